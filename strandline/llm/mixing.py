"""A mix of sources with given weights, drawn as disjoint permuted blocks for output shards.

Targets come from the weights, but no source is repeated more than `repeats` times: what it can't take goes to the
others.  A source's documents are permuted and cut into blocks.  How many blocks of each source an output shard gets is
split down a binary tree of shards, each node dealing its blocks to its halves by a multivariate hypergeometric draw,
so that every shard is a fair sample of the mix and the counts add up exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exchange import staged

WORDS = "[^\\x20\\x09-\\x0D]+"


def word_count(text: str) -> F.Column:
    """Number of words of a text column; of nulls 0."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def target_words(sources: DataFrame, repeats: int) -> DataFrame:
    """source, weight, source_size and target for a table of one row per source, water-filled by sums over all sources.

    A source is filled up when the water level reaches limit / weight; sources in that order fill up until the level that
    serves the rest is under the next one's.
    """
    ratio = F.col("cap") / F.col("weight")
    order = Window.orderBy("ratio", "weight", F.col("source").asc_nulls_last())
    ranked = sources.where("source_size > 0").withColumn("cap", F.col("source_size") * F.lit(float(repeats))).withColumn("ratio", ratio)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("filled", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    ranked = ranked.withColumn("level", (F.col("total") - F.col("filled")) / F.col("rest"))
    # levels rise while sources fill up; the first whose own ratio is not under its level sets it for all later ones
    level = ranked.where(F.col("level") <= F.col("ratio")).agg(F.min_by("level", F.struct("ratio", "weight")).alias("final"))
    out = ranked.crossJoin(F.broadcast(level)).withColumn("target", F.least("cap", F.col("weight") * F.coalesce("final", F.col("ratio"))))
    empty = sources.where("source_size <= 0").withColumn("target", F.lit(0.0))
    columns = ["source", "weight", "source_size", "target"]
    return out.select(*columns).unionAll(empty.select(*columns))


def split_quotas(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """source_key, n (blocks of a source) dealt exactly to shards: source_key, shard, n.

    One level of the tree at a time; a node's draw is one group with a row for each source.
    """
    levels = max(0, (shards - 1).bit_length())
    nodes = blocks.select(F.lit(0).cast("long").alias("node"), "source_key", "n")

    def halves(level: int):
        def split(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("source_key", kind="stable")
            node, n = int(pdf["node"].iloc[0]), pdf["n"].to_numpy(np.int64)
            rng = np.random.default_rng([seed, level, node])
            total = int(n.sum())
            left = rng.multivariate_hypergeometric(n, _left(total, node, level, shards), method="marginals") if total else n
            out = [pd.DataFrame({"node": 2 * node + k, "source_key": pdf["source_key"], "n": part}) for k, part in ((0, left), (1, n - left))]
            return pd.concat(out)[lambda d: d["n"] > 0]

        return split

    for level in range(levels):
        nodes = nodes.groupBy("node").applyInPandas(halves(level), "node long, source_key long, n long")
    return nodes.select("source_key", F.col("node").alias("shard"), "n")


def _left(total: int, node: int, level: int, shards: int) -> int:
    """Blocks for the left half of a node: in proportion to the shards under it."""
    width = 1 << (max(0, (shards - 1).bit_length()) - level)
    first = node * width
    here = min(shards, first + width) - first
    left = min(shards, first + width // 2) - first
    return total if here <= left else round(total * left / here)


#: Blocks that one task orders; the blocks of a large source are ordered in such parts.
PART = 1 << 16


def _before(df: DataFrame, key: str, part: str, order: list[str], value: str, out: str) -> DataFrame:
    """df with out: the sum of value over the key's rows before each row, along part and then order.

    The sums of parts are added up first, so that a key of very many rows is one task for each part.
    """
    up_to = (Window.unboundedPreceding, Window.currentRow)
    sums = df.groupBy(key, part).agg(F.sum(value).alias("_s"))
    ahead = sums.select(key, part, (F.sum("_s").over(Window.partitionBy(key).orderBy(part).rowsBetween(*up_to)) - F.col("_s")).alias("_ahead"))
    inside = F.sum(value).over(Window.partitionBy(key, part).orderBy(*order).rowsBetween(*up_to)) - F.col(value)
    return df.join(ahead, [key, part]).withColumn(out, F.col("_ahead") + inside).drop("_ahead")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), repeats: int = 3, block_words: int = 100_000, shard_words: int = 4_000_000, seed: int = 11) -> DataFrame:
    """docs with one more struct column `mix`: size, source_size, target, copies and places, an array of (shard, position).

    Size is a text's number of words (null: 0).  Sources weigh weights[0], [1], ... by code point, null last, repeating,
    and share all words; none takes more than `repeats` times its own, the excess goes to the others by weight.  A
    source's blocks are each taken floor(target / size) times, and in the permuted order once more until the target is
    met, the last block in part; the error is at most about a document.  The tree deals all these block copies to shards
    of about shard_words, and a document is where its block's copies are dealt to: places, of which there are `copies`.
    To read the mix, explode places and sort by shard and position (see laid_out).  A document without words is never
    taken; equal rows are separate documents of equal fate; all other columns stay.
    """
    key, order = F.xxhash64(F.col(source).cast("string")), F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.col(text).cast("string"))
    rows = staged(docs.select(F.col(source).cast("string").alias("source"), word_count(text).alias("size"), order.alias("h")))
    sizes = staged(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    total = sizes.agg(F.sum("source_size").cast("double").alias("total"))
    ranked = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(by_code) - 1, F.lit(len(weights))) + 1).cast("int"))).crossJoin(F.broadcast(total))
    targets = target_words(ranked, repeats)
    targets = targets.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    targets = targets.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")).withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(block_words))))
    targets = staged(targets.withColumn("source_key", F.xxhash64("source")))

    def unit(h: F.Column) -> F.Column:
        return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))

    #: The block of a permuted document: an equal part of the range of hashes.
    block = F.floor(unit(F.col("h")) * F.col("n_blocks")).cast("long")

    # what each block holds, and how much of it the last round takes
    sized = rows.where("size > 0").withColumn("source_key", F.xxhash64("source")).join(targets.select("source_key", "n_blocks"), "source_key").withColumn("block", block)
    blocks = staged(sized.groupBy("source_key", "block").agg(F.sum("size").alias("words")).withColumn("part", F.floor(F.col("block") / PART)))
    blocks = _before(blocks, "source_key", "part", ["block"], "words", "before").join(targets.select("source_key", "full", "rest", "n_blocks"), "source_key")
    need = F.greatest(F.lit(0.0), F.least(F.col("rest") - F.col("before"), F.col("words").cast("double")))
    blocks = staged(blocks.select("source_key", "block", "n_blocks", "words", "full", need.alias("need")))

    # the last block of a source is taken in part: documents in permuted order while they fit, then the one that comes nearest
    part = blocks.where("need > 0 AND need < words").select("source_key", "block", "need")
    inside = sized.join(part, ["source_key", "block"]).groupBy("source_key", "block", "need", "h", "size").agg(F.count("*").alias("c"))
    up_to = Window.partitionBy("source_key", "block").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("upto", F.sum(F.col("size") * F.col("c")).over(up_to))
    gap = F.max(F.when(F.col("upto") <= F.col("need"), F.col("upto"))).over(Window.partitionBy("source_key", "block"))
    inside = inside.withColumn("gap", F.col("need") - F.coalesce(gap, F.lit(0.0)))
    closest = F.min_by("h", F.abs(F.col("gap") - F.col("size") * F.col("c")))
    late = inside.where("upto > need").groupBy("source_key", "block").agg(closest.alias("one"), F.min(F.abs(F.col("gap") - F.col("size") * F.col("c")) - F.col("gap")).alias("gain"))
    chosen = inside.where("upto <= need").select("source_key", "h").unionAll(late.where("gain < 0").select("source_key", F.col("one").alias("h"))).distinct().withColumn("chosen", F.lit(True))

    # a source's block copies in a permuted order, round by round; the tree deals the shards disjoint ranges of it
    rounds = F.col("full") + (F.col("need") > 0).cast("long")
    copies = blocks.where(rounds > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), rounds.cast("int"))))
    turn = F.xxhash64(F.lit(seed), "block", "copy")
    parts = F.ceil(F.col("n_blocks") / F.lit(PART))
    copies = copies.withColumn("turn", turn).withColumn("part", F.col("copy") * parts + F.floor(unit(F.col("turn")) * parts)).withColumn("one", F.lit(1).cast("long"))
    copies = _before(copies, "source_key", "part", ["turn", "block"], "one", "at")
    shards = total.select(F.greatest(F.lit(1), F.ceil(F.coalesce("total", F.lit(0.0)) / F.lit(float(shard_words))))).first()[0]
    quotas = split_quotas(blocks.groupBy("source_key").agg(F.sum(rounds).cast("long").alias("n")).where("n > 0"), int(shards), seed)
    line = Window.partitionBy("source_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    quotas = quotas.withColumn("stop", F.sum("n").over(line)).select("source_key", F.col("shard").cast("int").alias("shard"), F.explode(F.sequence(F.col("stop") - F.col("n"), F.col("stop") - 1)).alias("at"))
    in_part = (F.col("copy") > F.col("full")) & (F.col("need") < F.col("words"))
    deal = F.struct("copy", "shard", in_part.alias("in_part"))
    deals = staged(copies.join(quotas, ["source_key", "at"]).groupBy("source_key", "block").agg(F.sort_array(F.collect_list(deal)).alias("deals")))

    kept = [c for c in docs.columns if c != "mix"]
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), key.alias("source_key"), word_count(text).alias("size"), order.alias("h"))
    out = out.join(targets.select("source_key", "n_blocks", "source_size", "target"), "source_key").withColumn("block", F.when(F.col("size") > 0, block))
    out = out.join(deals, ["source_key", "block"], "left").join(chosen, ["source_key", "h"], "left")
    mine = F.filter(F.coalesce("deals", F.array().cast("array<struct<copy:int,shard:int,in_part:boolean>>")), lambda d: ~d.in_part | F.coalesce("chosen", F.lit(False)))
    out = out.withColumn("places", F.transform(mine, lambda d: F.struct(d.shard.alias("shard"), F.xxhash64(F.lit(seed), F.col("h"), d.copy).alias("position"))))
    return out.select("row.*", F.struct("size", "source_size", "target", F.size("places").alias("copies"), "places").alias("mix"))


def laid_out(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each place of mix()'s rows, those of a shard together and in the order of their positions; `mix` goes.

    A shard is one task's rows: about shard_words words, whatever the corpus.
    """
    placed = mixed.withColumn("_place", F.explode("mix.places"))
    return placed.repartition(F.col("_place.shard")).sortWithinPartitions("_place").drop("_place", "mix")
