"""Shards by extendible hashing: a directory of hash prefixes in which only oversized buckets split on another bit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exchange import staged

#: Bits of the hash that a round reads: a directory node has at most 2 ** ROUND cells below it.
ROUND = 12
ROUNDS = 5


def _word(key: str, start: int, bits: int) -> F.Column:
    """`bits` bits of a column of 60 from bit `start` on, as a number."""
    return F.shiftrightunsigned(F.col(key), 60 - start - bits).bitwiseAND(F.lit((1 << bits) - 1))


def _leaves(cells: DataFrame, start: int, limit: int) -> DataFrame:
    """node, cell, depth of the leaf that holds a cell (null: the cell itself is oversized), and the leaf's bytes.

    cells: node, cell (ROUND bits) and n_bytes.  A leaf is the shortest prefix whose bytes fit, from the node itself on.
    """
    depths = F.explode(F.sequence(F.lit(0), F.lit(ROUND))).alias("d")
    spread = cells.select("node", "cell", "n_bytes", depths).withColumn("prefix", F.expr(f"shiftright(cell, {ROUND} - d)"))
    sums = spread.groupBy("node", "d", "prefix").agg(F.sum("n_bytes").alias("leaf_bytes")).where(F.col("leaf_bytes") <= limit)
    fits = spread.join(sums, ["node", "d", "prefix"]).groupBy("node", "cell").agg(F.min(F.struct("d", "leaf_bytes")).alias("leaf"))
    return cells.select("node", "cell").join(fits, ["node", "cell"], "left").select("node", "cell", (F.col("leaf.d") + start).alias("depth"), F.col("leaf.leaf_bytes").alias("leaf_bytes"))


def shard(docs: DataFrame, limit_bytes: int, doc_id: str = "doc_id", text: str = "text", prefix: str = "shard_") -> DataFrame:
    """docs with four more columns: shard_id (string), shard_depth, shard_bytes (long) and shard_part (int).

    A row's hash is the first 60 bits of md5 of its id and text; its size is its text's UTF-8 bytes.  The directory
    starts with one bucket; a bucket over limit_bytes splits on the next bit, until each fits.  shard_id is the leaf's
    bits ("" for the root).  Rows that all 60 bits can't part (equal id and text) are numbered and cut into shard_parts
    that fit; a text over limit_bytes stands alone in its shard, the only kind over the limit.  Null and empty texts have no
    bytes, a null id hashes as "".  Own columns of these four names are replaced.
    """
    if limit_bytes < 1:
        raise ValueError("limit_bytes is positive")
    names = {c: f"{prefix}{c}" for c in ("id", "depth", "bytes", "part")}
    kept = [c for c in docs.columns if c not in names.values()]
    body = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row")
    digest = F.md5(F.concat_ws("\x1f", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))))
    key = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    size = F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long")
    keyed = docs.select(key.alias("key"), size.alias("size"))
    sizes = staged(keyed.groupBy("key").agg(F.sum("size").alias("n_bytes"), F.count("*").alias("n"), F.max("size").alias("largest")))

    directory, rounds = None, 0
    open_ = sizes.withColumn("node", F.lit(0).cast("long"))
    for k in range(ROUNDS):
        rounds = k + 1
        cells = open_.withColumn("cell", _word("key", k * ROUND, ROUND)).groupBy("node", "cell").agg(F.sum("n_bytes").alias("n_bytes"))
        leaves = staged(_leaves(cells, k * ROUND, limit_bytes).withColumn("round", F.lit(k)))
        found = leaves.where("depth IS NOT NULL")
        directory = found if directory is None else directory.unionAll(found)
        over = leaves.where("depth IS NULL").select("node", "cell")
        if over.isEmpty():
            break
        below = open_.withColumn("cell", _word("key", k * ROUND, ROUND)).join(over, ["node", "cell"], "left_semi")
        if k == ROUNDS - 1:
            last = below.select(F.lit(k).alias("round"), "node", "cell", F.lit(60).alias("depth"), F.col("n_bytes").alias("leaf_bytes"))
            directory = directory.unionAll(last.select(*directory.columns))
        open_ = staged(below.select("key", "n_bytes", "n", "largest", F.shiftright("key", 60 - (k + 1) * ROUND).alias("node")))

    rows = docs.select(key.alias("key"), size.alias("size"), body)
    placed = _placed(rows, directory, rounds)
    out = placed.where(~((F.col("depth") == 60) & (F.col("leaf_bytes") > limit_bytes))).withColumn("part", F.lit(0)).withColumn("bytes", F.col("leaf_bytes"))
    if rounds == ROUNDS:
        # equal id and text: rows are alike but for their other columns; each distinct row is numbered once for all its copies
        heavy = placed.where((F.col("depth") == 60) & (F.col("leaf_bytes") > limit_bytes))
        alike = heavy.groupBy("key", "size", "depth", "leaf_bytes", "row").agg(F.count("*").alias("c"))
        before = F.sum("c").over(Window.partitionBy("key").orderBy(F.xxhash64(F.to_json("row"))).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")
        each = F.greatest(F.lit(1), F.floor(F.lit(limit_bytes) / F.nullif("size", F.lit(0))))
        numbered = alike.withColumn("before", before).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("c")))).withColumn("at", F.col("before") + F.col("k") - 1)
        numbered = numbered.withColumn("part", F.floor(F.col("at") / each).cast("int"))
        total = alike.groupBy("key").agg(F.sum("c").alias("total"))
        numbered = numbered.join(total, "key").withColumn("bytes", F.least(each, F.col("total") - F.col("part") * each) * F.col("size"))
        out = out.select("row", "key", "depth", "bytes", "part").unionAll(numbered.select("row", "key", "depth", "bytes", "part"))
    bits = F.substring(F.lpad(F.conv(F.col("key").cast("string"), 10, 2), 60, "0"), F.lit(1), F.col("depth").cast("int"))
    return out.select("row.*", bits.alias(names["id"]), F.col("depth").cast("long").alias(names["depth"]), F.col("bytes").cast("long").alias(names["bytes"]), F.col("part").cast("int").alias(names["part"]))


def _placed(rows: DataFrame, directory: DataFrame, rounds: int) -> DataFrame:
    """Each row with its leaf.  The last round's rows are found by an equal join on their cells, so are earlier rounds'."""
    out = None
    for k in range(rounds):
        here = directory.where(F.col("round") == k).select("node", "cell", "depth", "leaf_bytes")
        at = rows.withColumn("node", F.shiftright("key", 60 - k * ROUND) if k else F.lit(0).cast("long")).withColumn("cell", _word("key", k * ROUND, ROUND))
        found = at.join(here, ["node", "cell"]).select("key", "size", "row", "depth", "leaf_bytes")
        out = found if out is None else out.unionAll(found)
    return out
