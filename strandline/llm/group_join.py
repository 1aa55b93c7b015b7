"""Set-similarity join on word shingles by grouped prefixes.

Every shingle's document count orders the shingles of a document, rarest first.  Two sets that are similar enough share
a shingle among the first n - ceil(t n) + 1 of each; a shingle of one document alone cannot be it and is left out.
Equal sets become one class; sets with equal prefix and size become one group, and groups are paired through the
shingles of their prefixes under bounds of size and place; members of a surviving pair are verified on their sets.
For components, members are first verified against one leader of each list, the one whose shingles are the commonest on
average: of an original and its edited copies that is the original.  Only sets that are still in different components are
paired, so that a large group of copies costs a link for each copy, not for each pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .exchange import Layout, answered, chunked, measure, per_chunk, questions, staged, with_answers
from .text import Texts, mix, ngram_hashes, pieces, prefix_sums, spans

_U = np.uint64
_SETS = "doc_id long, n_shingles long, rarity long, set_a long, set_b long, prefix_key long, tokens array<long>, places array<int>, shared array<long>"
_SETS_OUT = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("rarity", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("prefix_key", pa.int64()), ("tokens", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("shared", pa.list_(pa.int64()))])


def shingle_sets(texts: Texts, n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles, of the whole if it has fewer words; A-Z are lower-cased."""
    starts, stops, firsts = texts.words()
    hashes = texts.word_hashes(starts, stops, lower=True)
    grams, at = ngram_hashes(hashes, firsts, n)
    cut = np.searchsorted(at, firsts)
    sums = prefix_sums(hashes)
    out = []
    for k in range(texts.n):
        if cut[k] < cut[k + 1]:
            out.append(np.unique(grams[cut[k] : cut[k + 1]]))
        elif firsts[k] < firsts[k + 1]:
            out.append(spans(sums, firsts[k : k + 1], firsts[k + 1 : k + 2]))
        else:
            out.append(np.zeros(0, _U))
    return out


def _level(counts: np.ndarray) -> np.ndarray:
    """A byte that grows with the count: exact up to 128, then by quarters of a power of two."""
    return np.where(counts <= 128, counts, 128 + np.ceil(4 * np.log2(np.maximum(counts, 128) / 128))).clip(0, 255).astype(np.uint8)


def prefixed_sets(docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int, chunk_bytes: int) -> DataFrame:
    """Each document's size, set fingerprint, prefix (only shingles that others share) and shared shingles."""
    layout = Layout(docs.sparkSession, measure(docs, text), chunk_bytes)
    chunks = chunked(docs, doc_id, text, layout)
    bits, shift, bucket_bits = layout.filter_bits - 8, _U(64 - layout.filter_bits + 8), layout.bucket_bits

    def sets_of(table: pa.Table) -> list[np.ndarray]:
        return [s for _, t in pieces(table["text"]) for s in shingle_sets(t, shingle)]

    def ranked_keys(sets: list[np.ndarray]) -> np.ndarray:
        keys = np.concatenate([np.zeros(0, _U), *sets])
        keys >>= shift
        keys.sort()
        return keys

    def ask(chunk: int, table: pa.Table) -> pa.Table:
        sets = sets_of(table)
        keys = ranked_keys(sets)
        sets.clear()
        first = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.diff(first, append=len(keys))
        return questions(chunk, keys, bucket_bits, bits, counts.astype([("count", "<u4")]))

    def count(group: np.ndarray, extras: np.ndarray) -> np.ndarray:
        return _level(np.bincount(group, weights=extras["count"]))[group]

    reply = answered(per_chunk(chunks, ask), count, [("count", "<u4")])

    def prefixes(chunk: int, table: pa.Table, replies: list[np.ndarray]) -> pa.Table:
        sets, levels = sets_of(table), replies[0]
        keys = ranked_keys(sets)
        keys = keys[np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]])]
        out: dict[str, list] = {name: [] for name in _SETS_OUT.names}
        out["doc_id"] = table["doc_id"]
        for s in sets:
            n = len(s)
            a, b = mix(s ^ _U(0x5851F42D4C957F2D)), mix(s + _U(n))
            level = levels[np.searchsorted(keys, s >> shift)] if n else np.zeros(0, np.uint8)
            order = np.argsort(level, kind="stable")  # s is sorted: equal levels stay in the order of their hashes
            first = order[: n - (percent * n + 99) // 100 + 1] if n else order
            common = np.flatnonzero(level[first] > 1)
            ranked = s[first]
            out["n_shingles"].append(n)
            out["rarity"].append(-int(1000 * level.mean()) if n else 0)
            out["set_a"].append(int(a.sum().astype(np.int64)) if n else 0)
            out["set_b"].append(int(np.bitwise_xor.reduce(b).astype(np.int64)) if n else 0)
            out["prefix_key"].append(int((mix(ranked) * (2 * np.arange(len(ranked), dtype=_U) + _U(1))).sum().astype(np.int64)) if n else 0)
            out["tokens"].append(ranked[common].view(np.int64))
            out["places"].append(common.astype(np.int32))
            out["shared"].append(s[level > 1].view(np.int64) if len(common) else np.zeros(0, np.int64))
        return pa.table(out, schema=_SETS_OUT)

    return with_answers(chunks, [reply], prefixes, _SETS)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b), those whose sets have percent * union <= 100 * intersection."""
    one = sets.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("shared").alias("sb"))
    two = sets.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("shared").alias("sa"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(one, "b").join(two, "a").where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _could_match(na: str, nb: str, pa_: str, pb: str, percent: int) -> F.Column:
    """Bounds of size and place: sets that share their first common shingle at places pa, pb can have the overlap they need."""
    a, b = F.col(na), F.col(nb)
    least = F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent))
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (F.least(a - F.col(pa_), b - F.col(pb)) >= least)


#: A key of very many rows is joined in so many parts.
SALTS = 64
#: Rows of a list that one task pairs with others at once.
LIST = 256


def _salt(column: str) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(17), column), F.lit(SALTS)).cast("int")


def _with_group(rows: DataFrame, key: list[str], spread: str, **least: F.Column) -> DataFrame:
    """rows with the least of each expression over their key.  Values go back to a key's rows by parts, so that no task gets all of a key.

    spread: a column by whose hash a key's rows are parted.  A group is at most a row for each part, a part's a row for each key.
    """
    parted = rows.withColumn("_salt", _salt(spread))
    parts = parted.groupBy(*key, "_salt").agg(*(F.min(c).alias(n) for n, c in least.items()))
    whole = parts.groupBy(*key).agg(*(F.min(n).alias(n) for n in least), F.collect_set("_salt").alias("_salts"))
    return parted.join(whole.withColumn("_salt", F.explode("_salts")).drop("_salts"), [*key, "_salt"]).drop("_salt")


def _open_pairs(listed: DataFrame, key: str, percent: int) -> DataFrame:
    """Pairs of (group, component) that share a key, have unlike components and pass the bounds.

    Only lists whose rows are not all of one component are paired: each in blocks of LIST rows, and only with sizes of the
    same band or the next, so that a list of any length is many tasks.
    """
    band = F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("int")
    parts = listed.withColumn("_salt", _salt("group_id")).groupBy(key, "_salt").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("c"))
    mixed = parts.groupBy(key).agg(F.min("x").alias("x"), F.max("y").alias("y"), F.sum("c").alias("c"), F.collect_set("_salt").alias("_salts")).where("x < y")
    mixed = mixed.select(key, F.ceil(F.col("c") / LIST).cast("int").alias("blocks"), F.explode("_salts").alias("_salt"))
    rows = staged(listed.withColumn("_salt", _salt("group_id")).join(mixed, [key, "_salt"]).select(key, "blocks", "group_id", "n", "place", "comp", band.alias("band")))
    left, right = (rows.select(key, "blocks", "band", *(F.col(c).alias(f"{c}_{s}") for c in ("group_id", "n", "place", "comp"))) for s in "ab")
    left = left.withColumn("block", F.pmod(F.xxhash64("group_id_a", "comp_a"), F.col("blocks")).cast("int")).drop("blocks")
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    right = right.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    pairs = left.join(right, [key, "block", "band"]).where(F.col("comp_a") < F.col("comp_b")).where(_could_match("n_a", "n_b", "place_a", "place_b", percent))
    return pairs.select("group_id_a", "comp_a", "group_id_b", "comp_b")


def ngram_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, chunk_bytes: int = 4 << 20) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, class_id (least id with the same set), component_id.

    Two documents link when 100 * |A and B| >= percent * |A or B| for their sets of `shingle`-word shingles (A-Z lower-cased;
    a text with fewer words has its whole sequence as its one shingle).  component_id is the least id that links
    reach.  Null and empty texts have no shingles and link with nothing; rows of one id are one document to links; a row
    without an id keeps null for class and component.  Other columns are ignored.
    """
    sets = staged(prefixed_sets(docs, doc_id, text, shingle, percent, chunk_bytes))
    known = sets.where("doc_id IS NOT NULL AND n_shingles > 0")
    key = ["n_shingles", "set_a", "set_b"]
    light = known.select("doc_id", *key)
    classed = staged(_with_group(light, key, "doc_id", class_id=F.col("doc_id")))
    classes = classed.where("doc_id = class_id").distinct()
    # one row per distinct set that could have a partner
    nodes = known.where("size(tokens) > 0").join(classes.select("doc_id", *key), ["doc_id", *key], "left_semi").dropDuplicates(["doc_id", *key])
    nodes = staged(nodes.withColumn("group_id", F.xxhash64("n_shingles", "prefix_key")).select("doc_id", "n_shingles", "rarity", "group_id", "tokens", "places", "shared"))

    # postings of groups: one member stands for its group, as all have the same prefix and size
    members = _with_group(nodes.select("doc_id", "n_shingles", "rarity", "group_id"), ["group_id"], "doc_id", first=F.struct("rarity", "doc_id"))
    members = staged(members.withColumn("leader", F.col("first.doc_id")))
    leaders = members.where("doc_id = leader").select("doc_id")
    prefix = nodes.join(leaders, "doc_id", "left_semi").select("group_id", F.struct("rarity", F.col("doc_id").alias("id")).alias("leader"), F.col("n_shingles").alias("n"), F.explode(F.arrays_zip("tokens", "places")).alias("p"))
    postings = staged(prefix.select("group_id", "leader", "n", F.col("p.tokens").alias("token"), F.col("p.places").alias("place")))

    # leaders: of each group, and of each list of groups of about the same size
    of_group = members.select(F.col("leader").alias("a"), F.col("doc_id").alias("b"))
    banded = postings.select("token", F.floor(F.log("n") / F.log(F.lit(100 / percent))).alias("band"), "leader")
    of_list = _with_group(banded, ["token", "band"], "leader", first=F.col("leader")).select(F.col("first.id").alias("a"), F.col("leader.id").alias("b"))
    links = staged(_verified(of_group.unionAll(of_list).where("a <> b").distinct(), nodes, percent))

    # rows of one id with different sets are one document to links
    sets_of = F.struct(*key)
    several = light.groupBy("doc_id").agg(F.min(sets_of).alias("lo"), F.max(sets_of).alias("hi")).where("lo <> hi").select("doc_id")
    owned = classed.join(several, "doc_id", "left_semi").select("doc_id", "class_id").distinct()
    same = owned.join(owned.groupBy("doc_id").agg(F.min("class_id").alias("b")), "doc_id").select(F.col("class_id").alias("a"), "b").where("a <> b")
    parts = components(links)
    at = staged(members.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", "group_id", F.coalesce("component", "doc_id").alias("comp")))

    # the rest: groups that share a shingle of their prefixes and have members in different components
    placed = at.select("group_id", "comp", F.col("n_shingles").alias("n")).distinct()
    listed = postings.select("token", "group_id", "place").join(placed, "group_id")
    between = _open_pairs(listed, "token", percent)
    inside = _open_pairs(placed.withColumn("place", F.lit(0)).withColumn("group", F.col("group_id")), "group", percent)
    pairs = between.unionAll(inside).distinct()
    member_a = at.select(F.col("group_id").alias("group_id_a"), F.col("comp").alias("comp_a"), F.col("doc_id").alias("a"))
    member_b = at.select(F.col("group_id").alias("group_id_b"), F.col("comp").alias("comp_b"), F.col("doc_id").alias("b"))
    rest = pairs.join(member_a, ["group_id_a", "comp_a"]).join(member_b, ["group_id_b", "comp_b"]).select("a", "b").distinct()
    more = staged(_verified(rest, nodes, percent))
    final = components(links.unionAll(more).unionAll(same))

    # a class's component goes back to its rows by parts, too
    found = classes.select("class_id", *key).join(final.withColumnRenamed("node", "class_id"), "class_id").select(*key, F.col("component").alias("least"))
    rows = classed.select("doc_id", *key, "class_id", F.lit(None).cast("long").alias("least")).unionAll(found.select(F.lit(None).cast("long").alias("doc_id"), *key, F.lit(None).cast("long").alias("class_id"), "least"))
    rows = _with_group(rows, key, "doc_id", component=F.col("least")).where("doc_id IS NOT NULL")
    out = rows.select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    rest = sets.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return out.unionAll(rest)
