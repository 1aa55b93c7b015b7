"""The trie of conversations' first turns: nodes are distinct sequences of first turns, from one ROLLUP over columns of turn ids.

A conversation is cut into blocks of WIDTH turns, a row each, with the turns' ids in the columns t1, t2, ...  GROUP BY the
node that the block starts from, ROLLUP(t1, ..., t8) gives all prefixes that end in any block at once: a long conversation goes on
in further rows of the same columns, keyed by the node before them, not in further rounds.

A node's key is a sum, mod 2**32 in four parts, of hashes of (place, turn), so the keys of all blocks of a conversation come
from running sums, cut into slabs of blocks: no task gets a long conversation whole.  Turns and nodes are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import ranged
from .exchange import staged

WIDTH = 8
#: Blocks in a slab of a conversation.
SLAB = 512
#: Ids in one string of those that are hashed together.
RUN = 1024
_PARTS = 4
_EMPTY = hashlib.sha256(b"").hexdigest()
WORDS = r"[^\x20\x09-\x0D]+"


def numbered(said: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place (1, 2, ...), role, text of each row, by turn, null first.

    Ties are ordered by role, then text; repeated rows stay turns of their own; null role or text is empty.  Rows without
    a conv_id belong to no conversation and are left out.  Rows are cut into ranges and numbered from each range's offset.
    """
    rows = said.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    rows = ranged(rows.where("conv_id IS NOT NULL").withColumn("_head", F.left("text", F.lit(40))), ["conv_id", "turn", "role", "_head"])
    each = rows.groupBy("conv_id", "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_range")) - F.col("_n")
    # only the first conversation of a range can have begun before it: a row for each range at most
    begun = F.broadcast(each.select("conv_id", "_range", before.alias("_before")).where("_before > 0"))
    within = F.row_number().over(Window.partitionBy("_range", "conv_id").orderBy("turn", "role", "text"))
    rows = rows.withColumn("place", within.cast("long")).join(begun, ["conv_id", "_range"], "left")
    return rows.select("conv_id", (F.col("place") + F.coalesce("_before", F.lit(0))).alias("place"), "role", "text")


def turn_ids(turns: DataFrame) -> DataFrame:
    """conv_id, place, turn_id (128 bits of role and text), n_words of numbered turns."""
    own = F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    return turns.select("conv_id", "place", F.unhex(own).alias("turn_id"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("n_words"))


def rebuilt(turns: DataFrame, family: int = 20, most: int = 3) -> DataFrame:
    """conv_id, place, turn_id, n_words, n_turns: each conversation c after the first h turns of conversation c - c % family.

    h = crc32(c) % (most + 1); c's own first h turns give way.  turns: what turn_ids() gives.  A conversation that is left
    without turns has one row, with a null place and n_turns 0.
    """
    fields = F.struct("place", "turn_id", "n_words")
    heads = turns.where((F.col("place") <= most) & (F.col("conv_id") % family == 0)).groupBy(F.col("conv_id").alias("_base")).agg(F.sort_array(F.collect_list(fields)).alias("_head"))
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("_n")).withColumn("_h", F.crc32(F.col("conv_id").cast("string")) % (most + 1)).withColumn("_base", F.col("conv_id") - F.col("conv_id") % family)
    convs = convs.join(heads, "_base", "left").withColumn("_head", F.slice(F.coalesce("_head", F.array().cast("array<struct<place:long,turn_id:binary,n_words:long>>")), F.lit(1), F.col("_h").cast("int")))
    convs = convs.withColumn("_first", F.size("_head")).withColumn("n_turns", F.col("_first") + F.greatest(F.col("_n") - F.col("_h"), F.lit(0)))
    first = convs.select("conv_id", "n_turns", F.explode_outer("_head").alias("t")).where("t IS NOT NULL OR n_turns = 0").select("conv_id", "t.*", "n_turns")
    own = turns.join(convs.select("conv_id", "_h", "_first", "n_turns"), "conv_id").where("place > _h")
    return first.unionByName(own.select("conv_id", (F.col("place") - F.col("_h") + F.col("_first")).alias("place"), "turn_id", "n_words", "n_turns"))


def _key(parts: list[Column]) -> Column:
    return F.concat(*(F.lpad(F.hex(F.pmod(p, F.lit(1 << 32))), 8, "0") for p in parts))


def _sums(rows: DataFrame, columns: list[str], later: bool = False) -> DataFrame:
    """Of each column c, before_c: its sum over a conversation's earlier (or later) blocks, by slab and then by block."""
    rows = rows.withColumn("_slab", F.floor(F.col("block") / SLAB))
    order = lambda c: F.col(c).desc() if later else F.col(c).asc()
    past = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    slabs = rows.groupBy("conv_id", "_slab").agg(*(F.sum(c).alias(c) for c in columns))
    by_slab = Window.partitionBy("conv_id").orderBy(order("_slab"))
    slabs = slabs.select("conv_id", "_slab", *(past(c, by_slab).alias(f"_{c}") for c in columns), F.row_number().over(by_slab).alias("_k")).where("_k > 1").drop("_k")
    within = Window.partitionBy("conv_id", "_slab").orderBy(order("block"))
    rows = rows.withColumns({f"before_{c}": past(c, within) for c in columns}).join(slabs, ["conv_id", "_slab"], "left")
    return rows.withColumns({f"before_{c}": F.col(f"before_{c}") + F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in columns}).drop("_slab", *(f"_{c}" for c in columns))


def _blocks(turns: DataFrame) -> DataFrame:
    """conv_id, block, n_turns, prior (the key of the node before), keys, words, t1 .. t8: a row for each WIDTH turns."""
    turns = turns.withColumn("block", F.coalesce(F.floor((F.col("place") - 1) / WIDTH), F.lit(0)).cast("long"))
    known = F.when(F.col("place").isNotNull(), F.struct("place", "turn_id", "n_words"))
    rows = turns.groupBy("conv_id", "block").agg(F.max("n_turns").alias("n_turns"), F.sort_array(F.collect_list(known)).alias("t"))
    digest = lambda t: F.md5(F.concat(F.encode(t.place.cast("string"), "UTF-8"), t.turn_id))
    rows = rows.withColumn("_d", F.transform("t", digest))
    part = lambda d, k: F.conv(F.substring(d, 8 * k + 1, 8), 16, 10).cast("long")
    total = lambda ds, k: F.aggregate(ds, F.lit(0).cast("long"), lambda a, d: a + part(d, k))
    names = [f"p{k}" for k in range(_PARTS)]
    rows = _sums(rows.withColumns({n: total(F.col("_d"), k) for k, n in enumerate(names)}), names)
    prior = [F.col(f"before_{n}") for n in names]
    keys = F.transform(F.sequence(F.lit(1), F.size("t")), lambda k: _key([p + total(F.slice("_d", 1, k), i) for i, p in enumerate(prior)]))
    ids = [F.get("t", F.lit(k)).turn_id.alias(f"t{k + 1}") for k in range(WIDTH)]
    none = F.array().cast("array<string>")
    return rows.select("conv_id", "block", "n_turns", _key(prior).alias("prior"), F.when(F.size("t") > 0, keys).otherwise(none).alias("keys"), F.transform("t", lambda t: t.n_words).alias("words"), *ids)


def _rolled(blocks: DataFrame, aggregates: str, columns: str) -> DataFrame:
    """columns of the nodes of all blocks; level: how many of t1 .. t8 a node is grouped by, 0 for the root alone."""
    ids = ", ".join(f"t{k + 1}" for k in range(WIDTH))
    return blocks.sparkSession.sql(
        f"""SELECT {columns} FROM (
          SELECT block, prior, {WIDTH} - bit_count(grouping_id()) AS level, any_value(keys) AS keys, max(size(keys)) AS longest, {aggregates}
          FROM {{blocks}} GROUP BY block, prior, ROLLUP({ids}))
        WHERE longest >= level AND (level > 0 OR block = 0)""",
        blocks=blocks,
    )


def _ends(blocks: DataFrame) -> DataFrame:
    """node, ends_sha256 of the conversations that end at a node: ids in runs of RUN, hashed run by run in one sorted stream."""
    last = blocks.where(F.col("block") * WIDTH + F.size("keys") == F.col("n_turns")).select(F.when(F.size("keys") > 0, F.element_at("keys", -1)).otherwise(F.col("prior")).alias("node"), "conv_id")
    runs = last.groupBy("node", F.floor(F.col("conv_id") / RUN).alias("run")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch["node"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if key != node:
                    if state:
                        done.append((node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], ["node", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (node, state.hexdigest())], ["node", "ends_sha256"])

    return runs.repartition("node").sortWithinPartitions("node", "run").mapInArrow(digests, "node string, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """node, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, a row for each node.

    turns: conv_id, place, turn_id, n_words, n_turns, as of rebuilt(); a turnless conversation is a row without a place.
    conv_id is a node's smallest member; a subtree's sums are those of all members from the node's depth on, as each
    node below is counted with its own smallest member, which is one of them.  No conversations, no nodes.
    """
    blocks = staged(_blocks(turns))
    at = "element_at(keys, level)"
    nodes = staged(
        _rolled(
            blocks,
            "min(conv_id) AS conv_id, count(*) AS n_convs, max(n_turns) AS most, any_value(words) AS words",
            f"""if(level = 0, prior, try_{at}) AS node, CASE level WHEN 0 THEN NULL WHEN 1 THEN prior ELSE try_element_at(keys, level - 1) END AS parent,
            conv_id, block * {WIDTH} + level AS depth, n_convs, CAST(most = block * {WIDTH} + level AS LONG) AS leaf, if(level = 0, 0, (n_convs - 1) * try_element_at(words, level)) AS saved""",
        )
    )
    own = nodes.where("depth > 0").groupBy("conv_id", F.floor((F.col("depth") - 1) / WIDTH).alias("block")).agg(F.collect_list(F.struct("depth", "leaf", "saved")).alias("own"))
    rows = blocks.join(own, ["conv_id", "block"], "left").withColumn("own", F.coalesce("own", F.array().cast("array<struct<depth:long,leaf:long,saved:long>>")))
    added = lambda own, c: F.aggregate(own, F.lit(0).cast("long"), lambda a, v: a + v[c])
    rows = _sums(rows.withColumns({c: added(F.col("own"), c) for c in ("leaf", "saved")}), ["leaf", "saved"], later=True)
    rest = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size("keys"), F.lit(1))), lambda k: F.col(f"before_{c}") + added(F.filter("own", lambda v: v.depth >= F.col("block") * WIDTH + k), c))
    rows = rows.select("block", "prior", "keys", *(f"t{k + 1}" for k in range(WIDTH)), rest("leaf").alias("leaves"), rest("saved").alias("saved"))
    listed = lambda c: "array(" + ", ".join(f"sum(get({c}, {k}))" for k in range(WIDTH)) + f") AS {c}"
    sums = _rolled(rows, f"{listed('leaves')}, {listed('saved')}", f"if(level = 0, prior, try_{at}) AS node, element_at(leaves, greatest(level, 1)) AS n_below, element_at(saved, greatest(level, 1)) AS saved_tokens")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    out = nodes.drop("saved").join(sums, "node").join(children, "node", "left").join(_ends(blocks), "node", "left")
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    zero = F.lit(0).cast("long")
    alone = F.when(F.col("depth") == 0, F.col("leaf")).otherwise(zero)  # a root without turns is a leaf itself
    return out.join(parents, "parent", "left").select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), (F.col("n_below") + alone).alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))


def with_last_turn(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of prefix_trie() with role and text of their last turn, null at the root; turns: conv_id, place, role, text of the same conversations."""
    said = turns.select("conv_id", F.col("place").alias("depth"), "role", "text")
    return nodes.join(said, ["conv_id", "depth"], "left")


def conversation_trie(said: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """prefix_trie() of conversations as they are, with role and text of each node's last turn.  Nulls, ties and repeated rows: see numbered()."""
    turns = staged(numbered(said, conv_id, turn, role, text))
    ids = turn_ids(turns).withColumn("n_turns", F.lit(None).cast("long"))
    length = ids.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    return with_last_turn(prefix_trie(ids.drop("n_turns").join(length, "conv_id")), turns)
