"""Path signatures: level one and two as plain sums, higher levels by Chen's identity over chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import paths
from . import slabs


def signature(df: DataFrame, keys: list[str], order: list[str], channels: list[str], level: int = 2, parts: int | None = None) -> DataFrame:
    """keys, term ('' is the leading 1, '1', '1,2', ... by channel number) and value, of the piecewise-linear path along order.

    Level two: S(i, j) = sum (X_i before - X_i first) dX_j + dX_i dX_j / 2, sums that combine on the map side.  A path of more
    rows than a task may hold (slabs.parts_for), and always the one path of a table without keys, is cut into ranges: each begins
    with the last point before it, and their signatures are multiplied in order (Chen).
    """
    if not keys:
        return signature(df.withColumn("_all", F.lit(0)), ["_all"], order, channels, level, PARTS if parts is None else parts).drop("_all")
    parts = slabs.parts_for(df, keys, parts)
    of = _low if level <= 2 else _chunked
    if not parts:
        return of(df, keys, order, channels, level).select(*keys, "term", "value")
    rows = slabs.with_halo(df.select(*keys, *order, *(c for c in channels if c not in order)), keys, order, parts, 1)
    each = of(rows, ["_range", *keys], order, channels, level)
    names = [",".join(map(str, x)) for x in paths.words(len(channels), level)]
    slab = each.groupBy("_range", *keys).agg(F.map_from_entries(F.collect_list(F.struct("term", "value"))).alias("_m"))
    slab = slab.select("_range", *keys, F.array(*(F.col("_m")[t] for t in names)).alias("_v"))
    # a tree of two levels: ranges of a block of them, then blocks
    for block in (F.floor(F.col("_range") / 64), F.lit(0)):
        lists = slab.groupBy(block.alias("_b"), *keys).agg(F.sort_array(F.collect_list(F.struct("_range", "_v"))).alias("_s"))
        slab = lists.select(F.col("_b").alias("_range"), *keys, _product(len(channels), level)(F.transform("_s", lambda s: s["_v"])).alias("_v"))
    return slab.select(*keys, F.posexplode("_v")).select(*keys, F.element_at(F.array(*map(F.lit, names)), F.col("pos") + 1).alias("term"), F.col("col").alias("value"))


#: Ranges of the one path of a table without keys.
PARTS = 64


def _product(n: int, level: int):
    """Column function: signatures (flat arrays) multiplied in order."""

    def levels(flat) -> list[np.ndarray]:
        cut = np.cumsum([0, *(n**k for k in range(level + 1))])
        return [np.asarray(flat[a:b], float).reshape((n,) * k) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]

    @F.pandas_udf("array<double>")
    def product(parts: pd.Series) -> pd.Series:
        def one(all_):
            out = levels(all_[0])
            for x in all_[1:]:
                out = paths.chen(out, levels(x))
            return np.concatenate([np.ravel(x) for x in out])

        return pd.Series([one(x) for x in parts])

    return product


def _low(df: DataFrame, keys: list[str], order: list[str], channels: list[str], level: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    n = len(channels)
    x = [F.col(c).cast("double") for c in channels]
    rows = df.select(*keys, *(F.lag(v).over(w).alias(f"_p{k}") for k, v in enumerate(x)), *(v.alias(f"_x{k}") for k, v in enumerate(x)), *(F.first(v).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_f{k}") for k, v in enumerate(x)))
    step = [F.coalesce(F.col(f"_x{k}") - F.col(f"_p{k}"), F.lit(0.0)) for k in range(n)]
    past = [F.coalesce(F.col(f"_p{k}") - F.col(f"_f{k}"), F.lit(0.0)) for k in range(n)]
    terms = {"": F.max(F.lit(1.0))} | {str(k + 1): F.sum(step[k]) for k in range(n)}
    if level == 2:
        terms |= {f"{i + 1},{j + 1}": F.sum(past[i] * step[j] + step[i] * step[j] / 2) for i in range(n) for j in range(n)}
    one = rows.groupBy(*keys).agg(*(a.alias(f"_t{k}") for k, a in enumerate(terms.values())))
    return one.select(*keys, F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"_t{k}").alias("value")) for k, t in enumerate(terms)))).alias("s")).select(*keys, "s.*")


def _chunked(df: DataFrame, keys: list[str], order: list[str], channels: list[str], level: int, size: int = 4096) -> DataFrame:
    """Signatures of chunks of a path (each with the first point of the next), multiplied in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    point = F.array(*(F.col(c).cast("double") for c in channels))
    rows = df.select(*keys, F.row_number().over(w).alias("_n"), point.alias("_x")).withColumn("_q", F.lead("_x").over(Window.partitionBy(*keys).orderBy("_n")))
    rows = rows.withColumn("_c", F.floor((F.col("_n") - 1) / size)).groupBy(*keys, "_c").agg(F.sort_array(F.collect_list(F.struct("_n", "_x", "_q"))).alias("_s"))
    n = len(channels)

    @F.pandas_udf("array<double>")
    def of_chunk(points: pd.Series, end: pd.Series) -> pd.Series:
        def one(p, q):
            path = [np.array(x, float) for x in p] + ([np.array(q, float)] if q is not None else [])
            return paths.signature(np.stack(path), level)

        return pd.Series([one(p, q) for p, q in zip(points, end, strict=True)])

    rows = rows.withColumn("_v", of_chunk(F.transform("_s", lambda s: s["_x"]), F.element_at("_s", -1)["_q"]))
    chunks = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_c", "_v"))).alias("_s"))
    names = [",".join(map(str, x)) for x in paths.words(n, level)]

    out = chunks.select(*keys, _product(n, level)(F.transform("_s", lambda s: s["_v"])).alias("_v"))
    return out.select(*keys, F.posexplode("_v")).select(*keys, F.element_at(F.array(*map(F.lit, names)), F.col("pos") + 1).alias("term"), F.col("col").alias("value"))


def signature_distance(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys and distance: Euclidean distance of two signatures, over their common terms."""
    both = a.select(*keys, "term", F.col("value").alias("_a")).join(b.select(*keys, "term", F.col("value").alias("_b")), [*keys, "term"])
    return both.groupBy(*keys).agg(F.sqrt(F.sum((F.col("_a") - F.col("_b")) ** 2)).alias("distance"))


def cross_terms(df: DataFrame, series: str, order: str, value: str, threshold: float = 0.05) -> DataFrame:
    """source, target, term: ordered pairs of series whose joint path has S(1, 2) over threshold; pairs share their times."""
    a, b = (df.select(F.col(order).alias("t"), F.col(series).alias(s), F.col(value).alias(v)) for s, v in (("source", "x"), ("target", "y")))
    pairs = a.join(b, "t").where("source <> target")
    two = signature(pairs, ["source", "target"], ["t"], ["x", "y"], 2).where("term = '1,2'")
    return two.where(F.col("value") > threshold).select("source", "target", F.col("value").alias("weight"))
