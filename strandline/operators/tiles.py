"""Alignments of pairs of long series: the matrix of costs in tiles, whose borders are handed on from round to round.

Tiles of one anti-diagonal don't need each other, so a round is a job over all tiles of its diagonal and all pairs; a task holds one
tile and its borders.  Paths that move by one column a row go down in bands of rows instead, each block of columns with its neighbours.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import paths
from ..sources import kept
from . import slabs

#: Rows and columns of a tile; series of at most as many rows are aligned whole.
TILE = 8192

PAIR = ["a", "b", "lag"]
_FLOATS = "array<double>"


def longest(df: DataFrame, series: str) -> int:
    return df.groupBy(series).count().agg(F.max("count").alias("n")).first()["n"] or 0


def chunks(df: DataFrame, series: str, order: str, value: str, lags: list[int], tile: int) -> tuple[DataFrame, DataFrame]:
    """Chunks of both series of each pair a < b and lag, x(t) beside y(t + lag): a, b, lag, i, x, n and a, b, lag, j, y, m."""
    rows = slabs.numbered(df.select(F.col(series).alias("s"), order, F.col(value).cast("double").alias("v")), ["s"], [order], "at")
    sizes = rows.groupBy("s").agg(F.count("*").alias("size"))
    names = sizes.select(F.col("s").alias("a"), F.col("size").alias("na"))
    pairs = names.join(sizes.select(F.col("s").alias("b"), F.col("size").alias("nb")), F.col("a") < F.col("b"))
    pairs = pairs.withColumn("lag", F.explode(F.array(*map(F.lit, lags))))
    # a lag takes rows off the start of one series and off the end of the other
    skip_x, skip_y = F.greatest(-F.col("lag"), F.lit(0)), F.greatest("lag", F.lit(0))
    pairs = pairs.withColumns({"skip_x": skip_x, "skip_y": skip_y, "n": F.col("na") - F.abs("lag"), "m": F.col("nb") - F.abs("lag")}).where("n > 0 AND m > 0")
    out = []
    for name, size, skip, place, values in (("a", "n", "skip_x", "i", "x"), ("b", "m", "skip_y", "j", "y")):
        mine = rows.withColumnRenamed("s", name).join(pairs.select(*PAIR, size, skip), name).withColumn("p", F.col("at") - F.col(skip)).where((F.col("p") >= 0) & (F.col("p") < F.col(size)))
        cut = mine.groupBy(*PAIR, F.floor(F.col("p") / tile).alias(place), size).agg(F.sort_array(F.collect_list(F.struct("p", "v"))).alias("c"))
        out.append(cut.select(*PAIR, place, F.transform("c", lambda r: r["v"]).alias(values), size))
    return out[0], out[1]


def walked(x: DataFrame, y: DataFrame, tile: int, f: Callable[..., tuple], extra: str) -> DataFrame:
    """a, b, lag, i, j and the fields of extra for every tile.  f(x, y, top, left, corner, i, j, n, m) gives bottom, right and the extra fields.

    top, left: the borders that the tiles above and to the left have left behind, None at the matrix' edges; corner: what
    lies above left and left of top, None at edges.
    """
    ends = x.groupBy(*PAIR).agg(F.max("i").alias("last_i"), F.first("n").alias("n")).join(y.groupBy(*PAIR).agg(F.max("j").alias("last_j"), F.first("m").alias("m")), PAIR)
    ends = kept(ends)
    names = [c.split(":")[0] for c in extra.split(",")]

    @F.pandas_udf(f"struct<bottom:{_FLOATS},right:{_FLOATS},corner_on:double,{extra}>")
    def run(x: pd.Series, y: pd.Series, top: pd.Series, left: pd.Series, corner: pd.Series, i: pd.Series, j: pd.Series, n: pd.Series, m: pd.Series) -> pd.DataFrame:
        arrays = lambda v: None if v is None else np.array(v, float)
        out = []
        for a, b, t, left_, c, p, q, n_, m_ in zip(x, y, top, left, corner, i, j, n, m, strict=True):
            side = arrays(left_)
            bottom, right, *more = f(arrays(a), arrays(b), arrays(t), side, None if c is None or np.isnan(c) else float(c), int(p), int(q), int(n_), int(m_))
            out.append((bottom, right, np.nan if side is None else side[-1], *more))
        return pd.DataFrame(out, columns=["bottom", "right", "corner_on", *names])

    rounds = ends.agg(F.max(F.col("last_i") + F.col("last_j")).alias("r")).first()["r"]
    state, out = None, None
    for _ in range((rounds if rounds is not None else -1) + 1):
        if state is None:
            start = ends.select(*PAIR, F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(None).cast(_FLOATS).alias("top"), F.lit(None).cast(_FLOATS).alias("left"), F.lit(None).cast("double").alias("corner"))
        else:
            none = lambda kind: F.lit(None).cast(kind)
            down = state.where("i < last_i").select(*PAIR, (F.col("i") + 1).alias("i"), "j", F.col("bottom").alias("top"), none(_FLOATS).alias("left"), F.col("corner_on").alias("corner"))
            right = state.where("j < last_j").select(*PAIR, "i", (F.col("j") + 1).alias("j"), none(_FLOATS).alias("top"), F.col("right").alias("left"), none("double").alias("corner"))
            start = down.unionByName(right).groupBy(*PAIR, "i", "j").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("top", "left", "corner")))
        rows = start.join(ends, PAIR).join(x.drop("n"), [*PAIR, "i"]).join(y.drop("m"), [*PAIR, "j"])
        rows = rows.withColumn("r", run("x", "y", "top", "left", "corner", "i", "j", "n", "m"))
        state = kept(rows.select(*PAIR, "i", "j", "last_i", "last_j", "r.*"))
        done = state.select(*PAIR, "i", "j", (F.col("i") == F.col("last_i")).alias("end_i"), (F.col("j") == F.col("last_j")).alias("end_j"), *names)
        out = done if out is None else out.unionByName(done)
    return out


def dtw(df: DataFrame, series: str, order: str, value: str, lags: list[int], squared: bool = False, band: int | None = None, tile: int = TILE) -> DataFrame:
    """a, b, lag, score: paths.dtw of each pair and lag, tile by tile."""
    x, y = chunks(df, series, order, value, lags, tile)

    def f(a, b, top, left, corner, i, j, n, m):
        return paths.dtw_tile(a, b, top, left, corner, i * tile, j * tile, n, m, squared, band)

    tiles = walked(x, y, tile, f, "score:double")
    score = F.sqrt("score") if squared else F.col("score")
    if tiles is None:
        return x.select(*PAIR, F.lit(None).cast("double").alias("score")).limit(0)
    return tiles.where("end_i AND end_j").select(*PAIR, score.alias("score"))


def thermal(df: DataFrame, series: str, order: str, value: str, temperature: float = 1.0, tile: int = TILE) -> DataFrame:
    """a, b, t (an anti-diagonal), average (mean of b - a on it) and, on the last one, log_final: paths.thermal_path, a row for each diagonal."""
    x, y = chunks(df, series, order, value, [0], tile)
    both = x.groupBy(*PAIR).agg(F.first("n").alias("n")).join(y.groupBy(*PAIR).agg(F.first("m").alias("m")), PAIR).select(*PAIR, F.least("n", "m").alias("k"))
    cut = lambda d, place, v, size: d.join(both, PAIR).where(F.col(place) * tile < F.col("k")).withColumn(v, F.slice(v, F.lit(1), F.least(F.lit(tile), F.col("k") - F.col(place) * tile).cast("int"))).withColumn(size, F.col("k")).drop("k")

    def f(a, b, top, left, corner, i, j, n, m):
        return paths.thermal_tile(a, b, top, left, corner, i * tile, j * tile, temperature)

    tiles = walked(cut(x, "i", "x", "n"), cut(y, "j", "y", "m"), tile, f, "first:long,peak:array<double>,weight:array<double>,moment:array<double>,last:double")
    if tiles is None:
        return x.select("a", "b", F.lit(0).cast("long").alias("t"), F.lit(None).cast("double").alias("average"), F.lit(None).cast("double").alias("log_final")).limit(0)
    lines = tiles.select("a", "b", "first", F.posexplode(F.arrays_zip("peak", "weight", "moment")).alias("k", "z"), F.when(F.col("end_i") & F.col("end_j"), F.col("last")).alias("last"))
    lines = lines.select("a", "b", (F.col("first") + F.col("k")).alias("t"), "z.*", "last")
    # weights of a diagonal's tiles are relative to each tile's peak
    top = lines.groupBy("a", "b", "t").agg(F.max("peak").alias("top"))
    share = F.exp(F.col("peak") - F.col("top"))
    sums = lines.join(top, ["a", "b", "t"]).groupBy("a", "b", "t").agg(F.sum(share * F.col("moment")).alias("moment"), F.sum(share * F.col("weight")).alias("weight"), F.max("last").alias("last"))
    end = sums.groupBy("a", "b").agg(F.max("t").alias("t")).withColumn("_end", F.lit(True))
    out = sums.join(end, ["a", "b", "t"], "left")
    return out.select("a", "b", "t", F.try_divide("moment", "weight").alias("average"), F.when(F.col("_end"), F.col("last")).alias("log_final"))


def optimal(df: DataFrame, series: str, order: str, value: str, beta: float = 1.0, tile: int = TILE) -> DataFrame:
    """a, b, mean_step (mean of j - i along the path), cost: paths.optimal_path without its path, a band of `tile` rows each round.

    A column's state is the least cost of a path that is in it and the sum of the columns that path was in; what a block of
    columns gets in a band comes from itself and the blocks beside it.
    """
    x, y = chunks(df, series, order, value, [0], tile)
    near = y.select(*PAIR, "m", F.explode(F.array(F.col("j") - 1, "j", F.col("j") + 1)).alias("block"), "j", "y").where(f"block >= 0 AND block * {tile} < m")
    wide = kept(near.groupBy(*PAIR, "block", "m").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "y"))), lambda r: r["y"]).alias("ys")))
    kind = f"struct<cost:{_FLOATS},total:{_FLOATS}>"

    @F.pandas_udf(kind)
    def band(x: pd.Series, ys: pd.Series, costs: pd.Series, totals: pd.Series, block: pd.Series) -> pd.DataFrame:
        out = []
        for a, parts, c, t, k in zip(x, ys, costs, totals, block, strict=True):
            columns = np.concatenate([np.array(p, float) for p in parts])
            first = max(int(k) - 1, 0) * tile
            given = None if c is None else (np.concatenate([np.array(p, float) for p in c]), np.concatenate([np.array(p, float) for p in t]))
            cost, total = paths.path_band(np.array(a, float), columns, first, given, beta)
            own = slice(int(k) * tile - first, int(k) * tile - first + tile)
            out.append((cost[own], total[own]))
        return pd.DataFrame(out, columns=["cost", "total"])

    rounds = x.agg(F.max("i").alias("r")).first()["r"]
    state = None
    ended = None
    for i in range((rounds if rounds is not None else -1) + 1):
        rows = wide.join(x.where(F.col("i") == i).select(*PAIR, "x", "n"), PAIR)
        if state is None:
            rows = rows.withColumns({"costs": F.lit(None).cast(f"array<{_FLOATS}>"), "totals": F.lit(None).cast(f"array<{_FLOATS}>")})
        else:
            beside = state.select(*PAIR, F.explode(F.array(F.col("block") - 1, "block", F.col("block") + 1)).alias("to"), "block", "cost", "total")
            given = beside.groupBy(*PAIR, F.col("to").alias("block")).agg(F.sort_array(F.collect_list(F.struct("block", "cost", "total"))).alias("g"))
            rows = rows.join(given.select(*PAIR, "block", F.transform("g", lambda r: r["cost"]).alias("costs"), F.transform("g", lambda r: r["total"]).alias("totals")), [*PAIR, "block"])
        state = kept(rows.select(*PAIR, "block", "n", band("x", "ys", "costs", "totals", "block").alias("s")).select(*PAIR, "block", "n", "s.*"))
        done = state.where(F.col("n") <= (i + 1) * tile)
        ended = done if ended is None else ended.unionByName(done)
    if ended is None:
        return x.select("a", "b", F.lit(0.0).alias("mean_step"), F.lit(0.0).alias("cost")).limit(0)
    each = ended.select("a", "b", "n", "block", F.posexplode(F.arrays_zip("cost", "total")).alias("k", "z"))
    best = each.groupBy("a", "b", "n").agg(F.min(F.struct("z.cost", (F.col("block") * tile + F.col("k")).alias("j"), "z.total")).alias("m"))
    return best.select("a", "b", (F.col("m.total") / F.col("n") - (F.col("n") - 1) / 2).alias("mean_step"), F.col("m.cost").alias("cost"))
