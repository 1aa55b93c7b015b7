"""Series cut into slabs, so that a hot series is many tasks: windows with a halo of rows around, and states handed from slab to slab.

A slab is what a range of the whole table, cut along keys and order, holds of one series.  A range's first and last series may reach
over its ends, all others are whole, so no more series span slabs than there are ranges, and tables of slabs of such series are small.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import known
from .windows import ranged

#: Rows of one series that a task may hold whole.
MOST = 2_000_000


def parts_for(df: DataFrame, keys: list[str], parts: int | None = None, most: int | None = None) -> int:
    """parts if given; else 0 (series are not cut) if none has over `most` rows (MOST), or as many ranges as hold a quarter of that each."""
    if parts is not None:
        return parts
    most = most or MOST
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("largest"), F.sum("n").alias("total")).first()
    return 0 if (sizes["largest"] or 0) <= most else min(4096, 1 + 4 * sizes["total"] // most)


def _same(a: DataFrame, b: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """a joined with b on columns, null equal to null."""
    names = {c: f"_same_{c}" for c in columns}
    b = b.withColumnsRenamed(names)
    on = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()))
    return a.join(b, on, how).drop(*names.values())


def _spanning(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _slabs: array of (range, first row's number, rows) of each series in more than one range; at most two entries for a range."""
    counts = rows.groupBy("_range", *keys).agg(F.count("*").alias("_n"))
    start = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = counts.withColumn("_from", start).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_range", "_from", "_n"))).alias("_slabs"))
    return F.broadcast(each.where(F.size("_slabs") > 1))


def with_halo(df: DataFrame, keys: list[str], order: list[str], parts: int, before: int = 0, after: int = 0) -> DataFrame:
    """df with _range and _halo: each slab also has, as halo, the `before` rows ahead of it and the `after` rows behind it in its series."""
    rows = ranged(df, [*keys, *order], parts)
    hot = _same(rows, _spanning(rows, keys), keys)
    own = F.filter("_slabs", lambda s: s["_range"] == F.col("_range"))[0]
    by, out = Window.partitionBy("_range", *keys), rows.withColumn("_halo", F.lit(False))
    for n, ahead in ((before, True), (after, False)):
        if not n:
            continue
        place = F.row_number().over(by.orderBy(*(F.col(c).desc() if ahead else F.col(c).asc() for c in order)))
        # a row is halo of a slab if it and the rows between are no more than n
        gap = (lambda s: s["_from"] - own["_from"] - own["_n"]) if ahead else (lambda s: own["_from"] - s["_from"] - s["_n"])
        near = lambda s: ((s["_range"] > F.col("_range")) if ahead else (s["_range"] < F.col("_range"))) & (gap(s) + F.col("_p") <= n)  # noqa: B023, E731
        edge = hot.withColumn("_p", place).where(F.col("_p") <= n).withColumn("_to", F.explode(F.transform(F.filter("_slabs", near), lambda s: s["_range"])))
        out = out.unionByName(edge.withColumn("_range", F.col("_to")).withColumn("_halo", F.lit(True)).drop("_p", "_to", "_slabs"))
    return out


def in_slabs(df: DataFrame, keys: list[str], order: list[str], f: Callable[[DataFrame, list[str]], DataFrame], before: int = 0, after: int = 0, parts: int | None = None) -> DataFrame:
    """f(df, keys), where f adds columns by windows over keys that look at most `before` rows back and `after` rows on.

    Where parts_for() says so, f gets slabs with halos and the slabs' keys; it must keep the rows' other columns.  Rows of equal keys and order are in one slab.
    """
    parts = parts_for(df, keys, parts)
    if not parts:
        return f(df, keys)
    return f(with_halo(df, keys, order, parts, before, after), ["_range", *keys]).where("NOT _halo").drop("_range", "_halo")


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, parts: int | None = None) -> DataFrame:
    """df with out: 0, 1, 2, ... in each series, from a slab's first number."""
    parts = parts_for(df, keys, parts)
    if not parts:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    rows = ranged(df, [*keys, *order], parts)
    rows = _same(rows, _spanning(rows, keys), keys, "left")
    start = F.filter("_slabs", lambda s: s["_range"] == F.col("_range"))[0]["_from"]
    within = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order)).cast("long") - 1
    return rows.withColumn(out, within).withColumn(out, F.col(out) + F.coalesce(start, F.lit(0))).drop("_range", "_slabs")


def carried(df: DataFrame, keys: list[str], order: list[str], column: str, parts: int | None = None) -> DataFrame:
    """df with nulls of column replaced by the last known value before; a slab's last known value is handed on."""
    parts = parts_for(df, keys, parts)
    fill = lambda by: F.last(column, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    if not parts:
        return df.withColumn(column, fill(keys))
    rows = ranged(df, [*keys, *order], parts)
    last = rows.groupBy("_range", *keys).agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order))).alias("_l"))
    past = F.last("_l", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    handed = last.withColumn("_h", past).where("_h IS NOT NULL").drop("_l")
    return _same(rows.withColumn(column, fill(["_range", *keys])), handed, ["_range", *keys], "left").withColumn(column, F.coalesce(column, "_h")).drop("_h", "_range")


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], parts: int | None = None) -> DataFrame:
    """df with out: the sum of column from the start of a series to a row, for each out: column; a slab begins with the sums before it."""
    parts = parts_for(df, keys, parts)
    upto = lambda by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if not parts:
        return df.withColumns({out: F.sum(c).over(upto(keys)) for out, c in sums.items()})
    rows = ranged(df, [*keys, *order], parts)
    past = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_range", *keys).agg(*(F.sum(c).alias(f"_t_{out}") for out, c in sums.items()))
    totals = totals.select("_range", *keys, *(F.sum(f"_t_{out}").over(past).alias(f"_h_{out}") for out in sums), F.row_number().over(Window.partitionBy(*keys).orderBy("_range")).alias("_k")).where("_k > 1").drop("_k")
    rows = _same(rows.withColumns({out: F.sum(c).over(upto(["_range", *keys])) for out, c in sums.items()}), totals, ["_range", *keys], "left")
    return rows.withColumns({out: F.when(F.col(f"_h_{out}").isNull(), F.col(out)).otherwise(F.col(out) + F.col(f"_h_{out}")) for out in sums}).drop("_range", *(f"_h_{out}" for out in sums))


Arrays = list[np.ndarray]


def gathered(df: DataFrame, keys: list[str], order: str, value: str, parts: int) -> DataFrame:
    """_range, keys, _s (order and value of a slab's rows, in order), _v (its values, NaN where missing)."""
    rows = ranged(df.select(*keys, order, known(value).alias(value)), [*keys, order], parts)
    slabs = rows.groupBy("_range", *keys).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("_s"))
    return slabs.withColumn("_v", F.transform("_s", lambda s: F.coalesce(s[value], F.lit(float("nan")))))


def _applied(f: Callable[..., np.ndarray], *columns: str) -> Column:
    """f of array columns, row by row."""

    @F.pandas_udf("array<double>")
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(f(*(np.array(x, float) for x in row)), float) for row in zip(*series, strict=True)], dtype=object)

    return run(*columns)


def handed_on(slabs: DataFrame, keys: list[str], out: str, summary: Callable[..., np.ndarray], fold: Callable[[Arrays], Arrays], *columns: str) -> DataFrame:
    """slabs with out: the state that each slab begins with.  summary(columns) describes a slab; fold(a series' summaries in order) gives its slabs' states."""
    each = slabs.select("_range", *keys, _applied(summary, *columns).alias("_a"))

    @F.pandas_udf("array<array<double>>")
    def folded(series: pd.Series) -> pd.Series:
        return pd.Series([[np.asarray(s, float) for s in fold([np.array(a, float) for a in one])] for one in series], dtype=object)

    lists = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_range", "_a"))).alias("_l"))
    lists = lists.withColumn("_f", folded(F.transform("_l", lambda s: s["_a"])))
    states = lists.select(*keys, F.explode(F.arrays_zip(F.transform("_l", lambda s: s["_range"]).alias("r"), F.col("_f").alias("f"))).alias("z")).select(F.col("z.r").alias("_range"), *keys, F.col("z.f").alias(out))
    return _same(slabs, states, ["_range", *keys])


def replayed(slabs: DataFrame, keys: list[str], order: str, value: str, out: str, f: Callable[..., np.ndarray], *columns: str) -> DataFrame:
    """keys, order, value and out = f(columns), a value for each row of a slab."""
    done = slabs.withColumn("_o", _applied(f, *columns))
    return done.select(*keys, F.explode(F.arrays_zip("_s", "_o")).alias("_z")).select(*keys, f"_z._s.{order}", f"_z._s.{value}", known(F.col("_z._o")).alias(out))
