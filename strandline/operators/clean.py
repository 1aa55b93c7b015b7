"""Validation, profiling, deduplication, reshaping, returns, encoding and scaling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import known
from . import slabs
from .windows import with_row_number


def validate(df: DataFrame, required: list[str]) -> DataFrame:
    """column_name, present, n_null, n_infinite, ok for each required column: one aggregation over the table."""
    numeric = {f.name for f in df.schema if isinstance(f.dataType, NumericType)}
    here = [c for c in required if c in df.columns]
    aggs = [F.count_if(F.col(c).isNull() | (F.isnan(F.col(c).cast("double")) if c in numeric else F.lit(False))).alias(f"null_{k}") for k, c in enumerate(here)]
    aggs += [(F.count_if(F.abs(F.col(c).cast("double")) == F.lit(float("inf"))) if c in numeric else F.lit(0).cast("long")).alias(f"inf_{k}") for k, c in enumerate(here)]
    one = df.agg(F.count("*").alias("_n"), *aggs)
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(True).alias("present"), F.col(f"null_{k}").alias("n_null"), F.col(f"inf_{k}").alias("n_infinite")) for k, c in enumerate(here)]
    rows += [F.struct(F.lit(c).alias("column_name"), F.lit(False).alias("present"), F.lit(0).cast("long").alias("n_null"), F.lit(0).cast("long").alias("n_infinite")) for c in required if c not in df.columns]
    out = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.withColumn("ok", F.col("present") & (F.col("n_null") == 0) & (F.col("n_infinite") == 0))


def require_valid(df: DataFrame, required: list[str]) -> DataFrame:
    """df itself; ValueError if a required column is missing, has nulls or infinities."""
    bad = [r["column_name"] for r in validate(df, required).where("NOT ok").collect()]
    if bad:
        raise ValueError(f"invalid columns: {', '.join(bad)}")
    return df


def profile(df: DataFrame, keys: list[str], date: str) -> DataFrame:
    """One row: n_rows, n_<key> (distinct), first_date, last_date, n_duplicate_keys."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    top = df.agg(F.count("*").alias("n_rows"), *(F.countDistinct(k).alias(f"n_{k}") for k in keys), F.min(date).alias("first_date"), F.max(date).alias("last_date"))
    return top.crossJoin(counts.agg(F.count_if(F.col("n") > 1).alias("n_duplicate_keys")))


def duplicate_keys(df: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """The first n keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_copies")).where("n_copies > 1").orderBy(*keys).limit(n)


def dedupe(df: DataFrame, keys: list[str], value: str, how: str = "mean", seq: str | None = None) -> DataFrame:
    """One row per key with its value: mean of the known ones, or the first or last by seq."""
    if how == "mean":
        return df.groupBy(*keys).agg(F.avg(known(value)).alias(value))
    if seq is None or how not in ("first", "last"):
        raise ValueError("how is mean, first or last; first and last need seq")
    pick = F.min_by if how == "first" else F.max_by
    return df.groupBy(*keys).agg(pick(value, seq).alias(value))


def to_long(df: DataFrame, ids: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def to_wide(df: DataFrame, ids: list[str], name: str, value: str, values: list[str]) -> DataFrame:
    """One column for each of the listed values; a key's only value of a name, or their mean."""
    return df.groupBy(*ids).pivot(name, values).agg(F.avg(value))


def to_returns(df: DataFrame, keys: list[str], order: list[str], price: str, kind: str = "log_returns", first: str = "zero", out: str = "ret", parts: int | None = None) -> DataFrame:
    """out: returns, log_returns, diff or none of price along order; the first row of a series is 0 or dropped.

    A return from or to a price that its formula has no value for is NULL.  Series too long for a task are cut (slabs.parts_for).
    """
    p, q = F.col(price), F.col("_q")
    kinds: dict[str, Column] = {"returns": F.try_divide(p - q, q), "log_returns": F.when((p > 0) & (q > 0), F.log(F.when(p > 0, p)) - F.log(F.when(q > 0, q))), "diff": p - q, "none": p}
    if kind not in kinds:
        raise ValueError(f"kind is one of {', '.join(kinds)}")
    if kind == "none":
        return df.withColumn(out, p)

    def before(d: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        return d.withColumn("_q", F.lag(price).over(w)).withColumn("_start", F.row_number().over(w) == 1)

    done = slabs.in_slabs(df, keys, order, before, 1, parts=parts).withColumn(out, F.when(F.col("_start"), F.lit(0.0)).otherwise(kinds[kind]))
    return (done if first == "zero" else done.where("NOT _start")).drop("_q", "_start")


def label_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """<column>_code: rank of the value among the sorted distinct ones, from 0; NULL stays NULL.  Distinct values are numbered in ranges."""
    for c in columns:
        codes = with_row_number(df.select(c).where(F.col(c).isNotNull()).distinct(), [c], out=f"{c}_code").withColumn(f"{c}_code", F.col(f"{c}_code").cast("int"))
        df = df.join(codes, c, "left")
    return df


def min_max_scale(df: DataFrame, columns: list[str], fit: Column | None = None) -> DataFrame:
    """Each column scaled to [0, 1] by the range of the rows where fit holds (all if None); a constant column is 0."""
    rows = df if fit is None else df.where(fit)
    ends = rows.agg(*(f(known(c)).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    out = df.crossJoin(F.broadcast(ends))
    for c in columns:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        out = out.withColumn(c, F.when(hi > lo, (F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise(F.when(F.col(c).isNotNull(), 0.0)))
    return out.drop(*(f"_{n}_{c}" for c in columns for n in ("lo", "hi")))


def group_normalise(df: DataFrame, keys: list[str], value: str, out: str | None = None) -> DataFrame:
    """(value - mean) / population standard deviation of its group; 0 in a group without spread."""
    w = Window.partitionBy(*keys)
    spread = F.stddev_pop(value).over(w)
    return df.withColumn(out or value, F.when(spread > 0, (F.col(value) - F.avg(value).over(w)) / F.nullif(spread, F.lit(0.0))).otherwise(F.when(F.col(value).isNotNull(), 0.0)))


def concat(frames: list[DataFrame]) -> DataFrame:
    """All rows by column name; columns that a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
