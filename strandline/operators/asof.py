"""As-of joins and covariances of overlapping increments, without theta joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)


def _neighbours(rows: DataFrame, found: DataFrame, by: list[str], at: str, slab: float | None, back: str | None, ahead: str | None) -> DataFrame:
    """rows with the struct _r of found's last row at or before `at` (named back) and of its first at or after (ahead); NULL if none.

    found: by, at, _r.  Both looks are running frames, the second over descending times: linear in the rows of a group.  Of
    equal times the greatest _r is the last and the least is the first.  With slab, groups are cut into ranges of that
    width, and each range only gets the last row of earlier ones and the first of later ones.
    """
    cut = F.floor(F.col(at) / slab).cast("long") if slab else F.lit(0).cast("long")
    both = rows.withColumn("_side", F.lit(1)).unionByName(found.withColumn("_side", F.lit(0)), allowMissingColumns=True).withColumn("_slab", cut)
    w = Window.partitionBy(*by, "_slab")
    looks = {back: [F.asc(at), F.asc("_side"), F.asc("_r")], ahead: [F.desc(at), F.asc("_side"), F.desc("_r")]}
    looks = {name: w.orderBy(*order).rowsBetween(*_UP_TO_HERE) for name, order in looks.items() if name}
    out = both.select("*", *(F.last("_r", ignorenulls=True).over(frame).alias(name) for name, frame in looks.items())).where("_side = 1")
    if slab:  # a row for each slab: what its neighbours hand over
        ends = both.groupBy(*by, "_slab").agg(F.max("_r").alias("_hi"), F.min("_r").alias("_lo"))
        s = Window.partitionBy(*by)
        before = F.last("_hi", ignorenulls=True).over(s.orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1))
        after = F.last("_lo", ignorenulls=True).over(s.orderBy(F.desc("_slab")).rowsBetween(Window.unboundedPreceding, -1))
        ends = ends.select(*by, "_slab", before.alias("_before"), after.alias("_after"))
        out = out.join(ends, [*by, "_slab"], "left")
        for name, other in ((back, "_before"), (ahead, "_after")):
            if name:
                out = out.withColumn(name, F.coalesce(name, other))
        out = out.drop("_before", "_after")
    return out.drop("_side", "_slab", "_r")


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], direction: str = "nearest", tolerance: float | None = None, slab: float | None = None) -> DataFrame:
    """left with <on>_match and the right side's values: the row at or before, at or after, or nearest; ties go to the earlier.

    Rows without a match within tolerance are dropped, so are rows with a null time.  `on` is a number.  With slab, keys are
    cut into ranges of that width, so one hot key is many tasks.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError("direction is backward, forward or nearest")
    kept = left.columns
    found = right.where(F.col(on).isNotNull()).select(*by, on, F.struct(F.col(on).alias("t"), *(F.col(v) for v in values)).alias("_r"))
    back, ahead = (None if direction == "forward" else "_b"), (None if direction == "backward" else "_a")
    out = _neighbours(left.where(F.col(on).isNotNull()), found, by, on, slab, back, ahead)
    pick: Column = F.col(ahead or back) if direction != "nearest" else F.when(F.col("_a").isNull() | (F.col(on) - F.col("_b.t") <= F.col("_a.t") - F.col(on)), F.col("_b")).otherwise(F.col("_a"))
    out = out.withColumn("_m", pick).where("_m IS NOT NULL")
    if tolerance is not None:
        out = out.where(F.abs(F.col("_m.t") - F.col(on)) <= tolerance)
    return out.select(*kept, F.col("_m.t").alias(f"{on}_match"), *(F.col(f"_m.{v}").alias(f"{v}_match" if v in kept else v) for v in values))


def increments(df: DataFrame, keys: list[str], t: str, p: str, slab: float | None = None) -> DataFrame:
    """keys, t0, t1, dp: price changes between consecutive rows; with slab, keys are cut into ranges that hand over their last row."""
    rows = df.select(*keys, F.struct(F.col(t).alias("t"), F.col(p).alias("p")).alias("_now"), (F.floor(F.col(t) / slab) if slab else F.lit(0)).cast("long").alias("_slab"))
    out = rows.withColumn("_was", F.lag("_now").over(Window.partitionBy(*keys, "_slab").orderBy("_now")))
    if slab:
        ends = rows.groupBy(*keys, "_slab").agg(F.max("_now").alias("_hi"))
        ends = ends.select(*keys, "_slab", F.lag("_hi").over(Window.partitionBy(*keys).orderBy("_slab")).alias("_before"))
        out = out.join(ends, [*keys, "_slab"]).withColumn("_was", F.coalesce("_was", "_before"))
    return out.where("_was IS NOT NULL").select(*keys, F.col("_was.t").alias("t0"), F.col("_now.t").alias("t1"), (F.col("_now.p") - F.col("_was.p")).alias("dp"))


def overlap_covariance(a: DataFrame, b: DataFrame, by: list[str], t: str, p: str, shifts: list[int] | None = None, slab: float | None = None) -> DataFrame:
    """by, shift, cov, var_a, var_b, corr: Hayashi-Yoshida sums over pairs of overlapping increments, b moved later by shift.

    Exact without pairing increments: those of b that overlap (A0, A1] follow each other, so their sum is b's price at
    its first time at or after A1 (else its last) minus its price at its last time at or before A0 (else its first).
    corr is NULL where a variance is not positive.  With slab (a width in units of t) one pair of series is many tasks.
    """
    moves = F.explode(F.array(*(F.lit(int(s)) for s in shifts or [0]))).alias("shift")
    a = a.select(*by, moves, F.col(t).alias("t"), F.col(p).alias("p"))
    b = b.select(*by, moves, F.col(t).alias("t"), F.col(p).alias("p")).withColumn("t", F.col("t") + F.col("shift"))
    keys = [*by, "shift"]
    steps = increments(a, keys, "t", "p", slab)
    ends = b.groupBy(*keys).agg(F.min(F.struct("t", "p")).alias("lo"), F.max(F.struct("t", "p")).alias("hi"))
    wide = steps.join(ends, keys).where((F.col("t1") > F.col("lo.t")) & (F.col("t0") < F.col("hi.t")))
    found = b.select(*keys, "t", F.struct("t", "p").alias("_r"))
    at_start = _neighbours(wide.withColumn("at", F.col("t0")), found.withColumnRenamed("t", "at"), keys, "at", slab, "_from", None)
    at_end = _neighbours(at_start.withColumn("at", F.col("t1")), found.withColumnRenamed("t", "at"), keys, "at", slab, None, "_to")
    pair = at_end.withColumn("sum_b", F.coalesce("_to.p", "hi.p") - F.coalesce("_from.p", "lo.p"))
    cov = pair.groupBy(*keys).agg(F.sum(F.col("dp") * F.col("sum_b")).alias("cov"))
    va = steps.groupBy(*keys).agg(F.sum(F.col("dp") ** 2).alias("var_a"))
    vb = increments(b, keys, "t", "p", slab).groupBy(*keys).agg(F.sum(F.col("dp") ** 2).alias("var_b"))
    out = va.join(vb, keys).join(cov, keys, "left").withColumn("cov", F.coalesce("cov", F.lit(0.0)))
    return out.withColumn("corr", F.when((F.col("var_a") > 0) & (F.col("var_b") > 0), F.col("cov") / F.nullif(F.sqrt(F.col("var_a") * F.col("var_b")), F.lit(0.0)))).select(*keys, "cov", "var_a", "var_b", "corr")
