"""Coupon schedules, par yields and prices over tables of bonds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bond_schedule(bonds: DataFrame, key: str = "bond", start: str = "ts", end: str = "te", freq: str = "freq", eps: float = 1e-12) -> DataFrame:
    """key, n, t, accrual: coupon times backward from maturity, the start first with accrual 0; the first stub is long.

    Times are end - k / freq for k < floor((end - start) * freq + eps); an accrual is the time since the date before.
    """
    n = F.floor((F.col(end) - F.col(start)) * F.col(freq) + eps).cast("int")
    times = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.col(end) - (n - 1 - k) / F.col(freq))).otherwise(F.array(F.col(end).cast("double")))
    dates = bonds.select(key, F.posexplode(F.concat(F.array(F.col(start).cast("double")), times)).alias("n", "t"))
    before = F.lag("t").over(Window.partitionBy(key).orderBy("n"))
    return dates.withColumn("accrual", F.coalesce(F.col("t") - before, F.lit(0.0)))


def discounted(schedule: DataFrame, curve: DataFrame) -> DataFrame:
    """schedule with df: the discount factor at t, log-linear between the curve's (t, df) points, flat forward beyond its ends.

    The curve holds (0, 1) or gets it; it is a small table of points, looked up through its segments.
    """
    points = curve.select(F.col("t").cast("double").alias("t"), F.col("df").cast("double").alias("d")).unionAll(curve.limit(1).select(F.lit(0.0), F.lit(1.0))).dropDuplicates(["t"])
    line = points.agg(F.sort_array(F.collect_list(F.struct("t", F.log("d").alias("l")))).alias("p"))
    both = schedule.crossJoin(F.broadcast(line))
    at = F.least(F.greatest(F.size(F.filter("p", lambda x: x["t"] <= F.col("t"))), F.lit(1)), F.size("p") - 1)
    both = both.withColumn("_a", F.element_at("p", at)).withColumn("_b", F.element_at("p", at + 1))
    value = F.exp(F.col("_a.l") + (F.col("_b.l") - F.col("_a.l")) * (F.col("t") - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t")))
    return both.withColumn("df", value).drop("p", "_a", "_b")


def par_yields(schedule: DataFrame, curve: DataFrame, key: str = "bond") -> DataFrame:
    """key and par_yield = (1 - discount at maturity) / (sum of discount * accrual + 1e-16)."""
    rows = discounted(schedule, curve)
    return rows.groupBy(key).agg(((1 - F.max_by("df", "n")) / (F.sum(F.col("df") * F.col("accrual")) + 1e-16)).alias("par_yield"))


def price_bonds(schedule: DataFrame, coupons: DataFrame, curve: DataFrame, key: str = "bond") -> DataFrame:
    """key and price = sum of discount * coupon * accrual + discount at maturity."""
    rows = discounted(schedule, curve).join(coupons.select(key, "coupon"), key)
    return rows.groupBy(key).agg((F.sum(F.col("df") * F.col("coupon") * F.col("accrual")) + F.max_by("df", "n")).alias("price"))
