"""Comparison of two event tables, and scores of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import slabs


def tv_distance(a: DataFrame, b: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """by, tv: half the sum of |share in a - share in b| over the categories of a column, of groups that both have."""
    by = by or []

    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(*by, column).agg(F.count("*").alias("_n"))
        total = df.groupBy(*by).agg(F.count("*").alias("_t")) if by else df.agg(F.count("*").alias("_t"))
        both = counts.join(total, by) if by else counts.crossJoin(F.broadcast(total))
        return both.select(*by, F.col(column).alias("_c"), (F.col("_n") / F.col("_t")).alias(name))

    x, y = shares(a, "_p"), shares(b, "_q")
    full = x.join(y, [*by, "_c"], "full_outer")
    out = full.groupBy(*by).agg((F.sum(F.abs(F.coalesce("_p", F.lit(0.0)) - F.coalesce("_q", F.lit(0.0)))) / 2).alias("tv"))
    return out.join(a.select(*by).distinct(), by, "left_semi").join(b.select(*by).distinct(), by, "left_semi") if by else out


def wasserstein(a: DataFrame, b: DataFrame, columns: list[str], by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """by, column_name, distance: area between the two distribution functions of each column.

    Counts per value first, then cumulative shares over sorted values; NULLs are left out.  With by, groups with at most
    one row on a side have no distance.  A column of more distinct values than a task may hold is cut into ranges of values
    (slabs.parts_for), which begin with the counts before them.
    """
    by = by or []

    def counts(df: DataFrame, name: str) -> DataFrame:
        long = df.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in columns))).alias("r")).select(*by, "r.*").where("x IS NOT NULL")
        return long.groupBy(*by, "column_name", "x").agg(F.count("*").alias(name))

    keys = [*by, "column_name"]
    full = counts(a, "na").join(counts(b, "nb"), [*keys, "x"], "full_outer").na.fill(0, ["na", "nb"])
    parts = slabs.parts_for(full, keys, parts)
    totals = full.groupBy(*keys).agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    ahead = lambda d, own: d.withColumn("gap", F.lead("x").over(Window.partitionBy(*own).orderBy("x")) - F.col("x"))
    full = slabs.in_slabs(slabs.running(full, keys, ["x"], {"ca": "na", "cb": "nb"}, parts), keys, ["x"], ahead, after=1, parts=parts)
    both = slabs._same(full, totals, keys)
    share = F.abs(F.col("ca") / F.nullif("ta", F.lit(0)) - F.col("cb") / F.nullif("tb", F.lit(0)))
    out = both.groupBy(*keys).agg(F.coalesce(F.sum(share * F.col("gap")), F.lit(0.0)).alias("distance"), F.min("ta").alias("ta"), F.min("tb").alias("tb"))
    least = 1 if by else 0
    return out.withColumn("distance", F.when((F.col("ta") > least) & (F.col("tb") > least), F.col("distance"))).drop("ta", "tb")


def persistence(df: DataFrame, keys: list[str], order: list[str], column: str, lag: int = 5, parts: int | None = None) -> DataFrame:
    """persistence: share of rows equal to the one `lag` rows before, averaged over keys with more than lag rows; 0 without any."""

    def before(d: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        return d.withColumn("_b", F.lag(column, lag).over(w)).withColumn("_k", F.row_number().over(w))

    rows = slabs.in_slabs(df, keys, order, before, lag, parts=parts).where(F.col("_k") > lag)
    each = rows.groupBy(*keys).agg(F.avg(F.col(column).eqNullSafe(F.col("_b")).cast("double")).alias("_s"))
    return each.agg(F.coalesce(F.avg("_s"), F.lit(0.0)).alias("persistence"))


def time_distance(a: DataFrame, b: DataFrame, key: str, seconds: str) -> DataFrame:
    """distance: Euclidean distance of mean event times over the keys of both tables."""
    x, y = (d.groupBy(key).agg(F.avg(seconds).alias(n)) for d, n in ((a, "_x"), (b, "_y")))
    return x.join(y, key).agg(F.coalesce(F.sqrt(F.sum((F.col("_x") - F.col("_y")) ** 2)), F.lit(0.0)).alias("distance"))


def classification_scores(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """n, accuracy (%) and Cohen's kappa from the confusion counts."""
    cells = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    rows, cols = cells.groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("r")), cells.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("s"))
    chance = rows.join(cols, "c").agg(F.coalesce(F.sum(F.col("r").cast("double") * F.col("s")), F.lit(0.0)).alias("e"))
    out = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)).alias("hit")).crossJoin(chance)
    observed, expected = F.col("hit") / F.nullif("n", F.lit(0)), F.col("e") / F.nullif(F.col("n").cast("double") * F.col("n"), F.lit(0.0))
    return out.select("n", (100 * observed).alias("accuracy"), F.when(expected < 1, (observed - expected) / F.nullif(1 - expected, F.lit(0.0))).alias("kappa"))


def mask_quality(known_mask: DataFrame, found_mask: DataFrame, keys: list[str], flag: str = "is_zero") -> DataFrame:
    """true_pos, false_pos, false_neg, precision, recall, f1 of a found mask against a known one (denominators + 1e-10)."""
    both = known_mask.select(*keys, F.col(flag).alias("k")).join(found_mask.select(*keys, F.col(flag).alias("f")), keys, "full_outer").na.fill(False, ["k", "f"])
    out = both.agg(F.count_if(F.col("k") & F.col("f")).alias("true_pos"), F.count_if(~F.col("k") & F.col("f")).alias("false_pos"), F.count_if(F.col("k") & ~F.col("f")).alias("false_neg"))
    out = out.withColumn("precision", F.col("true_pos") / (F.col("true_pos") + F.col("false_pos") + 1e-10)).withColumn("recall", F.col("true_pos") / (F.col("true_pos") + F.col("false_neg") + 1e-10))
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-10))


def benchmark_summary(df: DataFrame, method: str, seconds: str, r2: str) -> DataFrame:
    return df.groupBy(method).agg(F.avg(seconds).alias("mean_seconds"), F.avg(r2).alias("mean_r2"))
