"""Rules of hedge regressions as tables: selectors expanded over countries, tenors and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expand_rules(rules: DataFrame, outputs: DataFrame, n_features: int) -> DataFrame:
    """country, tenor, kind, feature, feature2, value: each rule for each output that it selects, once.

    rules: kind, countries (array, NULL = all), tenors (array, NULL = all), feature, feature2, value.  A feature outside
    0 .. n_features - 1 raises when the result is computed.
    """
    ok = F.col("feature").between(0, n_features - 1) & F.coalesce(F.col("feature2").between(0, n_features - 1), F.lit(True))
    checked = rules.withColumn("feature", F.when(ok, F.col("feature")).otherwise(F.raise_error(F.lit("feature out of range"))))
    both = outputs.crossJoin(F.broadcast(checked))  # rules are a configuration, not data
    hit = (F.col("countries").isNull() | F.array_contains("countries", F.col("country"))) & (F.col("tenors").isNull() | F.array_contains("tenors", F.col("tenor")))
    return both.where(hit).select("country", "tenor", "kind", "feature", "feature2", "value").distinct()


def allowed_futures(outputs: DataFrame, futures: DataFrame, allowed: DataFrame, adjacent_only: bool = False, fallback: DataFrame | None = None) -> DataFrame:
    """country, tenor, feature, is_zero: futures that a country's rule does not allow are zero; a country without rule has only zeros.

    futures: feature, country (of the future), tenors that it covers (array); allowed: country, allowed_country.  With
    adjacent_only at most the first two covering futures by feature are free; where none covers a tenor, those of
    fallback (tenor, feature) are.
    """
    cells = outputs.crossJoin(F.broadcast(futures.select("feature", F.col("country").alias("_home"), F.col("tenors").alias("_tenors"))))
    rule = allowed.select("country", F.col("allowed_country").alias("_home")).distinct().withColumn("_ok", F.lit(True))
    cells = cells.join(rule, ["country", "_home"], "left").withColumn("_ok", F.coalesce("_ok", F.lit(False)))
    if adjacent_only:
        cover = F.col("_ok") & F.array_contains("_tenors", F.col("tenor"))
        w = Window.partitionBy("country", "tenor")
        rank = F.count_if(cover).over(w.orderBy("feature").rowsBetween(Window.unboundedPreceding, 0))
        cells = cells.withColumn("_cover", cover).withColumn("_rank", rank).withColumn("_any", F.max("_cover").over(w))
        spare = fallback.select("tenor", "feature").distinct().withColumn("_spare", F.lit(True)) if fallback is not None else None
        cells = cells.join(F.broadcast(spare), ["tenor", "feature"], "left") if spare is not None else cells.withColumn("_spare", F.lit(None).cast("boolean"))
        cells = cells.withColumn("_ok", F.when(F.col("_any"), F.col("_cover") & (F.col("_rank") <= 2)).otherwise(F.col("_ok") & F.coalesce("_spare", F.lit(False))))
    return cells.select("country", "tenor", "feature", (~F.col("_ok")).alias("is_zero"))


def fixed_values(outputs: DataFrame, values: DataFrame) -> DataFrame:
    """country, tenor, feature, value: of a country's values for a tenor and for all tenors (NULL), the tenor's own wins."""
    both = outputs.join(values.withColumnRenamed("tenor", "_t"), "country").where(F.col("_t").isNull() | (F.col("_t") == F.col("tenor")))
    rank = F.row_number().over(Window.partitionBy("country", "tenor", "feature").orderBy(F.col("_t").isNull(), "value"))
    return both.withColumn("_k", rank).where("_k = 1").select("country", "tenor", "feature", "value")


def control_rules(control: DataFrame, keys: list[str]) -> DataFrame:
    """Rules of a control mask: 0 is a zero, 1 is free, the -1 cells of an output are taken in pairs that sum to zero.

    control: keys, feature, control.  An odd number of -1 cells raises when the result is computed.
    """
    zero = control.where("control = 0").select(*keys, F.lit("zero").alias("kind"), "feature", F.lit(None).cast("int").alias("feature2"), F.lit(0.0).alias("value"))
    w = Window.partitionBy(*keys)
    paired = control.where("control = -1").withColumn("_k", F.row_number().over(w.orderBy("feature")) - 1).withColumn("_n", F.count("*").over(w))
    paired = paired.withColumn("_pair", F.when(F.col("_n") % 2 == 0, F.floor(F.col("_k") / 2)).otherwise(F.raise_error(F.lit("odd number of -1 cells")).cast("long")))
    pairs = paired.groupBy(*keys, "_pair").agg(F.min("feature").alias("feature"), F.max("feature").alias("feature2"))
    return zero.unionByName(pairs.select(*keys, F.lit("offset").alias("kind"), "feature", "feature2", F.lit(0.0).alias("value")))
