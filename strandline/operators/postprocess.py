"""What happens to coefficients after a fit: thresholds, top-k, ties, sign consistency, sparsity, interpolation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import curves
from .windows import running_total


def keep_top(w: DataFrame, output: list[str], k: int) -> DataFrame:
    """w with all but the k largest |w| of each output set to 0; the higher feature number wins ties."""
    rank = F.row_number().over(Window.partitionBy(*output).orderBy(F.abs("w").desc(), F.desc("feature_no")))
    return w.withColumn("_r", rank).withColumn("w", F.when(F.col("_r") <= k, F.col("w")).otherwise(0.0)).drop("_r")


def freeze_mask(w: DataFrame, output: list[str], threshold: float | None = None, k: int | None = None) -> DataFrame:
    """w with frozen: |w| under a threshold, or under the k-th largest of its output."""
    if threshold is not None:
        return w.withColumn("frozen", F.abs("w") < threshold)
    by = Window.partitionBy(*output)
    place = F.row_number().over(by.orderBy(F.abs("w").desc()))
    top = F.max(F.when(F.col("_r") == k, F.abs("w"))).over(by)
    return w.withColumn("_r", place).withColumn("frozen", F.abs("w") < F.coalesce(top, F.lit(0.0))).drop("_r")


def post_process(w: DataFrame, output: list[str], zero: float = 1e-6, relative: float | None = None, top: int | None = None, signs: bool = False, sparsity: float | None = None) -> DataFrame:
    """w (window_id, output, feature, feature_no, w) after, in this order: absolute limit, limit relative to the output's
    greatest in its window, top-k, zero where the mean sign over windows is under one half, and a target share of zeros.
    """
    each = ["window_id", *output]
    w = w.withColumn("w", F.when(F.abs("w") > zero, F.col("w")).otherwise(0.0)) if zero > 0 else w
    if relative is not None:
        w = w.withColumn("w", F.when(F.abs("w") > relative * F.max(F.abs("w")).over(Window.partitionBy(*each)), F.col("w")).otherwise(0.0))
    if top is not None:
        w = keep_top(w, each, top)
    if signs:
        mean = F.avg(F.signum("w")).over(Window.partitionBy(*output, "feature"))
        w = w.withColumn("w", F.when(F.abs(mean) < 0.5, 0.0).otherwise(F.col("w")))
    if sparsity is not None:
        # the limit is the value before which just as many are kept as the share allows
        counts = w.where("w <> 0").groupBy((-F.abs("w")).alias("_a")).agg(F.count("*").alias("c"))
        size = w.agg(F.count("*").alias("n"), F.count_if(F.abs("w") > 1e-10).alias("on"))
        keep = F.floor(F.lit(1 - sparsity) * F.col("n") + 1e-9)
        limit = running_total(counts, ["_a"], "c", "u").crossJoin(F.broadcast(size)).where((F.col("u") > keep) & (1 - F.col("on") / F.col("n") < sparsity)).agg(F.max(-F.col("_a")).alias("_limit"))
        w = w.crossJoin(F.broadcast(limit)).withColumn("w", F.when(F.abs("w") > F.coalesce("_limit", F.lit(-1.0)), F.col("w")).otherwise(0.0)).drop("_limit")
    return w


def tie_features(w: DataFrame, output: list[str], ties: DataFrame) -> DataFrame:
    """w with tied features of an output: kind 'equal' gets the mean, 'opposite' half the difference to the other, 'sum_zero' less the mean.

    ties: tie, kind, feature; a feature is in one tie at most.
    """
    both = w.join(F.broadcast(ties), "feature", "left")
    by = Window.partitionBy(*output, "tie")
    mean, sign = F.avg("w").over(by), F.when(F.col("feature_no") == F.min("feature_no").over(by), 1.0).otherwise(-1.0)
    both = both.withColumn("_s", sign)
    apart = F.avg(F.col("_s") * F.col("w")).over(by)
    new = F.when(F.col("kind") == "equal", mean).when(F.col("kind") == "opposite", F.col("_s") * apart).when(F.col("kind") == "sum_zero", F.col("w") - mean).otherwise(F.col("w"))
    return both.withColumn("w", new).drop("tie", "kind", "_s")


def freeze_and_floor(w: DataFrame, plain: DataFrame, mask: DataFrame, keys: list[str], floor: float | None = None) -> DataFrame:
    """w of a masked refit: cells that the mask leaves free get the plain fit's value back; weights under floor are raised to it."""
    out = w.join(plain.select(*keys, F.col("w").alias("_p")), keys).join(mask.select(*keys, "is_zero"), keys, "left")
    value = F.when(F.coalesce("is_zero", F.lit(False)), F.col("w")).otherwise(F.col("_p"))
    return out.withColumn("w", F.greatest(value, F.lit(floor)) if floor is not None else value).drop("_p", "is_zero")


def interpolate_curve(curve: DataFrame, queries: DataFrame, method: str = "linear", extrapolate: str = "nearest") -> DataFrame:
    """country, tenor, feature, value, interpolated for each query (country, tenor) of a known country and each feature.

    curve: country, tenor (number), feature, w.  Methods: nearest, linear, log-linear (positive parts; at or beyond an end
    the end's sign), quadratic (through the three nearest knots) and cubic (not-a-knot).  Outside the knots: nearest,
    linear, zero or error.  Values are rounded to 6 digits; a curve of zeros gives 0.
    """
    if method not in ("nearest", "linear", "log-linear", "quadratic", "cubic") or extrapolate not in ("nearest", "linear", "zero", "error"):
        raise ValueError("unknown method or extrapolation")
    lines = curve.groupBy("country", "feature").agg(F.sort_array(F.collect_list(F.struct(F.col("tenor").cast("double").alias("t"), F.col("w").cast("double").alias("w")))).alias("s"))

    @F.pandas_udf("double")
    def at(tenors: pd.Series, values: pd.Series, asked: pd.Series) -> pd.Series:
        return pd.Series([value_at(np.array(t, float), np.array(v, float), q, method, extrapolate) for t, v, q in zip(tenors, values, asked, strict=True)])

    both = queries.select("country", F.col("tenor").cast("double").alias("tenor")).join(lines, "country")
    value = at(F.transform("s", lambda r: r["t"]), F.transform("s", lambda r: r["w"]), F.col("tenor"))
    known = F.exists("s", lambda r: r["t"] == F.col("tenor"))
    return both.select("country", "tenor", "feature", (F.round(value, 6) + F.lit(0.0)).alias("value"), (~known & F.lit(method != "nearest")).alias("interpolated"))


def value_at(x: np.ndarray, y: np.ndarray, q: float, method: str, extrapolate: str) -> float:
    if (x == q).any():
        return float(y[x == q][0])
    if (np.abs(y) < 1e-10).all():
        return 0.0
    outside = q < x[0] or q > x[-1]
    if outside and extrapolate == "error":
        raise ValueError(f"tenor {q} is outside {x[0]} to {x[-1]}")
    if method == "nearest" or len(x) == 1:
        return float(y[np.abs(x - q).argmin()])
    if method == "log-linear":
        log_y = np.log(np.maximum(y, 1e-10))
        if outside and extrapolate == "zero":
            return 1e-10
        value = np.exp(_line(x, log_y, q, extrapolate))
        return float(-value if (q <= x[0] and y[0] < 0) or (q >= x[-1] and y[-1] < 0) else value)
    if outside and extrapolate == "zero":
        return 0.0
    if outside or method == "linear":
        return float(_line(x, y, q, extrapolate))
    if method == "cubic":
        return float(curves.cubic_at(x, y, np.array([q]))[0])
    near = np.sort(np.argsort(np.abs(x - q), kind="stable")[:3])
    return float(np.polyval(np.polyfit(x[near] - q, y[near], len(near) - 1), 0.0))


def _line(x: np.ndarray, y: np.ndarray, q: float, extrapolate: str) -> float:
    """Piecewise linear; outside the ends the end's value, or its segment's line."""
    if (q < x[0] or q > x[-1]) and extrapolate != "linear":
        return float(y[0] if q < x[0] else y[-1])
    k = int(np.clip(np.searchsorted(x, q) - 1, 0, len(x) - 2))
    return float(y[k] + (y[k + 1] - y[k]) / (x[k + 1] - x[k]) * (q - x[k]))


def hedge_table(w: DataFrame, least: float = 1e-10) -> DataFrame:
    """country, tenor, hedges: the features with |w| over least, as a map in feature order."""
    return w.where(F.abs("w") > least).groupBy("country", "tenor").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", "w")))).alias("hedges"))
