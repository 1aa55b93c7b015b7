"""Smoothing of panels: across tenors within a curve, and causally along time within a series."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import known
from ..kernels import curves, smoothers
from . import slabs, windows

Curve = Callable[[np.ndarray, np.ndarray], np.ndarray]


def smooth_time(df: DataFrame, keys: list[str], order: str, value: str, method: str = "ewma", out: str = "smooth", parts: int | None = None, **params) -> DataFrame:
    """keys, order, value and out: a causal smoother along each series.  The moving average is a window function.

    A series of more rows than a task may hold (see slabs.parts_for) is cut into slabs, or all are cut into `parts` ranges: what
    a smoother remembers at a slab's start (a level and variance, or rows before it) is handed on, so results don't depend on the cuts.
    """
    if method == "moving_average":
        return windows.moving_average(df, keys, [order], value, params.get("window", 10), out, parts).select(*keys, order, value, out)
    kernel = smoothers.METHODS[method]
    parts = slabs.parts_for(df, keys, parts)
    if parts:
        return _smooth_slabs(df, keys, order, value, method, out, parts, params)
    rows = df.select(*keys, order, known(value).alias(value))
    series = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("_s"))

    @F.pandas_udf("array<double>")
    def smooth(values: pd.Series) -> pd.Series:
        return pd.Series([kernel(np.array(v, float), **params) for v in values])

    series = series.withColumn("_o", smooth(F.transform("_s", lambda s: F.coalesce(s[value], F.lit(float("nan"))))))
    return series.select(*keys, F.explode(F.arrays_zip("_s", "_o")).alias("_z")).select(*keys, f"_z._s.{order}", f"_z._s.{value}", known(F.col("_z._o")).alias(out))


def _levels(maps: list[np.ndarray], start: float | None) -> list[np.ndarray]:
    """The level before each slab, from maps (a, c, first known value); without a start, that of the first known value, NaN if none is."""
    if start is None:
        start = next((m[2] for m in maps if not np.isnan(m[2])), np.nan)
    out = []
    for a, c, _ in maps:
        out.append(np.array([start]))
        start = a * start + c
    return out


def _first_known(v: np.ndarray) -> float:
    good = v[~np.isnan(v)]
    return float(good[0]) if len(good) else np.nan


def affine_scan(df: DataFrame, keys: list[str], order: str, value: str, out: str, decay: float, start: float | None, parts: int) -> DataFrame:
    """s = decay * s + (1 - decay) * v in slabs: each is an affine map of s; maps are composed per series, then slabs replayed.

    Without a start s begins as the first known value, which is where it then stays up to that value.
    """
    cut = slabs.gathered(df, keys, order, value, parts)
    cut = slabs.handed_on(cut, keys, "_in", lambda v: [*smoothers.ewma_map(v, decay), _first_known(v)], lambda maps: _levels(maps, start), "_v")
    return slabs.replayed(cut, keys, order, value, out, lambda v, s: smoothers.ewma(v, decay, None if np.isnan(s[0]) else s[0]), "_v", "_in")


def _smooth_slabs(df: DataFrame, keys: list[str], order: str, value: str, method: str, out: str, parts: int, params: dict) -> DataFrame:
    if method in ("ewma", "double_ewma"):
        decay = params.get("decay", 0.94)
        once = affine_scan(df, keys, order, value, out, decay, None, parts)
        if method == "ewma":
            return once
        again = affine_scan(once.select(*keys, order, F.col(out).alias("_once")), keys, order, "_once", out, decay, None, parts)
        return slabs._same(once.drop(out), again.drop("_once"), [*keys, order])
    cut = slabs.gathered(df, keys, order, value, parts)
    if method == "kalman":
        # the variance depends on which values are known only, a slab being a Moebius map of it; given the variance, the level's map is affine
        def fresh(v: np.ndarray) -> np.ndarray:
            at = np.flatnonzero(~np.isnan(v))
            a, b, c, d = smoothers.kalman_variance(v[at[0] + 1 :], **params) if len(at) else (0.0, 1.0, 0.0, 1.0)
            return np.array([*smoothers.kalman_variance(v, **params), float(len(at) > 0), (a + b) / (c + d)])

        def variances(maps: list[np.ndarray]) -> list[np.ndarray]:
            result, p = [], np.nan  # NaN: not begun
            for a, b, c, d, seen, begun in maps:
                result.append(np.array([p]))
                p = (a * p + b) / (c * p + d) if p == p else begun if seen else np.nan
            return result

        def level_map(v: np.ndarray, p: np.ndarray) -> np.ndarray:
            if np.isnan(p[0]):
                at = np.flatnonzero(~np.isnan(v))
                return np.array([*(smoothers.kalman_map(v[at[0] + 1 :], 1.0, **params) if len(at) else (1.0, 0.0)), _first_known(v)])
            return np.array([*smoothers.kalman_map(v, p[0], **params), _first_known(v)])

        cut = slabs.handed_on(cut, keys, "_p", fresh, variances, "_v")
        cut = slabs.handed_on(cut, keys, "_in", level_map, lambda maps: _levels(maps, None), "_v", "_p")

        def replay(v: np.ndarray, p: np.ndarray, s: np.ndarray) -> np.ndarray:
            if np.isnan(s[0]):
                return v
            if np.isnan(p[0]):  # begins here, or later
                return smoothers.kalman(v, **params) if (~np.isnan(v)).any() else np.full(len(v), s[0])
            return smoothers.kalman(v, **params, level=s[0], variance=p[0])

        return slabs.replayed(cut, keys, order, value, out, replay, "_v", "_p", "_in")
    if method == "gaussian_process":
        history = params.get("history", 100)

        def tail(v: np.ndarray) -> np.ndarray:
            at = np.flatnonzero(~np.isnan(v))[-history:]
            return np.concatenate([[len(v), _first_known(v), len(at)], at, v[at]])

        def pasts(tails: list[np.ndarray]) -> list[np.ndarray]:
            first = next((t[1] for t in tails if t[2]), np.nan)
            result, at, past, done = [], np.zeros(0), np.zeros(0), 0
            for t in tails:
                result.append(np.concatenate([[first], at - done, past]))
                n, k = int(t[0]), int(t[2])
                at, past = np.concatenate([at, t[3 : 3 + k] + done])[-history:], np.concatenate([past, t[3 + k :]])[-history:]
                done += n
            return result

        def guessed(v: np.ndarray, s: np.ndarray) -> np.ndarray:
            k = (len(s) - 1) // 2
            done = smoothers.gaussian_process(v, **params, places=s[1 : 1 + k], past=s[1 + k :])
            return np.where(np.isnan(done), s[0], done) if not k else done

        cut = slabs.handed_on(cut, keys, "_past", tail, pasts, "_v")
        return slabs.replayed(cut, keys, order, value, out, guessed, "_v", "_past")
    history = params.get("window", 11) if method == "savitzky_golay" else params.get("history", 100)

    def halos(tails: list[np.ndarray]) -> list[np.ndarray]:
        result, rows = [], np.zeros(0)
        for t in tails:
            result.append(rows)
            rows = np.concatenate([rows, t])[-history:]
        return result

    raw = lambda v, h: smoothers.trailing(np.concatenate([h, v]), method, len(h), **params)
    cut = slabs.handed_on(cut, keys, "_h", lambda v: v[-history:], halos, "_v")
    cut = cut.withColumn("_raw", slabs._applied(raw, "_v", "_h"))

    def lasts(known_: list[np.ndarray]) -> list[np.ndarray]:
        result, last = [], np.nan
        for x in known_:
            result.append(np.array([last]))
            last = x[0] if x[0] == x[0] else last
        return result

    cut = slabs.handed_on(cut, keys, "_last", lambda r: [smoothers.carried(r)[-1]], lasts, "_raw")
    return slabs.replayed(cut, keys, order, value, out, lambda r, last: smoothers.carried(r, last[0]), "_raw", "_last")


def smooth_tenor(df: DataFrame, keys: list[str], tenor: str, value: str, method: str | Curve = "bernstein", out: str = "smooth", **params) -> DataFrame:
    """keys, tenor, value and out: a smoother across each curve; equal tenors are averaged first.

    method is a name of kernels.curves.METHODS or an own function (tenors, values) -> values.
    """
    kernel = curves.METHODS[method] if isinstance(method, str) else method
    rows = df.groupBy(*keys, tenor).agg(F.avg(known(value)).alias(value))
    curve = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(tenor, value))).alias("_s"))

    @F.pandas_udf("array<double>")
    def smooth(tenors: pd.Series, values: pd.Series) -> pd.Series:
        done = [(np.array(t, float), np.array(v, float)) for t, v in zip(tenors, values, strict=True)]
        return pd.Series([v if (~np.isnan(v)).sum() < 2 else np.asarray(kernel(t, v, **params), float) for t, v in done])

    nan = F.lit(float("nan"))
    curve = curve.withColumn("_o", smooth(F.transform("_s", lambda s: s[tenor].cast("double")), F.transform("_s", lambda s: F.coalesce(s[value], nan))))
    return curve.select(*keys, F.explode(F.arrays_zip("_s", "_o")).alias("_z")).select(*keys, f"_z._s.{tenor}", f"_z._s.{value}", known(F.col("_z._o")).alias(out))


def smooth_panel(df: DataFrame, date: str, country: str, tenor: str, value: str, tenor_method: str | Curve | None = "bernstein", time_method: str | None = "ewma", again: str | Curve | None = None, tenor_params: dict | None = None, time_params: dict | None = None) -> DataFrame:
    """date, country, tenor, value and smooth: across tenors, then along time, then optionally across tenors once more."""
    out = df.select(date, country, tenor, known(value).alias(value), known(value).alias("smooth"))
    base = out.groupBy(date, country, tenor).agg(F.avg(value).alias(value), F.avg("smooth").alias("smooth"))
    done = base.select(date, country, tenor, "smooth")
    for kind, method, params in (("tenor", tenor_method, tenor_params), ("time", time_method, time_params), ("tenor", again, tenor_params)):
        if method is None:
            continue
        step = smooth_tenor(done, [date, country], tenor, "smooth", method, "_out", **(params or {})) if kind == "tenor" else smooth_time(done, [country, tenor], date, "smooth", method, "_out", **(params or {}))
        done = step.select(date, country, tenor, F.col("_out").alias("smooth"))
    return base.select(date, country, tenor, value).join(done, [date, country, tenor])


def causality_gap(df: DataFrame, keys: list[str], order: str, value: str, cut, smooth: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """max_gap: largest change of smoothed values up to cut when all later inputs become v * 2 + 0.01."""
    bent = df.withColumn(value, F.when(F.col(order) > F.lit(cut), F.col(value) * 2 + 0.01).otherwise(F.col(value)))
    a, b = (smooth(x).where(F.col(order) <= F.lit(cut)).select(*keys, order, F.col("smooth").alias(n)) for x, n in ((df, "_a"), (bent, "_b")))
    return a.join(b, [*keys, order]).agg(F.coalesce(F.max(F.abs(F.col("_a") - F.col("_b"))), F.lit(0.0)).alias("max_gap"))


def roughness(df: DataFrame, keys: list[str], order: list[str], value: str, parts: int | None = None) -> DataFrame:
    """keys, n_valid, roughness (mean squared second difference), variance, mean_abs_change, volatility, rms_second, autocorr_lag1.

    Differences are between consecutive known values; autocorr_lag1 needs more than 10 of them, population moments throughout.
    """
    rows = df.select(*keys, *order, known(value).alias("_v")).where("_v IS NOT NULL")

    def differences(d: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        return d.withColumn("_p", F.lag("_v").over(w)).withColumn("_d", F.col("_v") - F.col("_p")).withColumn("_dd", F.col("_d") - F.lag("_d").over(w))

    parts = slabs.parts_for(rows, keys, parts)
    rows = slabs.in_slabs(rows, keys, order, differences, 2, parts=parts)
    if parts:  # means by a join: a window over a whole series would be one task again
        rows = slabs._same(rows, rows.groupBy(*keys).agg(F.avg("_v").alias("_m")), keys)
    else:
        rows = rows.withColumn("_m", F.avg("_v").over(Window.partitionBy(*keys)))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n_valid"),
        F.avg(F.col("_dd") ** 2).alias("roughness"),
        F.var_pop("_v").alias("variance"),
        F.avg(F.abs("_d")).alias("mean_abs_change"),
        F.stddev_pop("_d").alias("volatility"),
        F.sqrt(F.avg(F.col("_dd") ** 2)).alias("rms_second"),
        F.sum((F.col("_v") - F.col("_m")) * (F.col("_p") - F.col("_m"))).alias("_c1"),
    )
    corr = F.try_divide(F.col("_c1") / F.nullif(F.col("n_valid") - 1, F.lit(0)), F.col("variance"))
    return out.withColumn("autocorr_lag1", F.when(F.col("n_valid") > 10, F.coalesce(corr, F.lit(0.0)))).drop("_c1")


def compare_smoothing(methods: dict[str, DataFrame], date: str, country: str, tenor: str, at) -> DataFrame:
    """method, avg_roughness (x 1e4) and avg_rmse (x 100) over countries at one date; frames have `value` and `smooth`."""
    parts = None
    for name, df in methods.items():
        part = df.where(F.col(date) == F.lit(at)).select(F.lit(name).alias("method"), country, tenor, "value", "smooth")
        parts = part if parts is None else parts.unionAll(part)
    rough = roughness(parts, ["method", country], [tenor], "smooth").select("method", country, F.col("rms_second").alias("rough"))
    error = parts.groupBy("method", country).agg(F.sqrt(F.avg((F.col("smooth") - F.col("value")) ** 2)).alias("rmse"))
    both = rough.join(error, ["method", country])
    return both.groupBy("method").agg((F.avg("rough") * 10000).alias("avg_roughness"), (F.avg("rmse") * 100).alias("avg_rmse"))


def smoothing_effect(df: DataFrame, keys: list[str], tenor: str) -> DataFrame:
    """keys, original and smoothed roughness and the reduction in %: 0 where the original is smooth (under 1e-9, what rounding leaves)."""
    long = df.select(*keys, tenor, F.col("value").alias("_x"), F.col("smooth").alias("_y"))
    a = roughness(long, keys, [tenor], "_x").select(*keys, F.col("rms_second").alias("original_roughness"))
    b = roughness(long, keys, [tenor], "_y").select(*keys, F.col("rms_second").alias("smooth_roughness"))
    cut = F.when(F.col("original_roughness") > 1e-9, (1 - F.try_divide(F.col("smooth_roughness"), F.col("original_roughness"))) * 100).otherwise(0.0)
    return a.join(b, keys).withColumn("reduction", cut)


def grid_search(df: DataFrame, keys: list[str], tenor: str, value: str, method: str, name: str, values: list[float]) -> DataFrame:
    """parameter, mse, roughness and score = mse / (roughness + 1e-10) of a tenor smoother, over all curves.

    One pass: each curve is gathered once and gives, for each value, its squared errors and its mean squared second difference.
    """
    kernel = curves.METHODS[method]
    rows = df.groupBy(*keys, tenor).agg(F.avg(known(value)).alias(value))
    curve = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(tenor, value))).alias("_s"))

    def one(t: np.ndarray, v: np.ndarray, x: float) -> dict:
        good = ~np.isnan(v)
        out = v if good.sum() < 2 else np.asarray(kernel(t, v, **{name: x}), float)
        bends = np.diff(out[~np.isnan(out)], n=2)
        errors = (out - v)[good & ~np.isnan(out)]
        return {"parameter": float(x), "n": len(errors), "errors": float((errors**2).sum()), "rough": float((bends**2).mean()) if len(bends) else None}

    @F.pandas_udf("array<struct<parameter:double,n:long,errors:double,rough:double>>")
    def tried(tenors: pd.Series, given: pd.Series) -> pd.Series:
        return pd.Series([[one(np.array(t, float), np.array(v, float), x) for x in values] for t, v in zip(tenors, given, strict=True)])

    nan = F.lit(float("nan"))
    each = curve.select(F.explode(tried(F.transform("_s", lambda s: s[tenor].cast("double")), F.transform("_s", lambda s: F.coalesce(s[value], nan)))).alias("r")).select("r.*")
    out = each.groupBy("parameter").agg((F.sum("errors") / F.nullif(F.sum("n"), F.lit(0))).alias("mse"), F.avg("rough").alias("roughness"))
    return out.withColumn("score", F.col("mse") / (F.col("roughness") + 1e-10))
