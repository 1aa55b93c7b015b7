"""Rolling trends and stationarity of series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import known
from ..kernels import stationarity as tests
from ..sources import kept
from . import slabs


def rolling_trend(df: DataFrame, keys: list[str], order: list[str], value: str, window: int = 50, alpha: float = 0.05, parts: int | None = None) -> DataFrame:
    """keys, order, start, centre, slope, stderr, t, p, significant for each full window that ends at a row.

    Ordinary least squares on the row number with window - 2 degrees of freedom, from the moments of each window; a
    perfect fit has stderr 0, no t and p 0 (p 1 if it is flat).  Windows with missing values are left out.  Series too long
    for a task are cut (slabs.parts_for).
    """
    spread = window * (window**2 - 1) / 12

    def moments(d: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        back = w.rowsBetween(-(window - 1), 0)
        d = d if "_n" in d.columns else d.withColumn("_n", F.row_number().over(w))
        return d.withColumn("_c", F.count("_v").over(back)).withColumn("_xy", F.regr_sxy("_v", "_n").over(back)).withColumn("_yy", F.regr_syy("_v", "_n").over(back))

    rows = df.withColumn("_v", known(value))
    parts = slabs.parts_for(rows, keys, parts)
    if parts:
        rows = slabs.numbered(rows, keys, order, "_n", parts).withColumn("_n", F.col("_n") + 1)
    rows = slabs.in_slabs(rows, keys, order, moments, window - 1, parts=parts).where(F.col("_c") == window)
    left = F.col("_yy") - F.col("_xy") * F.col("_xy") / spread
    rows = rows.withColumn("slope", F.col("_xy") / spread).withColumn("_rss", F.when(left > 1e-13 * F.col("_yy"), left).otherwise(0.0))
    rows = rows.withColumn("stderr", F.sqrt(F.col("_rss") / (window - 2) / spread)).withColumn("t", F.try_divide("slope", "stderr"))

    @F.pandas_udf("double")
    def p_value(t: pd.Series) -> pd.Series:
        return pd.Series(np.nan_to_num(tests.t_two_sided(t.to_numpy(), window - 2), nan=0.0))

    rows = rows.withColumn("p", F.when((F.col("stderr") == 0) & (F.col("slope") == 0), 1.0).otherwise(p_value(F.coalesce("t", F.lit(float("nan"))))))
    start = (F.col("_n") - window).cast("long")
    return rows.select(*keys, *order, start.alias("start"), (start + window // 2).alias("centre"), "slope", "stderr", "t", "p", (F.col("p") < alpha).alias("significant"))


def last_significant(trends: DataFrame, keys: list[str]) -> DataFrame:
    """keys, centre, slope, p of the last significant window."""
    last = trends.where("significant").groupBy(*keys).agg(F.max_by(F.struct("centre", "slope", "p"), "start").alias("m"))
    return last.select(*keys, "m.*")


def stationarity(df: DataFrame, keys: list[str], order: str, value: str, alpha: float = 0.05, level: bool = True, parts: int | None = None) -> DataFrame:
    """keys, n, adf, adf_p, adf_lag, kpss, kpss_p, kpss_lag, stationary and, where stationary, the local-level model's last state.

    stationary: ADF rejects a unit root and KPSS does not reject a level.  Missing values are left out.  A series of more rows than
    a task may hold (slabs.parts_for) is cut into slabs, whose sums of products at all lags add up; it has no level states
    here (see level_series).
    """
    parts = slabs.parts_for(df, keys, parts)
    if parts:
        return _stationary_slabs(df, keys, order, value, alpha, parts)
    one = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda r: r[value].cast("double")).alias("v"))

    @F.pandas_udf("struct<adf:double,adf_p:double,adf_lag:long,kpss:double,kpss_p:double,kpss_lag:long,level:double,smoothed:double,level_stderr:double>")
    def report(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            y = np.array(v, float)
            a, k = tests.adf(y), tests.kpss(y)
            state = (None, None, None)
            if level and a[1] < alpha and k[1] >= alpha:
                filtered, smooth, error = tests.local_level(y)
                state = (filtered[-1], smooth[len(y) // 2], error[len(y) // 2])
            out.append((*a, *k, *state))
        return pd.DataFrame(out, columns=["adf", "adf_p", "adf_lag", "kpss", "kpss_p", "kpss_lag", "level", "smoothed", "level_stderr"])

    out = one.select(*keys, F.size("v").cast("long").alias("n"), report("v").alias("r")).select(*keys, "n", "r.*")
    return out.withColumn("stationary", (F.col("adf_p") < alpha) & (F.col("kpss_p") >= alpha))


def _stationary_slabs(df: DataFrame, keys: list[str], order: str, value: str, alpha: float, parts: int) -> DataFrame:
    rows = df.select(*keys, order, known(value).alias(value)).where(F.col(value).isNotNull())
    starts = lambda sizes: list(np.cumsum([0.0, *(s[0] for s in sizes)])[:-1, None])
    cut = slabs.handed_on(slabs.gathered(rows, keys, order, value, parts), keys, "_at", lambda v: [len(v)], starts, "_v")
    whole = rows.groupBy(*keys).agg(F.array(F.count(value).cast("double"), F.avg(value)).alias("_w"))
    cut = slabs._same(cut, whole, keys)
    cut = kept(cut.withColumn("_v", F.transform("_v", lambda x: x - F.col("_w")[1])))

    def tails(v: np.ndarray, most: int) -> np.ndarray:
        return np.concatenate([[most], v[len(v) - min(len(v), most) :]])

    def halos(ends: list[np.ndarray]) -> list[np.ndarray]:
        out, last = [], np.zeros(0)
        for t in ends:
            out.append(last)
            last = np.concatenate([last, t[1:]])
            last = last[len(last) - min(len(last), int(t[0])) :]
        return out

    def added(name: str, of, *columns: str) -> DataFrame:
        """keys, name: arrays of(columns) of the slabs, added up, by blocks of ranges first."""
        part = with_halo.select("_range", *keys, slabs._applied(of, *columns).alias("_a"))
        total = _applied_sum()
        for block in (F.floor(F.col("_range") / 64), F.lit(0)):
            lists = part.groupBy(block.alias("_b"), *keys).agg(F.collect_list(F.struct("_range", "_a")).alias("_l"))
            part = lists.select(F.col("_b").alias("_range"), *keys, total(F.transform(F.sort_array("_l"), lambda r: r["_a"])).alias("_a"))
        return part.select(*keys, F.col("_a").alias(name))

    lags = lambda w: max(tests.most_lags(int(w[0])), 0)
    with_halo = slabs.handed_on(cut, keys, "_h", lambda v, w: tails(v, lags(w) + 1), halos, "_v", "_w")
    gram = added("_g", lambda v, h, at, w: tests.adf_gram(np.concatenate([h, v]), len(h), int(at[0]), lags(w)).ravel(), "_v", "_h", "_at", "_w")
    # the first values, as far as they are in a slab: later fits start before all lags are known
    first = added("_first", lambda v, at, w: np.where((at[0] <= (k := np.arange(lags(w) + 1))) & (k < at[0] + len(v)), v[np.clip(k - int(at[0]), 0, len(v) - 1)], 0.0), "_v", "_at", "_w")
    # running sums from a slab's start, and what has been summed before it
    cover = lambda w: int(w[0] ** (2 / 9))
    with_halo = slabs.handed_on(cut, keys, "_h", lambda v, w: tails(v, cover(w)), halos, "_v", "_w")
    near = added("_near", lambda v, h, w: tests.lag_sums(np.concatenate([h, v]), len(h), cover(w)), "_v", "_h", "_w")

    @F.pandas_udf("array<double>")
    def lag_of(near: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([[float(tests.kpss_lag(np.array(s, float), int(x[0])))] for s, x in zip(near, w, strict=True)])

    lag = kept(slabs._same(near, whole, keys).select(*keys, lag_of("_near", "_w").alias("_lag")))
    cut = slabs._same(cut, lag, keys)
    with_halo = slabs.handed_on(cut, keys, "_h", lambda v, k: tails(v, int(k[0])), halos, "_v", "_lag")
    far = added("_far", lambda v, h, k: tests.lag_sums(np.concatenate([h, v]), len(h), int(k[0])), "_v", "_h", "_lag")
    with_halo = slabs.handed_on(cut, keys, "_in", lambda v: [v.sum()], lambda sums: list(np.cumsum([0.0, *(s[0] for s in sums)])[:-1, None]), "_v")
    squares = added("_q", lambda v, s: [((np.cumsum(v) + s[0]) ** 2).sum()], "_v", "_in")
    one = whole
    for part in (gram, first, far, squares):
        one = slabs._same(one, part, keys)

    @F.pandas_udf("struct<adf:double,adf_p:double,adf_lag:long,kpss:double,kpss_p:double,kpss_lag:long,level:double,smoothed:double,level_stderr:double>")
    def report(w: pd.Series, gram: pd.Series, first: pd.Series, far: pd.Series, squares: pd.Series) -> pd.DataFrame:
        out = []
        for x, g, head, s, q in zip(w, gram, first, far, squares, strict=True):
            n, most, s = int(x[0]), tests.most_lags(int(x[0])), np.array(s, float)
            flat = s[0] <= 1e-24 * n * max(x[1] ** 2, 1e-300)
            a = (np.nan, np.nan, 0) if most < 0 or flat else tests.adf_from_gram(np.array(g, float).reshape(most + 3, most + 3), np.array(head, float), most)
            k = (np.nan, np.nan, 0) if n < 3 or flat else tests.kpss_from_sums(q[0], s, n)
            out.append((*a, *k, None, None, None))
        return pd.DataFrame(out, columns=["adf", "adf_p", "adf_lag", "kpss", "kpss_p", "kpss_lag", "level", "smoothed", "level_stderr"])

    out = one.select(*keys, F.col("_w")[0].cast("long").alias("n"), report("_w", "_g", "_first", "_far", "_q").alias("r")).select(*keys, "n", "r.*")
    return out.withColumn("stationary", (F.col("adf_p") < alpha) & (F.col("kpss_p") >= alpha))


def _applied_sum():
    @F.pandas_udf("array<double>")
    def total(lists: pd.Series) -> pd.Series:
        return pd.Series([np.sum([np.array(a, float) for a in one], axis=0) for one in lists])

    return total


def trend_report(df: DataFrame, keys: list[str], order: str, value: str, window: int = 50, alpha: float = 0.05) -> DataFrame:
    """stationarity() with the number of significant windows and the last one."""
    trends = rolling_trend(df, keys, [order], value, window, alpha)
    counts = trends.groupBy(*keys).agg(F.count("*").alias("n_windows"), F.count_if("significant").alias("n_significant"))
    last = last_significant(trends, keys).select(*keys, F.col("centre").alias("last_centre"), F.col("slope").alias("last_slope"))
    return stationarity(df, keys, order, value, alpha).join(counts, keys, "left").join(last, keys, "left")


#: Ratios tried at once, and rounds of narrowing, of a long series' variance ratio: 18 / 16**9 is left of its logarithm's range.
GRID, ROUNDS = 33, 9


def level_series(df: DataFrame, keys: list[str], order: str, value: str, ratio: float | None = None, parts: int | None = None) -> DataFrame:
    """keys, order, value, filtered, smoothed, stderr: the local-level model's series, a row for each known value.

    ratio is the level's variance over the noise's; without one each series gets that of the greatest likelihood.  A series of more
    rows than a task may hold (slabs.parts_for) is cut into slabs: the filter is an affine map of the level in each, the
    errors' sum a quadratic one, so a likelihood is a sum over slabs; smoothing hands states back from slab to slab.
    """
    rows = df.select(*keys, order, known(value).alias(value)).where(F.col(value).isNotNull())
    parts = slabs.parts_for(rows, keys, parts)
    if parts:
        return _level_slabs(rows, keys, order, value, ratio, parts)
    one = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("_s"))

    @F.pandas_udf("struct<f:array<double>,s:array<double>,e:array<double>>")
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tests.local_level(np.array(v, float), ratio) for v in values], columns=["f", "s", "e"])

    one = one.withColumn("_r", run(F.transform("_s", lambda r: r[value])))
    return _level_rows(one.select(*keys, "_s", "_r.*"), keys, order, value)


def _level_rows(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    rows = series.select(*keys, F.explode(F.arrays_zip("_s", "f", "s", "e")).alias("z"))
    return rows.select(*keys, f"z._s.{order}", f"z._s.{value}", F.col("z.f").alias("filtered"), F.col("z.s").alias("smoothed"), F.col("z.e").alias("stderr"))


def _level_slabs(rows: DataFrame, keys: list[str], order: str, value: str, ratio: float | None, parts: int) -> DataFrame:
    starts = lambda sizes: list(np.cumsum([0.0, *(s[0] for s in sizes)])[:-1, None])
    cut = kept(slabs.handed_on(slabs.gathered(rows, keys, order, value, parts), keys, "_at", lambda v: [len(v)], starts, "_v"))
    span = cut.select(*keys).distinct().withColumns({"_lo": F.array(F.lit(-12.0)), "_hi": F.array(F.lit(6.0))})
    if ratio is not None:
        span = span.withColumns({c: F.array(F.lit(float(np.log(ratio)))) for c in ("_lo", "_hi")})
    for _ in range(ROUNDS if ratio is None else 0):
        tried = lambda v, at, lo, hi: tests.level_map(v, int(at[0]), np.exp(np.linspace(lo[0], hi[0], GRID))).ravel()
        each = slabs._same(cut, span, keys).select("_range", *keys, "_lo", "_hi", slabs._applied(tried, "_v", "_at", "_lo", "_hi").alias("_a"), F.size("_v").alias("_n"))
        series = each.groupBy(*keys, "_lo", "_hi").agg(F.sort_array(F.collect_list(F.struct("_range", "_a"))).alias("_l"), F.sum("_n").alias("_n"))

        @F.pandas_udf("array<double>")
        def narrowed(lists: pd.Series, n: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
            out = []
            for maps, k, a, b in zip(lists, n, lo, hi, strict=True):
                level, total, logs = np.zeros(GRID), np.zeros(GRID), np.zeros(GRID)
                for m in maps:
                    p, c, q0, q1, q2, g = np.array(m, float).reshape(6, GRID)
                    total, logs, level = total + q0 - 2 * q1 * level + q2 * level**2, logs + g, p * level + c
                cost = (k - 1) * np.log(np.maximum(total / max(k - 1, 1), 1e-300)) + logs
                best, grid = int(np.argmin(cost)), np.linspace(a[0], b[0], GRID)
                out.append([grid[max(best - 1, 0)], grid[min(best + 1, GRID - 1)]])
            return pd.Series(out)

        found = series.select(*keys, narrowed(F.transform("_l", lambda r: r["_a"]), "_n", "_lo", "_hi").alias("_z"))
        span = kept(found.select(*keys, F.array(F.col("_z")[0]).alias("_lo"), F.array(F.col("_z")[1]).alias("_hi")))
    cut = slabs._same(cut, span.select(*keys, F.array(F.exp((F.col("_lo")[0] + F.col("_hi")[0]) / 2)).alias("_q")), keys)

    def levels(maps: list[np.ndarray]) -> list[np.ndarray]:
        before, level, total, n = [], 0.0, 0.0, 0.0
        for a, c, q0, q1, q2, _, size in maps:
            before.append(level)
            total, level, n = total + q0 - 2 * q1 * level + q2 * level**2, a * level + c, n + size
        return [np.array([x, total / max(n - 1, 1)]) for x in before]

    cut = slabs.handed_on(cut, keys, "_l", lambda v, at, q: [*tests.level_map(v, int(at[0]), q)[:, 0], len(v)], levels, "_v", "_at", "_q")

    def handed_back(maps: list[np.ndarray]) -> list[np.ndarray]:
        out, state = [], np.array([np.nan, np.nan])
        for a, c, b, d, s, v in reversed(maps):
            out.append(state)
            state = np.array([s, v]) if np.isnan(state[0]) else np.array([a * state[0] + c, b * state[1] + d])
        return out[::-1]

    back = lambda v, at, q, state: tests.level_back(*tests.level_rows(v, int(at[0]), q[0], state[0]), q[0])
    cut = slabs.handed_on(cut, keys, "_b", back, handed_back, "_v", "_at", "_q", "_l")

    @F.pandas_udf("struct<f:array<double>,s:array<double>,e:array<double>>")
    def run(v: pd.Series, at: pd.Series, q: pd.Series, level: pd.Series, after: pd.Series) -> pd.DataFrame:
        out = []
        for y, first, ratio_, (before, sigma), (s, w) in zip(v, at, q, level, after, strict=True):
            filtered, variance = tests.level_rows(np.array(y, float), int(first[0]), ratio_[0], before)
            smooth, var = tests.level_smoothed(filtered, variance, ratio_[0], s, w)
            out.append((filtered, smooth, np.sqrt(np.maximum(var * sigma, 0))))
        return pd.DataFrame(out, columns=["f", "s", "e"])

    cut = cut.withColumn("_r", run("_v", "_at", "_q", "_l", "_b"))
    return _level_rows(cut.select(*keys, "_s", "_r.*"), keys, order, value)
