"""Series in slabs give what whole series give, wherever they are cut."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import backtest, clean, compare, regression, signature, slabs, smoothing, trend, windows


@pytest.fixture(scope="module")
def series(spark):
    """One hot series with gaps, one that begins with a long gap, short ones, one without values, one without a key."""
    r = random.Random(7)
    rows = []
    for key, n in (("hot", 400), ("late", 60), ("a", 3), ("b", 1), ("none", 9), (None, 25)):
        for t in range(n):
            gone = key == "none" or (key == "late" and t < 40) or r.random() < 0.25 or (key == "hot" and 150 < t < 185)
            rows.append((key, t * 3 % 1000 + t // 1000, None if gone else r.choice([float("nan"), 5.0 + r.random(), 3 + math.sin(t / 9)]) if r.random() < 0.1 else 5 + math.sin(t / 5) + r.random()))
    return spark.createDataFrame(rows, "k string, t int, v double").repartition(5).cache()


def table(df, columns):
    key = lambda row: tuple((x is None, x if x is not None else 0) for x in row[:2])
    return sorted((tuple(row[c] for c in columns) for row in df.collect()), key=key)


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or (u != u and v != v) or (isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-9)), (x, y)


@pytest.mark.parametrize("method", ["ewma", "double_ewma", "kalman", "gaussian_process", "moving_average", "savitzky_golay", "hodrick_prescott"])
def test_smoothers(spark, series, method):
    params = {"gaussian_process": {"history": 30}, "hodrick_prescott": {"history": 25}, "moving_average": {"window": 4}}.get(method, {})
    want = table(smoothing.smooth_time(series, ["k"], "t", "v", method, parts=0, **params), ["k", "t", "v", "smooth"])
    for parts in (2, 13):
        close(table(smoothing.smooth_time(series, ["k"], "t", "v", method, parts=parts, **params), ["k", "t", "v", "smooth"]), want)


def test_windows_over_rows(series):
    for parts in (3, 40):
        for f, columns in (
            (lambda p: clean.to_returns(series, ["k"], ["t"], "v", "diff", parts=p), ["k", "t", "ret"]),
            (lambda p: clean.to_returns(series, ["k"], ["t"], "v", "log_returns", "drop", parts=p), ["k", "t", "ret"]),
            (lambda p: trend.rolling_trend(series, ["k"], ["t"], "v", 5, parts=p), ["k", "t", "start", "centre", "slope", "stderr", "p", "significant"]),
            (lambda p: backtest.rolling_sharpe(series.where("NOT isnan(v)"), ["k"], ["t"], "v", 30, parts=p), ["k", "t", "rolling_sharpe", "time_to_target"]),
            (lambda p: windows.lead_lag_embedding(series, ["k"], ["t"], "v", parts=p).na.fill(0.0), ["k", "t", "lag1"]),
            (lambda p: windows.shifted(series.na.fill(0.0), ["k"], ["t"], "v", -40, parts=p), ["k", "t", "shifted"]),
            (lambda p: windows.local_derivative(series, ["k"], ["t"], "t", "v", parts=p), ["k", "t", "slope", "remainder"]),
            (lambda p: windows.forward_context(series, ["k"], ["t"], "v", 9, parts=p).withColumn("s", F.aggregate("context", F.lit(0.0), lambda a, x: 2 * a + x)), ["k", "t", "context_length", "s"]),
            (lambda p: windows.make_windows(series.na.fill(0.0), ["k"], ["t"], ["v"], 6, 3, "v", parts=p).withColumn("s", F.aggregate("x", F.lit(0.0), lambda a, x: 2 * a + x.v)), ["k", "t", "s", "y"]),
            (lambda p: smoothing.roughness(series, ["k"], ["t"], "v", parts=p), ["k", "n_valid", "roughness", "variance", "mean_abs_change", "volatility", "rms_second", "autocorr_lag1"]),
        ):
            nan = lambda rows: [tuple(None if isinstance(x, float) and math.isnan(x) else x for x in row) for row in rows]
            close(nan(table(f(parts), columns)), nan(table(f(0), columns)))


def test_halo_looks_both_ways_over_many_slabs(series):
    w = lambda by: Window.partitionBy(*by).orderBy("t").rowsBetween(-35, 20)
    f = lambda d, by: d.withColumn("n", F.count(F.lit(1)).over(w(by))).withColumn("s", F.sum("t").over(w(by)))
    want = table(f(series, ["k"]), ["k", "t", "n", "s"])
    close(table(slabs.in_slabs(series, ["k"], ["t"], f, 35, 20, parts=60), ["k", "t", "n", "s"]), want)
    cut = slabs.with_halo(series, ["k"], ["t"], 20, 1)
    assert cut.where("k = 'hot' AND NOT _halo").select("_range").distinct().count() > 10
    assert max(r["count"] for r in cut.groupBy("_range", "k").count().collect()) < 100


def test_numbers_and_carried_values(series):
    close(table(slabs.numbered(series, ["k"], ["t"], "n", 17), ["k", "t", "n"]), table(slabs.numbered(series, ["k"], ["t"], "n", 0), ["k", "t", "n"]))
    some = series.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    close(table(slabs.carried(some, ["k"], ["t"], "v", 17), ["k", "t", "v"]), table(slabs.carried(some, ["k"], ["t"], "v", 0), ["k", "t", "v"]))


def test_size_decides(series):
    assert slabs.parts_for(series, ["k"]) == 0
    assert slabs.parts_for(series, ["k"], most=100) == 1 + 4 * 498 // 100
    assert slabs.parts_for(series.where("false"), ["k"], most=1) == 0


def test_warm_starts(spark):
    w = spark.createDataFrame([(t, o, f, float(t * 7 % 5 - 2)) for t in range(120) for o in "ab" for f in "xy"], "window_id long, o string, feature string, w double")
    columns = ["o", "window_id", "feature", "w", "warm"]
    order = lambda df: sorted(table(df, columns), key=str)
    close(order(regression.warm_started(w, ["o"], parts=9)), order(regression.warm_started(w, ["o"], parts=0)))


def test_row_numbers_with_a_hot_first_value(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, 5).otherwise(F.col("id") % 97).alias("a"), F.xxhash64("id").alias("b"))
    got = windows.with_row_number(df, ["a", "b"]).collect()
    assert [r.idx for r in sorted(got, key=lambda r: (r.a, r.b))] == list(range(20_000))
    ranges = windows.ranged(df, ["a", "b"]).groupBy("_range").count().collect()
    assert max(r["count"] for r in ranges) < 2_000


def test_signatures_of_cut_paths(spark):
    r = random.Random(3)
    rows = [(k, t, r.random(), r.random() + t / 50) for k in ("a", "b", None) for t in range(3 if k == "b" else 150)]
    df = spark.createDataFrame(rows, "k string, t int, x double, y double").repartition(4)
    for level in (1, 2, 3):
        columns = ["k", "term", "value"]
        order = lambda d: sorted(table(d, columns), key=str)
        close(order(signature.signature(df, ["k"], ["t"], ["x", "y"], level, parts=11)), order(signature.signature(df, ["k"], ["t"], ["x", "y"], level, parts=0)))
    whole = {s.term: s.value for s in signature.signature(df.where("k = 'a'"), [], ["t"], ["x", "y"], 2).collect()}
    keyed = {s.term: s.value for s in signature.signature(df.where("k = 'a'"), ["k"], ["t"], ["x", "y"], 2, parts=0).collect()}
    assert whole.keys() == keyed.keys() and all(math.isclose(whole[t], keyed[t], abs_tol=1e-9) for t in keyed)


def test_distances_and_persistence_in_ranges(spark):
    r = random.Random(5)
    a, b = (spark.createDataFrame([(r.choice("pq"), t, float(r.choice([r.gauss(m, 1), 7.0])), r.choice("bs")) for t in range(300)], "g string, t int, v double, s string") for m in (0, 0.5))
    for by in (None, ["g"]):
        one, cut = ({(x[0] if by else ""): x.distance for x in compare.wasserstein(a, b, ["v"], by, parts=p).collect()} for p in (0, 23))
        assert one.keys() == cut.keys() and all(math.isclose(one[k], cut[k], rel_tol=1e-12) for k in one)
    x, y = (compare.persistence(a, ["g"], ["t"], "s", 9, parts=p).first()[0] for p in (0, 23))
    assert math.isclose(x, y, rel_tol=1e-12)
    z = slabs.running(a, ["g"], ["t"], {"c": "v"}, 23)
    close(table(z, ["g", "t", "c"]), table(slabs.running(a, ["g"], ["t"], {"c": "v"}, 0), ["g", "t", "c"]))


def test_level_series_in_slabs(spark):
    r = random.Random(9)
    rows = []
    for key, n in (("hot", 300), ("b", 40), ("c", 2)):
        level = 0.0
        for t in range(n):
            level += r.gauss(0, 0.4)
            rows.append((key, t, None if t % 17 == 5 else level + r.gauss(0, 1)))
    df = spark.createDataFrame(rows, "k string, t int, v double").repartition(4)
    columns = ["k", "t", "v", "filtered", "smoothed", "stderr"]
    close(table(trend.level_series(df, ["k"], "t", "v", 0.3, parts=9), columns), table(trend.level_series(df, ["k"], "t", "v", 0.3, parts=0), columns))
    hot = df.where("k <> 'c'")  # of two values the likelihood has no single top
    got, want = (table(trend.level_series(hot, ["k"], "t", "v", parts=p), columns) for p in (7, 0))
    assert len(got) == len(want) == len([x for x in rows if x[0] != "c" and x[2] is not None])
    assert all(math.isclose(a, b, rel_tol=1e-5, abs_tol=1e-6) for x, y in zip(got, want, strict=True) for a, b in zip(x[3:], y[3:], strict=True))


def test_stationarity_from_sums_of_slabs(spark):
    r = random.Random(11)
    rows, walk, noise = [], 0.0, 0.0
    for t in range(500):
        walk, noise = walk + r.gauss(0, 1), 0.5 * noise + r.gauss(0, 1)
        rows += [("walk", t, walk), ("noise", t, 7 + noise)] + ([("short", t, noise), ("flat", t, 3.0)] if t < 30 else [])
    df = spark.createDataFrame(rows, "k string, t int, v double").repartition(4)
    one, cut = ({x.k: x for x in trend.stationarity(df, ["k"], "t", "v", level=False, parts=p).collect()} for p in (0, 12))
    assert one.keys() == cut.keys() and not one["walk"].stationary and one["noise"].stationary
    for k in one:
        for c in ("n", "adf", "adf_p", "adf_lag", "kpss", "kpss_p", "kpss_lag", "stationary"):
            u, v = one[k][c], cut[k][c]
            assert u == v or (u != u and v != v) or math.isclose(u, v, rel_tol=1e-6, abs_tol=1e-9), (k, c, u, v)
