"""Operators on tiny tables with values known by hand, and against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline import sources
from strandline.functions import seconds_of_day, time_text
from strandline.kernels import solvers
from strandline.operators import asof, backtest, bonds, clean, compare, constraints, leadlag, orders, postprocess, regression, signature, smoothing, trend, windows


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), "x"), (2, 2.5, None)], "k int, v double, s string")
    sources.write_report({"summary": df, "other": df.limit(1)}, str(tmp_path))
    back = sources.read_table(spark, str(tmp_path / "summary"), "csv", "k int, v double, s string")
    assert sorted(rows(back), key=str) == [(1, None, "x"), (2, 2.5, None)]
    df.write.parquet(str(tmp_path / "p"))
    assert sources.read_table(spark, str(tmp_path / "p")).where("v IS NULL").count() == 1
    with pytest.raises(ValueError):
        sources.read_table(spark, "x", "csv")


def test_validation(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("inf"), None), (float("nan"), "b")], "x double, s string")
    got = {r.column_name: (r.present, r.n_null, r.n_infinite, r.ok) for r in clean.validate(df, ["x", "s", "z"]).collect()}
    assert got == {"x": (True, 1, 1, False), "s": (True, 1, 0, False), "z": (False, 0, 0, False)}
    with pytest.raises(ValueError):
        clean.require_valid(df, ["x"])
    assert clean.require_valid(df.where("s = 'a'"), ["x", "s"]).count() == 1


def test_returns_and_times(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("a", 3, 0.0), ("a", 4, 1.0)], "k string, t int, p double")
    got = [r.ret for r in clean.to_returns(df, ["k"], ["t"], "p", "returns").orderBy("t").collect()]
    assert got == [0, 1, -1, None]
    got = [r.ret for r in clean.to_returns(df, ["k"], ["t"], "p", first="drop").orderBy("t").collect()]
    assert got == [math.log(2), None, None]
    t = spark.createDataFrame([("01:02:03",), ("bad",), (None,), ("25:00:00",)], "s string")
    assert [r.v for r in t.select(seconds_of_day("s").alias("v")).collect()] == [3723, 0, 0, 0]
    assert spark.range(1).select(time_text(F.lit(3723)).alias("v")).first().v == "01:02:03"


def test_row_number_is_global_and_distributed(spark):
    n = 5000
    df = spark.range(n).select(F.xxhash64("id").alias("k"), (F.col("id") % 700).alias("t")).repartition(7)
    out = windows.with_row_number(df, ["t", "k"], parts=13).collect()
    want = {r: i for i, r in enumerate(sorted((r.t, r.k) for r in out))}
    assert all(want[(r.t, r.k)] == r.idx for r in out) and len(want) == n
    assert windows.with_row_number(df.limit(0), ["t"]).count() == 0


@pytest.mark.parametrize("size,stride,n", [(4, 2, 12), (5, 3, 17), (3, 5, 20), (10, 1, 9), (4, 4, 4)])
def test_window_membership(spark, size, stride, n):
    got = {(r.idx, r.window_id) for r in windows.assign_windows(spark.range(n).withColumnRenamed("id", "idx"), "idx", size, stride, n).collect()}
    count = (n - size) // stride + 1 if n >= size else 0
    assert got == {(i, w) for w in range(count) for i in range(w * stride, w * stride + size)}


def test_grids(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 5, 7.0)], "k string, i long, v double")
    assert sorted(rows(windows.densify(df, ["k"], "i", "v"))) == [("a", 2, 0), ("a", 3, 0), ("a", 4, 0), ("a", 5, 7)]
    ticks = spark.createDataFrame([("a", 10, 1.0), ("a", 12, 2.0), ("b", 31, 5.0), ("a", 12, 2.0)], "k string, ms long, v double")
    assert sorted(rows(windows.resample(ticks, ["k"], "ms", "v", 10).select("k", "slot", "v"))) == [("a", 0, 2), ("a", 1, 2), ("a", 2, 2), ("b", 0, 0), ("b", 1, 0), ("b", 2, 5)]
    df = spark.createDataFrame([("a", k, float(k)) for k in range(5)], "k string, t int, v double")
    out = windows.forward_context(df, ["k"], ["t"], "v", 3).orderBy("t").collect()
    assert out[4].context == [4, 0, 0] and out[4].context_length == 1 and out[0].context == [0, 1, 2]
    assert [r.y for r in windows.make_windows(df, ["k"], ["t"], ["v"], 2, 2, "v").orderBy("t").collect()] == [3, 4]
    assert [(r.chunk_id, r.chunk_row) for r in windows.chunk_ids(df, ["k"], ["t"], 2).orderBy("t").collect()] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]


def test_asof_ties_and_slabs(spark):
    left = spark.createDataFrame([("a", 5.0), ("a", 0.0), ("b", 1.0)], "k string, t double")
    right = spark.createDataFrame([("a", 3.0, "x"), ("a", 7.0, "y")], "k string, t double, v string")
    got = {r.t: (r.t_match, r.v) for r in asof.asof_join(left, right, "t", ["k"], ["v"]).collect()}
    assert got == {5.0: (3.0, "x"), 0.0: (3.0, "x")}
    assert asof.asof_join(left, right, "t", ["k"], ["v"], "backward").count() == 1
    r = random.Random(1)
    left = spark.createDataFrame([(r.choice("ab"), float(r.randint(0, 300)), k) for k in range(200)], "k string, t double, id int")
    right = spark.createDataFrame([(k, float(t), float(t)) for k in "ab" for t in r.sample(range(300), 40)], "k string, t double, v double")
    for how in ("backward", "forward", "nearest"):
        plain, slabs = (sorted(rows(asof.asof_join(left, right, "t", ["k"], ["v"], how, slab=s).select("id", "t_match", "v"))) for s in (None, 25.0))
        assert plain == slabs and len(plain) > 150


def naive_hy(a, b, shift):
    cov = 0.0
    for (s0, p0), (s1, p1) in zip(a, a[1:]):
        for (u0, q0), (u1, q1) in zip(b, b[1:]):
            if s1 > u0 + shift and u1 + shift > s0:
                cov += (p1 - p0) * (q1 - q0)
    return cov


def test_overlap_covariance_against_all_pairs(spark):
    r = random.Random(2)
    data, schema = [], "k int, t long, p double"
    a_rows, b_rows = [], []
    for k in range(12):
        a, b = ([(t, r.random()) for t in sorted(r.sample(range(40), r.randint(2, 12)))] for _ in range(2))
        data.append((k, a, b))
        a_rows += [(k, t, p) for t, p in a]
        b_rows += [(k, t, p) for t, p in b]
    out = asof.overlap_covariance(spark.createDataFrame(a_rows, schema), spark.createDataFrame(b_rows, schema), ["k"], "t", "p", [-5, 0, 3])
    got = {(x.k, x.shift): x.cov for x in out.collect()}
    for k, a, b in data:
        for s in (-5, 0, 3):
            assert abs(got[k, s] - naive_hy(a, b, s)) < 1e-9
    touch = [spark.createDataFrame([(0, t, float(p)) for t, p in x], schema) for x in ([(0, 0), (1, 1)], [(1, 0), (2, 1)])]
    assert asof.overlap_covariance(*touch, ["k"], "t", "p").first().cov == 0


def test_roughness_by_hand(spark):
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate([0.0, 1.0, 4.0, None, 9.0])], "k string, t int, v double")
    got = smoothing.roughness(df, ["k"], ["t"], "v").first()
    assert (got.n_valid, got.roughness, got.mean_abs_change, got.autocorr_lag1) == (4, 4, 3, None)


def test_smoothing_is_the_kernel_and_invariant(spark):
    from strandline.kernels import smoothers

    rng = np.random.default_rng(1)
    v = [None if x < -1.5 else float(x) for x in rng.normal(size=60)]
    df = spark.createDataFrame([("a", k, x) for k, x in enumerate(v)], "k string, t int, v double")
    want = smoothers.kalman(np.array([np.nan if x is None else x for x in v]))
    for part in (df, df.repartition(5).orderBy(F.rand(3))):
        got = [r.smooth for r in smoothing.smooth_time(part, ["k"], "t", "v", "kalman").orderBy("t").collect()]
        assert np.allclose(got, want)
    one = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 4.0)], "k string, t double, v double")
    assert rows(smoothing.smooth_tenor(one, ["k"], "t", "v", "nelson_siegel")) == [("a", 1.0, 3.0, 3.0)]


def test_comparisons_by_hand(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "c string") for s in ("aabb", "abbb"))
    assert compare.tv_distance(a, b, "c").first().tv == 0.25
    a, b = (spark.createDataFrame([(x,) for x in s], "v double") for s in ([0.0, 1.0], [1.0, 2.0]))
    assert compare.wasserstein(a, b, ["v"]).first().distance == 1
    df = spark.createDataFrame([("s", k, x) for k, x in enumerate(["buy", "buy", "sell"])], "k string, t int, side string")
    assert compare.persistence(df, ["k"], ["t"], "side", 1).first().persistence == 0.5
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "a int, p int")
    got = compare.classification_scores(df, "a", "p").first()
    assert got.accuracy == 75 and abs(got.kappa - 0.5) < 1e-12


def test_orders(spark):
    df = spark.createDataFrame([(1, 60, "y", 5, 2.5, "buy", 0, 1, 0)], "id int, time_s int, symbol string, quantity int, price double, side string, add int, modify int, delete int")
    v = orders.encode(df, ["x", "y"])
    assert v.first().vector == [60, 0, 1, 5, 2.5, 1, 0, 1, 0]
    back = orders.decode(v, ["x", "y"]).first()
    assert (back.d_symbol, back.d_side, back.d_modify, back.d_quantity) == ("y", "buy", 1, 5)
    vec = spark.createDataFrame([([0.0, 0.1, 0.2, 0.9, 1.0, 2.0, 0.6, 0.0, 0.0, 0.0],)], "vector array<double>")
    got = orders.decode(vec, ["p", "q", "r"]).first()
    assert (got.d_symbol, got.d_side) == ("r", "buy")
    e = spark.range(20000).selectExpr("id", "cast(id % 9 AS int) AS f", "1.5D AS q")
    m = orders.mask_fields(e, "id", {"f": 99}, ["q"])
    share = m.agg(F.avg((F.col("f_masked") == 99).cast("double"))).first()[0]
    assert abs(share - 0.15) < 0.01 and m.where("f_masked = 99 AND f_target <> f").count() == 0 and m.where("q_masked <> 0 AND q_target <> 0").count() == 0
    out = orders.resample_rows(e.limit(50), ["id"], 500)
    assert out.count() == 500 and out.select("id").distinct().count() > 45 and rows(out.orderBy("time").limit(5)) == rows(orders.resample_rows(e.limit(50), ["id"], 500).orderBy("time").limit(5))
    g = e.selectExpr("id", "f", "cast(id % 100 AS double) AS v")
    out = orders.resample_marginals(g, ["id"], 20000, ["v"], [["f"]]).agg(F.avg("v"), F.stddev("v"), F.avg("f")).first()
    assert abs(out[0] - 49.5) < 1 and abs(out[1] - 28.87) < 1 and abs(out[2] - 4) < 0.1
    real = spark.createDataFrame([(k, "xy"[k % 2], float(k % 5), float(k % 3), "bs"[k % 2], float(k)) for k in range(40)], "id int, symbol string, quantity double, price double, side string, time_s double")
    assert orders.overall_score(real, real, ["id"]).first().overall == 0


def test_signature_chunks_agree(spark):
    rng = np.random.default_rng(2)
    data = [("a", k, float(x), float(y)) for k, (x, y) in enumerate(rng.normal(size=(30, 2)))]
    df = spark.createDataFrame(data, "k string, t int, x double, y double")
    low = {r.term: r.value for r in signature.signature(df, ["k"], ["t"], ["x", "y"], 2).collect()}
    parts = {r.term: r.value for r in signature._chunked(df, ["k"], ["t"], ["x", "y"], 3, size=7).collect()}
    assert all(abs(parts[t] - v) < 1e-9 for t, v in low.items()) and len(parts) == 15
    corner = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 1.0)], "t int, x double, y double")
    got = {r.term: r.value for r in signature.signature(corner, [], ["t"], ["x", "y"]).collect()}
    assert got == {"": 1, "1": 1, "2": 1, "1,1": 0.5, "1,2": 1, "2,1": 0, "2,2": 0.5}


def test_positive_lag_means_the_first_leads(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=80)
    data = [("a", k, float(v)) for k, v in enumerate(x)] + [("b", k, float(x[k - 3]) if k >= 3 else 0.0) for k in range(80)]
    df = spark.createDataFrame(data, "s string, i long, v double")
    got = leadlag.all_methods(df, "s", "i", "v", 6, 0.01).first()
    assert got.correlation_lag == 3 and got.dtw_lag == 3 and got.path_lag in (2, 3)
    best = leadlag.best_lag(spark.createDataFrame([("a", "b", 1, -0.5), ("a", "b", 0, 0.5), ("a", "b", 2, None)], "a string, b string, lag int, score double")).first()
    assert best.lag == 0


IDENTITY = [(3 * q + i, *(float(i == j) for j in range(3)), float(i + 1)) for q in range(4) for i in range(3)]


def regression_table(spark, data=IDENTITY):
    return spark.createDataFrame([(*r[:4], "o", r[4]) for r in data], "idx long, a double, b double, c double, key string, y double")


def test_window_regression_on_identities(spark):
    df = regression_table(spark)
    g = regression.window_grams(df, "idx", 4, 2, 12, ["a", "b", "c"], "y", ["key"])
    assert sorted(r.window_id for r in g.collect()) == list(range(5))
    for r in regression.solve(g, 3).collect():
        assert np.allclose(r.w, [1, 2, 3], atol=1e-4)
    rules = spark.createDataFrame([("o", "fixed", 0, None, 2.0), ("o", "offset", 0, 1, 0.0), ("o", "offset", 1, 0, 0.0)], "key string, kind string, feature int, feature2 int, value double")
    for method, tol in (("kkt", 1e-6), ("penalty", 1e-5), ("qp", 1e-4)):
        for r in regression.solve(g, 3, method, rules=rules, keys=["key"]).collect():
            assert abs(r.w[0] - 2) < tol and abs(r.w[0] + r.w[1]) < tol
    scores = regression.fit_scores(regression.solve(g, 3), 3, ["window_id", "key"]).collect()
    assert all(s.r2 > 0.999 for s in scores)
    layered = regression.layered_fit(df, "idx", 4, 2, 12, ["a", "b", "c"], "y", ["key"], 2, rules)
    assert all(abs(r.w[0] - 2) < 1e-6 for r in layered.where("layer = 0").collect())
    bad = spark.createDataFrame([("o", "nonneg", 0, None, 0.0)], "key string, kind string, feature int, feature2 int, value double")
    with pytest.raises(Exception, match="can't hold"):
        regression.solve(g, 3, "kkt", rules=bad, keys=["key"]).collect()


@pytest.mark.parametrize("size,stride", [(20, 6), (15, 4), (10, 10)])
def test_block_grams_equal_row_grams(spark, size, stride):
    rng = np.random.default_rng(4)
    n, x, y = 67, rng.normal(size=(67, 3)), rng.normal(size=67)
    df = regression_table(spark, [(k, *map(float, x[k]), float(y[k])) for k in range(n)])
    out = regression.window_grams(df, "idx", size, stride, n, ["a", "b", "c"], "y", ["key"]).collect()
    assert len(out) == (n - size) // stride + 1
    for r in out:
        s = slice(r.window_id * stride, r.window_id * stride + size)
        assert np.allclose(regression.full_gram(np.array(r.xx), 3), x[s].T @ x[s]) and np.allclose(r.xy, x[s].T @ y[s]) and r.n == size


def test_post_processing(spark):
    w = spark.createDataFrame([(0, "o", f"f{k}", k, v) for k, v in enumerate([1.0, -3.0, 2.0, 2.0])], "window_id long, key string, feature string, feature_no int, w double")
    assert [r.w for r in postprocess.keep_top(w, ["window_id", "key"], 1).orderBy("feature_no").collect()] == [0, -3, 0, 0]
    assert [r.w for r in postprocess.keep_top(w, ["window_id", "key"], 2).orderBy("feature_no").collect()] == [0, -3, 0, 2]
    curve = spark.createDataFrame([("c", 2.0, "f", 0.2), ("c", 3.0, "f", 0.4), ("c", 50.0, "f", 1.0)], "country string, tenor double, feature string, w double")
    asked = spark.createDataFrame([("c", 2.5), ("c", 60.0), ("c", 3.0), ("d", 1.0)], "country string, tenor double")
    got = {r.tenor: (r.value, r.interpolated) for r in postprocess.interpolate_curve(curve, asked).collect()}
    assert got == {2.5: (0.3, True), 60.0: (1.0, True), 3.0: (0.4, False)}
    with pytest.raises(Exception, match="outside"):
        postprocess.interpolate_curve(curve, asked, "linear", "error").collect()


def test_rules_out_of_range_and_odd_masks_raise(spark):
    out = spark.createDataFrame([("c", "t")], "country string, tenor string")
    rules = spark.createDataFrame([("zero", None, None, 9, None, 0.0)], "kind string, countries array<string>, tenors array<string>, feature int, feature2 int, value double")
    with pytest.raises(Exception, match="out of range"):
        constraints.expand_rules(rules, out, 5).collect()
    mask = spark.createDataFrame([("k", 0, -1)], "key string, feature int, control int")
    with pytest.raises(Exception, match="odd number"):
        constraints.control_rules(mask, ["key"]).collect()


def test_trend_by_hand(spark):
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate([0.0, 1.0, 2.0, 4.0])], "k string, t int, v double")
    got = trend.rolling_trend(df, ["k"], ["t"], "v", 3).orderBy("start").collect()
    assert np.allclose([r.slope for r in got], [1, 1.5]) and got[0].t is None and got[0].p == 0 and got[0].significant and [r.centre for r in got] == [1, 2]


def test_backtest_and_bonds(spark):
    got = backtest.backtest_summary(spark.createDataFrame([(0.1,), (-0.1,)], "r double"), "r").first()
    assert abs(got.cumulative + 0.01) < 1e-12 and got.annual_sharpe == 0
    assert backtest.backtest_summary(spark.createDataFrame([(0.1,), (-1.0,), (-3.0,)], "r double"), "r").first().cumulative == -1
    b = spark.createDataFrame([(1, 0.0, 1.25, 2.0, 0.05), (2, 0.0, 0.3, 2.0, 0.05)], "bond int, ts double, te double, freq double, coupon double")
    s = bonds.bond_schedule(b)
    assert [(r.t, r.accrual) for r in s.where("bond = 1").orderBy("n").collect()] == [(0, 0), (0.75, 0.75), (1.25, 0.5)]
    assert [(r.t, r.accrual) for r in s.where("bond = 2").orderBy("n").collect()] == [(0, 0), (0.3, 0.3)]
    curve = spark.createDataFrame([(2.0, math.exp(-0.2))], "t double, df double")
    price = {r.bond: r.price for r in bonds.price_bonds(s, b, curve).collect()}
    assert abs(price[1] - (math.exp(-0.075) * 0.05 * 0.75 + math.exp(-0.125) * (1 + 0.05 * 0.5))) < 1e-12


def test_queries_have_unique_names():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and len(__spark_entry__.queries()) > 100


def test_ranges_follow_all_order_columns(spark):
    rows = [(None if k % 7 == 0 else 1, k % 50, "x" * (k % 3)) for k in range(600)]  # one hot first value, ties, nulls
    df = spark.createDataFrame(rows, "a int, b int, c string")
    got = windows.ranged(df, ["a", "b"], 8).select("a", "b", "_range").collect()
    assert len({r["_range"] for r in got}) > 3
    ordered = sorted(got, key=lambda r: ((r["a"] is not None, r["a"] or 0), r["b"]))
    assert [r["_range"] for r in ordered] == sorted(r["_range"] for r in got)
    totals = windows.running_total(df.withColumn("n", F.lit(2)), ["a", "b", "c"], "n").select("total").collect()
    assert sorted(r["total"] for r in totals) == list(range(2, 1201, 2))
    assert windows.ranged(df.limit(0), ["a"]).count() == 0 and windows.with_row_number(df.limit(0), ["a"]).count() == 0


def test_walk_forward_against_all_folds(spark):
    df = spark.range(40).select(F.col("id").alias("t"))
    got = {tuple(r) for r in windows.walk_forward(df, "t", 10, 5, 3, 33).select("t", "fold", "part").collect()}
    folds = (33 - 3 + 1 - 10) // 5
    want = {(t, k, "train" if t - 3 - 5 * k < 10 else "test") for t in range(40) for k in range(folds) if 0 <= t - 3 - 5 * k < 15}
    assert got == want
    assert windows.walk_forward(df, "t", 50, 5, 3, 33).count() == 0


def test_all_methods_are_the_single_ones(spark):
    rng = np.random.default_rng(5)
    base = np.cumsum(rng.normal(size=60))
    rows = [(s, t, float(np.roll(base, k)[t] + 0.01 * rng.normal())) for s, k in (("a", 0), ("b", 3), ("c", 1)) for t in range(60)]
    df = spark.createDataFrame(rows, "s string, t long, v double")
    lags = list(range(-5, 6))
    got = {(r["a"], r["b"]): r for r in leadlag.all_methods(df, "s", "t", "v", 5).collect()}
    assert len(got) == 3
    single = {
        "correlation_lag": leadlag.best_lag(leadlag.lagged_correlation(df, "s", "t", "v", lags)),
        "signature_lag": leadlag.best_lag(leadlag.signature_lags(df, "s", "t", "v", lags), "greatest"),
        "dtw_lag": leadlag.best_lag(leadlag.dtw_lags(df, "s", "t", "v", lags), "least"),
        "path_lag": leadlag.optimal_paths(df, "s", "t", "v", 1.0, 5),
    }
    for name, part in single.items():
        assert {(r["a"], r["b"]): r["lag"] for r in part.collect()} == {k: r[name] for k, r in got.items()}, name


def test_grid_search_is_one_smoother_per_value(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(k, float(t), float(rng.normal())) for k in range(3) for t in range(8)] + [(9, 1.0, 2.0)], "k int, t double, v double")
    got = {r["parameter"]: r for r in smoothing.grid_search(df, ["k"], "t", "v", "p_spline", "lam", [0.5, 2.0]).collect()}
    for lam in (0.5, 2.0):
        done = smoothing.smooth_tenor(df, ["k"], "t", "v", "p_spline", lam=lam)
        mse = done.agg(F.avg((F.col("smooth") - F.col("v")) ** 2)).first()[0]
        rough = smoothing.roughness(done, ["k"], ["t"], "smooth").agg(F.avg("roughness")).first()[0]
        assert np.isclose(got[lam]["mse"], mse) and np.isclose(got[lam]["roughness"], rough)


def test_qp_rules_together(spark):
    """Offset, sum and sign rules: the exact solution where no sign binds, the bound where one does; conflicts raise or fall back."""
    r = np.random.default_rng(4)
    rows = [(k % 2, *map(float, r.normal(size=3))) for k in range(400)]
    data = spark.createDataFrame([(g, a, b, c, float((2 * g - 1) * (a - b) + c + 0.1 * r.normal())) for g, a, b, c in rows], "g int, x1 double, x2 double, x3 double, y double")
    grams = regression.grams(data, ["g"], ["x1", "x2", "x3"], "y")
    rule = "g int, kind string, feature int, feature2 int, value double"
    rules = spark.createDataFrame([x for g in (0, 1) for x in ((g, "offset", 0, 1, 0.0), (g, "total", 0, None, 1.0), (g, "nonneg", 0, None, 0.0))], rule)
    got = {x.g: x.w for x in regression.solve(grams, 3, "qp", rules=rules, keys=["g"]).collect()}
    assert np.allclose(got[1], [1, -1, 1], atol=0.05) and abs(got[1][0] + got[1][1]) < 1e-12 and abs(got[1][2] - 1) < 1e-12
    assert np.allclose(got[0], [0, 0, 1], atol=1e-12)
    only = rules.where("kind = 'offset'")
    a, b = ({x.g: x.w for x in regression.solve(grams, 3, m, rules=only, keys=["g"]).collect()} for m in ("qp", "kkt"))
    assert all(np.allclose(a[g], b[g], atol=1e-10) for g in (0, 1))
    clash = rules.unionByName(spark.createDataFrame([(g, "nonpos", 2, None, 0.0) for g in (0, 1)], rule))
    plain = {x.g: x.w for x in regression.solve(grams, 3, keys=["g"]).collect()}
    back = {x.g: x.w for x in regression.solve(grams, 3, "qp", rules=clash, keys=["g"], on_conflict="ols").collect()}
    assert all(np.allclose(back[g], plain[g]) for g in (0, 1))
    with pytest.raises(Exception, match="contradict"):
        regression.solve(grams, 3, "qp", rules=clash, keys=["g"]).collect()


def test_huber_from_grams_is_huber_from_rows(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(300, 2))
    y = x @ [1.5, -0.7] + r.normal(size=300) + np.where(r.random(300) < 0.1, 40, 0)
    rows = [(k % 3, k, float(a), float(b), float(c)) for k, ((a, b), c) in enumerate(zip(x, y, strict=True))] + [(0, 999, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, i int, a double, b double, y double")
    got = {q.g: q.w for q in regression.solve_huber(df, ["g"], "i", ["a", "b"], "y").collect()}
    for g in range(3):
        assert np.allclose(got[g], solvers.huber(x[g::3], y[g::3]), atol=1e-9)


def test_tied_layers_by_hand(spark):
    """One window, two layers: w2 = -w1 after the fit, what is under the threshold refitted, residuals from what is left."""
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 2))
    y = x @ [2.0, 0.1]
    df = spark.createDataFrame([(k, "a", *map(float, x[k]), float(y[k])) for k in range(60)], "idx int, c string, x1 double, x2 double, y double")
    out = {q.layer: q.w for q in regression.tied_layers(df, "idx", 60, 60, 60, ["x1", "x2"], "y", ["c"], 2, ((0, 1),), 0.5, 1e6, True).collect()}
    g = x.T @ x
    refit = np.linalg.solve(g + np.diag([0, 1e6]), x.T @ y)
    first = np.array([solvers.ridge(g, x.T @ y)[0], refit[1]])
    assert np.allclose(out[0], first, atol=1e-9)
    left = y - x @ first
    plain = solvers.ridge(g, x.T @ left)
    masked = np.abs(plain) < 0.5
    want = np.where(masked, np.linalg.solve(g + np.diag(1e6 * masked), x.T @ left), [plain[0], -plain[0]])
    assert np.allclose(out[1], want, atol=1e-9)
    with pytest.raises(ValueError):
        regression.tied_layers(df, "idx", 60, 60, 60, ["x1", "x2"], "y", ["c"], 2, ((0, 1), (0, 1)))


def test_shared_grams(spark):
    r = random.Random(3)
    x = spark.createDataFrame([(k, r.random(), r.random() - 0.5) for k in range(40)], "idx int, x1 double, x2 double")
    y = spark.createDataFrame([(k, o, r.random()) for k in range(40) for o in "abc"], "idx int, o string, y double")
    columns = ["window_id", "o", "xx", "xy", "sx", "yy", "sy", "n"]
    key = lambda q: (q[0], q[1])
    got = sorted((tuple(q[c] for c in columns) for q in regression.shared_grams(x, y, "idx", 12, 8, 40, ["x1", "x2"], "y", ["o"]).collect()), key=key)
    want = sorted((tuple(q[c] for c in columns) for q in regression.window_grams(y.join(x, "idx"), "idx", 12, 8, 40, ["x1", "x2"], "y", ["o"]).collect()), key=key)
    assert len(got) == len(want) == 12
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and all(np.allclose(u, v, rtol=1e-12) for u, v in zip(a[2:], b[2:], strict=True))
    with pytest.raises(Exception, match="window_grams"):
        regression.shared_grams(x, y.where("NOT (o = 'b' AND idx = 13)"), "idx", 12, 8, 40, ["x1", "x2"], "y", ["o"]).collect()
