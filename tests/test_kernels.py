"""Kernels against hand values and direct formulas."""

import numpy as np
import pytest

from strandline.kernels import curves, paths, smoothers, solvers, stationarity

NAN = float("nan")


def test_ewma_and_kalman_by_hand():
    assert smoothers.ewma(np.array([NAN, 2, NAN, 4]), 0.5).tolist() == [2, 2, 2, 3]
    assert smoothers.kalman(np.array([0.0, 1.0]), 0.0, 1.0).tolist() == [0, 0.5]
    assert np.isnan(smoothers.ewma(np.array([NAN, NAN]))).all()
    assert smoothers.moving_average(np.array([1, NAN, NAN, 5.0]), 2).tolist() == [1, 1, 1, 5]


@pytest.mark.parametrize("method", sorted(smoothers.METHODS))
@pytest.mark.parametrize("gaps", [False, True])
def test_smoothers_are_causal(method, gaps):
    rng = np.random.default_rng(1)
    v = rng.normal(size=180).cumsum()
    if gaps:
        v[rng.random(180) < 0.2] = NAN
    bent = v.copy()
    bent[120:] = bent[120:] * 2 + 0.01
    a, b = smoothers.METHODS[method](v), smoothers.METHODS[method](bent)
    assert len(a) == 180 and np.nanmax(np.abs(a[:120] - b[:120])) < 1e-10


def test_gaussian_process_directly():
    v = np.sin(np.arange(30) / 3)
    out = smoothers.gaussian_process(v)
    t = np.arange(20)
    k = np.exp(-0.5 * ((t[:, None] - t) / 10) ** 2) + (0.1 + 1e-6) * np.eye(20)
    guess = np.exp(-0.5 * ((20 - t) / 10) ** 2) @ np.linalg.solve(k, v[:20])
    assert abs(out[20] - (v[20] + 0.1 * guess) / 1.1) < 1e-9


def test_polynomials_pass_through_fits():
    v = np.arange(60.0) ** 2 / 100
    assert np.allclose(smoothers.savitzky_golay(v)[11:], v[11:])
    assert np.allclose(smoothers.hodrick_prescott(np.arange(50.0))[20:], np.arange(20.0, 50))


def test_curves():
    t = np.array([0.25, 0.5, 1, 2, 3, 5, 7, 10, 15, 20, 30])
    for f in (curves.nelson_siegel, curves.svensson):
        level, hump = curves._decay(t, 2.0)
        assert np.allclose(f(t, 1 + 2 * level - hump), 1 + 2 * level - hump)
    assert np.allclose(curves.polynomial(t, 1 + t - t**2 / 50, 2), 1 + t - t**2 / 50)
    assert np.allclose(curves.local_quadratic(t, 1 + t - t**2 / 50), 1 + t - t**2 / 50)
    assert np.allclose(curves.bernstein(t, t**3), t**3)
    basis = curves.b_splines(t, 5)
    assert np.allclose(basis.sum(axis=1), 1) and (basis >= -1e-12).all()
    line = curves.p_spline(t, 2 + 3 * t, lam=1e6)
    assert np.allclose(line, 2 + 3 * t, atol=1e-3)
    v = np.where(t == 3, NAN, t)
    for f in curves.METHODS.values():
        assert not np.isnan(f(t, v)).any()
    assert np.isnan(curves.nelson_siegel(t, np.where(t == 3, 1.0, NAN))).sum() == 10


def test_splines_reproduce_cubics_and_stay_monotone():
    x = np.array([0, 1, 2.5, 4, 7, 8.0])
    at = np.linspace(-1, 9, 41)
    assert np.allclose(curves.cubic_at(x, x**3 - x, at), at**3 - at)
    y = np.array([0, 0, 1, 1, 5, 9.0])
    fine = curves.pchip_at(x, y, np.linspace(0, 8, 500))
    assert (np.diff(fine) >= -1e-12).all() and np.allclose(curves.pchip_at(x, y, x), y)


def systems(seed, p=5, n=60):
    rng = np.random.default_rng(seed)
    x, w = rng.normal(size=(n, p)), rng.normal(size=p)
    y = x @ w + 0.1 * rng.normal(size=n)
    return x, y, x.T @ x, x.T @ y


def test_kkt_and_penalty():
    x, y, g, b = systems(1)
    fixed, zeros, offsets = {0: 2.0}, {3}, {(1, 2)}
    a, c = solvers.equalities(5, fixed, zeros, offsets)
    w = solvers.kkt(g, b, a, c, 0.0)
    assert abs(w[0] - 2) < 1e-9 and abs(w[3]) < 1e-9 and abs(w[1] + w[2]) < 1e-9
    # by substitution: free are w1 (= -w2) and w4
    z = np.stack([x[:, 1] - x[:, 2], x[:, 4]], axis=1)
    u = np.linalg.lstsq(z, y - 2 * x[:, 0], rcond=None)[0]
    assert np.allclose(w[[1, 4]], u)
    assert np.allclose(solvers.penalty(g, b, fixed, zeros, offsets, 0.0), w, atol=1e-5)
    assert np.allclose(solvers.kkt(g, b, np.concatenate([a, a]), np.concatenate([c, c]), 0.0), w)
    with pytest.raises(ValueError):
        solvers.equalities(5, {0: 1.0}, {0}, set())
    with pytest.raises(ValueError):
        solvers.equalities(5, {}, {9}, set())


def test_box_meets_its_conditions():
    for seed in range(5):
        _, _, g, b = systems(seed)
        low, high = np.full(5, -np.inf), np.full(5, np.inf)
        assert np.allclose(solvers.box(g, b, low, high, reg=0.0), np.linalg.solve(g, b), atol=1e-7)
        w = solvers.box(g, b, np.zeros(5), high, reg=0.0)
        grad = g @ w - b
        assert (w >= 0).all() and (grad[w == 0] >= -1e-6).all() and np.abs(grad[w > 0]).max(initial=0) < 1e-5
        w = solvers.box(g, b, low, high, total=1.0, reg=0.0)
        a = np.linalg.solve(np.block([[g, np.ones((5, 1))], [np.ones((1, 5)), np.zeros((1, 1))]]), np.append(b, 1.0))
        assert np.allclose(w, a[:5], atol=1e-5)
        w = solvers.box(g, b, low, high, l1=20.0, reg=0.0)
        grad = g @ w - b
        assert (np.abs(grad[w == 0]) <= 20 + 1e-5).all() and np.allclose(grad[w != 0], -20 * np.sign(w[w != 0]), atol=1e-5)


def test_huber_resists_outliers():
    x, y, g, b = systems(3, n=200)
    w = np.linalg.solve(g, b)
    bad = y.copy()
    bad[::20] += 50
    assert np.abs(solvers.huber(x, bad, 0.5) - w).max() < 0.1 < np.abs(solvers.ridge(g, x.T @ bad) - w).max()


def test_asymmetric_ridge_conditions():
    _, _, g, b = systems(4)
    s = solvers.shrunk_covariance(g, 60, 0.3)
    w = solvers.asymmetric(g, b, s, 1.0, 10.0)
    assert np.abs(g @ w - b + s @ w + 2 * np.where(w > 0, 1.0, 10.0) * w).max() < 1e-6
    assert np.allclose(np.diag(s), np.diag(g) / 60) and np.allclose(solvers.shrunk_covariance(g, 60, 0.0), g / 60)


def naive_dtw(x, y, squared):
    d = np.full((len(x) + 1, len(y) + 1), np.inf)
    d[0, 0] = 0
    for i in range(len(x)):
        for j in range(len(y)):
            c = (x[i] - y[j]) ** 2 if squared else abs(x[i] - y[j])
            d[i + 1, j + 1] = c + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return np.sqrt(d[-1, -1]) if squared else d[-1, -1]


def test_alignments():
    rng = np.random.default_rng(2)
    for _ in range(10):
        x, y = rng.normal(size=rng.integers(1, 12)), rng.normal(size=rng.integers(1, 12))
        for squared in (False, True):
            assert abs(paths.dtw(x, y, squared) - naive_dtw(x, y, squared)) < 1e-9
            assert abs(paths.dtw(x, y, squared, band=50) - naive_dtw(x, y, squared)) < 1e-9
    y = rng.normal(size=60).cumsum()
    path, cost = paths.optimal_path(y[3:], y[:-3], 0.001)
    assert cost < 20 and abs(np.median(path - np.arange(57)) - 3) <= 1


def test_thermal_path_against_plain_sums():
    rng = np.random.default_rng(3)
    x, y, n = rng.normal(size=7), rng.normal(size=7), 7
    g = np.zeros((n, n))
    g[0, 0] = g[0, 1] = g[1, 0] = 1
    for i in range(1, n):
        for j in range(1, n):
            g[i, j] = (g[i, j - 1] + g[i - 1, j] + g[i - 1, j - 1]) * np.exp(-((x[i] - y[j]) ** 2) / 2.0)
    average, last = paths.thermal_path(x, y, 2.0)
    assert abs(last - np.log(g[-1, -1])) < 1e-9
    t = 6
    cells = [(i, t - i) for i in range(n)]
    assert abs(average[t] - sum((j - i) * g[i, j] for i, j in cells) / sum(g[i, j] for i, j in cells)) < 1e-9


def test_signatures():
    path = np.array([[0, 0], [1, 0], [1, 1.0]])
    got = dict(zip(paths.words(2, 2), paths.signature(path, 2)))
    assert got == {(): 1, (1,): 1, (2,): 1, (1, 1): 0.5, (1, 2): 1, (2, 1): 0, (2, 2): 0.5}
    rng = np.random.default_rng(4)
    path = rng.normal(size=(9, 3))
    whole = paths.signature(path, 3)
    levels = lambda v: [v[0].reshape(()), v[1:4], v[4:13].reshape(3, 3), v[13:].reshape(3, 3, 3)]
    parts = paths.chen(levels(paths.signature(path[:5], 3)), levels(paths.signature(path[4:], 3)))
    assert np.allclose(np.concatenate([np.ravel(x) for x in parts]), whole)


def test_stationarity_tests():
    rng = np.random.default_rng(6)
    noise, walk = rng.normal(size=400), rng.normal(size=400).cumsum()
    assert stationarity.adf(noise)[1] < 0.01 < 0.1 < stationarity.adf(walk)[1]
    assert stationarity.kpss(noise)[1] > 0.05 > stationarity.kpss(walk)[1]
    # the table's own points
    assert abs(stationarity.t_two_sided(2.0106, 48) - 0.05) < 1e-4 and abs(stationarity.t_two_sided(0.0, 5) - 1) < 1e-12
    level, smooth, error = stationarity.local_level(noise)
    assert len(level) == 400 and np.std(smooth) <= np.std(level) + 1e-9 and (error >= 0).all()
    assert np.isnan(stationarity.adf(np.ones(30))[0])


def best_by_enumeration(g, b, a, c, low, high, l1, norm):
    """Minimum over all choices of signs, zeros and bounds that bind: each an equality-constrained system."""
    import itertools

    p, best = len(b), (np.inf, None)
    for state in itertools.product(("-", "0", "+", "low", "high"), repeat=p):
        for tight in (False, True) if norm is not None else (False,):
            rows, values, sign = [*a], [*c], np.zeros(p)
            for k, s in enumerate(state):
                if s in "-+":
                    sign[k] = 1.0 if s == "+" else -1.0
                    continue
                v = {"0": 0.0, "low": low[k], "high": high[k]}[s]
                if not np.isfinite(v):
                    break
                sign[k] = np.sign(v)
                rows.append(np.eye(p)[k])
                values.append(v)
            else:
                if tight:
                    rows.append(sign)
                    values.append(norm)
                m = np.array(rows).reshape(len(rows), p)
                kkt = np.block([[g, m.T], [m, np.zeros((len(rows), len(rows)))]])
                w = np.linalg.lstsq(kkt, np.concatenate([b - l1 * sign, values]), rcond=None)[0][:p]
                if np.abs(m @ w - values).max(initial=0) < 1e-8 and (w >= low - 1e-8).all() and (w <= high + 1e-8).all() and (norm is None or np.abs(w).sum() <= norm + 1e-8):
                    cost = w @ g @ w / 2 - b @ w + (l1 * np.abs(w)).sum()
                    best = min(best, (cost, tuple(w)))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_ruled_is_the_best_of_all_working_sets(seed):
    r = np.random.default_rng(seed)
    p = 3 + seed % 2
    x = r.normal(size=(40, p)) * r.uniform(0.1, 30, p)
    y = x @ r.normal(size=p) + r.normal(size=40)
    g, b = x.T @ x, x.T @ y
    offset = np.zeros(p)
    offset[:2] = 1
    a, c = {0: (np.zeros((0, p)), np.zeros(0)), 1: (offset[None], np.zeros(1)), 2: (np.vstack([offset, np.ones(p)]), np.array([0.0, 1.0]))}[seed % 3]
    low = np.where(r.random(p) < 0.5, 0.0, -np.inf)
    high = np.where(low < 0, r.choice([0.0, 0.7, np.inf], p), np.inf)
    high[-1] = np.inf
    l1 = r.choice([0.0, 20.0, 200.0], p)
    norm = 1.6 if seed % 4 > 1 else None
    w = solvers.ruled(g, b, a, c, low, high, l1, norm, reg=0.0)
    cost, want = best_by_enumeration(g, b, a, c, low, high, l1, norm)
    assert np.isclose(w @ g @ w / 2 - b @ w + (l1 * np.abs(w)).sum(), cost, rtol=1e-9, atol=1e-8) and np.allclose(w, want, atol=1e-6)
    assert np.abs(a @ w - c).max(initial=0) < 1e-10 and (w >= low - 1e-10).all() and (w <= high + 1e-10).all()


def test_ruled_equals_kkt_where_no_bound_binds_and_is_quick():
    import time

    r = np.random.default_rng(1)
    x = r.normal(size=(200, 3))
    y = x @ np.array([0.3, -0.2, 0.8]) + r.normal(size=200)
    g, b = x.T @ x, x.T @ y
    a, c = solvers.equalities(3, {}, set(), {(0, 1)})
    free = np.full(3, np.inf)
    assert np.allclose(solvers.ruled(g, b, a, c, -free, free), solvers.kkt(g, b, a, c), atol=1e-12)
    with pytest.raises(ValueError):
        solvers.ruled(g, b, np.vstack([a, [[1, 0, 0], [0, 1, 0]]]), np.array([0, 1, 1.0]), -free, free)
    with pytest.raises(ValueError):
        solvers.ruled(g, b, np.ones((1, 3)), np.array([1.0]), -free, np.zeros(3))
    x = r.normal(size=(300, 7))
    g, many = x.T @ x, x.T @ r.normal(size=(300, 200))
    start = time.thread_time()
    for k in range(200):
        w = solvers.ruled(g, many[:, k], np.ones((1, 7)), np.ones(1), np.zeros(7), np.full(7, np.inf))
        grad = g @ w + 1e-6 * w - many[:, k]
        on = w > 1e-10
        assert abs(w.sum() - 1) < 1e-10 and np.ptp(grad[on]) < 1e-8 * np.abs(grad).max() and (grad >= grad[on].min() - 1e-8 * np.abs(grad).max()).all()
    assert time.thread_time() - start < 2
