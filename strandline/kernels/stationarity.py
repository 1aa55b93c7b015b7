"""Unit-root and stationarity tests, Student-t tails and the local-level model, from the published formulas."""

from __future__ import annotations

from math import erf, exp, lgamma, log, sqrt

import numpy as np

# MacKinnon (1994), constant only, one variable: polynomial coefficients of the p-value's normal quantile,
# for small and large statistics, the split and the bounds.
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_SPLIT, ADF_LEAST, ADF_MOST = -1.61, -18.83, 2.74
# Kwiatkowski et al. (1992), level stationarity: statistics and their p-values.
KPSS_STATISTICS = (0.347, 0.463, 0.574, 0.739)
KPSS_P_VALUES = (0.10, 0.05, 0.025, 0.01)


def _continued_beta(a: float, b: float, x: np.ndarray, steps: int = 200) -> np.ndarray:
    """The continued fraction of the incomplete beta function (Lentz), for all x at once."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    c, d = np.ones_like(x), 1 / guard(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, steps):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / guard(1 + top * d), guard(1 + top / c)
            out *= c * d
        if np.abs(c * d - 1).max(initial=0.0) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function."""
    x = np.clip(np.asarray(x, float), 0.0, 1.0)
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    low = inner < (a + 1) / (a + b + 2)
    out = np.where(low, front * _continued_beta(a, b, np.where(low, inner, 0.5)) / a, 1 - front * _continued_beta(b, a, np.where(low, 0.5, 1 - inner)) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_two_sided(t: np.ndarray, dof: float) -> np.ndarray:
    """P(|T| > |t|) for all t; NaN stays NaN."""
    t = np.asarray(t, float)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.where(np.isfinite(t), dof / (dof + t * t), 0.0)
    return np.where(np.isnan(t), np.nan, incomplete_beta(dof / 2, 0.5, x))


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    w, *_ = np.linalg.lstsq(x, y, rcond=None)
    rss = float(((y - x @ w) ** 2).sum())
    cov = np.linalg.pinv(x.T @ x) * rss / max(len(y) - x.shape[1], 1)
    return w, np.sqrt(np.maximum(np.diag(cov), 0)), rss


def adf(y: np.ndarray, max_lag: int | None = None) -> tuple[float, float, int]:
    """Augmented Dickey-Fuller with a constant: statistic, MacKinnon p-value and the lag with the least AIC."""
    n = len(y)
    most = most_lags(n) if max_lag is None else max_lag
    if most < 0 or np.ptp(y) == 0:
        return float("nan"), float("nan"), 0
    d = np.diff(y)

    def design(lag: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(skip, len(d))
        return np.stack([y[rows], np.ones(len(rows)), *(d[rows - k] for k in range(1, lag + 1))], axis=1), d[rows]

    best = None
    for lag in range(most + 1):  # all lags over the same rows
        x, target = design(lag, most)
        rss = _ols(x, target)[2]
        aic = len(target) * (log(max(rss, 1e-300) / len(target)) + 1 + log(2 * np.pi)) + 2 * x.shape[1]
        if best is None or aic < best[0]:
            best = (aic, lag)
    x, target = design(best[1], best[1])
    w, error, _ = _ols(x, target)
    stat = w[0] / error[0] if error[0] > 0 else float("-inf")
    return float(stat), adf_p(stat), best[1]


def adf_p(stat: float) -> float:
    """MacKinnon's p-value of the statistic with a constant."""
    if stat > ADF_MOST:
        return 1.0
    if stat < ADF_LEAST:
        return 0.0
    z = sum(c * stat**k for k, c in enumerate(ADF_SMALL if stat <= ADF_SPLIT else ADF_LARGE))
    return 0.5 * (1 + erf(z / sqrt(2)))


def most_lags(n: int) -> int:
    return min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)


def adf_gram(y: np.ndarray, halo: int, first: int, most: int) -> np.ndarray:
    """Sums over rows of products of (y, 1, the `most` differences before, the difference), of the differences that end in y[halo:].

    y begins with up to most + 1 values ahead of its own, which are rows first ... of the series.  Rows with fewer differences before are left out.
    """
    d = np.diff(y)
    ends = np.arange(max(halo, 1), len(y))
    ends = ends[first - halo + ends >= most + 1]
    r = ends - 1
    z = np.stack([y[r], np.ones(len(r)), *(d[r - k] for k in range(1, most + 1)), d[r]], axis=1) if len(r) else np.zeros((0, most + 3))
    return z.T @ z


def adf_from_gram(gram: np.ndarray, head: np.ndarray, most: int) -> tuple[float, float, int]:
    """adf() from all rows' adf_gram() and the series' first most + 1 values."""
    rows = gram[1, 1]

    def fit(m: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray, float]:
        x, b, yy = m[: lag + 2, : lag + 2], m[: lag + 2, -1], m[-1, -1]
        inverse = np.linalg.pinv(x)
        w = inverse @ b
        return w, inverse, max(float(yy - w @ b), 0.0)

    costs = []
    for lag in range(most + 1):
        rss = fit(gram, lag)[2]
        costs.append(rows * (log(max(rss, 1e-300) / rows) + 1 + log(2 * np.pi)) + 2 * (lag + 2))
    best = int(np.argmin(costs))
    keep = [*range(best + 2), -1]
    m = gram[np.ix_(keep, keep)] + adf_gram(head, 0, 0, best)
    w, inverse, rss = fit(m, best)
    error = sqrt(max(float(inverse[0, 0]), 0.0) * rss / max(m[1, 1] - best - 2, 1))
    stat = float(w[0] / error) if error > 0 else float("-inf")
    return stat, adf_p(stat), best


def lag_sums(e: np.ndarray, halo: int, most: int) -> np.ndarray:
    """Sums of e[t] * e[t - k], k = 0 .. most, over t after the first `halo` values."""
    return np.array([e[halo:] @ e[halo - k : len(e) - k] if k <= halo else e[k:] @ e[: len(e) - k] for k in range(most + 1)])


def kpss_lag(sums: np.ndarray, n: int) -> int:
    """The lag of Hobijn et al. (1998) from sums of products at lags 0 .. n^(2/9)."""
    s0, s1 = sums[0] / n, 0.0
    for k in range(1, int(n ** (2 / 9)) + 1):
        s0, s1 = s0 + 2 * sums[k] / n, s1 + 2 * k * sums[k] / n
    return min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1) if s0 else 0


def kpss_from_sums(squares: float, sums: np.ndarray, n: int) -> tuple[float, float, int]:
    """kpss() from the sum of squared running sums, and sums of products at lags 0 .. kpss_lag()."""
    lag = len(sums) - 1
    variance = sums[0] / n + sum(2 * (1 - k / (lag + 1)) * sums[k] / n for k in range(1, lag + 1))
    stat = float(squares / n**2 / variance)
    return stat, float(np.interp(stat, KPSS_STATISTICS, KPSS_P_VALUES)), lag


def kpss(y: np.ndarray) -> tuple[float, float, int]:
    """KPSS level test: statistic, p-value interpolated in the table (clamped at its ends) and the automatic lag."""
    n = len(y)
    e = y - y.mean()
    if n < 3 or not (e**2).sum():
        return float("nan"), float("nan"), 0
    # the lag of Hobijn et al. (1998)
    cover = int(n ** (2 / 9))
    s0, s1 = (e**2).sum() / n, 0.0
    for k in range(1, cover + 1):
        c = 2 * (e[k:] * e[:-k]).sum() / n
        s0, s1 = s0 + c, s1 + k * c
    lag = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1) if s0 else 0
    variance = (e**2).sum() / n
    for k in range(1, lag + 1):
        variance += 2 * (1 - k / (lag + 1)) * (e[k:] * e[:-k]).sum() / n
    stat = float((np.cumsum(e) ** 2).sum() / n**2 / variance)
    return stat, float(np.interp(stat, KPSS_STATISTICS, KPSS_P_VALUES)), lag


def local_level(y: np.ndarray, ratio: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Filtered and smoothed level and the smoothed standard error; without a variance ratio, that of the greatest concentrated likelihood."""
    n = len(y)

    def run(ratio: float):
        level, p = np.empty(n), np.empty(n)
        level[0], p[0], total, logs = y[0], 1.0, 0.0, 0.0
        for k in range(1, n):
            prior = p[k - 1] + ratio
            f = prior + 1
            error = y[k] - level[k - 1]
            level[k], p[k] = level[k - 1] + prior / f * error, prior / f
            total, logs = total + error**2 / f, logs + log(f)
        sigma = total / max(n - 1, 1)
        return (n - 1) * log(max(sigma, 1e-300)) + logs, level, p, sigma

    low, high, golden = -12.0, 6.0, (sqrt(5) - 1) / 2
    for _ in range(60 if ratio is None else 0):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if run(exp(a))[0] < run(exp(b))[0] else (a, high)
    ratio = exp((low + high) / 2) if ratio is None else ratio
    _, level, p, sigma = run(ratio)
    smooth, variance = level.copy(), p.copy()
    for k in range(n - 2, -1, -1):
        gain = p[k] / (p[k] + ratio)
        smooth[k] += gain * (smooth[k + 1] - level[k])
        variance[k] += gain**2 * (variance[k + 1] - p[k] - ratio)
    return level, smooth, np.sqrt(np.maximum(variance * sigma, 0))


def level_variance(ratio: np.ndarray, k: int) -> np.ndarray:
    """The local-level filter's variance (of noise one) after row k >= 0: it depends on no value and soon stands still."""
    p = np.ones_like(ratio)
    for _ in range(k):
        q = (p + ratio) / (p + ratio + 1)
        if (q == p).all():
            break
        p = q
    return p


def level_map(y: np.ndarray, first: int, ratio: np.ndarray) -> np.ndarray:
    """What rows first ... of a series do to the filter's level L, for each ratio: a, c, q0, q1, q2, logs.

    L becomes a L + c; the squared errors over their variances are q0 - 2 q1 L + q2 L^2, and logs is the sum of log variances.
    """
    a, c = np.ones_like(ratio), np.zeros_like(ratio)
    q0, q1, q2, logs = (np.zeros_like(ratio) for _ in range(4))
    p = level_variance(ratio, first - 1) if first else np.ones_like(ratio)
    for k, v in enumerate(y):
        if first + k == 0:
            a, c = np.zeros_like(ratio), np.full_like(ratio, v)
            continue
        f = p + ratio + 1
        miss = v - c
        q0, q1, q2, logs = q0 + miss**2 / f, q1 + miss * a / f, q2 + a**2 / f, logs + np.log(f)
        p = (f - 1) / f
        a, c = a * (1 - p), c + p * miss
    return np.stack([a, c, q0, q1, q2, logs])


def level_rows(y: np.ndarray, first: int, ratio: float, level: float) -> tuple[np.ndarray, np.ndarray]:
    """Filtered levels and variances (of noise one) of rows first ..., from the level before them."""
    out, variance = np.empty(len(y)), np.empty(len(y))
    p = float(level_variance(np.array([ratio]), first - 1)[0]) if first else 1.0
    for k, v in enumerate(y):
        if first + k == 0:
            level = v
        else:
            p = (p + ratio) / (p + ratio + 1)
            level = level + p * (v - level)
        out[k], variance[k] = level, p
    return out, variance


def level_smoothed(level: np.ndarray, variance: np.ndarray, ratio: float, after: float, after_variance: float) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed levels and variances of rows, from those of the row after them (NaN: none is)."""
    smooth, var = level.copy(), variance.copy()
    for k in range(len(level) - 1, -1, -1):
        if after == after:
            gain = variance[k] / (variance[k] + ratio)
            smooth[k] += gain * (after - level[k])
            var[k] += gain**2 * (after_variance - variance[k] - ratio)
        after, after_variance = smooth[k], var[k]
    return smooth, var


def level_back(level: np.ndarray, variance: np.ndarray, ratio: float) -> np.ndarray:
    """a, c, b, d, s, v: the first row's smoothed level is a x + c and its variance b x + d of those of the row after the last; s and v if none is."""
    gain = variance / (variance + ratio)
    s0, v0 = level_smoothed(level, variance, ratio, 0.0, 0.0)
    s, v = level_smoothed(level, variance, ratio, np.nan, np.nan)
    return np.array([gain.prod(), s0[0], (gain**2).prod(), v0[0], s[0], v[0]])
