"""Smoothers and interpolators of one curve: tenors ascending and distinct, values with NaN for missing ones."""

from __future__ import annotations

from math import comb

import numpy as np


def filled(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Missing values by linear interpolation, clamped at the ends; fewer than two known values stay as they are."""
    good = ~np.isnan(v)
    return v if good.all() or good.sum() < 2 else np.interp(t, t[good], v[good])


def _usable(v: np.ndarray) -> bool:
    return len(v) > 1 and not np.isnan(v).any()


def _range(v: np.ndarray) -> float:
    return float(v.max() - v.min())


def _least_squares(basis: np.ndarray, v: np.ndarray) -> np.ndarray:
    return basis @ np.linalg.lstsq(basis, v, rcond=None)[0]


def bernstein(t: np.ndarray, v: np.ndarray, degree: int = 5) -> np.ndarray:
    """Least squares on the Bernstein basis of scaled tenors; the filled curve if the fit's range collapses under 1 %."""
    v = filled(t, v)
    if not _usable(v):
        return v
    s = (t - t[0]) / (t[-1] - t[0])
    out = _least_squares(np.stack([comb(degree, k) * s**k * (1 - s) ** (degree - k) for k in range(degree + 1)], axis=1), v)
    return v if _range(out) < 0.01 * _range(v) else out


def b_splines(t: np.ndarray, segments: int, degree: int = 3) -> np.ndarray:
    """B-spline basis on equal segments of the range of t, by the Cox-de Boor recursion."""
    step = (t[-1] - t[0]) / segments
    knots = t[0] + step * np.arange(-degree, segments + degree + 1)
    cell = np.clip(((t - t[0]) / step).astype(int), 0, segments - 1)
    basis = np.zeros((len(t), len(knots) - 1))
    basis[np.arange(len(t)), cell + degree] = 1.0
    for k in range(1, degree + 1):
        left = (t[:, None] - knots[: -k - 1]) / (k * step)
        right = (knots[k + 1 :] - t[:, None]) / (k * step)
        basis = left * basis[:, :-1] + right * basis[:, 1:]
    return basis


def p_spline(t: np.ndarray, v: np.ndarray, lam: float | None = None, degree: int = 3, segments: int = 10) -> np.ndarray:
    """B-splines with a penalty on second differences; lam by generalised cross-validation if None, 0 interpolates.

    The filled curve if the fit's range falls under 10 %.
    """
    v = filled(t, v)
    if not _usable(v) or lam == 0 or len(v) < 4:
        return v
    basis = b_splines(t, min(segments, len(t)), degree)
    d = np.diff(np.eye(basis.shape[1]), n=2, axis=0)
    best, out = np.inf, v
    for x in 10.0 ** np.arange(-6, 5) if lam is None else [lam]:
        hat = basis @ np.linalg.solve(basis.T @ basis + x * d.T @ d + 1e-12 * np.eye(basis.shape[1]), basis.T)
        fit, free = hat @ v, len(v) - np.trace(hat)
        score = len(v) * ((v - fit) ** 2).sum() / max(free, 1e-9) ** 2
        if score < best:
            best, out = score, fit
    return v if _range(out) < 0.1 * _range(v) else out


def cubic_at(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Not-a-knot cubic spline through (x, y); with fewer than four points the polynomial through them."""
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x - x[0], y, n - 1), at - x[0])
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    a, rhs = np.zeros((n, n)), np.zeros(n)
    for k in range(1, n - 1):
        a[k, k - 1 : k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
        rhs[k] = 6 * (slope[k] - slope[k - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, rhs)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    d = at - x[k]
    return y[k] + d * (slope[k] - h[k] * (2 * m[k] + m[k + 1]) / 6) + d**2 * m[k] / 2 + d**3 * (m[k + 1] - m[k]) / (6 * h[k])


def pchip_at(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone cubic (Fritsch and Carlson, harmonic means; one-sided three-point slopes at the ends)."""
    h, s = np.diff(x), np.diff(y) / np.diff(x)
    if len(x) == 2:
        return y[0] + s[0] * (at - x[0])
    d = np.zeros(len(x))
    same = s[:-1] * s[1:] > 0
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        d[1:-1] = np.where(same, (w1 + w2) / (w1 / s[:-1] + w2 / s[1:]), 0.0)
    for end, (h0, h1, s0, s1) in ((0, (h[0], h[1], s[0], s[1])), (-1, (h[-1], h[-2], s[-1], s[-2]))):
        slope = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
        if slope * s0 <= 0:
            slope = 0.0
        elif s0 * s1 <= 0 and abs(slope) > 3 * abs(s0):
            slope = 3 * s0
        d[end] = slope
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    u = (at - x[k]) / h[k]
    return y[k] * (1 + 2 * u) * (1 - u) ** 2 + h[k] * d[k] * u * (1 - u) ** 2 + y[k + 1] * u**2 * (3 - 2 * u) + h[k] * d[k + 1] * u**2 * (u - 1)


def _through(at_known):
    def smooth(t: np.ndarray, v: np.ndarray) -> np.ndarray:
        good = ~np.isnan(v)
        return v if good.sum() < 2 else np.where(good, v, at_known(t[good], v[good], t))

    return smooth


cubic_spline, monotone_spline = _through(cubic_at), _through(pchip_at)


def _decay(t: np.ndarray, tau: float) -> tuple[np.ndarray, np.ndarray]:
    m = np.maximum(t, 0.01) / tau
    level = (1 - np.exp(-m)) / m
    return level, level - np.exp(-m)


def nelson_siegel(t: np.ndarray, v: np.ndarray, tau: float = 2.0) -> np.ndarray:
    v = filled(t, v)
    return _least_squares(np.stack([np.ones(len(t)), *_decay(t, tau)], axis=1), v) if _usable(v) else v


def svensson(t: np.ndarray, v: np.ndarray, tau1: float = 2.0, tau2: float = 5.0) -> np.ndarray:
    v = filled(t, v)
    return _least_squares(np.stack([np.ones(len(t)), *_decay(t, tau1), _decay(t, tau2)[1]], axis=1), v) if _usable(v) else v


def polynomial_ridge(t: np.ndarray, v: np.ndarray, degree: int = 5, alpha: float = 0.1) -> np.ndarray:
    """Ridge on powers of the tenor; the intercept is penalised too."""
    v = filled(t, v)
    if not _usable(v):
        return v
    x = t[:, None] ** np.arange(degree + 1)
    # as a least-squares problem with extra rows, which is stable where the normal equations of high powers are not
    rows = np.concatenate([x, np.sqrt(alpha) * np.eye(degree + 1)])
    return x @ np.linalg.lstsq(rows, np.concatenate([v, np.zeros(degree + 1)]), rcond=None)[0]


def polynomial(t: np.ndarray, v: np.ndarray, degree: int = 4) -> np.ndarray:
    return polynomial_ridge(t, v, min(degree, len(t) - 1), 0.0)


def local_quadratic(t: np.ndarray, v: np.ndarray, bandwidth: float = 5.0) -> np.ndarray:
    """At each tenor a quadratic with Gaussian weights around it."""
    v = filled(t, v)
    if not _usable(v):
        return v
    out = np.empty(len(t))
    for k, centre in enumerate(t):
        root = np.exp(-((t - centre) ** 2) / (4 * bandwidth**2))
        x = (t - centre)[:, None] ** np.arange(3)
        out[k] = np.linalg.lstsq(x * root[:, None], v * root, rcond=None)[0][0]
    return out


METHODS = {"bernstein": bernstein, "p_spline": p_spline, "cubic_spline": cubic_spline, "monotone_spline": monotone_spline, "nelson_siegel": nelson_siegel, "svensson": svensson, "polynomial_ridge": polynomial_ridge, "polynomial": polynomial, "local_quadratic": local_quadratic, "none": filled}
