"""Alignment and path kernels for two short series or one path."""

from __future__ import annotations

import itertools

import numpy as np


def dtw(x: np.ndarray, y: np.ndarray, squared: bool = False, band: int | None = None) -> float:
    """Exact dynamic time warping distance: sum of |x - y|, or the root of summed squares; row by row in linear memory."""
    n, m = len(x), len(y)
    if not n or not m:
        return float("nan")
    before = np.full(m + 1, np.inf)
    before[0] = 0.0
    places = np.arange(1, m + 1)
    for i in range(n):
        cost = np.abs(x[i] - y)
        if squared:
            cost = cost**2
        if band is not None:
            cost = np.where(np.abs(places - 1 - i * (m - 1) / max(n - 1, 1)) <= band, cost, np.inf)
        step = np.minimum(before[1:], before[:-1])
        now = np.full(m + 1, np.inf)
        finite = np.isfinite(cost)
        if finite.all():  # now[j] = cost[j] + min(step[j], now[j - 1]), as a running minimum over prefix sums
            total = np.cumsum(cost)
            now[1:] = total + np.minimum.accumulate(step - (total - cost))
        else:
            left = np.inf
            for j in np.flatnonzero(finite):
                left = cost[j] + min(step[j], now[j])
                now[j + 1] = left
        before = now
    return float(np.sqrt(before[-1]) if squared else before[-1])


def dtw_tile(x: np.ndarray, y: np.ndarray, top: np.ndarray | None, left: np.ndarray | None, corner: float | None, first_i: int, first_j: int, n: int, m: int, squared: bool = False, band: int | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Rows first_i ... and columns first_j ... of the n x m matrix of dtw(), from its borders: last row, last column and last cell (not rooted)."""
    inside = np.full(len(x), np.inf) if left is None else left
    before = np.concatenate([[0.0 if first_i == first_j == 0 else np.inf if corner is None else corner], np.full(len(y), np.inf) if top is None else top])
    right = np.empty(len(x))
    places = first_j + np.arange(len(y))
    for i in range(len(x)):
        cost = np.abs(x[i] - y)
        if squared:
            cost = cost**2
        step = np.minimum(before[1:], before[:-1])
        ok = np.ones(len(y), bool) if band is None else np.abs(places - (first_i + i) * (m - 1) / max(n - 1, 1)) <= band
        now = np.full(len(y) + 1, np.inf)
        now[0] = inside[i]
        if ok.all():
            total = np.cumsum(cost)
            now[1:] = total + np.minimum(np.minimum.accumulate(step - (total - cost)), inside[i])
        else:
            for j in np.flatnonzero(ok):
                now[j + 1] = cost[j] + min(step[j], now[j])
        right[i] = now[-1]
        before = now
    return before[1:], right, float(before[-1])


def thermal_tile(x: np.ndarray, y: np.ndarray, top: np.ndarray | None, left: np.ndarray | None, corner: float | None, first_i: int, first_j: int, temperature: float = 1.0):
    """A tile of thermal_path()'s log weights from its borders: last row, last column, first diagonal, and of each diagonal peak, weight and moment of b - a, last cell."""
    n, m = len(x), len(y)
    g = np.full((n + 1, m + 1), -np.inf)
    if top is not None:
        g[0, 1:] = top
    if left is not None:
        g[1:, 0] = left
    if corner is not None:
        g[0, 0] = corner
    peaks, weights, moments = np.full(n + m - 1, -np.inf), np.zeros(n + m - 1), np.zeros(n + m - 1)
    with np.errstate(divide="ignore"):
        for t in range(n + m - 1):
            i = np.arange(max(0, t - m + 1), min(t, n - 1) + 1)
            j = t - i
            parts = np.stack([g[i + 1, j], g[i, j + 1], g[i, j]])
            peak = parts.max(axis=0)
            on = np.isfinite(peak)
            line = np.where(on, peak + np.log(np.exp(parts - np.where(on, peak, 0)).sum(axis=0)), -np.inf) - (x[i] - y[j]) ** 2 / temperature
            # the edges of the whole matrix: one at the corner and beside it, zero beyond
            edge = (first_i + i == 0) | (first_j + j == 0)
            line = np.where(edge, np.where(first_i + i + first_j + j <= 1, 0.0, -np.inf), line)
            g[i + 1, j + 1] = line
            if np.isfinite(line.max()):
                share = np.exp(line - line.max())
                peaks[t], weights[t], moments[t] = line.max(), share.sum(), (share * (first_j + j - first_i - i)).sum()
    return g[-1, 1:], g[1:, -1], first_i + first_j, peaks, weights, moments, float(g[-1, -1])


def path_band(x: np.ndarray, y: np.ndarray, first_j: int, given: tuple[np.ndarray, np.ndarray] | None, beta: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """optimal_path()'s least costs after these rows and the sums of the columns of the paths, from those before; without any, the first row begins."""
    places = first_j + np.arange(len(y)).astype(float)
    begin = 0
    if given is None:
        cost, total, begin = (x[0] - y) ** 2, places.copy(), 1
    else:
        cost, total = given
    at = np.arange(len(y))
    for i in range(begin, len(x)):
        options = np.stack([np.concatenate([[np.inf], cost[:-1]]) + beta, cost, np.concatenate([cost[1:], [np.inf]]) + beta])
        back = options.argmin(axis=0)
        total = total[np.clip(at + back - 1, 0, len(y) - 1)] + places
        cost = (x[i] - y) ** 2 + options.min(axis=0)
    return cost, total


def optimal_path(x: np.ndarray, y: np.ndarray, beta: float = 1.0) -> tuple[np.ndarray, float]:
    """For each i the j of the cheapest path: squared distances plus beta for each step of j by one; first choice wins ties."""
    n, m = len(x), len(y)
    cost = (x[0] - y) ** 2
    back = np.zeros((n, m), np.int8)
    for i in range(1, n):
        options = np.stack([np.concatenate([[np.inf], cost[:-1]]) + beta, cost, np.concatenate([cost[1:], [np.inf]]) + beta])
        back[i] = options.argmin(axis=0) - 1
        cost = (x[i] - y) ** 2 + options.min(axis=0)
    path = np.empty(n, np.int64)
    path[-1] = int(cost.argmin())
    for i in range(n - 1, 0, -1):
        path[i - 1] = path[i] + back[i, path[i]]
    return path, float(cost.min())


def thermal_path(x: np.ndarray, y: np.ndarray, temperature: float = 1.0) -> tuple[np.ndarray, float]:
    """Average thermal path over anti-diagonals (mean of b - a) and the log of the partition function at the end.

    Both are cut to the shorter length.  Each diagonal is rescaled, so that long series do not underflow; the boundary
    starts with weight one at the corner and its two neighbours and is zero beyond.
    """
    n = min(len(x), len(y))
    g = np.full((n, n), -np.inf)
    g[0, 0] = 0.0
    if n > 1:
        g[0, 1] = g[1, 0] = 0.0
    average = np.zeros(2 * n - 1)
    with np.errstate(divide="ignore"):
        for t in range(2 * n - 1):
            a = np.arange(max(0, t - n + 1), min(t, n - 1) + 1)
            b = t - a
            inner = (a > 0) & (b > 0)
            i, j = a[inner], b[inner]
            if len(i):
                parts = np.stack([g[i, j - 1], g[i - 1, j], g[i - 1, j - 1]])
                top = parts.max(axis=0)
                g[i, j] = np.where(np.isfinite(top), top + np.log(np.exp(parts - np.where(np.isfinite(top), top, 0)).sum(axis=0)), -np.inf) - (x[i] - y[j]) ** 2 / temperature
            line = g[a, b]
            weight = np.exp(line - line.max()) if np.isfinite(line.max()) else np.zeros(len(line))
            average[t] = (weight * (b - a)).sum() / weight.sum() if weight.sum() else np.nan
    return average, float(g[-1, -1])


def words(dim: int, level: int) -> list[tuple[int, ...]]:
    """Index words of a signature: (), (1,), ..., by length and then in order."""
    return [w for n in range(level + 1) for w in itertools.product(range(1, dim + 1), repeat=n)]


def segment_signature(step: np.ndarray, level: int) -> list[np.ndarray]:
    """Levels 0..level of the signature of a straight segment: tensor powers over factorials."""
    out = [np.ones(())]
    for n in range(1, level + 1):
        out.append(np.multiply.outer(out[-1], step) / n)
    return out


def chen(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Signature of one path after another."""
    return [sum(np.multiply.outer(a[k], b[n - k]) for k in range(n + 1)) for n in range(len(a))]


def signature(path: np.ndarray, level: int) -> np.ndarray:
    """All terms up to a level of a piecewise-linear path, in the order of words()."""
    out = [np.ones(()), *(np.zeros((path.shape[1],) * n) for n in range(1, level + 1))]
    for step in np.diff(path, axis=0):
        out = chen(out, segment_signature(step, level))
    return np.concatenate([np.ravel(x) for x in out])


def morlet_energy(values: np.ndarray, scales: tuple[int, ...] = (1, 2, 3, 4, 5)) -> np.ndarray:
    """Sum of absolute wavelet coefficients per scale, real Morlet exp(-t^2/2) cos(5t), by direct convolution."""
    out = []
    for s in scales:
        t = np.arange(-8 * s, 8 * s + 1) / s
        kernel = np.exp(-(t**2) / 2) * np.cos(5 * t) / np.sqrt(s)
        full = np.convolve(values, kernel)
        out.append(np.abs(full[8 * s : 8 * s + len(values)]).sum())
    return np.array(out)
