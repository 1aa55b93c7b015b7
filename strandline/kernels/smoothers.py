"""Causal smoothers of one series: the value at a place depends on values up to it only.  NaN means missing."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def _first(values: np.ndarray) -> int | None:
    known = np.flatnonzero(~np.isnan(values))
    return int(known[0]) if len(known) else None


def ewma(values: np.ndarray, decay: float = 0.94, level: float | None = None) -> np.ndarray:
    """s = decay * s + (1 - decay) * v; a missing value carries s on, leading ones get the first value.  level: s before the first place."""
    start = _first(values)
    if start is None and level is None:
        return values
    out = np.empty(len(values))
    begin = 0
    if level is None:
        level, begin = values[start], start + 1
        out[:begin] = level
    for k in range(begin, len(values)):
        if values[k] == values[k]:
            level = decay * level + (1 - decay) * values[k]
        out[k] = level
    return out


def ewma_map(values: np.ndarray, decay: float = 0.94) -> tuple[float, float]:
    """a, c: after these values s is a * s + c."""
    good = values[~np.isnan(values)]
    ages = np.arange(len(good) - 1, -1, -1)
    return decay ** len(good), float((1 - decay) * (decay**ages @ good))


def double_ewma(values: np.ndarray, decay: float = 0.94) -> np.ndarray:
    return ewma(ewma(values, decay), decay)


def kalman(values: np.ndarray, process_noise: float = 0.01, measurement_noise: float = 0.1, level: float | None = None, variance: float = 1.0) -> np.ndarray:
    """Local-level filter from the first value with variance 1; a missing value only adds process noise.  level, variance: those before the first place."""
    start = _first(values)
    if start is None and level is None:
        return values
    out = np.empty(len(values))
    begin = 0
    if level is None:
        level, variance, begin = values[start], 1.0, start + 1
        out[:begin] = level
    for k in range(begin, len(values)):
        variance += process_noise
        if values[k] == values[k]:
            gain = variance / (variance + measurement_noise)
            level += gain * (values[k] - level)
            variance *= 1 - gain
        out[k] = level
    return out


def kalman_variance(values: np.ndarray, process_noise: float = 0.01, measurement_noise: float = 0.1) -> np.ndarray:
    """m: after these values the variance is (m0 v + m1) / (m2 v + m3); products of 2 x 2 matrices, scaled."""
    gap, seen = np.array([[1.0, process_noise], [0.0, 1.0]]), np.array([[measurement_noise, process_noise * measurement_noise], [1.0, process_noise + measurement_noise]])
    out = np.eye(2)
    for good in ~np.isnan(values):
        out = (seen if good else gap) @ out
        out /= np.abs(out).max()
    return out.ravel()


def kalman_map(values: np.ndarray, variance: float, process_noise: float = 0.01, measurement_noise: float = 0.1) -> tuple[float, float]:
    """a, c: after these values, from this variance, the level is a * level + c."""
    a, c = 1.0, 0.0
    for v in values:
        variance += process_noise
        if v == v:
            gain = variance / (variance + measurement_noise)
            a, c = a * (1 - gain), c + gain * (v - c)
            variance *= 1 - gain
    return a, c


@lru_cache(maxsize=4096)
def _gp_weights(ages: bytes, length_scale: float, noise: float) -> np.ndarray:
    """Weights of history values that lie these many steps back."""
    back = np.frombuffer(ages, np.int64).astype(float)
    gram = np.exp(-0.5 * ((back[:, None] - back) / length_scale) ** 2) + (noise + 1e-6) * np.eye(len(back))
    return np.linalg.solve(gram, np.exp(-0.5 * (back / length_scale) ** 2))


def gaussian_process(values: np.ndarray, length_scale: float = 10.0, noise: float = 0.1, history: int = 100, places: np.ndarray | None = None, past: np.ndarray | None = None) -> np.ndarray:
    """Prediction from the last `history` known values before a place, blended with the value there by 1 / (1 + noise).

    places (below zero) and past: known values before the first place, if the series began earlier.
    """
    begun = places is not None and len(places) > 0
    start = _first(values)
    if start is None and not begun:
        return values
    n_past = len(places) if begun else 0
    at = np.concatenate([places if begun else np.zeros(0), np.arange(len(values))]).astype(np.int64)
    every = np.concatenate([past if begun else np.zeros(0), values])
    known = np.flatnonzero(~np.isnan(every))
    out = np.empty(len(values))
    begin = 0 if begun else start + 1
    out[:begin] = values[start] if begin else 0.0
    for k in range(begin, len(values)):
        n = int(np.searchsorted(known, k + n_past))
        mine = known[max(0, n - history) : n]
        guess = _gp_weights((k - at[mine]).tobytes(), length_scale, noise) @ every[mine]
        out[k] = guess if np.isnan(values[k]) else (values[k] + noise * guess) / (1 + noise)
    return out


def moving_average(values: np.ndarray, window: int = 10) -> np.ndarray:
    """Mean of the known values among the last `window`; with none, the previous result."""
    good = ~np.isnan(values)
    total, count = np.cumsum(np.where(good, values, 0.0)), np.cumsum(good)
    total, count = (x - np.concatenate([np.zeros(min(window, len(x))), x[:-window]])[: len(x)] for x in (total, count))
    out = np.where(count > 0, total / np.maximum(count, 1), np.nan)
    for k in np.flatnonzero(count == 0):
        out[k] = out[k - 1] if k else np.nan
    return out


def _running_mean(values: np.ndarray, n: int) -> np.ndarray:
    head = values[:n]
    good = ~np.isnan(head)
    count = np.cumsum(good)
    return np.where(count > 0, np.cumsum(np.where(good, head, 0.0)) / np.maximum(count, 1), head)


def _filled(window: np.ndarray) -> np.ndarray:
    good = ~np.isnan(window)
    if good.all():
        return window
    places = np.arange(len(window))
    return np.interp(places, places[good], window[good])


@lru_cache(maxsize=64)
def _last_fit(window: int, degree: int) -> np.ndarray:
    """Weights whose dot product with a window is its least-squares polynomial at the last place."""
    basis = np.vander(np.arange(window) / window, degree + 1)
    return basis[-1] @ np.linalg.pinv(basis)


def carried(values: np.ndarray, last: float = np.nan) -> np.ndarray:
    """NaN replaced by the value before, at the start by `last`."""
    at = np.maximum.accumulate(np.where(np.isnan(values), -1, np.arange(len(values)))) if len(values) else np.zeros(0, int)
    return np.where(at >= 0, values[at], last)


def trailing(values: np.ndarray, method: str, halo: int = 0, **params) -> np.ndarray:
    """Outputs of savitzky_golay or hodrick_prescott after the first `halo` values, NaN where the output before is carried on.

    values start with the series, or so early that no output wanted has a shorter history for it.
    """
    history, least, weights, enough = {"savitzky_golay": _golay, "hodrick_prescott": _prescott}[method](**params)
    out = np.full(len(values), np.nan)
    if halo < least:
        out[:least] = _running_mean(values, least)
    for k in range(max(least, halo), len(values)):
        part = values[max(0, k - history + 1) : k + 1]
        good = int((~np.isnan(part)).sum())
        if enough(good) or good == len(part):
            out[k] = weights(len(part)) @ _filled(part)
    return out[halo:]


def _golay(window: int = 11, degree: int = 3):
    return window, window, lambda n: _last_fit(window, degree), lambda good: good > degree


def _prescott(lamb: float = 1600.0, history: int = 100, least: int = 20):
    return history, least, lambda n: _hp_weights(n, lamb), lambda good: good > 2


def savitzky_golay(values: np.ndarray, window: int = 11, degree: int = 3) -> np.ndarray:
    """Polynomial over the last `window` values at its end; the first `window` places get the running mean; with too few known, the output before."""
    return carried(trailing(values, "savitzky_golay", window=window, degree=degree))


@lru_cache(maxsize=512)
def _hp_weights(n: int, lamb: float) -> np.ndarray:
    """Last row of the inverse of I + lamb * D'D, D the second differences."""
    d = np.diff(np.eye(n), n=2, axis=0)
    return np.linalg.solve(np.eye(n) + lamb * d.T @ d, np.eye(n)[-1])


def hodrick_prescott(values: np.ndarray, lamb: float = 1600.0, history: int = 100, least: int = 20) -> np.ndarray:
    """Last value of the HP trend over the last `history` values; the first `least` places get the running mean; with too few known, the output before."""
    return carried(trailing(values, "hodrick_prescott", lamb=lamb, history=history, least=least))


METHODS = {"ewma": ewma, "double_ewma": double_ewma, "kalman": kalman, "gaussian_process": gaussian_process, "moving_average": moving_average, "savitzky_golay": savitzky_golay, "hodrick_prescott": hodrick_prescott}
