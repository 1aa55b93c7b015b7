"""Small constrained least squares on Gram matrices: g = X'X, b = X'y."""

from __future__ import annotations

import numpy as np


def ridge(g: np.ndarray, b: np.ndarray, reg: float = 1e-6) -> np.ndarray:
    """(g + reg I) w = b, for one system or a stack of them."""
    return np.linalg.solve(g + reg * np.eye(g.shape[-1]), b[..., None])[..., 0]


def equalities(p: int, fixed: dict[int, float], zeros: set[int], offsets: set[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows a and values c of a w = c for w_i = v, w_i = 0 and w_i + w_j = 0; equal rows once, conflicts raise."""
    rows: dict[tuple[int, ...], float] = {}
    for key, value in [*(((i,), v) for i, v in fixed.items()), *(((i,), 0.0) for i in zeros), *((tuple(sorted(o)), 0.0) for o in offsets)]:
        if not all(0 <= i < p for i in key):
            raise ValueError(f"feature out of range: {key}")
        if rows.setdefault(key, value) != value:
            raise ValueError(f"feature {key[0]} has two fixed values")
    a = np.zeros((len(rows), p))
    for k, key in enumerate(rows):
        for i in key:
            a[k, i] += 1.0
    return a, np.array(list(rows.values()), float)


def kkt(g: np.ndarray, b: np.ndarray, a: np.ndarray, c: np.ndarray, reg: float = 1e-6) -> np.ndarray:
    """Least squares under a w = c exactly: a particular solution plus the best step in the null space of a."""
    p = len(b)
    g = g + reg * np.eye(p)
    if not len(a):
        return np.linalg.solve(g, b)
    w, null = feasible_space(a, c, p)
    return w + null @ np.linalg.solve(null.T @ g @ null, null.T @ (b - g @ w)) if null.shape[1] else w


def penalty(g: np.ndarray, b: np.ndarray, fixed: dict[int, float], zeros: set[int], offsets: set[tuple[int, int]], reg: float = 1e-6, zero: float = 1e12, offset: float = 1e10, fix: float = 1e10) -> np.ndarray:
    """The same rules as penalties on g and b; scaled to a unit diagonal before solving."""
    g, b = g + reg * np.eye(len(b)), b.copy()
    for i in zeros:
        g[i, i] += zero
    for i, v in fixed.items():
        g[i, i] += fix
        b[i] += fix * v
    for i, j in offsets:
        for x, y in ((i, i), (j, j), (i, j), (j, i)):
            g[x, y] += offset
    d = 1 / np.sqrt(np.diag(g))
    return d * np.linalg.solve(g * d[:, None] * d, b * d)


def feasible_space(a: np.ndarray, c: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """A point of a w = c and an orthonormal basis of a's null space; raises if no point is."""
    if not len(a):
        return np.zeros(p), np.eye(p)
    u, s, vt = np.linalg.svd(a)
    rank = int((s > 1e-12 * max(1.0, s[0])).sum())
    w = vt[:rank].T @ ((u.T @ c)[:rank] / s[:rank])
    if np.abs(a @ w - c).max() > 1e-9 * (1 + np.abs(c).max()):
        raise ValueError("the rules contradict each other")
    return w, vt[rank:].T


class Infeasible(ValueError):
    """No point holds all inequalities."""


def quadratic(g: np.ndarray, b: np.ndarray, rows: np.ndarray, least: np.ndarray, more=None, rounds: int = 1000, tol: float = 1e-11) -> tuple[np.ndarray, dict[int, float]]:
    """min w'gw/2 - b'w with rows w >= least, exactly, and the multipliers of the rows that bind; g is positive definite.

    A dual active-set method: from the free minimum, the most violated row is added, and rows whose multiplier would turn
    negative on the way are dropped, until none is violated.  more(w) may give a further violated row (row, least) of a
    family that is too large to list; its number follows those of the given rows.  Raises if rows exclude each other.
    """
    inverse = np.linalg.inv(g)
    w, active, u = inverse @ b, [], np.zeros(0)
    rows, least = rows.copy(), least.copy()
    size = np.sqrt((rows**2).sum(1)) if len(rows) else np.zeros(0)
    for _ in range(rounds):
        extra = more(w) if more else None
        if extra is not None:
            rows, least = np.vstack([rows, extra[0]]), np.append(least, extra[1])
            size = np.append(size, np.sqrt((extra[0] ** 2).sum()))
        fixed = size < 1e-10  # rows that no step can change
        if (least[fixed] > 1e-9).any():
            raise Infeasible("the rules contradict each other")
        gap = np.where(fixed, 0.0, (rows @ w - least) / np.where(fixed, 1.0, size)) if len(rows) else np.zeros(0)
        gap[active] = 0.0
        k = int(np.argmin(gap)) if len(gap) else -1
        if k < 0 or gap[k] >= -tol * (1 + np.abs(w).max(initial=0.0)):
            return w, dict(zip(active, u.tolist(), strict=True))
        normal, mine = rows[k], 0.0
        while True:
            across = inverse @ normal
            if active:
                held = rows[active].T
                r = np.linalg.solve(held.T @ inverse @ held, held.T @ across)
                step = across - inverse @ (held @ r)
            else:
                r, step = np.zeros(0), across
            rise = float(step @ normal)
            falls = np.flatnonzero(r > 1e-14)
            first = falls[np.argmin(u[falls] / r[falls])] if len(falls) else -1
            until = u[first] / r[first] if first >= 0 else np.inf
            free = rise > 1e-13 * float(normal @ across) and len(active) < len(w)
            full = (least[k] - rows[k] @ w) / rise if free else np.inf
            t = min(until, full)
            if t == np.inf:
                raise Infeasible("the rules contradict each other")
            if free:
                w = w + t * step
            u, mine = u - t * r, mine + t
            if t == full:
                active, u = [*active, k], np.append(u, mine)
                break
            active, u = [x for j, x in enumerate(active) if j != first], np.delete(u, first)
    raise ArithmeticError(f"no solution after {rounds} rounds")


def ruled(g: np.ndarray, b: np.ndarray, a: np.ndarray, c: np.ndarray, low: np.ndarray, high: np.ndarray, l1: np.ndarray | float = 0.0, norm: float | None = None, reg: float = 1e-6) -> np.ndarray:
    """min w'(g + reg I)w/2 - b'w + sum l1 |w| with a w = c, low <= w <= high and, if norm is given, sum |w| <= norm.

    Equalities are eliminated, bounds are a working set; exact up to rounding.  With l1, the minimum of one orthant after the
    other: a zero whose multiplier says so changes sides, which lowers the objective each time.  The norm's faces are added as violated.
    """
    p = len(b)
    l1 = np.broadcast_to(np.asarray(l1, float), p)
    size = 1 / np.sqrt(np.diag(g) + reg)  # unit diagonal: w = size * v
    h = (g + reg * np.eye(p)) * size[:, None] * size
    start, basis = feasible_space(a * size, c, p)
    reduced = basis.T @ h @ basis

    def faces(y: np.ndarray):
        v = start + basis @ y
        over = np.abs(v) @ size - norm
        side = np.where(v >= 0, size, -size)
        return (-(side @ basis), -norm + side @ start) if over > 1e-11 * (1 + norm) else None

    bounds = [(k, 1.0, low[k] / size[k]) for k in range(p) if low[k] > -np.inf] + [(k, -1.0, -high[k] / size[k]) for k in range(p) if high[k] < np.inf]

    def solved(sides: np.ndarray | None) -> tuple[np.ndarray, dict[int, float]]:
        signs = [] if sides is None else [(k, sides[k], 0.0) for k in range(p) if l1[k] > 0]
        every = [*signs, *bounds]
        rows = np.array([s * basis[k] for k, s, _ in every]).reshape(len(every), basis.shape[1])
        least = np.array([v - s * start[k] for k, s, v in every])
        pull = size * (b - (l1 * sides if sides is not None else 0.0))
        if not basis.shape[1]:
            if len(least) and least.max() > 1e-9 or faces(np.zeros(0)) is not None:
                raise Infeasible("the rules contradict each other")
            return start, {}
        y, held = quadratic(reduced, basis.T @ (pull - h @ start), rows, least, faces if norm is not None else None)
        v = start + basis @ y
        for k in held:
            if k < len(every):
                v[every[k][0]] = every[k][1] * every[k][2]  # a bound that binds is met exactly
        return v, {signs[k][0]: m for k, m in held.items() if k < len(signs)}

    v, _ = solved(None)
    if not (l1 > 0).any():
        return v * size
    sides = np.where(v < 0, -1.0, 1.0)
    for _ in range(1000):
        v, held = solved(sides)
        # at a zero the penalty's slope may change by 2 * l1 before the other side is better
        turned = {k: m - 2 * l1[k] * size[k] for k, m in held.items() if m > 2 * l1[k] * size[k] * (1 + 1e-9) + 1e-12}
        turned = {k: m for k, m in turned.items() if (low[k] if sides[k] > 0 else -high[k]) < 0}
        if not turned:
            return v * size
        sides[max(turned, key=turned.get)] *= -1
    raise ArithmeticError("no orthant holds the minimum after 1,000 changes of sides")


def box(g: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, l1: np.ndarray | float = 0.0, total: float | None = None, reg: float = 1e-6) -> np.ndarray:
    """ruled() with bounds, l1 and, if given, sum(w) = total."""
    some = total is not None
    return ruled(g, b, np.ones((int(some), len(b))), np.full(int(some), total if some else 0.0), low, high, l1, None, reg)


def huber(x: np.ndarray, y: np.ndarray, delta: float = 1.0, rounds: int = 20, tol: float = 1e-4, reg: float = 1e-6) -> np.ndarray:
    """Huber loss by iteratively reweighted least squares on the rows."""
    w = ridge(x.T @ x, x.T @ y, reg)
    for _ in range(rounds):
        r = np.abs(y - x @ w)
        weight = np.where(r <= delta, 1.0, delta / np.maximum(r, 1e-12))
        new = ridge(x.T @ (x * weight[:, None]), x.T @ (y * weight), reg)
        done = np.abs(new - w).max() < tol
        w = new
        if done:
            break
    return w


def shrunk_covariance(gram: np.ndarray, n: float, alpha: float) -> np.ndarray:
    """D ((1 - alpha) R + alpha I) D of a centred Gram matrix of n rows; negative eigenvalues clipped."""
    s = gram / n
    std = np.maximum(np.sqrt(np.diag(s)), 1e-12)
    r = s / np.outer(std, std)
    np.fill_diagonal(r, 1.0)
    out = ((1 - alpha) * r + alpha * np.eye(len(s))) * np.outer(std, std)
    out = (out + out.T) / 2
    values, vectors = np.linalg.eigh(out)
    return (vectors * np.clip(values, 0, None)) @ vectors.T if values.min() < -1e-8 else out


def asymmetric(g: np.ndarray, b: np.ndarray, s: np.ndarray, positive: float = 1.0, negative: float = 10.0, rounds: int = 5000, tol: float = 1e-12) -> np.ndarray:
    """min w'gw/2 - b'w + w'sw/2 + positive |w+|^2 + negative |w-|^2 by coordinate descent."""
    h, w = g + s, np.zeros(len(b))
    grad = -b.astype(float)
    for _ in range(rounds):
        moved = 0.0
        for k in range(len(b)):
            z = w[k] * h[k, k] - grad[k]
            new = z / (h[k, k] + 2 * (positive if z > 0 else negative))
            step = new - w[k]
            grad += step * h[:, k]
            w[k] = new
            moved = max(moved, abs(step))
        if moved < tol * max(1.0, np.abs(w).max()):
            break
    return w
