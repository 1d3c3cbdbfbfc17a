"""Random intercepts of groups: sums over a group's rows, Newton's step of its
intercepts, and the value and slope of its integral by Laplace's method.

Parameters of a model are its coefficients, block by block, then the logarithms of
the diagonal of the intercepts' Cholesky factor, then what stands left of it, row by
row. Everything that a group's rows tell is a sum, so rows of one group may lie
anywhere: their sums are added up before a group's step is made.
"""

from __future__ import annotations

from collections.abc import Generator

import numpy as np

from ..schema import Dist
from .models import Model, cholesky, log_factorial

#: Spreads past e^6 or under e^-9 are off the map and cost so much for each unit.
LEAST, GREATEST, COST = -9.0, 6.0, 1e3
#: Once a Newton step is this small, the mode after it is exact to rounding.
STILL = 1e-5


def dimension(model: Model) -> int:
    k = model.blocks
    return model.size + k + k * (k - 1) // 2


def _parts(model: Model, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients by block, spread within its bounds, Cholesky factor)"""
    p, k = model.size, model.blocks
    spread = np.r_[np.clip(theta[p : p + k], LEAST, GREATEST), theta[p + k :]]
    return theta[:p].reshape(k, -1), spread, cholesky(spread, k)


def row_sums(model: Model, theta: np.ndarray, u: np.ndarray, a: np.ndarray, w: np.ndarray, g: np.ndarray, n: int, deep: bool = False) -> np.ndarray:
    """Sums over the rows of each of ``n`` groups at intercepts ``u`` (n x k): log
    likelihood, slope, curvature; ``deep``: also what the coefficients' slope takes."""
    x, k = a[:, model.cols], model.blocks
    eta = x @ _parts(model, theta)[0].T + u[g]
    if model.dist is Dist.MULTINOMIAL:
        y = a[:, model.y]
        full = np.column_stack([np.zeros(len(eta)), eta])
        full -= full.max(axis=1, keepdims=True)
        mu = np.exp(full)
        total = mu.sum(axis=1, keepdims=True)
        mu = mu / total
        ll, r, mu = (y * full).sum(axis=1) - np.log(total[:, 0]), (y - mu)[:, 1:], mu[:, 1:]
        eye = np.eye(k)
        h = mu[:, :, None] * (eye - mu[:, None, :])
        if deep:
            third = mu[:, :, None, None] * (eye[None, :, None, :] - mu[:, None, None, :]) * (eye[None, :, :, None] - mu[:, None, :, None])
            third = third - mu[:, :, None, None] * mu[:, None, :, None] * (eye[None, None, :, :] - mu[:, None, None, :])
    else:
        y, e = a[:, model.y[0]], eta[:, 0]
        if model.dist is Dist.BINOMIAL:
            m = 1 / (1 + np.exp(-np.clip(e, -700, 700)))
            ll, slope, curve = y * e - np.logaddexp(0, e), y - m, m * (1 - m)
            third = curve * (1 - 2 * m)
        else:
            e = np.minimum(e, 700)
            m = np.exp(e)
            ll, slope, curve, third = y * e - m - log_factorial(y), y - m, m, m
        r, h, third = slope[:, None], curve[:, None, None], third[:, None, None, None]
    flat = lambda v: v.reshape(len(v), -1)
    columns = [ll[:, None], r, flat(h)]
    if deep:
        times = lambda v: flat(flat(v)[:, :, None] * x[:, None, :])
        columns += [times(r), times(h), flat(third), times(third)]
    every = np.column_stack(columns) * w[:, None]
    return np.column_stack([np.bincount(g, every[:, i], n) for i in range(every.shape[1])]) if len(g) else np.zeros((n, every.shape[1]))


def newton_step(model: Model, theta: np.ndarray, u: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log density of each group's intercepts, their Newton step)"""
    k = model.blocks
    half = _parts(model, theta)[2]
    inverse = np.linalg.inv(half @ half.T)
    value = sums[:, 0] - 0.5 * ((u @ inverse) * u).sum(axis=1)
    slope = sums[:, 1 : 1 + k] - u @ inverse
    curve = sums[:, 1 + k : 1 + k + k * k].reshape(-1, k, k) + inverse
    return value, np.linalg.solve(curve, slope[:, :, None])[:, :, 0]


def settle(u, value, step, before, best) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each group's intercepts go next: ``(next u, mode so far, its value, distance)``.
    A place that is worse than the one before is left for half the way to it."""
    worse = value < best - 1e-10 * (1 + np.abs(best))
    before = np.where(worse[:, None], before, u)
    best = np.where(worse, best, value)
    to = np.where(worse[:, None], (u + before) / 2, u + step)
    return to, before, best, np.abs(to - before).max(axis=1, initial=0)


def value_slope(model: Model, theta: np.ndarray, u: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln of each group's integral, its slope in all parameters) at the modes
    ``u``, from deep sums. The mode moves with the parameters, and the curvature
    with the mode: third derivatives carry both."""
    k, p = model.blocks, len(model.cols)
    _, spread, half = _parts(model, theta)
    inverse = np.linalg.inv(half @ half.T)
    n, at = len(sums), 0

    def take(*shape):
        nonlocal at
        size = int(np.prod(shape))
        out = sums[:, at : at + size].reshape(n, *shape)
        at += size
        return out

    ll, _, h, rx, hx, third, thirdx = take(1), take(k), take(k, k), take(k, p), take(k, k, p), take(k, k, k), take(k, k, k, p)
    curve = h + inverse
    value = ll[:, 0] - 0.5 * ((u @ inverse) * u).sum(axis=1) - 0.5 * np.linalg.slogdet(curve)[1] - spread[:k].sum()
    back = np.linalg.inv(curve)
    q = np.einsum("nab,nbad->nd", back, third)
    # coefficient j of block c: direct, through the curvature, and through the mode
    moved = -np.einsum("nda,nacj->ndcj", back, hx)
    slope = [(rx - 0.5 * (np.einsum("nab,nbacj->ncj", back, thirdx) + np.einsum("nd,ndcj->ncj", q, moved))).reshape(n, -1)]
    ways = [(i, i, half[i, i]) for i in range(k)] + [(i, j, 1.0) for i, j in zip(*np.tril_indices(k, -1), strict=True)]
    for i, j, size in ways:
        d = np.zeros((k, k))
        d[i, j] = size
        change = -inverse @ (d @ half.T + half @ d.T) @ inverse
        out = -0.5 * ((u @ change) * u).sum(axis=1) - 0.5 * np.einsum("nab,ba->n", back, change) - 0.5 * np.einsum("nd,nd->n", q, -np.einsum("nab,nb->na", back, u @ change))
        slope.append((out - (1.0 if i == j else 0.0))[:, None])
    return value, np.column_stack(slope)


def penalty(model: Model, theta: np.ndarray) -> tuple[float, np.ndarray]:
    """What a spread off the map costs, and its slope."""
    p, k = model.size, model.blocks
    over = theta[p : p + k] - np.clip(theta[p : p + k], LEAST, GREATEST)
    slope = np.zeros(len(theta))
    slope[p : p + k] = -COST * np.sign(over)
    return -COST * float(np.abs(over).sum()), slope


def local_terms(model: Model, theta: np.ndarray, a: np.ndarray, w: np.ndarray, g: np.ndarray, n: int) -> np.ndarray:
    """Value and slope of the sum over groups, whose rows are all at hand."""
    u = np.zeros((n, model.blocks))
    before, best = u, np.full(n, -np.inf)
    for _ in range(200):
        value, step = newton_step(model, theta, u, row_sums(model, theta, u, a, w, g, n))
        u, before, best, far = settle(u, value, step, before, best)
        if far.max(initial=0) < STILL:
            break
    value, slope = value_slope(model, theta, u, row_sums(model, theta, u, a, w, g, n, deep=True))
    return np.r_[value.sum(), slope.sum(axis=0)]


def ascend(start: np.ndarray, inverse: np.ndarray, tol: float = 1e-8, most: int = 100) -> Generator[list[np.ndarray], list[tuple[float, np.ndarray]], tuple[np.ndarray, float, np.ndarray]]:
    """Quasi-Newton ascent. Yields lists of points and gets (value, slope) of each;
    ``inverse`` is the first guess of the inverse information. Returns (point,
    value, information by differences of slopes)."""
    x, inv = start.astype(float), inverse.copy()
    ((f, slope),) = yield [x]
    if not np.isfinite(f):
        return x, float("-inf"), np.eye(len(x))
    for _ in range(most):
        step = inv @ slope
        if slope @ step <= 0:
            inv = np.diag(np.maximum(np.diag(inv), 1e-8))
            step = inv @ slope
        if len(x) == 0 or slope @ step < tol * tol * (1 + abs(f)):
            break
        step *= min(1.0, 3.0 / max(np.abs(step).max(), 1e-300))
        t = 1.0
        while True:
            ((f2, slope2),) = yield [x + t * step]
            if np.isfinite(f2) and f2 >= f + 1e-4 * t * (slope @ step) or t < 1e-6:
                break
            t *= 0.3
        if not (np.isfinite(f2) and f2 > f - 1e-9 * (1 + abs(f))):
            break
        s, d = t * step, slope - slope2
        small = abs(f2 - f) < tol * tol * (1 + abs(f)) and np.abs(s).max() < tol
        x, f, slope = x + s, f2, slope2
        if s @ d > 1e-14:
            r = 1 / (s @ d)
            left = np.eye(len(x)) - r * np.outer(s, d)
            inv = left @ inv @ left.T + r * np.outer(s, s)
        if small:
            break
    h = 1e-4 * (1 + np.abs(x))
    eye = np.eye(len(x))
    got = yield [x + sign * h[i] * eye[i] for i in range(len(x)) for sign in (1, -1)]
    info = np.array([(got[2 * i + 1][1] - got[2 * i][1]) / (2 * h[i]) for i in range(len(x))]).reshape(len(x), len(x))
    return x, float(f), (info + info.T) / 2
