"""Regression kernels of a node given its parents.

Solvers are coroutines: they yield the parameters at which they want the
likelihood and get (log likelihood, gradient, information) back. The same solver
runs within a task, on a table that fits there, or in lockstep over scans of the
whole table, whichever the table's size asks for.
"""

from __future__ import annotations

import math
from collections.abc import Generator
from dataclasses import dataclass, field

import numpy as np

from ..schema import Dist

LN2PI = math.log(2 * math.pi)


@dataclass(frozen=True)
class Priors:
    """Normal coefficients (mean, precision), gamma precision (shape, inverse scale)."""

    mean: float = 0.0
    precision: float = 0.001
    shape: float = 1.0
    inv_scale: float = 5e-5


@dataclass
class Model:
    """A child, its distribution, the design columns of its parents, and the
    child's own columns (one for each level if multinomial)."""

    key: int
    dist: Dist
    y: tuple[int, ...]
    cols: list[int]
    #: number of parents' columns, for the description length
    n_parents: int
    #: share by which responses shrink towards 1/2 (bias reduction)
    shrink: float = 0.0
    priors: Priors | None = None
    #: (parameter, value) held fixed
    fixed: tuple[int, float] | None = None

    @property
    def blocks(self) -> int:
        return len(self.y) - 1 if self.dist is Dist.MULTINOMIAL else 1

    @property
    def size(self) -> int:
        return self.blocks * len(self.cols)


@dataclass
class Fit:
    beta: np.ndarray
    loglik: float
    info: np.ndarray
    ok: bool = True
    extra: dict = field(default_factory=dict)


def log_factorial(y: np.ndarray) -> np.ndarray:
    """ln Gamma(y + 1), y >= 0, to double precision."""
    y = np.asarray(y, float)
    z = y + 1.0
    shift = np.zeros_like(z)
    low = z < 10
    while low.any():
        shift[low] += np.log(z[low])
        z = np.where(low, z + 1, z)
        low = z < 10
    i = 1 / z
    i2 = i * i
    series = i * (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 * (1 / 1680 - i2 / 1188))))
    return (z - 0.5) * np.log(z) - z + 0.5 * LN2PI + series - shift


def evaluate(model: Model, beta: np.ndarray, a: np.ndarray, w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(objective, log likelihood, gradient, information) over rows ``a`` of the
    design with weights ``w``; the objective is the log likelihood of the shrunk
    responses. Sums over rows: parts add up."""
    x = a[:, model.cols]
    if model.dist is Dist.MULTINOMIAL:
        return _softmax(model, beta, x, a[:, model.y], w)
    y = a[:, model.y[0]]
    eta = x @ beta
    if model.dist is Dist.BINOMIAL:
        mu = np.where(eta >= 0, 1 / (1 + np.exp(-np.abs(eta))), np.exp(-np.abs(eta)) / (1 + np.exp(-np.abs(eta))))
        norm = np.logaddexp(0, eta)
        s = (y + model.shrink / 2) / (1 + model.shrink)
        loglik, goal, resid, v = w @ (y * eta - norm), w @ (s * eta - norm), s - mu, mu * (1 - mu)
    else:
        mu = np.exp(np.minimum(eta, 700))
        loglik = w @ (y * eta - mu - log_factorial(y))
        goal, resid, v = loglik, y - mu, mu
    return goal, loglik, x.T @ (w * resid), x.T @ (x * (w * v)[:, None])


def _softmax(model, beta, x, y, w):
    k, p = model.blocks, x.shape[1]
    eta = np.column_stack([np.zeros(len(x)), x @ beta.reshape(k, p).T])
    eta -= eta.max(axis=1, keepdims=True)
    mu = np.exp(eta)
    total = mu.sum(axis=1, keepdims=True)
    mu /= total
    loglik = w @ ((y * eta).sum(axis=1) - np.log(total[:, 0]))
    grad = (x.T @ ((y - mu)[:, 1:] * w[:, None])).T.ravel()
    info = np.zeros((k * p, k * p))
    for i in range(k):
        for j in range(k):
            v = w * mu[:, i + 1] * ((i == j) - mu[:, j + 1])
            info[i * p : (i + 1) * p, j * p : (j + 1) * p] = x.T @ (x * v[:, None])
    return loglik, loglik, grad, info


def start(model: Model, mean_y: float) -> np.ndarray:
    """0, but for a Poisson model, whose constant is ln of the mean."""
    beta = np.zeros(model.size)
    if model.dist is Dist.POISSON and mean_y > 0:
        level = math.log(mean_y)
        if model.cols and model.cols[0] == 0:
            beta[0] = level
        else:
            beta[:] = 0.0
            beta[: len(model.cols)] = level / max(1, model.n_parents and 1)
    if model.fixed:
        beta[model.fixed[0]] = model.fixed[1]
    return beta


def newton(model: Model, beta: np.ndarray, tol: float = 1e-8, most: int = 100) -> Generator[np.ndarray, tuple, Fit]:
    """Maximises the objective (plus the log prior) by Newton steps, halved as
    long as they lead down."""
    prior = model.priors
    free = np.ones(model.size, bool)
    if model.fixed:
        free[model.fixed[0]] = False

    def with_prior(beta, got):
        goal, loglik, grad, info = got
        if prior:
            d = beta - prior.mean
            goal = goal - 0.5 * prior.precision * (d @ d) + 0.5 * len(beta) * (math.log(prior.precision) - LN2PI)
            grad, info = grad - prior.precision * d, info + prior.precision * np.eye(len(beta))
        return goal, loglik, grad, info

    now = with_prior(beta, (yield beta))
    ok = False
    for _ in range(most):
        goal, _, grad, info = now
        step = np.zeros(model.size)
        step[free] = np.linalg.lstsq(info[np.ix_(free, free)], grad[free], rcond=1e-12)[0]
        for _ in range(40):
            to = beta + step
            got = with_prior(to, (yield to))
            if np.isfinite(got[0]) and got[0] >= goal - 1e-11 * (1 + abs(goal)):
                break
            step = step / 2
        else:
            break
        beta, now = to, got
        if np.abs(step).max(initial=0) < tol * (1 + np.abs(beta).max(initial=0)):
            ok = True
            break
    goal, loglik, _, info = now
    return Fit(beta, float(loglik), info, ok, {"goal": float(goal), "free": free})


def run(solver: Generator, call) -> Fit:
    """Runs a solver to its end with a function of the parameters."""
    try:
        ask = next(solver)
        while True:
            ask = solver.send(call(ask))
    except StopIteration as end:
        return end.value


def full_rank(gram: np.ndarray) -> int:
    """How many first columns go until the rest of X'X has full rank."""
    drop, scale = 0, np.sqrt(np.maximum(np.diag(gram), 1e-300))
    gram = gram / np.outer(scale, scale)
    while drop < len(gram) and np.linalg.matrix_rank(gram[drop:, drop:], tol=1e-9 * len(gram)) < len(gram) - drop:
        drop += 1
    return drop


def scores(loglik: float, df: float, n: float, n_parents: int, n_vars: int) -> dict[str, float]:
    """Scores to be minimised, and the log likelihood."""
    bic = -2 * loglik + math.log(n) * df
    return {"mlik": loglik, "aic": -2 * loglik + 2 * df, "bic": bic, "mdl": bic + (1 + n_parents) * math.log(max(n_vars, 1))}


FAILED = dict.fromkeys(("mlik", "aic", "bic", "mdl"), float("-inf"))


def gaussian(m, model: Model) -> tuple[float, float, int]:
    """(log likelihood, residual sum of squares, rank with the constant), from moments alone."""
    y, cols = model.y[0], [c for c in model.cols if c]
    ssr, rank = m.cross[y, y], 1
    if cols:
        s = m.cross[np.ix_(cols, cols)]
        scale = np.sqrt(np.maximum(np.diag(s), 1e-300))
        s, b = s / np.outer(scale, scale), m.cross[cols, y] / scale
        value, vector = np.linalg.eigh(s)
        use = value > 1e-10 * len(cols)
        rank += int(use.sum())
        ssr -= float((((vector[:, use].T @ b) ** 2) / value[use]).sum())
    ssr = max(ssr, 1e-300)
    return 0.5 * (-m.n * (LN2PI + 1 - math.log(m.n) + math.log(ssr))), ssr, rank


def gaussian_coefficients(m, model: Model) -> tuple[np.ndarray, np.ndarray, float]:
    """(coefficients, standard errors, residual variance) of the design columns."""
    _, ssr, rank = gaussian(m, model)
    xx = m.raw(model.cols)
    xy = m.cross[model.cols, model.y[0]] + m.n * m.mean[model.cols] * m.mean[model.y[0]]
    inv = np.linalg.pinv(xx, hermitian=True)
    mse = ssr / max(m.n - rank, 1)
    return inv @ xy, np.sqrt(np.maximum(mse * np.diag(inv), 0)), mse


# --- Laplace approximation of the marginal likelihood ---------------------


def laplace(fit: Fit) -> float:
    """ln of the integral of likelihood times prior, from the mode and the
    information there (of the free parameters)."""
    free = fit.extra["free"]
    info = fit.info[np.ix_(free, free)]
    m = int(free.sum())
    sign, logdet = np.linalg.slogdet(info) if m else (1, 0.0)
    return fit.extra["goal"] - 0.5 * logdet + 0.5 * m * LN2PI if sign > 0 else float("-inf")


def gaussian_laplace(m, model: Model, fixed: tuple[int, float] | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """(ln marginal likelihood, modes of coefficients and precision, standard
    deviations) of a gaussian node from moments; parameter ``fixed`` held."""
    p, prior = len(model.cols), model.priors
    xx = m.raw(model.cols)
    y = model.y[0]
    xy = m.cross[model.cols, y] + m.n * m.mean[model.cols] * m.mean[y]
    yy = m.cross[y, y] + m.n * m.mean[y] ** 2
    free = np.ones(p + 1, bool)
    beta, tau = np.zeros(p), m.n / max(m.cross[y, y], 1e-12)
    if fixed:
        free[fixed[0]] = False
        if fixed[0] < p:
            beta[fixed[0]] = fixed[1]
        else:
            tau = fixed[1]
    fb = free[:p]
    for _ in range(500):
        a = tau * xx + prior.precision * np.eye(p)
        b = tau * xy + prior.precision * prior.mean
        new = beta.copy()
        if fb.any():
            new[fb] = np.linalg.solve(a[np.ix_(fb, fb)], b[fb] - a[np.ix_(fb, ~fb)] @ beta[~fb])
        ssr = yy - 2 * new @ xy + new @ xx @ new
        t = tau if not free[p] else (m.n / 2 + prior.shape - 1) / (ssr / 2 + prior.inv_scale)
        moved = abs(t - tau) / tau + np.abs(new - beta).max(initial=0)
        beta, tau = new, t
        if moved < 1e-13:
            break
    ssr = yy - 2 * beta @ xy + beta @ xx @ beta
    d = beta - prior.mean
    goal = 0.5 * m.n * (math.log(tau) - LN2PI) - 0.5 * tau * ssr
    goal += 0.5 * p * (math.log(prior.precision) - LN2PI) - 0.5 * prior.precision * (d @ d)
    goal += prior.shape * math.log(prior.inv_scale) - math.lgamma(prior.shape) + (prior.shape - 1) * math.log(tau) - prior.inv_scale * tau
    h = np.zeros((p + 1, p + 1))
    h[:p, :p] = tau * xx + prior.precision * np.eye(p)
    h[:p, p] = h[p, :p] = xx @ beta - xy
    h[p, p] = (m.n / 2 + prior.shape - 1) / tau**2
    sub = h[np.ix_(free, free)]
    sign, logdet = np.linalg.slogdet(sub)
    k = int(free.sum())
    sd = np.zeros(p + 1)
    sd[free] = np.sqrt(np.maximum(np.diag(np.linalg.pinv(sub)), 0))
    return (goal - 0.5 * logdet + 0.5 * k * LN2PI if sign > 0 else float("-inf")), np.r_[beta, tau], sd


# --- Random intercepts ----------------------------------------------------


def group_laplace(model: Model, beta: np.ndarray, log_sd: np.ndarray, a: np.ndarray, w: np.ndarray, g: np.ndarray, n_groups: int) -> float:
    """Sum over groups of ln of the integral over the group's random intercepts
    (one, or one for each block), by Laplace's method; ``g`` numbers the groups.
    ``log_sd`` are the logarithms of the diagonal of the covariance's Cholesky
    factor, row by row what stands left of it after them."""
    x, k = a[:, model.cols], model.blocks
    half = cholesky(log_sd, k)
    inverse = np.linalg.inv(half @ half.T)
    base = x @ beta.reshape(k, -1).T
    u = np.zeros((n_groups, k))
    y = a[:, model.y] if model.dist is Dist.MULTINOMIAL else a[:, model.y[0]]

    def at(u):
        eta = base + u[g]
        if model.dist is Dist.MULTINOMIAL:
            full = np.column_stack([np.zeros(len(eta)), eta])
            full -= full.max(axis=1, keepdims=True)
            mu = np.exp(full)
            t = mu.sum(axis=1, keepdims=True)
            mu = mu / t
            ll = (y * full).sum(axis=1) - np.log(t[:, 0])
            r = (y - mu)[:, 1:]
            h = mu[:, 1:, None] * (np.eye(k)[None] - mu[:, None, 1:])
        elif model.dist is Dist.BINOMIAL:
            e = eta[:, 0]
            mu = 1 / (1 + np.exp(-np.clip(e, -700, 700)))
            ll, r, h = y * e - np.logaddexp(0, e), (y - mu)[:, None], (mu * (1 - mu))[:, None, None]
        else:
            e = np.minimum(eta[:, 0], 700)
            mu = np.exp(e)
            ll, r, h = y * e - mu - log_factorial(y), (y - mu)[:, None], mu[:, None, None]
        total = np.bincount(g, w * ll, n_groups) - 0.5 * ((u @ inverse) * u).sum(axis=1)
        grad = np.column_stack([np.bincount(g, w * r[:, i], n_groups) for i in range(k)]) - u @ inverse
        hess = np.empty((n_groups, k, k))
        for i in range(k):
            for j in range(k):
                hess[:, i, j] = np.bincount(g, w * h[:, i, j], n_groups) + inverse[i, j]
        return total, grad, hess

    total, grad, hess = at(u)
    for _ in range(100):
        step = np.linalg.solve(hess, grad[:, :, None])[:, :, 0]
        scale = np.ones(n_groups)
        for _ in range(30):
            to = u + step * scale[:, None]
            got = at(to)
            worse = got[0] < total - 1e-10 * (1 + np.abs(total))
            if not worse.any():
                break
            scale = np.where(worse, scale / 2, scale)
        u, (total, grad, hess) = to, got
        if np.abs(step).max(initial=0) < 1e-9:
            break
    return float((total - 0.5 * np.linalg.slogdet(hess)[1]).sum() - n_groups * log_sd[:k].sum())


def cholesky(spread: np.ndarray, k: int) -> np.ndarray:
    """Lower factor of a covariance from the logarithms of its diagonal and, where
    they are given, the numbers left of it."""
    out = np.diag(np.exp(spread[:k]))
    if len(spread) > k:
        out[np.tril_indices(k, -1)] = spread[k:]
    return out


def maximise(start: np.ndarray, most: int = 200, tol: float = 1e-7) -> Generator[list[np.ndarray], list[float], tuple[np.ndarray, float, np.ndarray]]:
    """Quasi-Newton ascent with central differences. Yields lists of points (one
    scan each) and gets their values; returns (point, value, information)."""

    def stencil(x):
        h = 1e-4 * (1 + np.abs(x))
        return h, [x + s * h[i] * np.eye(len(x))[i] for i in range(len(x)) for s in (1, -1)]

    def slope(x, h, v):
        return np.array([(v[2 * i] - v[2 * i + 1]) / (2 * h[i]) for i in range(len(x))])

    x, n = start.astype(float), len(start)
    h, points = stencil(x)
    values = yield [x, *points]
    f, grad, inv = values[0], slope(x, h, values[1:]), None
    if not np.isfinite(f):
        return x, float("-inf"), np.zeros((n, n))
    for it in range(most):
        if inv is None:
            curve = np.array([(values[1 + 2 * i] + values[2 + 2 * i] - 2 * f) / h[i] ** 2 for i in range(n)])
            inv = np.diag(1 / np.maximum(-curve, 1e-6))
        step = inv @ grad
        if grad @ step <= 0:
            inv, step = np.eye(n) * 1e-3, grad * 1e-3
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))
        scales = [1.0, 0.5, 0.25, 0.1, 0.02, 0.002]
        tried = yield [x + s * step for s in scales]
        best = int(np.nanargmax([v if np.isfinite(v) else -np.inf for v in tried]))
        if not tried[best] > f - 1e-12 * (1 + abs(f)):
            break
        new, gain = x + scales[best] * step, tried[best] - f
        h, points = stencil(new)
        values = [tried[best], *(yield points)]
        g2 = slope(new, h, values[1:])
        s, d = new - x, grad - g2
        if s @ d > 1e-12:
            r = 1 / (s @ d)
            left = np.eye(n) - r * np.outer(s, d)
            inv = left @ inv @ left.T + r * np.outer(s, s)
        x, f, grad = new, tried[best], g2
        if gain < tol * 1e-2 and np.abs(s).max() < tol * 100 or np.abs(grad).max() < tol * (1 + abs(f)) * 1e-2:
            break
    h = 1e-3 * (1 + np.abs(x))
    eye = np.eye(n)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    points = [x + a * h[i] * eye[i] + b * h[j] * eye[j] for i, j in pairs for a, b in ((1, 1), (1, -1), (-1, 1), (-1, -1))]
    v = yield points
    info = np.zeros((n, n))
    for k, (i, j) in enumerate(pairs):
        info[i, j] = info[j, i] = -(v[4 * k] - v[4 * k + 1] - v[4 * k + 2] + v[4 * k + 3]) / (4 * h[i] * h[j])
    return x, float(f), info


def lmm(n: float, yx: np.ndarray, ratios: np.ndarray, inner: np.ndarray, logs: np.ndarray, cols: list[int], y: int, reml: bool = True) -> tuple[float, float, np.ndarray, np.ndarray, float, float]:
    """Gaussian random intercept from sums over groups.

    ``yx`` is X'X of all design columns, ``inner[r]`` the sum over groups of
    c_g s_g s_g' for ratio r = var(group) / var(rest), c_g = r / (1 + r n_g), s_g
    the group's column sums, ``logs[r]`` the sum of ln(1 + r n_g). Returns (log
    likelihood, ratio, coefficients, standard errors, residual variance, group
    variance) at the best ratio of the grid.
    """
    best = None
    p = len(cols)
    for r, s, ld in zip(ratios, inner, logs, strict=True):
        v = yx - s
        a, b, c = v[np.ix_(cols, cols)], v[cols, y], v[y, y]
        beta = np.linalg.lstsq(a, b, rcond=1e-12)[0]
        ssr = max(c - b @ beta, 1e-300)
        df = n - p if reml else n
        var = ssr / df
        ll = -0.5 * (df * (LN2PI + math.log(var) + 1) + ld)
        if reml:
            ll -= 0.5 * np.linalg.slogdet(a)[1]
        if best is None or ll > best[0]:
            best = ll, float(r), beta, np.sqrt(np.maximum(np.diag(np.linalg.pinv(a)) * var, 0)), var, float(r) * var
    return best
