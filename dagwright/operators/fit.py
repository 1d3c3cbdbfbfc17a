"""Parameters of a given network: estimates, errors, scores, marginals, densities."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Dag
from ..plans import fitting as P
from ..plans.controls import FitControl
from ..schema import Dist, Schema, standardised, validate, with_levels
from . import models as M
from .moments import Design, moments


@dataclass
class NodeFit:
    node: str
    dist: Dist
    #: (name, state, parent, estimate, standard error); state None but for multinomial nodes
    terms: list[tuple[str, str | None, str | None, float, float]]
    scores: dict[str, float]
    df: float
    #: residual standard deviation of a gaussian node; group standard deviations
    sigma: float | None = None
    sigma_alpha: list[float] | None = None
    #: covariance of the group intercepts of a multinomial node's categories
    covariance: list[list[float]] | None = None


@dataclass
class Network:
    """A fitted network. What the driver holds is a few numbers for each arc."""

    dag: Dag
    schema: Schema
    method: str
    n: int
    nodes: dict[str, NodeFit] = field(default_factory=dict)

    def coefficients(self, spark, pvalues: bool = False) -> DataFrame:
        """``(node, term, state, parent, estimate, stderr)``, and Wald ``pvalue`` if asked for."""
        rows = [(n.node, *t, wald(t[3] / t[4]) if t[4] else None) for n in self.nodes.values() for t in n.terms]
        out = spark.createDataFrame(rows, "node string, term string, state string, parent string, estimate double, stderr double, pvalue double")
        return out if pvalues else out.drop("pvalue")

    def node_scores(self, spark) -> DataFrame:
        """``(node, dist, df, mlik, aic, bic, mdl)``."""
        rows = [(f.node, f.dist.value, float(f.df), *(f.scores.get(k) for k in ("mlik", "aic", "bic", "mdl"))) for f in self.nodes.values()]
        return spark.createDataFrame(rows, "node string, dist string, df double, mlik double, aic double, bic double, mdl double")

    def spreads(self, spark) -> DataFrame:
        """``(node, name, value)``: residual and group standard deviations."""
        rows = [(f.node, "sigma", f.sigma) for f in self.nodes.values() if f.sigma is not None]
        rows += [(f.node, "sigma_alpha", v) for f in self.nodes.values() for v in f.sigma_alpha or ()]
        return spark.createDataFrame(rows, "node string, name string, value double")

    def total(self, score: str = "bic") -> float:
        """Sum of the nodes' scores; missing ones count nothing."""
        return sum(v for f in self.nodes.values() if (v := f.scores.get(score)) is not None and math.isfinite(v))

    def log_lik(self) -> float:
        """Sum of the nodes' log likelihoods."""
        return self.total("mlik")

    def aic(self) -> float:
        return self.total("aic")

    def bic(self) -> float:
        return self.total("bic")

    def nobs(self) -> int:
        return self.n

    def __str__(self) -> str:
        lines = [f"{self.method} fit of {len(self.nodes)} nodes, {len(self.dag.arcs)} arcs, {self.n} rows"]
        for f in self.nodes.values():
            lines.append(f"{f.node} ({f.dist.value}): " + ", ".join(f"{t[0]} {t[3]:.4g} ({t[4]:.3g})" for t in f.terms))
        sums = [f"{k} {self.total(k):.6g}" for k in ("mlik", "aic", "bic", "mdl") if any(k in f.scores for f in self.nodes.values())]
        return "\n".join([*lines, ", ".join(sums)])

    def family(self) -> dict[str, str]:
        return {n: f.dist.value for n, f in self.nodes.items()}


#: Steps of a grid's side that are asked for at once.
STEPS = 8
#: A side's step doubles where a density is over this share of the one before.
FLAT = 0.8
#: Neighbouring densities differ by at most this share of the highest one, after
#: HALVINGS rounds at most.
STEEP, HALVINGS = 0.3, 12


def wald(z: float) -> float:
    """Two-sided p value."""
    return math.erfc(abs(z) / math.sqrt(2))


def _terms(design: Design, model: M.Model, node: str, beta, se, states) -> list[tuple]:
    nodes = design.schema.nodes
    owner = {k: nodes[i] for i, cols in enumerate(design.of) for k in cols}
    out, p = [], len(model.cols)
    for b in range(model.blocks):
        state = str(states[b + 1]) if states else None
        for k, c in enumerate(model.cols):
            name = f"{node}|intercept" if c == 0 else design.names[c]
            out.append((name if state is None else f"{name}.{state}", state, owner.get(c), float(beta[b * p + k]), float(se[b * p + k])))
    return out


def fit(df: DataFrame, schema: Schema, dag: Dag, method: str = "mle", centre: bool = True, priors: M.Priors | None = None, reml: bool = True, check: bool = True, control: FitControl | None = None) -> Network:
    """Fits every node's regression on its parents.

    ``mle``: maximum likelihood; logistic nodes that separate get the
    bias-reduced estimate. ``bayes``: posterior modes and their standard
    deviations, mlik the log marginal likelihood. A schema with a group column
    adds random intercepts. Gaussian nodes come from one scan's cross-products,
    all others share their scans. ``control`` has the priors, unless given, and
    the solvers' tolerance and most steps.
    """
    control = control or FitControl()
    if method not in ("mle", "bayes"):
        raise ValueError("method is 'mle' or 'bayes'")
    if tuple(dag.nodes) != tuple(schema.nodes):
        raise ValueError("the network's nodes aren't the schema's, in order")
    if check:
        validate(df, schema)
    schema = with_levels(df, schema)
    df = P.only_needed(df, schema)
    design = Design.build(schema)
    gaussians = [i for i, d in enumerate(schema.dists.values()) if d is Dist.GAUSSIAN]
    m = moments(df, design)
    if centre:
        m = m.standardised([design.of[i][0] for i in gaussians])
        df = standardised(df, schema)
    n_vars = len(schema.nodes)
    prior = (priors or control.priors()) if method == "bayes" else None
    out = Network(dag, schema, method, int(m.n))
    at = {n: i for i, n in enumerate(schema.nodes)}
    built = {c: P.build_model(i, design, i, [at[p] for p in dag.parents(c)], None, prior) for c, i in at.items()}
    normal = [c for c in schema.nodes if schema.dists[c] is Dist.GAUSSIAN]
    other = [c for c in schema.nodes if schema.dists[c] is not Dist.GAUSSIAN]
    found: dict[str, NodeFit] = {}
    if normal and schema.group and not prior:
        fits = P.solve(P.Rows.of_groups(df, design), [(built[c], 0.0) for c in normal], lambda job: P.lmm_solver(job[0], m, reml), P.lmm_call)
        for i, c in enumerate(normal):
            ll, _, beta, se, var, between = fits[i]
            k = len(built[c].cols) + 2
            s = M.scores(ll, k, m.n, 0, n_vars)
            s["mdl"] = s["bic"] + (k - 1) * math.log(n_vars)
            found[c] = NodeFit(c, Dist.GAUSSIAN, _terms(design, built[c], c, beta, se, None), s, k, math.sqrt(var), [math.sqrt(between)])
    elif normal and schema.group:
        from ..plans.cache import _bayes_group, lmm_bayes_call, lmm_bayes_solver

        rows = P.Rows.of_groups(df, design)
        fits = P.solve(rows, [(built[c], 0.0) for c in normal], lambda job: lmm_bayes_solver(job[0], m, prior), lmm_bayes_call)
        for i, c in enumerate(normal):
            f = fits[i]
            se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(f.info)), 0))
            ls = f.extra["log_sd"]
            found[c] = NodeFit(c, Dist.GAUSSIAN, _terms(design, built[c], c, f.beta, se, None), {"mlik": _bayes_group(f, 0)[0]}, built[c].size + 2, float(np.exp(ls[0])), [float(np.exp(ls[1]))])
    else:
        for c in normal:
            model = built[c]
            if prior:
                value, mode, sd = M.gaussian_laplace(m, model)
                terms = _terms(design, model, c, mode, sd, None) + [(f"{c}|precision", None, None, float(mode[-1]), float(sd[-1]))]
                found[c] = NodeFit(c, Dist.GAUSSIAN, terms, {"mlik": value}, len(mode), 1 / math.sqrt(mode[-1]))
            else:
                ll, _, rank = M.gaussian(m, model)
                beta, se, mse = M.gaussian_coefficients(m, model)
                found[c] = NodeFit(c, Dist.GAUSSIAN, _terms(design, model, c, beta, se, None), M.scores(ll, rank + 1, m.n, model.n_parents, n_vars), rank + 1, math.sqrt(mse))
    if other:
        rows = P.Rows(df, design, group=bool(schema.group))
        jobs = [(built[c], float(m.mean[design.of[at[c]][0]])) for c in other]
        if schema.group:
            fits = P.solve(rows, jobs, lambda job: P.glmm_solver(job[0], job[1], prior, control.tol, control.max_iters), P.glmm_call)
        else:
            fits = P.solve(rows, jobs, lambda job: P.glm_solver(job[0], job[1], control.tol, control.max_iters), P.glm_call)
            again = [i for i, (model, _) in enumerate(jobs) if model.dist is Dist.BINOMIAL and not prior and (fits[i] is None or not fits[i].ok or np.abs(fits[i].beta).max(initial=0) > 15)]
            if again:
                for i in again:
                    built[other[i]].shrink = len(built[other[i]].cols) / m.n
                more = P.solve(rows, [jobs[i] for i in again], lambda job: P.glm_solver(job[0], job[1], control.tol, control.max_iters), P.glm_call)
                for k, i in enumerate(again):
                    fits[i] = more[k]
        for i, c in enumerate(other):
            model, f = built[c], fits[i]
            if f is None:
                found[c] = NodeFit(c, model.dist, [], dict(M.FAILED), 0)
                continue
            states = schema.levels[c] if model.dist is Dist.MULTINOMIAL else None
            se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(f.info)), 0))
            terms = _terms(design, model, c, f.beta, se[: model.size], states)
            if schema.group:
                k = model.size + len(f.extra["log_sd"])
                half = M.cholesky(f.extra["log_sd"], model.blocks)
                between = half @ half.T
                if prior:
                    from ..plans.cache import _bayes_group

                    s = {"mlik": _bayes_group(f, k)[0]}
                else:
                    s = M.scores(f.loglik, k, m.n, 0, n_vars)
                    s["mdl"] = s["bic"] + (k - 1) * math.log(n_vars)
                found[c] = NodeFit(c, model.dist, terms, s, k, None, [float(v) for v in np.sqrt(np.diag(between))], between.tolist() if model.blocks > 1 else None)
            elif prior:
                found[c] = NodeFit(c, model.dist, terms, {"mlik": M.laplace(f)}, model.size)
            else:
                gram = f.info[: len(model.cols), : len(model.cols)]
                drop = M.full_rank(gram)
                k = model.blocks * (len(model.cols) - drop)
                found[c] = NodeFit(c, model.dist, terms, M.scores(f.loglik, k, m.n, model.n_parents - drop, n_vars), k)
    out.nodes = {c: found[c] for c in schema.nodes}
    return out


def log_factorial(y):
    """ln Gamma(y + 1) of a column, y >= 0: Stirling's series of y + 8, brought down."""
    z = y + F.lit(8.0)
    low = F.lit(1.0)
    for k in range(1, 8):
        low = low * (y + F.lit(float(k)))
    i = 1 / z
    i2 = i * i
    series = i * (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 / 1680)))
    return (z - 0.5) * F.ln(z) - z + 0.5 * M.LN2PI + series - F.ln(low)


def score_contributions(df: DataFrame, network: Network, keys: Sequence[str] = ()) -> DataFrame:
    """Per row and node ``(keys..., node, mlik, aic, bic, mdl, hat)``: what each
    observation adds to each score, and its leverage (null for multinomial nodes).
    ``df`` has the network's scale of gaussian columns. One scan sums what the
    leverages need of all nodes; the rest is a projection: no shuffle of rows."""
    schema, n = network.schema, network.n
    design = Design.build(schema)
    wide = design.frame(df, keep=keys)
    at = {c: i for i, c in enumerate(schema.nodes)}
    plan, sums = {}, []
    for c, f in network.nodes.items():
        cols = design.columns([at[p] for p in network.dag.parents(c)])
        terms = [F.lit(1.0) if k == 0 else F.col(f"x{k}") for k in cols]
        y = F.col(f"x{design.of[at[c]][0]}")
        etas = []
        for b in range(len(design.of[at[c]]) - 1 if f.dist is Dist.MULTINOMIAL else 1):
            eta = F.lit(0.0)
            for t, term in zip(f.terms[b * len(cols) : (b + 1) * len(cols)], terms, strict=True):
                eta = eta + F.lit(t[3]) * term
            etas.append(eta)
        (eta, *_), weight, k = etas, None, len(cols) * len(etas)
        if f.dist is Dist.GAUSSIAN:
            ll = F.lit(-0.5 * math.log(2 * math.pi * f.sigma**2)) - (y - eta) * (y - eta) / F.lit(2 * f.sigma**2)
            k, weight = k + 1, F.lit(1.0)
        elif f.dist is Dist.BINOMIAL:
            ll = y * eta - F.greatest(eta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(eta)))
            mu = 1 / (1 + F.exp(-eta))
            weight = mu * (1 - mu)
        elif f.dist is Dist.POISSON:
            ll, weight = y * eta - F.exp(eta) - log_factorial(y), F.exp(eta)
        else:
            high = F.greatest(F.lit(0.0), *etas)
            total = F.exp(-high)
            ll = -high
            for e, j in zip(etas, design.of[at[c]][1:], strict=True):
                total = total + F.exp(e - high)
                ll = ll + F.col(f"x{j}") * e
            ll = ll - F.ln(total)
        plan[c] = ll, weight, k, terms
        if weight is not None:
            sums += [F.sum(weight * a * b).alias(f"{at[c]}_{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if j >= i]
    s = wide.agg(F.count(F.lit(1)), *sums).first()
    rows = []
    for c, (ll, weight, k, terms) in plan.items():
        hat = F.lit(None).cast("double")
        if weight is not None:
            xx = np.array([[s[f"{at[c]}_{min(i, j)}_{max(i, j)}"] for j in range(len(terms))] for i in range(len(terms))])
            inv = np.linalg.pinv(xx, hermitian=True)
            hat = F.lit(0.0)
            for i, a in enumerate(terms):
                for j, b in enumerate(terms):
                    hat = hat + F.lit(float(inv[i, j])) * a * b
            hat = weight * hat
        bic = -2 * ll + F.lit(k / n * math.log(n))
        mdl = bic + F.lit((1 + len(network.dag.parents(c))) / n * math.log(n))
        rows.append(F.struct(F.lit(c).alias("node"), ll.alias("mlik"), (-2 * ll + F.lit(2 * k / n)).alias("aic"), bic.alias("bic"), mdl.alias("mdl"), hat.alias("hat")))
    return wide.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")


# --- Posterior marginals --------------------------------------------------


def marginals(
    df: DataFrame, schema: Schema, dag: Dag, network: Network | None = None, nodes: Iterable[str] | None = None, points: int | None = None, spread: float = 5.0, centre: bool = True, priors: M.Priors | None = None, control: FitControl | None = None
) -> DataFrame:
    """``(node, param, x, f)``: posterior density of each coefficient and precision,
    by Laplace's method over the others; with random intercepts, too.

    The grid of a parameter goes from its mode in steps of half a standard
    deviation, either way, until the density is under ``control.min_pdf`` or
    ``control.max_grid_iter`` steps are made. Each side doubles its own step where
    the density hardly falls; intervals are halved while the densities at their ends
    differ by more than STEEP of the highest. A precision's grid stays above 0, which
    it comes near by halves. With
    ``points``, it is that many of them over mode +- spread standard deviations.
    The points that all parameters ask for are solved together, some rounds of them.
    """
    control = control or FitControl()
    network = network or fit(df, schema, dag, "bayes", centre, priors, control=control)
    schema = network.schema
    design, prior = Design.build(schema), priors or control.priors()
    df = P.only_needed(df, schema)
    gaussians = [design.of[i][0] for i, d in enumerate(schema.dists.values()) if d is Dist.GAUSSIAN]
    m = moments(df, design)
    if centre:
        m, df = m.standardised(gaussians), standardised(df, schema)
    at = {c: i for i, c in enumerate(schema.nodes)}
    built = {c: P.build_model(at[c], design, at[c], [at[p] for p in dag.parents(c)], None, prior) for c in nodes or schema.nodes}
    held: dict[bool, P.Rows] = {}

    def table(normal: bool) -> P.Rows:
        """What nodes need: the groups' sums for gaussian ones with groups, else the rows."""
        if normal not in held:
            held[normal] = P.Rows.of_groups(df, design) if normal else P.Rows(df, design, group=bool(schema.group))
        return held[normal]

    def densities(asked: list[tuple[str, int, float]]) -> list[float]:
        """Density of each (node, number of the term, value)."""
        out, jobs, where = [0.0] * len(asked), [], []
        for i, (c, k, x) in enumerate(asked):
            f, model = network.nodes[c], built[c]
            if f.dist is Dist.GAUSSIAN and not schema.group:
                out[i] = float(np.exp(M.gaussian_laplace(m, model, (k, x))[0] - f.scores["mlik"]))
            else:
                jobs.append((M.Model(len(jobs), model.dist, model.y, model.cols, model.n_parents, 0.0, prior, (k, x)), float(m.mean[model.y[0]])))
                where.append(i)
        by = lambda d: [i for i, j in enumerate(jobs) if (j[0].dist is Dist.GAUSSIAN) == d]
        for normal in (True, False):
            if not (own := by(normal)):
                continue
            mine = [jobs[i] for i in own]
            if not schema.group:
                values = {i: M.laplace(v) if v else -math.inf for i, v in P.solve(table(False), mine, lambda job: P.glm_solver(job[0], job[1], control.tol, control.max_iters), P.glm_call).items()}
            else:
                from ..plans.cache import _bayes_group, lmm_bayes_call, lmm_bayes_solver

                make, call = (lambda job: lmm_bayes_solver(job[0], m, prior), lmm_bayes_call) if normal else (lambda job: P.glmm_solver(job[0], job[1], prior, control.tol, control.max_iters), P.glmm_call)
                values = {i: _bayes_group(v, 0)[0] for i, v in P.solve(table(normal), mine, make, call).items()}
            for i, k in enumerate(own):
                out[where[k]] = float(np.exp(values[i] - network.nodes[asked[where[k]][0]].scores["mlik"]))
        return out

    terms = [(c, k, t) for c in built for k, t in enumerate(network.nodes[c].terms)]
    rows: list[tuple] = []
    if points:
        grid = [(c, k, t, float(x)) for c, k, t in terms for x in t[3] + np.linspace(-spread, spread, points) * max(t[4], 1e-12) if x > 0 or not t[0].endswith("|precision")]
        for (c, _, t, x), f in zip(grid, densities([(c, k, x) for c, k, _, x in grid]), strict=True):
            rows.append((c, t[0], x, f))
    else:
        mode, unit = ([t[k] for _, _, t in terms] for k in (3, 4))
        bounded = [t[0].endswith("|precision") for _, _, t in terms]
        found: list[dict[float, float]] = [{} for _ in terms]

        def ask(places: list[tuple[int, float]]) -> None:
            for (i, x), f in zip(places, densities([(terms[i][0], terms[i][1], x) for i, x in places]), strict=True):
                found[i][x] = f

        # (term, side) -> where it stands, its step and the steps made; a side that has come under min_pdf goes no further.
        sides = {(i, s): (mode[i], 0.5 * max(unit[i], 1e-12), 0) for i in range(len(terms)) for s in (1, -1)}
        ask([(i, float(x)) for i, x in enumerate(mode)])
        while sides and control.max_grid_iter > 0:
            way = {k: _way(*state, k[1], bounded[k[0]], control.max_grid_iter) for k, state in sides.items()}
            ask([(k[0], x) for k, xs in way.items() for x in xs])
            left = {}
            for k, xs in way.items():
                (_, h, n), f = sides[k], [found[k[0]][x] for x in xs]
                if f[-1] > control.min_pdf and n + len(xs) < control.max_grid_iter:
                    left[k] = xs[-1], 2 * h if len(f) > 1 and f[-1] > FLAT * f[-2] else h, n + len(xs)
            sides = left
        for _ in range(HALVINGS):
            steep = [(i, (a + b) / 2) for i, at in enumerate(found) for a, b in itertools.pairwise(sorted(at)) if abs(at[a] - at[b]) > STEEP * max(at.values())]
            if not steep:
                break
            ask(steep)
        rows = [(c, t[0], float(x), f) for (c, _, t), at in zip(terms, found, strict=True) for x, f in at.items()]
    return df.sparkSession.createDataFrame(rows, "node string, param string, x double, f double")


def _way(x: float, h: float, made: int, side: int, bounded: bool, most: int) -> list[float]:
    """The next points of one side of a grid; towards a bound at 0, halves of what
    is left where the step would reach it."""
    out = []
    for k in range(1, min(STEPS, most - made) + 1):
        to = x + side * k * h
        out.append(float(to if to > 0 or not bounded else (out[-1] if out else x) / 2))
    return out


def posterior(df: DataFrame, schema: Schema, dag: Dag, control: FitControl | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """What a Bayesian fit's user looks at: :func:`marginals` on ``control.n_grid``
    equal steps, of unit area if ``control.std_area``, and their
    ``control.quantiles``."""
    control = control or FitControl()
    density = marginals(df, schema, dag, control=control, **how)
    if control.n_grid:
        density = regrid(density, control.n_grid)
    if control.std_area:
        density = unit_area(density)
    return density, density_quantiles(density, control.quantiles)


def _steps(density: DataFrame, keys: Sequence[str]) -> tuple:
    by = Window.partitionBy(*keys)
    return by, by.orderBy("x")


def unit_area(density: DataFrame, keys: Sequence[str] = ("node", "param")) -> DataFrame:
    """Densities divided by their area, step * sum(f), on equal steps."""
    by, order = _steps(density, keys)
    step = F.max(F.when(F.col("k") == 2, F.col("x")).otherwise(None)).over(by) - F.min("x").over(by)
    area = step * F.sum("f").over(by)
    return density.withColumn("k", F.row_number().over(order)).withColumn("f", F.col("f") / area).select(*keys, "x", "f")


def density_quantiles(density: DataFrame, at: Sequence[float] = (0.025, 0.25, 0.5, 0.75, 0.975), keys: Sequence[str] = ("node", "param")) -> DataFrame:
    """``(keys..., p, x)``: the first x whose share of the running sum exceeds p."""
    by, order = _steps(density, keys)
    run = F.sum("f").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("f").over(by)
    cum = density.withColumn("c", run)
    ask = cum.select(*keys, "x", "c", F.explode(F.array(*[F.lit(float(p)) for p in at])).alias("p"))
    return ask.groupBy(*keys, "p").agg(F.min(F.when(F.col("c") > F.col("p"), F.col("x"))).alias("x"))


def regrid(density: DataFrame, points: int = 250, keys: Sequence[str] = ("node", "param")) -> DataFrame:
    """Each density on ``points`` equal steps, by a natural cubic spline."""

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values("x")
        x, y = pdf["x"].to_numpy(), pdf["f"].to_numpy()
        q = np.linspace(x[0], x[-1], points)
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * points for k in keys})
        out["x"], out["f"] = q, np.maximum(spline(x, y, q), 0)
        return out

    kinds = dict(density.dtypes)
    return density.groupBy(*keys).applyInPandas(one, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", x double, f double")


def spline(x: np.ndarray, y: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Natural cubic spline through (x, y) at q."""
    n = len(x)
    if n < 3:
        return np.interp(q, x, y)
    h = np.diff(x)
    a = np.zeros((n, n))
    a[0, 0] = a[-1, -1] = 1
    r = np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    c = np.linalg.solve(a, r)
    k = np.clip(np.searchsorted(x, q) - 1, 0, n - 2)
    u, v = x[k + 1] - q, q - x[k]
    return (c[k] * u**3 + c[k + 1] * v**3) / (6 * h[k]) + (y[k] / h[k] - c[k] * h[k] / 6) * u + (y[k + 1] / h[k] - c[k + 1] * h[k] / 6) * v


def mse_from_modes(coefficients: DataFrame) -> DataFrame:
    """``(node, mse)``: 1 / precision of the gaussian nodes."""
    return coefficients.filter(F.col("term").endswith("|precision")).select("node", (1 / F.col("estimate")).alias("mse"))


def mode_of(density: DataFrame, keys: Sequence[str] = ("node", "param"), points: int = 10_000) -> DataFrame:
    """``(keys..., mode)``: where the spline through each density is highest."""
    top = Window.partitionBy(*keys).orderBy(F.desc("f"), "x")
    return regrid(density, points, keys).withColumn("r", F.row_number().over(top)).filter("r = 1").select(*keys, F.col("x").alias("mode"))


def modes_to_coefficients(coefficients: DataFrame) -> DataFrame:
    """``(node, name, estimate)``: modes without the precisions, intercepts as
    ``node|intercept``, slopes under the parent's name."""
    return coefficients.filter(~F.col("term").endswith("|precision")).select("node", F.regexp_replace("term", r"^[^|]*\|(?!intercept)", "").alias("name"), "estimate")


__all__ = ["Network", "NodeFit", "density_quantiles", "fit", "log_factorial", "marginals", "mode_of", "modes_to_coefficients", "mse_from_modes", "posterior", "regrid", "score_contributions", "spline", "unit_area", "wald"]
