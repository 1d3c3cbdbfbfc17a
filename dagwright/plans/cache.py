"""Score caches: every admissible parent set of every node, with its scores."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Dag
from ..operators import models as M
from ..operators.moments import Design, Moments, moments
from ..operators.parent_sets import parent_sets, user_sets
from ..schema import Dist, Schema, standardised, validate, with_levels
from ..storage import stored
from .controls import BuildControl
from .fitting import Rows, build_model, fit_sets, glm_call, glm_solver, glmm_call, glmm_solver, lmm_call, lmm_solver, only_needed

SCORES = ("mlik", "aic", "bic", "mdl")


def build_cache(
    df: DataFrame,
    schema: Schema,
    method: str = "mle",
    limit: int | Iterable[int] | Mapping[str, int] | None = None,
    banned: Dag | None = None,
    retained: Dag | None = None,
    which: Iterable[str] | None = None,
    adjusted: Iterable[str] = (),
    sets: Iterable[tuple[str, Iterable[str]]] | None = None,
    centre: bool = True,
    priors: M.Priors | None = None,
    reml: bool = True,
    dry_run: bool = False,
    check: bool = True,
    control: BuildControl | None = None,
) -> DataFrame:
    """``(row_id, child, child_name, parents, mask, n_parents, mlik, aic, bic,
    mdl, error_code)``.

    ``mle``: log likelihood (mlik) and the scores made of it; ``bayes``: mlik is
    the log marginal likelihood by Laplace's method, the others are null. A
    schema with a group column adds a random intercept for each group. Gaussian
    nodes need one scan for all parent sets (cross-products); other nodes are
    fitted in the tasks if the table, equal rows merged, is small, else over
    scans that all models share. A fit that fails scores minus infinity
    (error_code 2). ``control`` has the priors, unless given, and the solvers'
    tolerance and most steps.
    """
    control = control or BuildControl()
    if method not in ("mle", "bayes"):
        raise ValueError("method is 'mle' or 'bayes'")
    spark = df.sparkSession
    if which is not None:
        schema = schema.only(which)
    if check:
        validate(df, schema)
    made = user_sets(spark, schema, sets) if sets is not None else parent_sets(spark, schema, limit, banned, retained, None, adjusted)
    if dry_run:
        return made
    schema = with_levels(df, schema)
    df = only_needed(df, schema)
    gaussians = [i for i, d in enumerate(schema.dists.values()) if d is Dist.GAUSSIAN]
    design = Design.build(schema)
    prior = (priors or control.priors()) if method == "bayes" else None
    children = [r[0] for r in made.select("child").distinct().collect()]
    out = []
    m: Moments | None = None
    if any(c in gaussians for c in children) or schema.group:
        m = moments(df, design)
        if centre:
            m = m.standardised([design.of[i][0] for i in gaussians])
    rest = [c for c in children if c not in gaussians or schema.group]
    if centre and gaussians and rest:
        df = standardised(df, schema)
    if not schema.group and any(c in gaussians for c in children):
        out.append(_from_moments(made.filter(F.col("child").isin([c for c in children if c in gaussians])), design, m, prior))
    if rest:
        out.append(_fitted(df, made.filter(F.col("child").isin(rest)), design, m, prior, reml, control))
    scored = out[0]
    for x in out[1:]:
        scored = scored.unionByName(x)
    return scored


def _columns(made: DataFrame) -> str:
    return "row_id long, child int, child_name string, parents array<int>, mask long, n_parents int, mlik double, aic double, bic double, mdl double, error_code int"


def _from_moments(made: DataFrame, design: Design, m: Moments, prior: M.Priors | None) -> DataFrame:
    """Gaussian scores: cross-products are broadcast (columns squared), sets stay distributed."""
    shared = made.sparkSession.sparkContext.broadcast((design, m))
    n_vars = len(design.schema.dists)

    def score(batches):
        design, m = shared.value
        for pdf in batches:
            got = []
            for key, child, parents in zip(pdf["row_id"], pdf["child"], pdf["parents"], strict=True):
                model = build_model(int(key), design, int(child), [int(p) for p in parents], m.n, prior)
                if prior:
                    value = M.gaussian_laplace(m, model)[0]
                    got.append((value, None, None, None, 0 if np.isfinite(value) else 2))
                else:
                    ll, _, rank = M.gaussian(m, model)
                    s = M.scores(ll, rank + 1, m.n, model.n_parents, n_vars)
                    got.append((*(s[k] for k in SCORES), 0))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(got, columns=[*SCORES, "error_code"]).astype({"error_code": "int32"})], axis=1)

    return made.mapInPandas(score, _columns(made))


_SCORE_COLUMNS = "mlik double, aic double, bic double, mdl double, error_code int"


def scoring(design: Design, n: float, mean: Mapping[str, float] | np.ndarray, m: Moments | None, prior: M.Priors | None, reml: bool, control: BuildControl):
    """``(job, ways)``: ``job(row_id, child, parents)`` is the job of a parent set,
    ``ways(gaussian)`` the solver, what it asks of the rows (of the groups' sums,
    for gaussian nodes with groups), and what becomes of its fit: a row of scores."""
    n_vars, grouped = len(design.schema.dists), bool(design.schema.group)
    tol, most = control.tol, control.max_iters

    def job(key, child, parents):
        return build_model(key, design, child, parents, n, prior), float(mean[design.of[child][0]])

    def mixed(loglik: float, df_: int) -> tuple:
        s = M.scores(loglik, df_, n, 0, n_vars)
        s["mdl"] = s["bic"] + (df_ - 1) * np.log(n_vars)
        return (*(float(s[k]) for k in SCORES), 0)

    failed = (*M.FAILED.values(), 2)

    def finish(job, fit) -> tuple:
        model = job[0]
        if fit is None or not np.isfinite(fit.loglik):
            return failed
        if prior:
            if grouped:
                return _bayes_group(fit, model.size + model.blocks)
            value = M.laplace(fit)
            return (value, None, None, None, 0 if np.isfinite(value) else 2)
        if grouped:
            return mixed(fit.loglik, model.size + len(fit.extra["log_sd"]))
        gram = fit.info[: len(model.cols), : len(model.cols)]
        drop = M.full_rank(gram) if len(gram) else 0
        s = M.scores(fit.loglik, model.blocks * (len(model.cols) - drop), n, model.n_parents - drop, n_vars)
        return (*(float(s[k]) for k in SCORES), 0)

    def ways(gaussian: bool):
        if gaussian and prior:
            return (lambda j: lmm_bayes_solver(j[0], m, prior)), lmm_bayes_call, lambda j, fit: _bayes_group(fit, j[0].size + 2)
        if gaussian:
            return (lambda j: lmm_solver(j[0], m, reml)), lmm_call, lambda j, fit: mixed(fit[0], len(j[0].cols) + 2) if fit else failed
        if grouped:
            return (lambda j: glmm_solver(j[0], j[1], prior, tol, most)), glmm_call, finish
        return (lambda j: glm_solver(j[0], j[1], tol, most)), glm_call, finish

    return job, ways


def _fitted(df: DataFrame, made: DataFrame, design: Design, m: Moments | None, prior: M.Priors | None, reml: bool, control: BuildControl) -> DataFrame:
    """Scores that need a likelihood of the rows; the sets stay a table all along."""
    made = stored(made, "sets")
    x = design.frame(df)
    stats = x.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"x{i}") for i in range(1, len(design.names))]).first()
    mean = np.array([1.0, *(stats[f"x{i}"] for i in range(1, len(design.names)))])
    job, ways = scoring(design, float(stats["n"]), mean, m, prior, reml, control)
    normal = [i for i, d in enumerate(design.schema.dists.values()) if d is Dist.GAUSSIAN]
    children = {r[0] for r in made.select("child").distinct().collect()}
    out = []
    if gaussian := children & set(normal):
        out.append(fit_sets(Rows.of_groups(df, design), made.filter(F.col("child").isin([*gaussian])), job, *ways(True), _SCORE_COLUMNS))
    if children - set(normal):
        sets = made.filter(~F.col("child").isin(normal)) if normal else made
        out.append(fit_sets(Rows(df, design, group=bool(design.schema.group)), sets, job, *ways(False), _SCORE_COLUMNS))
    both = out[0]
    for other in out[1:]:
        both = both.unionByName(other)
    return both.select(*made.columns, *SCORES, "error_code")


def score_here(design: Design, m: Moments, a: np.ndarray, w: np.ndarray, g: np.ndarray, sets: Iterable[tuple[int, int, tuple[int, ...]]]) -> list[tuple]:
    """``(row_id, mlik, aic, bic, mdl, error_code)`` of sets of a table that is all
    at hand (rows ``a``, weights, groups, moments), gaussian columns standardised:
    what a cache build would give. Without groups, ``a`` may be None if all nodes
    are gaussian."""
    schema, n_vars = design.schema, len(design.schema.dists)
    dists = list(schema.dists.values())
    job, ways = scoring(design, m.n, m.mean, m, None, True, BuildControl())
    sums = None
    if schema.group:
        n = np.bincount(g, w)
        sums = np.column_stack([np.bincount(g, w * a[:, i]) for i in range(a.shape[1])]), n, np.zeros(len(n), int)
    out = []
    for key, child, parents in sets:
        j = job(key, child, list(parents))
        normal = dists[child] is Dist.GAUSSIAN
        if normal and not schema.group:
            ll, _, rank = M.gaussian(m, j[0])
            s = M.scores(ll, rank + 1, m.n, j[0].n_parents, n_vars)
            out.append((key, *(float(s[k]) for k in SCORES), 0))
            continue
        make, call, finish = ways(normal)
        at = sums if normal else (a, w, g)
        try:
            fit = M.run(make(j), lambda ask, j=j, at=at, call=call: call(j, ask, *at))
        except (np.linalg.LinAlgError, FloatingPointError, ValueError):
            fit = None
        out.append((key, *finish(j, fit)))
    return out


def _bayes_group(fit, size: int) -> tuple:
    """Laplace's method over coefficients and precisions from the point and
    information that the outer search found (in ln of the spreads)."""
    if fit is None or not np.isfinite(fit.loglik):
        return (float("-inf"), None, None, None, 2)
    info = fit.info.copy()
    # d ln sd = -d tau / (2 tau): curvature in the precision itself
    for i, ls in enumerate(fit.extra["log_sd"]):
        k = len(info) - len(fit.extra["log_sd"]) + i
        f = 1 / (2 * np.exp(-2 * ls))
        info[k, :] *= f
        info[:, k] *= f
    sign, logdet = np.linalg.slogdet(info)
    if sign <= 0:
        return (float("-inf"), None, None, None, 4)
    return (float(fit.extra["goal"] - 0.5 * logdet + 0.5 * len(info) * M.LN2PI), None, None, None, 0)


def lmm_bayes_solver(model: M.Model, m: Moments, prior: M.Priors):
    """Gaussian random intercept with priors: over coefficients and the logs of
    both spreads; a scan gives the groups' share."""
    p = len(model.cols)
    xx = m.raw(model.cols)
    xy = m.cross[model.cols, model.y[0]] + m.n * m.mean[model.cols] * m.mean[model.y[0]]
    yy = m.cross[model.y[0], model.y[0]] + m.n * m.mean[model.y[0]] ** 2
    beta = np.linalg.lstsq(xx, xy, rcond=1e-12)[0]
    sd = 0.5 * np.log(max((yy - beta @ xy) / m.n, 1e-12))

    def rest(x, got):
        b, te = x[:p], np.exp(-2 * x[p])
        rss = yy - 2 * b @ xy + b @ xx @ b
        out = 0.5 * m.n * (np.log(te) - M.LN2PI) - 0.5 * te * rss + got
        d = b - prior.mean
        out += 0.5 * p * (np.log(prior.precision) - M.LN2PI) - 0.5 * prior.precision * (d @ d)
        for ls in x[p:]:
            tau = np.exp(-2 * ls)
            out += prior.shape * np.log(prior.inv_scale) - np.log(M.math.gamma(prior.shape)) + (prior.shape - 1) * np.log(tau) - prior.inv_scale * tau
        return float(out)

    first, free = np.r_[beta, sd, sd - 1.0], np.ones(p + 2, bool)
    if model.fixed:
        free[model.fixed[0]], first[model.fixed[0]] = False, model.fixed[1]

    def whole(v):
        x = first.copy()
        x[free] = v
        return x

    outer = M.maximise(first[free])
    points = next(outer)
    while True:
        full = [whole(v) for v in points]
        got = yield full
        try:
            points = outer.send([rest(x, v) for x, v in zip(full, got, strict=True)])
        except StopIteration as end:
            v, value, info = end.value
            x = whole(v)
            return M.Fit(x[:p], value, info, bool(np.isfinite(value)), {"log_sd": x[p:], "goal": value})


def lmm_bayes_call(job, ask, a, w, g) -> np.ndarray:
    """The groups' share at each point: rows are groups, columns their sums, ``w`` their sizes."""
    model = job[0]
    p = len(model.cols)
    s = np.column_stack([w if c == 0 else a[:, c] for c in model.cols]) if p else np.zeros((len(w), 0))
    out = []
    for q in ask:
        te, r = np.exp(-2 * q[p]), np.exp(2 * (q[p + 1] - q[p]))
        u = a[:, model.y[0]] - s @ q[:p]
        out.append(float((0.5 * te * (r / (1 + r * w)) * u * u - 0.5 * np.log1p(r * w)).sum()))
    return np.array(out)


def tidy(cache: DataFrame) -> DataFrame:
    """Without the sets whose fit failed."""
    return cache.filter("error_code = 0")


def score_column(score: str):
    """A score to be maximised: log likelihoods as they are, the others negated;
    missing and infinite ones as the smallest number."""
    if score not in SCORES:
        raise ValueError(f"score is one of {SCORES}")
    c = F.col(score) if score == "mlik" else -F.col(score)
    bad = F.col(score).isNull() | F.isnan(score) | (F.abs(F.col(score)) == float("inf"))
    return F.when(bad, F.lit(-1.797e308)).otherwise(c)


def summary(cache: DataFrame) -> DataFrame:
    """``(score, n, least, q1, median, q3, greatest, mean)`` of each score's finite
    values; a cache has as many rows as there are parent sets, so they are sorted
    as they are."""
    out = None
    for s in SCORES:
        ok = cache.filter(F.col(s).isNotNull() & (F.abs(s) != float("inf"))).select(F.col(s).alias("v"))
        q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        row = ok.agg(F.count("v").alias("n"), F.min("v").alias("least"), q.alias("q"), F.max("v").alias("greatest"), F.avg("v").alias("mean"))
        one = row.select(F.lit(s).alias("score"), "n", "least", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "greatest", "mean")
        out = one if out is None else out.unionByName(one)
    return out
