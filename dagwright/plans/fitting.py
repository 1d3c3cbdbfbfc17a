"""Chooses how a regression runs: from moments, within a task, or over scans."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mixed as X
from ..operators import models as M
from ..operators.moments import Design
from ..schema import Dist, Schema
from ..storage import Growing, stored
from .grouped import Groups

#: A table of at most so many numbers (32 MB) is sent to the tasks, which then
#: share the models out; over a larger one, all models advance together, by scan.
LOCAL = 4_000_000
#: A column with more values than this, and than a tenth of the rows, tells rows apart.
MANY = 1_000
#: Models that advance together; what they keep in the driver is a few MB.
TOGETHER = 2_000


def compressed(df: DataFrame, design: Design, group: bool = False) -> DataFrame:
    """Design columns with a weight ``w``; equal rows are one row, unless columns
    have so many values that few rows can be equal: measured, not told from the
    distributions."""
    x = design.frame(df, group)
    kinds = [c for d, cols in zip(design.schema.dists.values(), design.of, strict=True) if d not in (Dist.BINOMIAL, Dist.MULTINOMIAL) for c in cols]
    if kinds:
        seen = x.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(f"x{i}").alias(f"d{i}") for i in kinds]).first()
        if max(seen[f"d{i}"] for i in kinds) > max(MANY, seen["n"] // 10):
            return x.withColumn("w", F.lit(1.0))
    return x.groupBy(*x.columns).agg(F.count(F.lit(1)).cast("double").alias("w"))


class Rows:
    """The rows of a design, held once: in the tasks if small, else stored."""

    def __init__(self, df: DataFrame, design: Design, group: bool = False):
        self.design, self.width, self.group = design, len(design.names), group
        self._hold(stored(compressed(df, design, group), "design"))

    def _hold(self, frame: DataFrame) -> None:
        self.frame, self.spark = frame, frame.sparkSession
        self.count = frame.count()
        self.local = self.count * (self.width + 1) <= LOCAL

    @classmethod
    def of_groups(cls, df: DataFrame, design: Design) -> Rows:
        """One row for each group: sums of its columns, its number of rows as the weight."""
        rows = cls.__new__(cls)
        rows.design, rows.width, rows.group = design, len(design.names), False
        rows._hold(group_sums(df, design).withColumnRenamed("n", "w"))
        return rows

    def matrix(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = self.frame.toArrow()
        return arrays(t, self.width, self.group)


def arrays(t, width: int, group: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(design matrix with the intercept, weights, group numbers)"""
    a = np.ones((t.num_rows, width))
    for i in range(1, width):
        a[:, i] = t.column(f"x{i}").to_numpy()
    g = np.unique(np.array(t.column("g").to_pylist(), dtype=object).astype(str), return_inverse=True)[1] if group and t.num_rows else np.zeros(t.num_rows, int)
    return a, t.column("w").to_numpy().astype(float), g


def solve(rows: Rows, jobs: list, make: Callable, call: Callable) -> dict:
    """Runs a solver for each job: ``make(job)`` gives the coroutine, ``call(job,
    ask, a, w, g)`` an array that adds up over the parts of the table. Returns
    results by job key."""
    if rows.local:
        shared = rows.spark.sparkContext.broadcast(rows.matrix())
        sent = rows.spark.sparkContext.broadcast(jobs)

        def each(batches):
            import pickle

            a, w, g = shared.value
            for b in batches:
                at = b.column("id").to_pylist()
                done = []
                for i in at:
                    job = sent.value[i]
                    try:
                        done.append(pickle.dumps(M.run(make(job), lambda ask, job=job: call(job, ask, a, w, g))))
                    except (np.linalg.LinAlgError, FloatingPointError, ValueError):
                        done.append(pickle.dumps(None))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(done, pa.binary())], names=["id", "fit"])

        import pickle

        parts = max(1, min(len(jobs), rows.spark.sparkContext.defaultParallelism * 2))
        # All tasks at once; a result is the size of its job, which the driver holds as well.
        out = rows.spark.range(0, len(jobs), 1, parts).mapInArrow(each, "id long, fit binary").toArrow()
        return {i: pickle.loads(f) for i, f in zip(out.column("id").to_pylist(), out.column("fit").to_pylist(), strict=True)}
    found: dict = {}
    for s in range(0, len(jobs), TOGETHER):
        groups = Groups(rows.frame, rows.width) if rows.group else None
        found |= _lockstep(rows, groups, jobs, range(s, min(s + TOGETHER, len(jobs))), make, call)
        if groups:
            groups.close()
    return found


def fit_sets(rows: Rows, sets: DataFrame, job: Callable, make: Callable, call: Callable, finish: Callable, columns: str) -> DataFrame:
    """``sets`` (row_id, child, parents, ...) with the scores of each: ``job(row_id,
    child, parents)`` is its job, ``make`` and ``call`` as in :func:`solve`,
    ``finish(job, fit)`` its row of ``columns``; stored.

    A table that is sent to the tasks meets the sets where they are: a set never
    leaves its task. Over a larger one, ``TOGETHER`` sets at a time advance by scan;
    they are read one partition after another and written when done, so the driver
    holds one such block, however many sets there are.
    """
    names = [c.split()[0] for c in columns.split(", ")]
    types = ", ".join([*(f"{c} {t}" for c, t in sets.dtypes), columns])
    if rows.local:
        shared = rows.spark.sparkContext.broadcast(rows.matrix())

        def each(batches):
            a, w, g = shared.value
            for pdf in batches:
                out = []
                for key, child, parents in zip(pdf["row_id"], pdf["child"], pdf["parents"], strict=True):
                    j = job(int(key), int(child), [int(p) for p in parents])
                    try:
                        fit = M.run(make(j), lambda ask, j=j: call(j, ask, a, w, g))
                    except (np.linalg.LinAlgError, FloatingPointError, ValueError):
                        fit = None
                    out.append(finish(j, fit))
                yield pd.concat([pdf.reset_index(drop=True), _scored(out, names)], axis=1)

        parts = max(rows.spark.sparkContext.defaultParallelism * 2, math.ceil(sets.count() / 2_000))
        return stored(sets.repartition(parts).mapInPandas(each, types), "scores")
    done = Growing(rows.spark, types, "scores")
    todo = sets.toLocalIterator()
    while some := list(islice(todo, TOGETHER)):
        jobs = [job(int(r["row_id"]), int(r["child"]), [int(p) for p in r["parents"]]) for r in some]
        groups = Groups(rows.frame, rows.width) if rows.group else None
        fits = _lockstep(rows, groups, jobs, range(len(jobs)), make, call)
        if groups:
            groups.close()
        done.add([(*r, *finish(j, fits[i])) for i, (r, j) in enumerate(zip(some, jobs, strict=True))])
    return done.frame()


def _scored(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    plain = lambda x: None if x is None else x if isinstance(x, int) else float(x)
    return pd.DataFrame([tuple(map(plain, r)) for r in rows], columns=names).astype({names[-1]: "int32"})


def _lockstep(rows: Rows, groups: Groups | None, jobs: list, ids: Iterable[int], make, call) -> dict:
    solvers = {i: make(jobs[i]) for i in ids}
    asks, found = {}, {}
    for i, s in solvers.items():
        asks[i] = next(s)
    while asks:
        # What needs each group's intercepts goes over the groups' state, all else over the rows.
        whole = {i: a for i, a in asks.items() if isinstance(a, tuple) and a[0] == "groups"}
        got = _row_sums(rows, jobs, {i: a for i, a in asks.items() if i not in whole}, call)
        if whole:
            got |= {i: np.concatenate(v) for i, v in groups.terms([(i, jobs[i][0], a[1]) for i, a in whole.items()]).items()}
        following = {}
        for i in asks:
            try:
                following[i] = solvers[i].send(got[i])
            except StopIteration as end:
                found[i] = end.value
            except (np.linalg.LinAlgError, FloatingPointError, ValueError):
                found[i] = None
        asks = following
    return found


def _row_sums(rows: Rows, jobs: list, asks: dict, call) -> dict[int, np.ndarray]:
    """What ``call`` gives for each ask, added up over all rows in one scan."""
    if not asks:
        return {}
    width = rows.width
    sent = rows.spark.sparkContext.broadcast([(i, jobs[i], a) for i, a in asks.items()])

    def part(batches):
        total: dict[int, np.ndarray] = {}
        for t in batches:
            if not t.num_rows:
                continue
            a, w, g = arrays(t, width, False)
            for i, job, ask in sent.value:
                v = call(job, ask, a, w, g)
                total[i] = total[i] + v if i in total else v
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(list(total), [len(v) for v in total.values()])), pa.array(np.concatenate([np.arange(len(v)) for v in total.values()])), pa.array(np.concatenate(list(total.values())))],
                names=["id", "k", "v"],
            )

    sums: dict[int, list] = {}
    for i, k, v in rows.frame.mapInArrow(part, "id long, k long, v double").groupBy("id", "k").agg(F.sum("v").alias("v")).collect():
        sums.setdefault(i, []).append((k, v))
    sent.unpersist()
    return {i: np.array([v for _, v in sorted(sums[i])]) for i in asks}


# --- Jobs -----------------------------------------------------------------


def pack(model: M.Model, beta: np.ndarray, a, w) -> np.ndarray:
    goal, loglik, grad, info = M.evaluate(model, beta, a, w)
    return np.r_[goal, loglik, grad, info.ravel()]


def unpack(model: M.Model, v: np.ndarray) -> tuple:
    p = model.size
    return v[0], v[1], v[2 : 2 + p], v[2 + p :].reshape(p, p)


def glm_solver(model: M.Model, mean_y: float, tol: float = 1e-8, most: int = 100):
    """Newton's method in the terms of :func:`solve`."""
    inner = M.newton(model, M.start(model, mean_y), tol, most)
    ask = next(inner)
    while True:
        got = yield ask
        try:
            ask = inner.send(unpack(model, got))
        except StopIteration as end:
            return end.value


def glm_call(job, ask, a, w, g) -> np.ndarray:
    return pack(job[0], ask, a, w)


#: Standard deviations of the groups that a search begins with, one after another.
SPREADS = (0.3, 1.0, 0.05)


def glmm_solver(model: M.Model, mean_y: float, priors: M.Priors | None = None, tol: float = 1e-8, most: int = 100):
    """Fits without groups first, then the coefficients and spreads together; a
    fixed coefficient stays where it is."""
    plain = M.Model(model.key, model.dist, model.y, model.cols, model.n_parents)
    inner = M.newton(plain, M.start(plain, mean_y), tol, most)
    ask = next(inner)
    while True:
        got = yield ("rows", ask)
        try:
            ask = inner.send(unpack(plain, got))
        except StopIteration as end:
            fit = end.value
            break
    p, k, size = model.size, model.blocks, X.dimension(model)

    def prior(x):
        """(log density, slope) of coefficients and precisions"""
        slope = np.zeros(size)
        if priors is None:
            return 0.0, slope
        d, tau = x[:p] - priors.mean, np.exp(-2 * x[p : p + k])
        out = 0.5 * p * (math.log(priors.precision) - M.LN2PI) - 0.5 * priors.precision * (d @ d)
        slope[:p] = -priors.precision * d
        slope[p : p + k] = -2 * (priors.shape - 1) + 2 * priors.inv_scale * tau
        return out + float((priors.shape * math.log(priors.inv_scale) - math.lgamma(priors.shape) + (priors.shape - 1) * np.log(tau) - priors.inv_scale * tau).sum()), slope

    # Intercepts of several categories vary together: their covariance is free.
    free = np.ones(size, bool)
    guess = np.eye(size) * 0.05
    guess[:p, :p] = np.linalg.pinv(fit.info, hermitian=True) if len(fit.info) == p else guess[:p, :p]
    best = None
    # A search that ends at no maximum is tried again from other spreads.
    for spread in SPREADS:
        first = np.r_[fit.beta, np.full(k, math.log(spread)), np.zeros(size - p - k)]
        if model.fixed:
            free[model.fixed[0]], first[model.fixed[0]] = False, model.fixed[1]

        def whole(v, first=first):
            x = first.copy()
            x[free] = v
            return x

        outer = X.ascend(first[free], guess[np.ix_(free, free)], tol, most)
        points = next(outer)
        while True:
            full = [whole(v) for v in points]
            got = np.asarray((yield ("groups", full))).reshape(len(full), 1 + size)
            answers = []
            for x, row in zip(full, got, strict=True):
                more = prior(x), X.penalty(model, x)
                answers.append((row[0] + sum(v for v, _ in more), (row[1:] + sum(s for _, s in more))[free]))
            try:
                points = outer.send(answers)
            except StopIteration as end:
                v, value, info = end.value
                break
        x = whole(v)
        top = bool(np.isfinite(value)) and np.linalg.slogdet(info)[0] > 0
        if best is None or (top, value) > best[:2]:
            best = top, value, M.Fit(x[:p], value - prior(x)[0], info, bool(np.isfinite(value)), {"log_sd": x[p:], "goal": value})
        if top:
            break
    return best[2]


def glmm_call(job, ask, a, w, g) -> np.ndarray:
    """Answers of :func:`glmm_solver` where all rows are at hand, or sums over some rows of its first phase."""
    model = job[0]
    kind, what = ask
    if kind == "rows":
        return pack(M.Model(model.key, model.dist, model.y, model.cols, model.n_parents), what, a, w)
    n = int(g.max()) + 1
    return np.concatenate([X.local_terms(model, x, a, w, g, n) for x in what])


def build_model(key: int, design: Design, child: int, parents: Iterable[int], n: float | None = None, priors: M.Priors | None = None) -> M.Model:
    dist = list(design.schema.dists.values())[child]
    cols = design.columns(list(parents))
    shrink = len(cols) / n if dist is Dist.BINOMIAL and n and priors is None else 0.0
    n_parents = sum(len(design.of[p]) for p in parents)
    return M.Model(key, dist, design.of[child], cols, n_parents, shrink, priors)


def group_sums(df: DataFrame, design: Design) -> DataFrame:
    """Per group: rows ``n`` and the sums of the design columns; stored."""
    x = design.frame(df, group=True)
    return stored(x.groupBy("g").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(f"x{i}").alias(f"x{i}") for i in range(1, len(design.names))]), "groups")


def lmm_solver(model: M.Model, m, reml: bool = True):
    """Gaussian random intercept over the groups' sums (:meth:`Rows.of_groups`): the
    variance ratio is closed in on by four grids; asks for ratios, gets for each the
    sums over groups of c s s' and of ln(1 + ratio n)."""
    own = [*model.cols, model.y[0]]
    yx = m.raw(own)
    if 0 in own:
        yx[own.index(0), own.index(0)] = m.n
    grid, best, p = np.r_[0.0, np.logspace(-8, 6, 43)], None, len(model.cols)
    for turn in range(4):
        got = (yield grid).reshape(len(grid), -1)
        fit = M.lmm(m.n, yx, grid, got[:, :-1].reshape(len(grid), p + 1, p + 1), got[:, -1], list(range(p)), p, reml)
        best = fit if turn == 0 or fit[0] >= best[0] else best
        k = int(np.searchsorted(grid, fit[1]))
        lo, hi = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
        grid = np.unique(np.r_[fit[1], np.linspace(lo, hi, 13)])
    return best


def lmm_call(job, ask, a, w, g) -> np.ndarray:
    model = job[0]
    s = np.column_stack([w if c == 0 else a[:, c] for c in (*model.cols, model.y[0])])
    return np.concatenate([np.r_[(s.T @ (s * (r / (1 + r * w))[:, None])).ravel(), np.log1p(r * w).sum()] for r in ask])


def only_needed(df: DataFrame, schema: Schema) -> DataFrame:
    return df.select(*schema.nodes, *([schema.group] if schema.group else []))
