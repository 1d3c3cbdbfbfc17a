"""Random networks, and rows drawn from a network."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..graph import Dag
from ..schema import Dist, Schema
from ..storage import stored
from .fit import Network
from .moments import Design, Moments


def random_dag(nodes: Sequence[str], density: float = 0.5, seed: int = 0) -> Dag:
    """Each pair in a random order of the nodes is an arc with the given probability."""
    if not 0 <= density <= 1:
        raise ValueError("the density is in [0, 1]")
    rng = np.random.default_rng(seed)
    order = [nodes[i] for i in rng.permutation(len(nodes))]
    return Dag.of(nodes, [(order[i], order[j]) for j in range(len(order)) for i in range(j) if rng.random() < density])


@F.pandas_udf(DoubleType())
def _poisson(rate: pd.Series, u: pd.Series) -> pd.Series:
    """The u quantile of a Poisson variable: fixed by its arguments."""
    rate, u = rate.to_numpy(dtype=float), u.to_numpy(dtype=float)
    rate = np.maximum(rate, 0.0)
    out = np.zeros(len(rate))
    big = rate > 500
    p = np.exp(-np.where(big, 0, rate))
    total, todo, k = p.copy(), ~big & (u > p), 0
    while todo.any() and k < 5000:
        k += 1
        p = p * rate / k
        total = total + p
        out[todo] = k
        todo &= u > total
    if big.any():
        # Wilson-Hilferty; exact enough beyond 500
        z = _normal_quantile(u[big])
        out[big] = np.maximum(0, np.round(rate[big] * (1 - 1 / (9 * rate[big]) + z / (3 * np.sqrt(rate[big]))) ** 3))
    return pd.Series(out)


def _normal_quantile(u: np.ndarray) -> np.ndarray:
    """Quantiles of the standard normal: a first guess by the logistic distribution,
    then Halley steps on the distribution function to rounding."""
    u = np.clip(u, 1e-15, 1 - 1e-15)
    z = np.clip(np.log(u / (1 - u)) / 1.702, -8, 8)
    for _ in range(30):
        density = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
        error = (0.5 * np.array([math.erfc(-x / math.sqrt(2)) for x in z]) - u) / density
        step = error / (1 + 0.5 * z * error)
        z = z - np.clip(step, -1, 1)
        if np.abs(step).max(initial=0) < 1e-12:
            break
    return z


def uniform(key: Column, *salt: int) -> Column:
    """A number in (0, 1) fixed by the key: the same whichever task draws it."""
    bits = 48
    return (F.pmod(F.xxhash64(key, *[F.lit(s) for s in salt]), F.lit(1 << bits)) + 0.5) / float(1 << bits)


def normal(key: Column, *salt: int) -> Column:
    return F.sqrt(-2 * F.ln(uniform(key, *salt, 0))) * F.cos(2 * F.pi() * uniform(key, *salt, 1))


def simulate(spark: SparkSession, network: Network, rows: int = 1000, seed: int = 42, groups: int | None = None, replicates: int | None = None) -> DataFrame:
    """``(id, nodes...)``: rows drawn parent by parent, in generated code (counts
    by an Arrow function). A network with random intercepts draws a value for
    each of ``groups`` (by default as many as rows / 10) and adds ``group_id``.
    With ``replicates``, so many tables of ``rows`` rows are one, told apart by
    ``replicate``; each has groups of its own."""
    schema, dag = network.schema, network.dag
    grouped = any(f.sigma_alpha for f in network.nodes.values())
    out = spark.range(rows * (replicates or 1))
    if grouped:
        groups = groups or max(1, rows // 10)
        out = out.withColumn("group_id", F.floor(F.col("id") / rows) * groups + F.col("id") % rows % groups)
    for k, c in enumerate(dag.order()):
        f = network.nodes[c]
        states = list(schema.levels[c]) if f.dist is Dist.MULTINOMIAL else [None]
        etas = []
        for b in range(max(1, len(states) - 1)):
            part = [t for t in f.terms if f.dist is not Dist.MULTINOMIAL or t[1] == str(states[b + 1])]
            eta: Column = F.lit(0.0)
            for name, state, parent, value, _ in part:
                if name.endswith("|precision"):
                    continue
                eta = eta + F.lit(value) * _term(schema, c, name, state, parent)
            if f.covariance:
                for j, x in enumerate(np.linalg.cholesky(np.array(f.covariance) + 1e-12 * np.eye(len(f.covariance)))[b, : b + 1]):
                    eta = eta + F.lit(float(x)) * normal(F.col("group_id"), seed, k, j, 7)
            elif f.sigma_alpha:
                eta = eta + F.lit(f.sigma_alpha[min(b, len(f.sigma_alpha) - 1)]) * normal(F.col("group_id"), seed, k, b, 7)
            etas.append(eta)
        if f.dist is Dist.GAUSSIAN:
            value = etas[0] + F.lit(f.sigma or 0.0) * normal(F.col("id"), seed, k)
        elif f.dist is Dist.BINOMIAL:
            value = F.when(uniform(F.col("id"), seed, k) < 1 / (1 + F.exp(-etas[0])), F.lit(schema.levels[c][-1])).otherwise(F.lit(schema.levels[c][0]))
        elif f.dist is Dist.POISSON:
            # e^43 is the last rate whose counts are longs: beyond it there is no right draw.
            rate = F.when(etas[0] <= 43, F.exp(etas[0])).otherwise(F.raise_error(F.lit(f"{c}: a rate of over e^43")).cast("double"))
            value = _poisson(rate, uniform(F.col("id"), seed, k)).cast("long")
        else:
            out = out.withColumn("u", uniform(F.col("id"), seed, k))
            weights = [F.lit(1.0), *[F.exp(F.least(e, F.lit(700.0))) for e in etas]]
            total = weights[0]
            for w in weights[1:]:
                total = total + w
            value, run = F.lit(states[-1]), F.lit(0.0)
            marks = []
            for w, s in zip(weights[:-1], states[:-1], strict=True):
                run = run + w / total
                marks.append((run, s))
            for edge, s in reversed(marks):
                value = F.when(F.col("u") < edge, F.lit(s)).otherwise(value)
        out = out.withColumn(c, value)
        if "u" in out.columns:
            out = out.drop("u")
    number = [F.floor(F.col("id") / rows).alias("replicate")] if replicates else []
    return out.select("id", *number, *(["group_id"] if grouped else []), *schema.nodes)


def _term(schema: Schema, child: str, name: str, state: str | None, parent: str | None) -> Column:
    if parent is None:
        return F.lit(1.0)
    if schema.dists[parent] is Dist.MULTINOMIAL:
        bare = name.removesuffix(f".{state}") if state is not None else name
        level = next(x for x in schema.levels[parent] if f"{parent}{x}" == bare)
        return F.when(F.col(parent) == F.lit(level), 1.0).otherwise(0.0)
    if schema.dists[parent] is Dist.BINOMIAL:
        return F.when(F.col(parent) == F.lit(schema.levels[parent][-1]), 1.0).otherwise(0.0)
    return F.col(parent).cast("double")


def bootstrap_support(spark: SparkSession, network: Network, replicates: int, rows: int, limit: int, score: str = "bic", seed: int = 42) -> DataFrame:
    """``(parent, child, n, share)``: how often each arc is found again in networks
    learned from rows drawn from the network.

    All replicates are one simulated table. Gaussian networks need each replicate's
    cross-products, sums with partial sums in each task whatever the number of rows;
    others its rows, equal ones of discrete networks merged, in one task, if they
    are at most as many numbers as a table that is sent to the tasks. All replicates'
    parent sets are then searched together, so the number of jobs does not grow
    with theirs. Replicates of more rows are scored one after another.
    """
    from ..plans import fitting as P
    from . import exact
    from .search import support

    nodes = network.schema.nodes
    schema = Schema(network.schema.dists, "group_id" if any(f.sigma_alpha for f in network.nodes.values()) else None, network.schema.levels)
    design = Design.build(schema)
    normal = not schema.group and all(d is Dist.GAUSSIAN for d in schema.dists.values())
    if not normal and rows * (len(design.names) + 1) > P.LOCAL:
        return _table_bootstrap(spark, network, replicates, rows, limit, score, seed)
    drawn = simulate(spark, network, rows, seed, replicates=replicates)
    x = design.frame(drawn, bool(schema.group), keep=["replicate"])
    scored = _moment_scores(x, design, limit, score) if normal else _row_scores(x, design, limit, score)
    sets = stored(scored, "replicates").withColumn("value", F.col("score"))
    found = exact.best_sets(sets, len(nodes), ["replicate"])
    if found.filter("row_id IS NULL").count():
        raise ValueError("a replicate has a node without a parent set that fits")
    runs = found.groupBy("replicate").agg(F.array_sort(F.collect_list(F.struct("child", "mask"))).alias("sets"))
    runs = runs.select(F.col("replicate").alias("search_id"), F.transform("sets", lambda s: s["mask"]).alias("masks"))
    return support(runs, nodes)


_SETS = "replicate long, row_id long, child int, mask long, score double"


def _every_set(n: int, limit: int) -> list[tuple[int, int, tuple[int, ...]]]:
    """All parent sets of up to ``limit`` nodes, in the order of a cache."""
    pairs = ((c, ps) for c in range(n) for size in range(limit + 1) for ps in combinations([p for p in range(n) if p != c], size))
    return [(k, c, ps) for k, (c, ps) in enumerate(pairs)]


def _scored(replicate: int, design: Design, limit: int, score: str, m: Moments, a=None, w=None, g=None) -> pd.DataFrame:
    from ..plans.cache import SCORES, score_here

    sets = _every_set(len(design.schema.dists), limit)
    got = pd.DataFrame(score_here(design, m, a, w, g, sets), columns=["row_id", *SCORES, "error_code"])
    value = got[score] if score == "mlik" else -got[score]
    out = pd.DataFrame({"replicate": replicate, "row_id": got["row_id"], "child": [c for _, c, _ in sets], "mask": [sum(1 << p for p in ps) for _, _, ps in sets], "score": value.astype(float)})
    return out[(got["error_code"] == 0) & np.isfinite(out["score"])].astype({"child": "int32"})


def _moment_scores(x: DataFrame, design: Design, limit: int, score: str) -> DataFrame:
    """Every replicate's scores from its cross-products: one aggregate."""
    width = len(design.names)
    pairs = [(i, j) for i in range(1, width) for j in range(i, width)]
    sums = x.groupBy("replicate").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(1, width)], *[F.covar_samp(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs])

    def kernel(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                cov = np.zeros((width, width))
                for i, j in pairs:
                    cov[i, j] = cov[j, i] = getattr(r, f"c{i}_{j}")
                sd = np.sqrt(np.where(np.diag(cov) > 0, np.diag(cov), 1.0))
                m = Moments(float(r.n), np.r_[1.0, np.zeros(width - 1)], cov * (r.n - 1) / np.outer(sd, sd))
                yield _scored(int(r.replicate), design, limit, score, m)

    return sums.mapInPandas(kernel, _SETS)


def _row_scores(x: DataFrame, design: Design, limit: int, score: str) -> DataFrame:
    """Every replicate's scores from its rows: one task for each replicate."""
    width, group = len(design.names), bool(design.schema.group)
    gaussian = [c for d, cols in zip(design.schema.dists.values(), design.of, strict=True) if d is Dist.GAUSSIAN for c in cols]
    x = x.withColumn("w", F.lit(1.0)) if gaussian else x.groupBy(*x.columns).agg(F.count(F.lit(1)).cast("double").alias("w"))

    def kernel(pdf):
        pdf = pdf.sort_values([*(["g"] if group else []), *(f"x{i}" for i in range(1, width))])
        a = np.column_stack([np.ones(len(pdf)), *(pdf[f"x{i}"].to_numpy(float) for i in range(1, width))])
        w = pdf["w"].to_numpy(float)
        g = np.unique(pdf["g"].to_numpy(), return_inverse=True)[1] if group else np.zeros(len(pdf), int)
        n = w.sum()
        for c in gaussian:
            mean = (w @ a[:, c]) / n
            sd = np.sqrt((w @ (a[:, c] - mean) ** 2) / max(n - 1, 1))
            a[:, c] = (a[:, c] - mean) / (sd or 1.0)
        mean = (w @ a) / n
        centred = a - mean
        centred[:, 0] = 0.0
        return _scored(int(pdf["replicate"].iloc[0]), design, limit, score, Moments(float(n), mean, centred.T @ (centred * w[:, None])), a, w, g)

    return x.groupBy("replicate").applyInPandas(kernel, _SETS)


def _table_bootstrap(spark: SparkSession, network: Network, replicates: int, rows: int, limit: int, score: str, seed: int) -> DataFrame:
    from ..plans.cache import build_cache
    from ..storage import dropped
    from .search import best_rows, support

    nodes = network.schema.nodes
    schema = Schema(network.schema.dists, "group_id" if any(f.sigma_alpha for f in network.nodes.values()) else None, network.schema.levels)
    found = []
    for r in range(replicates):
        drawn = stored(simulate(spark, network, rows, seed + 7919 * r), "drawn")
        # A level that wasn't drawn is no error here.
        cache = build_cache(drawn, schema, "mle", limit, check=False)
        masks = {x["child"]: x["mask"] for x in best_rows(cache, len(nodes), score).collect()}
        found.append((r, 0.0, [masks[i] for i in range(len(nodes))], []))
        dropped(drawn)
    return support(spark.createDataFrame(found, "search_id long, score double, masks array<long>, path array<double>"), nodes)
