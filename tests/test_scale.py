"""How much work plans ask for, and cases that larger tables bring."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dagwright import storage
from dagwright.graph import Dag
from dagwright.operators import fit as fitting
from dagwright.operators import infotheo, models, search, simulate
from dagwright.operators.moments import Design, moments
from dagwright.plans import fitting as P
from dagwright.plans.cache import build_cache
from dagwright.plans.controls import BuildControl, control
from dagwright.schema import Schema, split_group
from dagwright.sources import export


class jobs:
    """Counts the Spark jobs of a block."""

    def __init__(self, spark):
        self.sc = spark.sparkContext

    def __enter__(self):
        self.sc.setJobGroup("counted", "counted")
        self.before = len(self.sc.statusTracker().getJobIdsForGroup("counted"))
        return self

    def __exit__(self, *_):
        self.n = len(self.sc.statusTracker().getJobIdsForGroup("counted")) - self.before
        self.sc.setLocalProperty("spark.jobGroup.id", None)


def wide(spark, rows=2000, columns=12, parts=16):
    return spark.range(0, rows, 1, parts).select(*[F.randn(i).alias(f"v{i}") for i in range(columns)])


def test_wide_moments_are_few_jobs(spark):
    t = storage.stored(wide(spark), "wide")
    design = Design.build(Schema.of(dict.fromkeys(t.columns, "gaussian")))
    with jobs(spark) as done:
        m = moments(t, design)
    assert done.n <= 3
    x = t.toPandas().to_numpy()
    assert np.allclose(m.mean[1:], x.mean(axis=0)) and np.allclose(m.cross[1:, 1:], (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)))


def test_local_fits_are_few_jobs(spark):
    t = wide(spark, 400, 4).withColumn("b", F.when(F.rand(1) < 0.5, "x").otherwise("y"))
    schema = Schema.of(dict.fromkeys([f"v{i}" for i in range(4)], "gaussian") | {"b": "binomial"})
    with jobs(spark) as done:
        build_cache(t, schema, "mle", 3, check=False).count()
    assert done.n < 60


def test_link_strength_reads_the_table_once(spark, sf):
    from dagwright.sources.tables import lineitem_nodes

    t = lineitem_nodes(spark, sf)
    schema = Schema.of(dict.fromkeys(("l_quantity", "l_extendedprice", "l_discount", "net"), "gaussian"))
    out = infotheo.link_strength(t, schema, [("l_extendedprice", "net"), ("l_discount", "net"), ("l_quantity", "l_discount")], "ls")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[0]
    assert plan.count("FileScan") - plan.count("ReusedExchange") <= 1 or plan.count("FileScan") == 1


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.floats(-5, 5), st.integers(0, 3)), min_size=1, max_size=60), st.lists(st.floats(0, 1), min_size=1, max_size=3), st.integers(1, 40))
def test_quantiles_of_columns(spark, values, at, small):
    rows = [(float(v), float(v) * 2 if i % 3 else None) for i, v in enumerate(values)]
    got = infotheo.column_quantiles(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], at, small)
    for c, k in (("a", 0), ("b", 1)):
        have = [r[k] for r in rows if r[k] is not None]
        want = np.quantile(have, at) if have else [math.nan] * len(at)
        assert np.allclose(got[c], want, equal_nan=True)


def test_group_ids_in_ranges(spark):
    t = spark.createDataFrame([(i, f"g{(i * 37) % 101:03d}") for i in range(500)], "x long, g string")
    got = split_group(t, Schema.of({"x": "poisson"}, group="g")).collect()
    order = {g: k + 1 for k, g in enumerate(sorted({f"g{i:03d}" for i in range(101)}))}
    assert all(r["group_id"] == order[f"g{(r['x'] * 37) % 101:03d}"] for r in got)


def test_counts_of_any_rate(spark):
    schema = Schema.of({"c": "poisson"})
    node = fitting.NodeFit("c", list(schema.dists.values())[0], [("c|intercept", None, None, 16.0, 0.0)], {}, 1)
    net = fitting.Network(Dag.of(["c"]), schema, "mle", 0, {"c": node})
    mean, sd = simulate.simulate(spark, net, 2_000).agg(F.avg("c"), F.stddev_samp("c")).first()
    assert abs(mean - math.exp(16)) < 5 * math.exp(8) / math.sqrt(2_000) and abs(sd - math.exp(8)) < 0.1 * math.exp(8)
    node.terms[0] = ("c|intercept", None, None, 44.0, 0.0)
    with pytest.raises(Exception, match="a rate of over"):
        simulate.simulate(spark, net, 10).collect()


def test_log_factorials(spark):
    got = spark.range(2000).select("id", fitting.log_factorial(F.col("id").cast("double")).alias("v")).collect()
    assert all(abs(r["v"] - math.lgamma(r["id"] + 1)) < 1e-9 * max(1, abs(math.lgamma(r["id"] + 1))) for r in got)


def test_retained_arcs_stay(spark):
    t = wide(spark, 300, 4, 2)
    names = t.columns
    schema = Schema.of(dict.fromkeys(names, "gaussian"))
    retained = Dag.of(names, [("v3", "v0"), ("v0", "v1")])
    cache = build_cache(t, schema, "mle", 2, None, retained)
    for found in (search.hill_climb(cache, names, "bic", 10), search.heuristic(cache, names, "sa", "bic", 5), search.heuristic(cache, names, "tabu", "bic", 5)):
        for r in found.collect():
            dag = Dag.from_masks(dict(zip(names, r["masks"], strict=True)), names)
            assert retained.arcs <= dag.arcs
    with pytest.raises(Exception, match="lacks arcs"):
        search.hill_climb(cache, names, "bic", 1, start=Dag.of(names)).collect()


def test_controls_are_read(spark):
    t = wide(spark, 300, 2, 2).withColumn("b", F.when(F.col("v0") + F.rand(3) > 0.5, 1).otherwise(0))
    schema = Schema.of({"v0": "gaussian", "b": "binomial"})
    score = lambda **o: {(r["child"], r["mask"]): r["mlik"] for r in build_cache(t, schema, "bayes", 1, control=control("bayes", **o)).collect()}
    usual, tight = score(), score(prec=10.0)
    assert usual == {(r["child"], r["mask"]): r["mlik"] for r in build_cache(t, schema, "bayes", 1, priors=BuildControl().priors()).collect()}
    assert usual[1, 1] > tight[1, 1] and score(max_iters=1)[1, 1] != usual[1, 1]
    dag = Dag.of(schema.nodes, [("v0", "b")])
    density, quantiles = fitting.posterior(t, schema, dag, control("bayes", True, n_grid=40, quantiles=(0.1, 0.5, 0.9)))
    by = {}
    for r in density.collect():
        by.setdefault((r["node"], r["param"]), []).append((r["x"], r["f"]))
    assert len(by) == 4 and all(len(v) == 40 for v in by.values())
    for v in by.values():
        v.sort()
        assert abs(sum(f for _, f in v) * (v[1][0] - v[0][0]) - 1) < 1e-6 and v[0][1] < 0.01 * max(f for _, f in v) > v[-1][1]
    assert {r["p"] for r in quantiles.collect()} == {0.1, 0.5, 0.9}
    with pytest.warns(UserWarning, match="no engine"):
        control("bayes", ncores=4)


def test_marginals_of_grouped_models(spark):
    r = np.random.default_rng(5)
    g = np.repeat(np.arange(12), 20)
    u = r.normal(0, 0.8, 12)[g]
    x = r.normal(size=240)
    y = 0.5 * x + u + r.normal(size=240)
    b = (r.random(240) < 1 / (1 + np.exp(-(0.8 * x + u)))).astype(int)
    t = spark.createDataFrame([(float(a), float(c), int(d), int(k)) for a, c, d, k in zip(x, y, b, g, strict=True)], "x double, y double, b int, g int")
    schema = Schema.of({"x": "gaussian", "y": "gaussian", "b": "binomial"}, group="g")
    dag = Dag.of(schema.nodes, [("x", "y"), ("x", "b")])
    net = fitting.fit(t, schema, dag, "bayes")
    got = fitting.marginals(t, schema, dag, net, ["y", "b"], points=9, spread=3.0).toPandas()
    for node in ("y", "b"):
        at = {x[0]: x[3] for x in net.nodes[node].terms}
        for name, d in got[got["node"] == node].groupby("param"):
            d = d.sort_values("x")
            assert abs(d["x"].iloc[int(np.argmax(d["f"].to_numpy()))] - at[name]) < 1e-6
            assert 0.9 < float(np.trapezoid(d["f"], d["x"])) < 1.1


def test_categories_vary_together(spark):
    # Laplace's sum over a group's intercepts, against quadrature, with a covariance.
    model = models.Model(0, list(Schema.of({"m": "multinomial"}).dists.values())[0], (1, 2, 3), [0], 0)
    r = np.random.default_rng(1)
    k = r.integers(0, 3, 60)
    a = np.column_stack([np.ones(60), *[(k == i).astype(float) for i in range(3)]])
    g, w, beta, spread = np.repeat(np.arange(2), 30), np.ones(60), np.array([0.2, -0.3]), np.array([-0.4, -0.9, 0.35])
    half = models.cholesky(spread, 2)
    assert np.allclose(half, [[math.exp(-0.4), 0], [0.35, math.exp(-0.9)]])
    node, weight = np.polynomial.hermite_e.hermegauss(40)
    want = 0.0
    for group in range(2):
        n = np.bincount(k[g == group], minlength=3)
        total = 0.0
        for i, wi in zip(node, weight, strict=True):
            for j, wj in zip(node, weight, strict=True):
                eta = np.r_[0.0, beta + half @ np.array([i, j])]
                total += wi * wj * math.exp(float(n @ (eta - np.log(np.exp(eta).sum()))))
        want += math.log(total / (2 * math.pi))
    assert abs(models.group_laplace(model, beta, spread, a, w, g, 2) - want) < 0.05
    rows = [(["x", "y", "z"][int(v)], int(h)) for v, h in zip(r.integers(0, 3, 400), np.repeat(np.arange(20), 20), strict=True)]
    t = spark.createDataFrame(rows, "m string, g int")
    net = fitting.fit(t, Schema.of({"m": "multinomial"}, group="g"), Dag.of(["m"]))
    f = net.nodes["m"]
    assert f.df == 2 + 3 and len(f.covariance) == 2 and f.covariance[0][1] == f.covariance[1][0]
    text = export.to_json_frame(spark, net).first()["json"]
    assert "random_covariance" in text and '"sigma_alpha_y_z"' in text
    assert f"sigma_alpha_m[1, 2] <- {export.number(f.covariance[0][1])}" in export.to_bugs(net)
    assert simulate.simulate(spark, net, 200).count() == 200


def test_rows_merge_by_measured_values(spark):
    t = spark.range(3000).select((F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, 1).otherwise(0).alias("b"), F.randn(1).alias("z"))
    few = Schema.of({"x": "gaussian", "b": "binomial"}, levels={"b": (0, 1)})
    assert P.compressed(t, Design.build(few)).count() == 14
    many = Schema.of({"z": "gaussian", "b": "binomial"}, levels={"b": (0, 1)})
    assert P.compressed(t, Design.build(many)).count() == 3000


def test_tables_go(spark):
    import os

    t = storage.stored(spark.range(10), "gone")
    path = t._stored_at.replace("file:", "")
    assert os.path.isdir(path) and t.count() == 10
    storage.dropped(t, None, spark.range(1))
    assert not os.path.exists(path)


def test_summary_of_a_fit(spark):
    r = random.Random(1)
    t = spark.createDataFrame([(r.gauss(0, 1), r.gauss(0, 1)) for _ in range(50)], "a double, b double")
    schema = Schema.of({"a": "gaussian", "b": "gaussian"})
    net = fitting.fit(t, schema, Dag.of("ab", [("a", "b")]))
    text = str(net)
    assert "2 nodes, 1 arcs, 50 rows" in text and "b (gaussian): b|intercept" in text and "bic" in text
    assert net.nobs() == 50 and abs(net.aic() - sum(f.scores["aic"] for f in net.nodes.values())) < 1e-9 and net.log_lik() < 0
