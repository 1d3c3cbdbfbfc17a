"""All replicates of a bootstrap at once, against caches and searches of each alone."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dagwright.graph import Dag
from dagwright.operators import fit as fitting
from dagwright.operators import search, simulate
from dagwright.operators.moments import Design
from dagwright.plans import fitting as P
from dagwright.plans.cache import build_cache
from dagwright.schema import Dist, Schema


def term(name, parent, value):
    return (name, None, parent, value, 0.0)


def network(kinds, arcs, group=False):
    schema = Schema.of(kinds, levels={"b": ("no", "yes")} if "b" in kinds else None)
    nodes = {}
    for c, d in schema.dists.items():
        terms = [term(f"{c}|intercept", None, 0.2), *(term(p, p, 0.9) for p, k in arcs if k == c)]
        nodes[c] = fitting.NodeFit(c, d, terms, {}, len(terms), 1.0 if d is Dist.GAUSSIAN else None, [0.7] if group else None)
    return fitting.Network(Dag.of(schema.nodes, arcs), schema, "mle", 0, nodes)


CASES = {
    "gaussian": (network({"a": "gaussian", "g": "gaussian", "h": "gaussian"}, [("a", "g"), ("a", "h")]), 2),
    "mixed": (network({"a": "gaussian", "b": "binomial", "c": "poisson"}, [("a", "b"), ("b", "c")]), 1),
    "discrete": (network({"b": "binomial", "c": "poisson"}, [("b", "c")]), 1),
    "grouped": (network({"a": "gaussian", "b": "binomial"}, [("a", "b")], True), 1),
}


@pytest.mark.parametrize("name", CASES)
def test_replicates_together_score_as_alone(spark, name):
    net, limit = CASES[name]
    group = "group_id" if name == "grouped" else None
    drawn = simulate.simulate(spark, net, 120, 5, 6, replicates=3).persist()
    assert drawn.groupBy("replicate").count().filter("count = 120").count() == 3
    schema = Schema(net.schema.dists, group, net.schema.levels)
    design = Design.build(schema)
    x = design.frame(drawn, bool(group), keep=["replicate"])
    scored = simulate._moment_scores(x, design, limit, "bic") if name == "gaussian" else simulate._row_scores(x, design, limit, "bic")
    got = {(r["replicate"], r["child"], r["mask"]): r["score"] for r in scored.collect()}
    for rep in (0, 2):
        want = build_cache(drawn.filter(F.col("replicate") == rep), schema, "mle", limit, check=False).collect()
        for r in want:
            assert abs(got[rep, r["child"], r["mask"]] + r["bic"]) < 1e-5 * (1 + abs(r["bic"]))
        assert len(want) == sum(k[0] == rep for k in got)


def test_support_is_that_of_single_searches(spark):
    net, limit = CASES["mixed"]
    got = {(r["parent"], r["child"]): r["n"] for r in simulate.bootstrap_support(spark, net, 4, 150, limit, seed=3).collect()}
    drawn, want = simulate.simulate(spark, net, 150, 3, replicates=4), {}
    for rep in range(4):
        cache = build_cache(drawn.filter(F.col("replicate") == rep), net.schema, "mle", limit, check=False)
        for p, c in search.most_probable(cache, net.schema.nodes, "bic").dag.arcs:
            want[p, c] = want.get((p, c), 0) + 1
    assert got == want


def test_jobs_do_not_grow_with_replicates(spark):
    net, limit = CASES["gaussian"]
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for n in (3, 60):
        spark.sparkContext.setJobGroup(f"boot{n}", "")
        simulate.bootstrap_support(spark, net, n, 40, limit).collect()
        jobs.append(len(tracker.getJobIdsForGroup(f"boot{n}")))
    spark.sparkContext.setJobGroup("rest", "")
    assert jobs[1] <= jobs[0] + 6


def test_large_replicates_go_one_by_one(spark, monkeypatch):
    net, limit = CASES["discrete"]
    monkeypatch.setattr(P, "LOCAL", 100)
    assert simulate.bootstrap_support(spark, net, 2, 80, limit).count() <= 2


def test_normal_quantiles():
    u = np.array([1e-12, 0.001, 0.25, 0.5, 0.9, 1 - 1e-9])
    z = simulate._normal_quantile(u)
    assert max(abs(0.5 * math.erfc(-x / math.sqrt(2)) / p - 1) for x, p in zip(z, u, strict=True)) < 1e-9
