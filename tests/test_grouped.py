"""Random intercepts whose groups lie in any task, against the same where all rows are at hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dagwright.graph import Dag
from dagwright.operators import fit as fitting
from dagwright.operators import mixed as X
from dagwright.operators import models as M
from dagwright.plans import fitting as P
from dagwright.plans import grouped
from dagwright.plans.cache import build_cache
from dagwright.schema import Dist, Schema

SCHEMA = Schema.of({"x": "gaussian", "b": "binomial", "k": "poisson", "m": "multinomial"}, group="g")


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(5)
    n, rows = 500, []
    effect = r.normal(0, 0.8, 9)
    for _ in range(n):
        g = 0 if r.random() < 0.5 else int(r.integers(1, 9))  # half of the rows in one group
        x = float(r.normal())
        b = int(r.random() < 1 / (1 + math.exp(-(0.4 * x + effect[g]))))
        rows.append((round(x, 1), b, int(r.poisson(math.exp(0.3 * b + 0.5 * effect[g]))), "uvw"[int(r.integers(0, 3)) if r.random() < 0.5 else g % 3], f"g{g}"))
    return spark.createDataFrame(rows, "x double, b int, k int, m string, g string").persist()


def model(dist, rng, n=120):
    x = np.column_stack([np.ones(n), rng.normal(size=n)])
    if dist is Dist.MULTINOMIAL:
        return M.Model(0, dist, (2, 3, 4), [0, 1], 1), np.column_stack([x, np.eye(3)[rng.integers(0, 3, n)]])
    y = rng.poisson(2, n) if dist is Dist.POISSON else rng.random(n) < 0.4
    return M.Model(0, dist, (2,), [0, 1], 1), np.column_stack([x, y.astype(float)])


@pytest.mark.parametrize("dist", [Dist.BINOMIAL, Dist.POISSON, Dist.MULTINOMIAL])
def test_slopes_are_those_of_the_value(dist):
    rng = np.random.default_rng(2)
    m, a = model(dist, rng)
    g, w = rng.integers(0, 5, len(a)), rng.integers(1, 4, len(a)).astype(float)
    at = rng.normal(size=X.dimension(m)) * 0.3
    got = X.local_terms(m, at, a, w, g, 5)
    assert abs(got[0] - M.group_laplace(m, at[: m.size], at[m.size :], a, w, g, 5)) < 1e-9
    for i in range(len(at)):
        e = np.eye(len(at))[i] * 1e-5
        assert abs((X.local_terms(m, at + e, a, w, g, 5)[0] - X.local_terms(m, at - e, a, w, g, 5)[0]) / 2e-5 - got[1 + i]) < 1e-5


def test_groups_in_parts_are_groups_in_one(spark, table, monkeypatch):
    """A group of half the rows, dealt out over many parts and blocks, fits as if
    it lay in one place."""
    sets = [("b", ["x"]), ("k", ["b"]), ("m", [])]
    key = lambda r: (r["child_name"], r["mlik"], r["mdl"])
    local = sorted(map(key, build_cache(table, SCHEMA, sets=sets).collect()))
    bayes = sorted(map(key, build_cache(table, SCHEMA, "bayes", sets=[("x", ["b"]), ("b", ["x"])]).collect()), key=str)
    monkeypatch.setattr(P, "LOCAL", 0)
    monkeypatch.setattr(grouped, "PART", 60)
    monkeypatch.setattr(grouped, "BLOCK", 16)
    spread = sorted(map(key, build_cache(table, SCHEMA, sets=sets).collect()))
    for a, b in zip(local, spread, strict=True):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-5 and abs(a[2] - b[2]) < 1e-5
    again = sorted(map(key, build_cache(table, SCHEMA, "bayes", sets=[("x", ["b"]), ("b", ["x"])]).collect()), key=str)
    for a, b in zip(bayes, again, strict=True):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-3


def test_no_part_gets_a_large_group(spark, table, monkeypatch):
    monkeypatch.setattr(grouped, "PART", 40)
    monkeypatch.setattr(grouped, "BLOCK", 16)
    from dagwright.operators.moments import Design
    from dagwright.schema import with_levels

    design = Design.build(with_levels(table, SCHEMA))
    rows = design.frame(table, group=True).withColumn("w", F.lit(1.0))
    width = len(design.names)
    parts = grouped.blocks_of(rows, width).groupBy("g", "part").agg(F.sum(F.octet_length("data") / (8 * width)).alias("n"), F.max("n_parts").alias("parts")).collect()
    count = {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(r["n"] for r in parts) == 500
    for g, n in count.items():
        mine = [r for r in parts if r["g"] == g]
        assert {r["parts"] for r in mine} == {math.ceil(n / 40)} and max(r["n"] for r in mine) <= 100
        assert sum(r["n"] for r in mine) == n


def test_controls_reach_grouped_fits(table):
    from dagwright.plans.controls import control

    dag = Dag.of(SCHEMA.nodes, [("x", "b")])
    few = fitting.fit(table, SCHEMA, dag, control=control("mle", True, max_iters=1))
    many = fitting.fit(table, SCHEMA, dag)
    assert few.nodes["b"].scores["mlik"] < many.nodes["b"].scores["mlik"] - 1e-6


def test_marginals_of_groups_are_densities(table):
    s = Schema.of({"b": "binomial", "k": "poisson"}, group="g")
    t = table.select("b", "k", "g")
    out = fitting.marginals(t, s, Dag.of(s.nodes, [("b", "k")]), points=31, spread=6).toPandas()
    for (_, param), d in out.groupby(["node", "param"]):
        d = d.sort_values("x")
        # the outer Laplace integral is an approximation: the area is near 1
        assert abs(np.trapezoid(d["f"], d["x"]) - 1) < 0.25, param
