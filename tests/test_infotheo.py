import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dagwright.functions import expit, logit, odds
from dagwright.operators import infotheo as info
from dagwright.schema import Schema


def test_scalars(spark):
    t = spark.createDataFrame([(0.5,), (0.0,), (1.0,)], "x double")
    assert [r[0] for r in t.select(odds(F.col("x"))).collect()] == [1.0, 0.0, math.inf]
    back = spark.createDataFrame([(-800.0,), (0.3,), (800.0,)], "x double").select(expit(F.col("x"))).collect()
    assert back[0][0] == 0 and abs(back[1][0] - 1 / (1 + math.exp(-0.3))) < 1e-15 and back[2][0] == 1
    assert t.select(logit(F.col("x"))).first()[0] == 0
    with pytest.raises(Exception, match="probabilities"):
        spark.createDataFrame([(1.1,)], "x double").select(odds(F.col("x"))).collect()


def test_bins(spark):
    x = np.random.default_rng(0).normal(size=500)
    t = spark.createDataFrame([(float(v),) for v in x], "x double")
    s = Schema.of({"x": "g"})
    for method, bins in (("sturges", math.ceil(math.log2(500) + 2) - 1), (7, 7), ("sqrt", math.ceil(math.sqrt(500) + 1) - 1)):
        lo, hi, n = info.bin_counts(t, s, method)["x"]
        assert n == bins and lo == x.min() and hi == x.max()
        got = {r["x"]: r["n"] for r in info.contingency(info.discretise(t, s, method)).collect()}
        edges = np.linspace(lo, hi, n + 1)
        want = np.bincount(np.clip(np.searchsorted(edges, x, side="left"), 1, n), minlength=n + 1)
        assert all(got.get(i, 0) == want[i] for i in range(1, n + 1))
    one = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert info.discretise(one, s, 5).distinct().collect()[0][0] == 1


def test_quantiles_close_in(spark):
    x = np.r_[np.random.default_rng(1).normal(size=3000), np.full(500, 0.25)]
    t = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = info.quantiles(t, "x", (0, 0.1, 0.5, 0.975, 1), small=50)
    assert np.allclose(got, np.quantile(x, (0, 0.1, 0.5, 0.975, 1)))


def test_information(spark):
    joint = {(0, 0): 10, (0, 1): 20, (1, 0): 30, (1, 1): 5}
    c = spark.createDataFrame([(a, b, n) for (a, b), n in joint.items()], "a int, b int, n long")
    p = np.array([[10, 20], [30, 5]]) / 65
    h = -(p * np.log2(p)).sum()
    mi = (p * np.log(p / np.outer(p.sum(1), p.sum(0)))).sum()
    assert abs(info.entropy(c).first()[0] - h) < 1e-12
    assert abs(info.mutual_information(c).first()["mi"] - mi) < 1e-12


def test_links_of_independent_columns(spark):
    t = spark.range(400).select((F.col("id") % 2).alias("a"), (F.floor(F.col("id") / 2) % 2).alias("b"), (F.col("id") % 2).alias("c"))
    s = Schema.of({k: "binomial" for k in "abc"})
    for method in ("mi.raw", "ls", "ls.pc", "mi.raw.pc"):
        r = {(x["parent"], x["child"]): x["strength"] for x in info.link_strength(t, s, [("a", "b"), ("a", "c")], method).collect()}
        assert abs(r["a", "b"]) < 1e-9 and r["a", "c"] > 0.5
    assert info.link_strength(t, s, []).count() == 0
    with pytest.raises(ValueError):
        info.link_strength(t, s, [("a", "b")], "x")


def test_cells_of_sets_are_rolled_up(spark):
    rng = np.random.default_rng(4)
    rows = [tuple(None if v == 3 else int(v) for v in rng.integers(0, 4, 4)) for _ in range(600)]
    t = spark.createDataFrame(rows, "a int, b int, c int, d int").selectExpr("a", "b", "c", "d")
    names = "abcd"
    for sets in (["abcd", "ab", "a", "d", "bcd"], ["ab", "a", "bc", "b", "cd", "d"], ["a", "b"], ["abc"], []):
        got = {}
        for r in info.set_counts(t, [tuple(s) for s in sets]).collect():
            got.setdefault(r["id"], []).append(r["n"])
        for k, s in enumerate(sets):
            cells = {}
            for row in rows:
                key = tuple(row[names.index(c)] for c in s)
                cells[key] = cells.get(key, 0) + 1
            # A null is a level of its own, and no column of another set splits a cell.
            assert sorted(got[k]) == sorted(cells.values())
        assert len(got) == len(sets)
    h = info.set_entropies(t, [("a", "b"), ("a",), ()]).first()
    p = np.array([sum(r[0] == v for r in rows) for v in (None, 0, 1, 2)]) / 600
    assert h["h_"] == 0 and abs(h["h_a"] + (p * np.log2(p)).sum()) < 1e-12


def test_one_family_needs_no_expand(spark):
    t = spark.range(100).selectExpr("cast(id % 3 as int) a", "cast(id % 4 as int) b", "cast(id % 5 as int) c")
    plan = info.set_entropies(t, [("a", "b", "c"), ("a", "b"), ("c",)])._jdf.queryExecution().optimizedPlan().toString()
    # Cells are multiplied (Generate), above the rows' aggregate; rows aren't.
    assert "Expand" not in plan and plan.index("Generate") < plan.rindex("Aggregate")
