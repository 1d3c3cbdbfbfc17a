import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dagwright.graph import Dag
from dagwright.operators import fit as fitting
from dagwright.operators import models as M
from dagwright.operators import moments as mom
from dagwright.operators import search, simulate
from dagwright.operators.moments import Design, moments
from dagwright.operators.parent_sets import parent_sets
from dagwright.plans import fitting as P
from dagwright.plans.cache import build_cache
from dagwright.plans.controls import control
from dagwright.schema import Dist, Schema
from dagwright.sources import export
from dagwright.sources.tables import chain_sample

SCHEMA = Schema.of({"a": "gaussian", "b": "gaussian", "c": "binomial", "d": "poisson", "e": "multinomial"})


@pytest.fixture(scope="module")
def sample(spark):
    return chain_sample(spark, 3000).cache()


def matrix(sample, schema=SCHEMA):
    from dagwright.schema import with_levels

    design = Design.build(with_levels(sample, schema))
    t = design.frame(sample).toPandas().to_numpy()
    return design, np.column_stack([np.ones(len(t)), t])


def test_log_factorial():
    y = np.array([0, 1, 2, 5, 20, 171, 5000])
    assert np.allclose(M.log_factorial(y), [math.lgamma(v + 1) for v in y], rtol=1e-13)


def test_moments_either_way(sample, monkeypatch):
    design, a = matrix(sample)
    one = moments(sample, design)
    monkeypatch.setattr(mom, "WIDE", 0)
    two = moments(sample, design)
    for m in (one, two):
        assert np.allclose(m.mean, a.mean(axis=0)) and np.allclose(m.raw(list(range(a.shape[1]))), a.T @ a)


def test_gaussian_is_least_squares(sample):
    design, a = matrix(sample)
    m = moments(sample, design)
    for parents in ([], [0], [0, 2], [4], [4, 0]):
        model = P.build_model(0, design, 1, parents)
        ll, ssr, rank = M.gaussian(m, model)
        x, y = a[:, model.cols], a[:, 2]
        b, *_ = np.linalg.lstsq(x, y, rcond=None)
        rss = ((y - x @ b) ** 2).sum()
        n = len(y)
        assert abs(ssr - rss) < 1e-6 * rss and rank == np.linalg.matrix_rank(x)
        assert abs(ll - (-n / 2 * (math.log(2 * math.pi) + 1 + math.log(rss / n)))) < 1e-6
        beta, se, mse = M.gaussian_coefficients(m, model)
        assert np.allclose(beta, b) and abs(mse - rss / (n - rank)) < 1e-6


@pytest.mark.parametrize("child,parents", [(2, [1]), (2, [0, 1, 4]), (3, [0]), (3, [0, 2]), (4, [1]), (4, [])])
def test_newton_is_at_a_maximum(sample, child, parents):
    design, a = matrix(sample)
    model = P.build_model(0, design, child, parents)
    w = np.ones(len(a))
    f = M.run(M.newton(model, M.start(model, a[:, model.y[0]].mean())), lambda b: M.evaluate(model, b, a, w))
    _, ll, grad, info = M.evaluate(model, f.beta, a, w)
    assert f.ok and np.abs(grad).max() < 1e-5 * len(a)
    rng = np.random.default_rng(0)
    for _ in range(5):
        d = rng.normal(size=len(f.beta)) * 1e-2
        assert M.evaluate(model, f.beta + d, a, w)[1] < ll
        eps = 1e-5
        slope = (M.evaluate(model, f.beta + d + eps * d, a, w)[1] - M.evaluate(model, f.beta + d - eps * d, a, w)[1]) / (2 * eps)
        assert abs(slope - M.evaluate(model, f.beta + d, a, w)[2] @ d) < 1e-3 * (1 + abs(slope))


def test_scans_and_tasks_agree(spark, sample, monkeypatch):
    local = {r["row_id"]: r for r in build_cache(sample, SCHEMA, limit=1).collect()}
    monkeypatch.setattr(P, "LOCAL", 0)
    monkeypatch.setattr(P, "TOGETHER", 5)
    far = {r["row_id"]: r for r in build_cache(sample, SCHEMA, limit=1).collect()}
    assert len(local) == 25 and local.keys() == far.keys()
    for k, r in local.items():
        assert r["error_code"] == 0
        assert abs(r["mlik"] - far[k]["mlik"]) < 1e-5 * abs(r["mlik"])


def test_more_parents_never_lose_likelihood(sample):
    rows = {(r["child"], r["mask"]): r["mlik"] for r in build_cache(sample, SCHEMA.only("abd"), limit=2).collect()}
    for (c, m), v in rows.items():
        for (c2, m2), v2 in rows.items():
            if c == c2 and m & m2 == m:
                assert v2 >= v - 1e-6


def test_separated_logistic_node(spark):
    t = spark.range(40).select(F.col("id").cast("double").alias("x"), (F.col("id") >= 20).cast("int").alias("y"))
    s = Schema.of({"x": "gaussian", "y": "binomial"})
    r = build_cache(t, s, sets=[("y", ["x"])]).first()
    assert r["error_code"] == 0 and math.isfinite(r["bic"])
    net = fitting.fit(t, s, Dag.of("xy", [("x", "y")]))
    assert all(abs(x[3]) < 100 for x in net.nodes["y"].terms)


def test_constraints(spark):
    s = Schema.of({k: "gaussian" for k in "abcd"})
    with pytest.raises(ValueError):
        parent_sets(spark, s, 1, retained=Dag.of("abcd", [("a", "b"), ("c", "b")]))
    with pytest.raises(ValueError):
        parent_sets(spark, s, 2, banned=Dag.of("abcd", [("a", "b")]), retained=Dag.of("abcd", [("a", "b")]))
    rows = parent_sets(spark, s, {"a": 0, "b": 1, "c": 2, "d": 3}).groupBy("child").count().orderBy("child").collect()
    assert [r["count"] for r in rows] == [1, 4, 7, 8]
    forced = parent_sets(spark, s, 1, adjusted=["d"])
    assert forced.filter("(mask & 8) = 0 or child = 3").count() == 0


def brute(cache, n):
    best = -math.inf
    by = {}
    for r in cache:
        by.setdefault(r["child"], []).append((r["mask"], -r["bic"]))
    for pick in itertools.product(*[by[i] for i in range(n)]):
        masks = [p[0] for p in pick]
        left = set(range(n))
        while left:
            free = [i for i in left if not any(masks[i] >> j & 1 for j in left)]
            if not free:
                break
            left -= set(free)
        else:
            best = max(best, sum(p[1] for p in pick))
    return best


def test_exact_search_is_brute_force(spark, sample):
    s = SCHEMA.only("abcd")
    cache = build_cache(sample, s, limit=2).cache()
    rows = cache.collect()
    found = search.most_probable(cache, s.nodes, "bic")
    assert abs(found.score - brute(rows, 4)) < 1e-6
    climbs = search.hill_climb(cache, s.nodes, "bic", searches=6)
    for r in climbs.collect():
        assert r["score"] <= found.score + 1e-6
        assert not Dag.from_masks(dict(zip(s.nodes, r["masks"], strict=True)), s.nodes).has_cycle()
        assert r["path"] == sorted(r["path"])
    for algo in ("hc", "tabu", "sa"):
        for r in search.heuristic(cache, s.nodes, algo, "bic", searches=4).collect():
            assert r["score"] <= found.score + 1e-6
            Dag.from_masks(dict(zip(s.nodes, r["masks"], strict=True)), s.nodes)
    total = search.dag_score(cache, found.dag, "bic").agg(F.sum("score")).first()[0]
    assert abs(total + found.score) < 1e-6
    assert search.support(climbs, s.nodes).filter("share > 1").count() == 0
    with pytest.raises(ValueError):
        search.best_rows(cache, len(s.nodes) + 1)


def test_prior():
    assert search.prior_terms(5, 2) == 0 and abs(search.prior_terms(5, 2, 2) + math.log(6)) < 1e-12


def test_laplace_of_a_gaussian_node(spark, sample):
    design, a = matrix(sample)
    m = moments(sample, design)
    model = P.build_model(0, design, 1, [0], priors=M.Priors())
    value, mode, sd = M.gaussian_laplace(m, model)
    # numerically: integrate the precision out on a grid, the coefficients exactly
    x, y = a[:, [0, 1]], a[:, 2]
    n, p = x.shape
    taus = mode[-1] * np.linspace(0.7, 1.35, 4001)
    logs = []
    for t in taus:
        h = t * x.T @ x + 0.001 * np.eye(p)
        b = np.linalg.solve(h, t * x.T @ y)
        r = y - x @ b
        g = 0.5 * n * (math.log(t) - math.log(2 * math.pi)) - 0.5 * t * r @ r + 0.5 * p * math.log(0.001 / (2 * math.pi)) - 0.0005 * b @ b + math.log(5e-5) - 5e-5 * t
        logs.append(g - 0.5 * np.linalg.slogdet(h)[1] + 0.5 * p * math.log(2 * math.pi))
    top = max(logs)
    exact = top + math.log(np.trapezoid(np.exp(np.array(logs) - top), taus))
    assert abs(exact - value) < 0.01


def test_grid_of_a_skewed_precision(spark):
    # Five rows: the density of the precision is far from normal on either side of its mode.
    from math import exp, lgamma, log

    t = spark.createDataFrame([(float(x * x),) for x in range(5)], "g double")
    schema = Schema.of({"g": "gaussian"})
    d = fitting.marginals(t, schema, Dag.of(schema.nodes), control=control("bayes", True, min_pdf=1e-7)).toPandas()
    for _, one in d.groupby("param"):
        one = one.sort_values("x")
        x, f = one["x"].to_numpy(), one["f"].to_numpy()
        assert np.abs(np.diff(f)).max() <= 0.3 * f.max() + 1e-12 and f[0] < 0.1 * f.max() and f[-1] <= 1e-7
    assert one["param"].iloc[0] == "g|precision" and x[0] > 0
    # Gamma(shape, rate) up to the constant of Laplace's method, which the mass gives.
    shape, rate = 1 + 5 / 2 - 0.5, (5 - 1) / 2 + 5e-5
    mass = np.trapezoid(fitting.spline(x, f, np.linspace(x[0], x[-1], 20_001)), dx=(x[-1] - x[0]) / 20_000)
    exact = np.array([exp(shape * log(rate) - lgamma(shape) + (shape - 1) * log(v) - rate * v) for v in x])
    assert np.abs(f / mass - exact).max() < 0.01 * exact.max() and 0.8 < mass < 1.2


def test_grid_steps():
    from dagwright.operators.fit import _way

    assert _way(1.0, 0.5, 0, 1, True, 1000) == [1.0 + 0.5 * k for k in range(1, 9)]
    assert _way(1.0, 0.4, 0, -1, True, 4) == [0.6, pytest.approx(0.2), pytest.approx(0.1), pytest.approx(0.05)]
    assert _way(1.0, 1.0, 7, -1, False, 9) == [0.0, -1.0]


def test_marginals_have_area_one(spark, sample):
    s = Schema.of({"b": "gaussian", "c": "binomial"})
    dag = Dag.of("bc", [("b", "c")])
    net = fitting.fit(sample, s, dag, "bayes")
    d = fitting.marginals(sample, s, dag, net, points=41)
    for (node, param), g in d.toPandas().groupby(["node", "param"]):
        g = g.sort_values("x")
        assert abs(np.trapezoid(g["f"], g["x"]) - 1) < 0.02, (node, param)
    q = fitting.density_quantiles(fitting.unit_area(d)).toPandas()
    mid = q[(q["p"] == 0.5) & (q["param"] == "b")]["x"].iloc[0]
    mode = next(t[3] for t in net.nodes["c"].terms if t[0] == "b")
    assert abs(mid - mode) < 0.05
    assert fitting.mse_from_modes(net.coefficients(spark)).count() == 1


def grouped(spark):
    rng = np.random.default_rng(3)
    u = rng.normal(scale=1.2, size=40)
    g = np.repeat(np.arange(40), 50)
    x = rng.normal(size=2000)
    y = 1 + 2 * x + u[g] + rng.normal(size=2000)
    z = (rng.random(2000) < 1 / (1 + np.exp(-(0.5 * x + u[g])))).astype(int)
    k = rng.poisson(np.exp(0.3 * x + 0.5 * u[g]))
    return spark.createDataFrame([(float(a), float(b), int(c), int(d), int(e)) for a, b, c, d, e in zip(x, y, z, k, g, strict=True)], "x double, y double, z int, k long, g int")


def test_random_intercepts(spark):
    t = grouped(spark)
    s = Schema.of({"x": "gaussian", "y": "gaussian", "z": "binomial", "k": "poisson"}, group="g")
    dag = Dag.of(s.nodes, [("x", "y"), ("x", "z"), ("x", "k")])
    net = fitting.fit(t, s, dag, centre=False)
    slope = {c: next(v for n, _, p, v, _ in net.nodes[c].terms if p == "x") for c in "yzk"}
    assert abs(slope["y"] - 2) < 0.1 and abs(slope["z"] - 0.5) < 0.2 and abs(slope["k"] - 0.3) < 0.1
    assert abs(net.nodes["y"].sigma - 1) < 0.1
    assert abs(net.nodes["y"].sigma_alpha[0] - 1.2) < 0.4 and abs(net.nodes["z"].sigma_alpha[0] - 1.2) < 0.5 and abs(net.nodes["k"].sigma_alpha[0] - 0.6) < 0.25
    rows = {(r["child_name"], r["n_parents"]): r for r in build_cache(t, s, limit=1, sets=[("y", []), ("y", ["x"]), ("z", []), ("z", ["x"])]).collect()}
    assert rows["y", 1]["mlik"] > rows["y", 0]["mlik"] and rows["z", 1]["mlik"] > rows["z", 0]["mlik"]


def test_grouped_likelihood_against_quadrature():
    rng = np.random.default_rng(0)
    g = np.repeat(np.arange(6), 30)
    a = np.column_stack([np.ones(180), rng.normal(size=180), (rng.random(180) < 0.4).astype(float)])
    model = M.Model(0, Dist.BINOMIAL, (2,), [0, 1], 1)
    beta, sd = np.array([-0.3, 0.2]), 0.8
    got = M.group_laplace(model, beta, np.array([math.log(sd)]), a, np.ones(180), g, 6)
    u = np.linspace(-8 * sd, 8 * sd, 4001)
    want = 0.0
    for k in range(6):
        x, y = a[g == k][:, [0, 1]], a[g == k][:, 2]
        eta = (x @ beta)[:, None] + u[None]
        f = np.exp((y[:, None] * eta - np.logaddexp(0, eta)).sum(axis=0) - 0.5 * u**2 / sd**2) / (sd * math.sqrt(2 * math.pi))
        want += math.log(np.trapezoid(f, u))
    assert abs(got - want) < 0.05


def test_grouped_bayes_and_multinomial(spark, sample):
    t = sample.select("b", "c", "e", (F.col("g") % 12).alias("g"))
    s = Schema.of({"b": "gaussian", "c": "binomial", "e": "multinomial"}, group="g")
    mle = build_cache(t, s, sets=[("e", ["b"]), ("c", ["b"]), ("b", [])]).collect()
    assert all(r["error_code"] == 0 and math.isfinite(r["mdl"]) for r in mle)
    bayes = build_cache(t.drop("e"), s.only("bc"), "bayes", sets=[("c", ["b"]), ("b", ["c"])]).collect()
    assert all(math.isfinite(r["mlik"]) for r in bayes)
    plain = {r["child_name"]: r["mlik"] for r in mle}
    assert bayes[0]["mlik"] < plain["c"]


def test_contributions_add_up(spark, sample):
    s = SCHEMA.only("abcd")
    dag = Dag.of(s.nodes, [("a", "b"), ("b", "c"), ("a", "d")])
    net = fitting.fit(sample, s, dag, centre=False)
    sums = {r["node"]: r for r in fitting.score_contributions(sample, net, ["id"]).groupBy("node").agg(F.sum("mlik").alias("m"), F.sum("hat").alias("h"), F.sum("bic").alias("b")).collect()}
    for c, k in (("c", 2), ("d", 2), ("b", 2)):
        assert abs(sums[c]["h"] - k) < 1e-3
        assert abs(sums[c]["m"] - net.nodes[c].scores["mlik"]) < 1.0
    assert abs(sums["c"]["b"] - net.nodes["c"].scores["bic"]) < 1e-3 * abs(sums["c"]["b"])


def test_simulated_moments(spark, sample):
    dag = Dag.of(SCHEMA.nodes, [("a", "b"), ("b", "c"), ("a", "d"), ("b", "e")])
    net = fitting.fit(sample, SCHEMA, dag, centre=False)
    out = simulate.simulate(spark, net, 20_000, seed=5)
    again = simulate.simulate(spark, net, 20_000, seed=5)
    assert out.exceptAll(again).isEmpty()
    one, two = (x.agg(F.avg("b"), F.avg((F.col("c") == "yes").cast("int")), F.avg("d"), F.avg((F.col("e") == "x").cast("int"))).first() for x in (sample, out))
    assert all(abs(p - q) < 0.1 for p, q in zip(one, two, strict=True))
    assert not simulate.random_dag("abcdef", 1.0).has_cycle() and len(simulate.random_dag("abcdef", 1.0).arcs) == 15


def test_texts(spark, sample):
    d = Dag.of(("b1", "b2"), [("b2", "b1")])
    assert export.to_dot(spark, d, {"b1": "binomial", "b2": "binomial"}, directed=False) == 'graph dag { \n\n"b1"[shape=box];\n"b2"[shape=box];\n\n\n\n"b2"--"b1";\n\n}\n'
    assert export.bugs_node("a", "gaussian", [0.318077], [[(0.3059395, "b"), (0.5555, "c")]], 0.05773503) == [
        "a ~ dnorm(mu.a, precision.a) # Gaussian response",
        "mu.a <- 0.318077 + 0.3059395*b + 0.5555*c # Linear regression",
        "precision.a <- inverse(0.05773503) # precision tau = 1/standard_dev",
    ]
    assert export.bugs_node("b", "multinomial", [2.18865, 3.133928], [[(1.686432, "a")], [(3.134161, "a")]])[4:] == [
        "log(phi.b[2]) <- 2.18865 + 1.686432*a",
        "p.b[3] <- phi.b[3]/sum(phi.b) # soft-max",
        "log(phi.b[3]) <- 3.133928 + 3.134161*a",
    ]
    assert np.allclose(export.softmaxed([2.22, 3.33, 4.44, 5.55]), [0.0242836145724376, 0.0736851897251164, 0.223587273987992, 0.678443921714454])
    assert export.bugs_group_node("Y", "binomial", [3], [[(4, "X"), (5, "N")]], None, 0.5) == [
        "Y ~ dbern(p_Y)",
        "logit(p_Y) <- mu_Y + 4*X + 5*N + alpha_Y",
        "mu_Y <- 3",
        "alpha_Y ~ dnorm(mu_alpha_Y, tau_alpha_Y)",
        "mu_alpha_Y <- 0",
        "tau_alpha_Y <- inverse(sigma_alpha_Y)",
        "sigma_alpha_Y <- 0.5",
    ]
    dag = Dag.of(SCHEMA.nodes, [("a", "b"), ("b", "c"), ("b", "e")])
    net = fitting.fit(sample, SCHEMA, dag)
    text = export.to_bugs(net)
    assert text.startswith("model{\na ~ dnorm") and text.endswith("}\n") and "dcat" in text
    import json

    j = json.loads(export.to_json_frame(spark, net, label="x").first()[0])
    assert [v["variable_id"] for v in j["variables"]] == list("abcde")
    assert j["variables"][4]["states"][0]["is_baseline"] and j["variables"][0]["states"] is None
    assert {p["link_function_name"] for p in j["parameters"]} == {"identity", "logit", "log"}
    assert len(j["arcs"]) == 3 and j["scenario_id"] is None
    assert sum(p["source"]["variable_id"] == "e" for p in j["parameters"]) == 4


def test_controls(spark, sample):
    from dagwright.plans.controls import control

    c = control("bayes", fit=True, prec=0.01)
    assert c.priors().precision == 0.01 and c.tol == 1e-11 and c.seed == 9062019
    with pytest.raises(ValueError, match="unknown"):
        control("mle", precision=1)
    with pytest.warns(UserWarning, match="not read"):
        control("mle", prec=1.0)
    s = Schema.of({"b": "gaussian", "c": "binomial"})
    net = fitting.fit(sample, s, Dag.of("bc", [("b", "c")]))
    p = {r["term"]: r["pvalue"] for r in net.coefficients(spark, pvalues=True).filter("node = 'c'").collect()}
    assert p["b"] < 1e-6 and net.family() == {"b": "gaussian", "c": "binomial"} and net.n == 3000
