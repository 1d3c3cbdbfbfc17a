"""Registered queries of fitted models, and their SQL: closed forms, and Newton's
method written out step by step where there is none."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import graph
from ..graph import Dag
from ..operators import fit as fitting
from ..operators import infotheo as info
from ..operators import search, simulate
from ..operators.models import Priors
from ..operators.parent_sets import parent_sets
from ..schema import Dist, Schema, parent_limits, validate
from ..sources import export
from ..sources.tables import lineitem_nodes, read
from .cache import build_cache, score_column, tidy
from .controls import control
from .queries import _FIVE, _MIXED, _N_SQL, _NET, _TWO_SQL, _cache_sql, _dp_sql, _five, _gauss, _shown, _trace_sql, arcs_sql, gauss_cache, learned, learned_dag, query

LN2PI = "ln(2 * pi())"

# --- SQL of models --------------------------------------------------------


def _newton(name: str, cells: str, dist: str, prior: float = 0.0, shrink: str = "0", null: bool = False, steps: int = 14) -> str:
    """CTEs ending in ``name`` (b0, b1, ll, laplace): a logistic or Poisson
    regression on x over ``cells`` (x, m rows, y their sum, lf their sum of
    ln y!), by Newton steps from the mean."""
    eta = "(b0 + b1 * x)"
    if dist == "binomial":
        y, mu, var = f"((y + m * h / 2) / (1 + h))", f"(1 / (1 + exp(-{eta})))", f"(1 / (1 + exp(-{eta})) * (1 - 1 / (1 + exp(-{eta}))))"
        ll, first = f"sum(y * {eta} - m * ln(1 + exp({eta})))", "0.0::DOUBLE"
    else:
        y, mu, var = "y", f"exp({eta})", f"exp({eta})"
        ll, first = f"sum(y * {eta} - m * exp({eta}) - lf)", "ln(sum(y) / sum(m))"
    ctes = [f"{name}_s0 AS (SELECT {first} AS b0, 0.0::DOUBLE AS b1, ({shrink})::DOUBLE AS h FROM {cells})"]
    sums = f"b0, b1, h, sum({y} - m * {mu}) - {prior} * b0 AS g0, sum(x * ({y} - m * {mu})) - {prior} * b1 AS g1, sum(m * {var}) + {prior} AS h00, sum(x * m * {var}) AS h01, sum(x * x * m * {var}) + {prior} AS h11, {ll} AS ll"
    for k in range(steps + 1):
        ctes.append(f"{name}_t{k} AS (SELECT {sums} FROM {cells}, {name}_s{k} GROUP BY b0, b1, h)")
        if k < steps:
            move = "b0 + g0 / h00 AS b0, b1" if null else "b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b0, b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b1"
            ctes.append(f"{name}_s{k + 1} AS (SELECT {move}, h FROM {name}_t{k})")
    p, det = (1, "h00") if null else (2, "(h00 * h11 - h01 * h01)")
    laplace = f"ll - 0.5 * {prior} * (b0 * b0 + b1 * b1) + 0.5 * {p} * (ln({prior or 1}) - {LN2PI}) - 0.5 * ln({det}) + 0.5 * {p} * {LN2PI}"
    ctes.append(f"{name} AS (SELECT b0, b1, ll, {laplace} AS laplace FROM {name}_t{steps})")
    return ",\n".join(ctes)


def _gauss_laplace(name: str, sums: str, null: bool = False, steps: int = 8) -> str:
    """CTEs ending in ``name`` (b0, b1, tau, laplace): a gaussian regression under
    the default priors from ``sums`` (n, sx, sxx, sy, sxy, syy)."""
    q, shape_rate = 0.001, 5e-5
    ctes = [f"{name}_s0 AS (SELECT *, n / syy AS tau FROM {sums})"]
    for k in range(1, steps + 1):
        a00, a01, a11 = f"(tau * n + {q})", "(tau * sx)", f"(tau * sxx + {q})"
        if null:
            beta = f"tau * sy / {a00} AS b0, 0.0::DOUBLE AS b1"
        else:
            det = f"({a00} * {a11} - {a01} * {a01})"
            beta = f"({a11} * tau * sy - {a01} * tau * sxy) / {det} AS b0, ({a00} * tau * sxy - {a01} * tau * sy) / {det} AS b1"
        ctes.append(f"{name}_b{k} AS (SELECT *, {beta} FROM (SELECT * {'' if k == 1 else 'EXCLUDE (b0, b1, ssr)'} FROM {name}_s{k - 1}))")
        ssr = "syy - 2 * (b0 * sy + b1 * sxy) + b0 * b0 * n + 2 * b0 * b1 * sx + b1 * b1 * sxx"
        ctes.append(f"{name}_s{k} AS (SELECT * REPLACE ((n / 2) / (ssr / 2 + {shape_rate}) AS tau) FROM (SELECT *, {ssr} AS ssr FROM {name}_b{k}))")
    p = 1 if null else 2
    goal = f"0.5 * n * (ln(tau) - {LN2PI}) - 0.5 * tau * ssr + 0.5 * {p} * (ln({q}) - {LN2PI}) - 0.5 * {q} * (b0 * b0 + b1 * b1) + ln({shape_rate}) - {shape_rate} * tau"
    c0, c1, h22 = "(n * b0 + sx * b1 - sy)", "(sx * b0 + sxx * b1 - sxy)", "(n / 2 / (tau * tau))"
    h00, h01, h11 = f"(tau * n + {q})", "(tau * sx)", f"(tau * sxx + {q})"
    det = f"({h00} * {h22} - {c0} * {c0})" if null else f"({h00} * ({h11} * {h22} - {c1} * {c1}) - {h01} * ({h01} * {h22} - {c1} * {c0}) + {c0} * ({h01} * {c1} - {h11} * {c0}))"
    ctes.append(f"{name} AS (SELECT b0, b1, tau, n, {goal} - 0.5 * ln({det}) + 0.5 * {p + 1} * {LN2PI} AS laplace FROM {name}_s{steps})")
    return ",\n".join(ctes)


#: lineitem with the columns that the models see: gaussian ones standardised.
_SEEN = """st AS (SELECT avg(l_quantity) AS qm, stddev_samp(l_quantity) AS qs FROM lineitem),
seen AS (SELECT (l_linestatus = 'O')::INTEGER::DOUBLE AS bin, l_linenumber::DOUBLE AS pois, l_returnflag AS multi, (l_quantity - qm) / qs AS gauss, lgamma(l_linenumber + 1.0::DOUBLE) AS lf FROM lineitem, st),
total AS (SELECT count(*)::DOUBLE AS n FROM seen)"""


def _cells(y: str, x: str) -> str:
    return f"(SELECT {x}::DOUBLE AS x, count(*)::DOUBLE AS m, sum({y})::DOUBLE AS y, sum(lf) AS lf FROM seen GROUP BY 1)"


def _mixed_sql() -> str:
    ctes, rows = [_SEEN], []

    def add(child, mask, ll, df, n_parents, source):
        rows.append(f"SELECT {child} AS child, {mask}::BIGINT AS mask, {1 if mask else 0} AS n_parents, {ll} AS mlik, {df} AS df, {n_parents} AS np FROM {source}")

    for child, (y, dist) in enumerate((("bin", "binomial"), ("pois", "poisson"))):
        for x, mask in (("0", 0), ("bin", 1), ("pois", 2), ("gauss", 8)):
            if x == y:
                continue
            name, k = f"{y}_{mask}", 1 if x == "0" else 2
            ctes.append(f"{name}_c AS {_cells(y, x)}")
            ctes.append(_newton(name, f"{name}_c", dist, 0.0, f"{k} / sum(m)" if y == "bin" else "0 * sum(m)", x == "0"))
            add(child, mask, "ll", k, k - 1, name)
    ctes.append("by_multi AS (SELECT multi, count(*)::DOUBLE AS m, sum(bin) AS y, avg(pois) AS mu, sum(lf) AS lf, avg(gauss) AS gm FROM seen GROUP BY 1)")
    ctes.append("shrunk AS (SELECT *, (y / m + 3 / n / 2) / (1 + 3 / n) AS q FROM by_multi, total)")
    add(0, 4, "sum(y * ln(q) + (m - y) * ln(1 - q))", 3, 3, "shrunk")
    add(1, 4, "sum(m * mu * ln(mu) - m * mu - lf)", 3, 3, "by_multi")
    add(2, 0, "sum(m * ln(m / n))", 2, 0, "by_multi, total")
    ctes.append("by_both AS (SELECT bin, count(*)::DOUBLE AS m, sum(count(*)) OVER (PARTITION BY bin) AS all_m FROM seen GROUP BY bin, multi)")
    add(2, 1, "sum(m * ln(m / all_m))", 4, 1, "by_both")
    ctes.append("rest AS (SELECT count(*)::DOUBLE AS n, 1 - corr(gauss, bin) * corr(gauss, bin) AS rb, 1 - corr(gauss, pois) * corr(gauss, pois) AS rp FROM seen)")
    ctes.append("anova AS (SELECT 1 - sum(m * gm * gm) / (n - 1) AS rm FROM by_multi, total GROUP BY n)")
    for mask, share, df, n_parents in ((0, "1", 2, 0), (1, "rb", 3, 1), (2, "rp", 3, 1), (4, "rm", 4, 3)):
        add(3, mask, f"0.5 * (-n * ({LN2PI} + 1 - ln(n) + ln((n - 1) * {share})))", df, n_parents, "rest, anova")
    union = " UNION ALL ".join(rows)
    return (
        f"WITH {', '.join(ctes)}, r AS ({union}) SELECT child, mask, n_parents, round(mlik, 3) AS mlik, round(-2 * mlik + 2 * df, 3) AS aic, round(-2 * mlik + ln(n) * df, 3) AS bic,"
        " round(-2 * mlik + ln(n) * df + (1 + np) * ln(4.0::DOUBLE), 3) AS mdl FROM r, total"
    )


@query("mixed_scores", _mixed_sql())
def mixed_scores(spark, sf):
    """All parent sets of up to one parent; multinomial children have parents of few values."""
    banned = Dag.of(tuple(_MIXED), [("l_linenumber", "l_returnflag"), ("l_quantity", "l_returnflag")])
    c = tidy(build_cache(lineitem_nodes(spark, sf), Schema.of(_MIXED), "mle", 1, banned))
    return c.select("child", "mask", "n_parents", *[F.round(s, 3).alias(s) for s in ("mlik", "aic", "bic", "mdl")])


def _laplace_sql() -> str:
    ctes, rows = [_SEEN], []
    for child, (y, dist) in enumerate((("bin", "binomial"), ("pois", "poisson"))):
        for x, mask in (("0", 0), ("bin", 1), ("pois", 2), ("gauss", 4)):
            if x == y:
                continue
            name = f"{y}_{mask}"
            ctes.append(f"{name}_c AS {_cells(y, x)}")
            ctes.append(_newton(name, f"{name}_c", dist, 0.001, "0 * sum(m)", x == "0"))
            rows.append(f"SELECT {child} AS child, {mask}::BIGINT AS mask, laplace FROM {name}")
    for x, mask in (("0", 0), ("bin", 1), ("pois", 2)):
        name = f"gauss_{mask}"
        ctes.append(f"{name}_c AS (SELECT count(*)::DOUBLE AS n, sum({x})::DOUBLE AS sx, sum({x} * {x})::DOUBLE AS sxx, 0.0::DOUBLE AS sy, sum({x} * gauss) AS sxy, count(*) - 1.0::DOUBLE AS syy FROM seen)")
        ctes.append(_gauss_laplace(name, f"{name}_c", x == "0"))
        rows.append(f"SELECT 2 AS child, {mask}::BIGINT AS mask, laplace FROM {name}")
    return f"WITH {', '.join(ctes)}, r AS ({' UNION ALL '.join(rows)}) SELECT child, mask, round(laplace, 3) AS mlik FROM r"


@query("laplace_scores", _laplace_sql())
def laplace_scores(spark, sf):
    schema = Schema.of(_MIXED).only(["l_linestatus", "l_linenumber", "l_quantity"])
    return build_cache(lineitem_nodes(spark, sf), schema, "bayes", 1, priors=Priors()).select("child", "mask", F.round("mlik", 3).alias("mlik"))


_LMM = ("l_quantity", "l_extendedprice", "net")


def _lmm_sql() -> str:
    """Restricted likelihood of each model over a grid of variance ratios, closed in
    on three times."""
    cols = ["1.0::DOUBLE", *(f"({c} - m{i}) / s{i}" for i, c in enumerate(_LMM))]
    stats = ", ".join(f"avg({c}) AS m{i}, stddev_samp({c}) AS s{i}" for i, c in enumerate(_LMM))
    ctes = [
        f"src AS (SELECT l_suppkey AS g, l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net FROM lineitem), st AS (SELECT {stats} FROM src)",
        f"std AS (SELECT g, {', '.join(f'{c} AS x{i}' for i, c in enumerate(cols))} FROM src, st)",
        f"sums AS (SELECT {', '.join(f'sum(x{i}) AS s{i}' for i in range(4))} FROM std GROUP BY g)",
        f"yx AS (SELECT {', '.join(f'sum(x{i} * x{j}) AS a{i}_{j}' for i in range(4) for j in range(i, 4))} FROM std)",
        "grid AS (SELECT 0.0::DOUBLE AS r UNION ALL SELECT power(10.0::DOUBLE, -8 + 14 * i / 42.0::DOUBLE) FROM (SELECT unnest(range(0, 43)) AS i))",
    ]
    rows = []
    for y in (1, 2, 3):
        for x in (0, *(k for k in (1, 2, 3) if k != y)):
            name, p = f"l{y}_{x}", 2 if x else 1
            v = lambda i, j: f"(min(a{min(i, j)}_{max(i, j)}) - sum(r / (1 + r * s0) * s{i} * s{j}))"
            if x:
                det = f"(v00 * v{x}{x} - v0{x} * v0{x})"
                fitted = f"((v{x}{x} * v0{y} * v0{y} - 2 * v0{x} * v0{y} * vxy + v00 * vxy * vxy) / {det})"
                need = {"v00": (0, 0), f"v0{x}": (0, x), f"v{x}{x}": (x, x), f"v0{y}": (0, y), "vxy": (x, y), "vyy": (y, y)}
            else:
                det, fitted, need = "v00", f"(v0{y} * v0{y} / v00)", {"v00": (0, 0), f"v0{y}": (0, y), "vyy": (y, y)}
            df = f"(n - {p})"
            for turn in range(4):
                source = "grid" if not turn else f"{name}_g{turn}"
                ctes.append(
                    f"{name}_v{turn} AS (SELECT r, min(a0_0) AS n, sum(ln(1 + r * s0)) AS ld, {', '.join(f'{v(*ij)} AS {k}' for k, ij in need.items())} FROM sums, yx, {source} GROUP BY r)"
                )
                ctes.append(
                    f"{name}_l{turn} AS (SELECT *, lag(r) OVER (ORDER BY r) AS lo, lead(r) OVER (ORDER BY r) AS hi FROM (SELECT r, n, -0.5 * ({df} * ({LN2PI} + ln((vyy - {fitted}) / {df}) + 1) + ld) - 0.5 * ln({det}) AS ll FROM {name}_v{turn}))"
                )
                ctes.append(f"{name}_b{turn} AS (SELECT r, n, ll, coalesce(lo, r) AS lo, coalesce(hi, r) AS hi FROM {name}_l{turn} ORDER BY ll DESC, r LIMIT 1)")
                if turn < 3:
                    ctes.append(f"{name}_g{turn + 1} AS (SELECT r FROM {name}_b{turn} UNION SELECT lo + (hi - lo) * i / 12.0::DOUBLE FROM {name}_b{turn}, (SELECT unnest(range(0, 13)) AS i))")
            best = " UNION ALL ".join(f"SELECT ll, n FROM {name}_b{turn}" for turn in range(4))
            rows.append(f"SELECT {y - 1} AS child, {(1 << (x - 1)) if x else 0}::BIGINT AS mask, {p + 2} AS df, max(ll) AS mlik, max(n) AS n FROM ({best})")
    return (
        f"WITH {', '.join(ctes)}, r AS ({' UNION ALL '.join(rows)}) SELECT child, mask, round(mlik, 2) AS mlik, round(-2 * mlik + 2 * df, 2) AS aic, round(-2 * mlik + ln(n) * df, 2) AS bic,"
        " round(-2 * mlik + ln(n) * df + (df - 1) * ln(3.0::DOUBLE), 2) AS mdl FROM r"
    )


@query("lmm_scores", _lmm_sql())
def lmm_scores(spark, sf):
    c = build_cache(lineitem_nodes(spark, sf), Schema.of(dict.fromkeys(_LMM, "gaussian"), group="l_suppkey"), "mle", 1)
    return c.select("child", "mask", *[F.round(s, 2).alias(s) for s in ("mlik", "aic", "bic", "mdl")])


# --- Fits of lineitem -----------------------------------------------------

_KINDS = {"l_extendedprice": "gaussian", "net": "gaussian", "l_linestatus": "binomial", "l_linenumber": "poisson", "l_returnflag": "multinomial"}
_LINE_ARCS = [("l_extendedprice", "net"), ("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber")]


def line_network(spark, sf) -> fitting.Network:
    schema = Schema.of(_KINDS)
    return fitting.fit(lineitem_nodes(spark, sf), schema, Dag.of(schema.nodes, _LINE_ARCS))


_CELLS = f"""cors AS (SELECT count(*)::DOUBLE AS n, corr(l_extendedprice, net) AS r FROM {_NET}),
flags AS (SELECT l_returnflag AS f, count(*)::DOUBLE AS m, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::DOUBLE AS y, avg(l_linenumber)::DOUBLE AS mu, row_number() OVER (ORDER BY l_returnflag) AS k FROM lineitem GROUP BY 1),
first AS (SELECT m AS m0 FROM flags WHERE k = 1)"""
#: (pos, node, term, state, parent, level, estimate, stderr), in the network's order.
_TERMS = f"""WITH {_CELLS}, terms AS (
SELECT 1 AS pos, 'l_extendedprice' AS node, 'l_extendedprice|intercept' AS term, NULL::VARCHAR AS state, NULL::VARCHAR AS parent, NULL::BIGINT AS level, 0.0::DOUBLE AS estimate, 1 / sqrt(n) AS stderr FROM cors
UNION ALL SELECT 2, 'net', 'net|intercept', NULL, NULL, NULL, 0.0, sqrt((n - 1) * (1 - r * r) / (n - 2) / n) FROM cors
UNION ALL SELECT 3, 'net', 'l_extendedprice', NULL, 'l_extendedprice', NULL, r, sqrt((1 - r * r) / (n - 2)) FROM cors
UNION ALL SELECT 3 + k, 'l_linestatus', 'l_returnflag' || f, NULL, 'l_returnflag', k, ln(y / (m - y)), 1 / sqrt(y * (m - y) / m) FROM flags
UNION ALL SELECT 6 + k, 'l_linenumber', 'l_returnflag' || f, NULL, 'l_returnflag', k, ln(mu), 1 / sqrt(m * mu) FROM flags
UNION ALL SELECT 8 + k, 'l_returnflag', 'l_returnflag|intercept.' || f, f, NULL, k, ln(m / m0), sqrt(1 / m + 1 / m0) FROM flags, first WHERE k > 1)"""
_NODE_SCORES = f"""{_TERMS}, ll AS (
SELECT 'l_extendedprice' AS node, 'gaussian' AS dist, 2 AS df, 0 AS np, 0.5 * (-n * ({LN2PI} + 1 - ln(n) + ln(n - 1))) AS mlik FROM cors
UNION ALL SELECT 'net', 'gaussian', 3, 1, 0.5 * (-n * ({LN2PI} + 1 - ln(n) + ln((n - 1) * (1 - r * r)))) FROM cors
UNION ALL SELECT 'l_linestatus', 'binomial', 3, 3, sum(y * ln(y / m) + (m - y) * ln(1 - y / m)) FROM flags
UNION ALL SELECT 'l_linenumber', 'poisson', 3, 3, sum(l_linenumber * ln(mu) - mu - lgamma(l_linenumber + 1.0::DOUBLE)) FROM lineitem JOIN flags ON f = l_returnflag
UNION ALL SELECT 'l_returnflag', 'multinomial', 2, 0, sum(m * ln(m / n)) FROM flags, cors),
scored AS (SELECT node, dist, df, mlik, -2 * mlik + 2 * df AS aic, -2 * mlik + ln(n) * df AS bic, -2 * mlik + ln(n) * df + (1 + np) * ln(5.0::DOUBLE) AS mdl FROM ll, cors)"""


@query("fit_nodes", f"{_TERMS} SELECT node, term, state, parent, round(estimate, 5) + 0.0 AS estimate, round(stderr, 7) AS stderr FROM terms")
def fit_nodes(spark, sf):
    c = line_network(spark, sf).coefficients(spark)
    return c.select("node", "term", "state", "parent", (F.round("estimate", 5) + F.lit(0.0)).alias("estimate"), F.round("stderr", 7).alias("stderr"))


@query("node_scores", f"{_NODE_SCORES} SELECT node, dist, df::DOUBLE AS df, round(mlik, 2) AS mlik, round(aic, 2) AS aic, round(bic, 2) AS bic, round(mdl, 2) AS mdl FROM scored")
def node_scores(spark, sf):
    return line_network(spark, sf).node_scores(spark).select("node", "dist", "df", *[F.round(s, 2).alias(s) for s in ("mlik", "aic", "bic", "mdl")])


@query("network_scores", f"{_NODE_SCORES} SELECT count(*) AS nodes, round(sum(mlik), 2) AS mlik, round(sum(aic), 2) AS aic, round(sum(bic), 2) AS bic, round(sum(mdl), 2) AS mdl, (SELECT count(*) FROM lineitem) AS nobs FROM scored")
def network_scores(spark, sf):
    net = line_network(spark, sf)
    row = (len(net.family()), net.log_lik(), net.aic(), net.bic(), net.total("mdl"), net.nobs())
    t = spark.createDataFrame([row], "nodes long, mlik double, aic double, bic double, mdl double, nobs long")
    return t.select("nodes", *[F.round(c, 2).alias(c) for c in ("mlik", "aic", "bic", "mdl")], "nobs")


@query(
    "score_contribution_discrete",
    f"""WITH {_CELLS}, cell AS (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem),
c AS (SELECT l_returnflag, l_linestatus, l_linenumber, 'l_linestatus' AS node, CASE WHEN l_linestatus = 'O' THEN ln(y / m) ELSE ln(1 - y / m) END AS ll, 3 AS k, 1 AS np, 1 / m AS hat FROM cell JOIN flags ON f = l_returnflag
UNION ALL SELECT l_returnflag, l_linestatus, l_linenumber, 'l_linenumber', l_linenumber * ln(mu) - mu - lgamma(l_linenumber + 1.0::DOUBLE), 3, 1, 1 / m FROM cell JOIN flags ON f = l_returnflag
UNION ALL SELECT l_returnflag, l_linestatus, l_linenumber, 'l_returnflag', ln(m / n), 2, 0, NULL FROM cell JOIN flags ON f = l_returnflag, cors)
SELECT l_returnflag AS flag, l_linestatus AS status, l_linenumber AS number, node, round(ll, 6) AS mlik, round(-2 * ll + 2 * k / n, 6) AS aic, round(-2 * ll + k / n * ln(n), 6) AS bic,
 round(-2 * ll + k / n * ln(n) + (1 + np) / n * ln(n), 6) AS mdl, round(hat, 9) AS hat FROM c, cors""",
)
def score_contribution_discrete(spark, sf):
    t = lineitem_nodes(spark, sf).withColumns({"flag": F.col("l_returnflag"), "status": F.col("l_linestatus"), "number": F.col("l_linenumber").cast("int")})
    schema = Schema.of({k: v for k, v in _KINDS.items() if v != "gaussian"})
    net = fitting.fit(t, schema, Dag.of(schema.nodes, _LINE_ARCS[1:]))
    s = fitting.score_contributions(t, net, ["flag", "status", "number"]).distinct()
    return s.select("flag", "status", "number", "node", *[F.round(c, 6).alias(c) for c in ("mlik", "aic", "bic", "mdl")], F.round("hat", 9).alias("hat")).distinct()


_PARAMETER = "array<struct<parameter_id:string,name:string,link_function_name:string,source:struct<variable_id:string,state_id:string>,coefficients:array<struct<value:double,stderr:double,condition_type:string,conditions:array<struct<parent_variable_id:string,parent_state_id:string>>>>>>"


@query(
    "export_json",
    f"""{_TERMS} SELECT 's1' AS scenario_id, pos::VARCHAR AS parameter_id, CASE WHEN parent IS NOT NULL THEN term WHEN state IS NULL THEN 'intercept' ELSE 'prob_' || level END AS name,
 CASE node WHEN 'l_linenumber' THEN 'log' WHEN 'l_linestatus' THEN 'logit' WHEN 'l_returnflag' THEN 'logit' ELSE 'identity' END AS link, node AS variable_id, CASE WHEN state IS NOT NULL THEN level::VARCHAR END AS state_id,
 round(estimate, 5) + 0.0 AS value, round(stderr, 7) AS stderr, CASE WHEN parent IS NULL THEN 'intercept' ELSE 'linear_term' END AS kind, parent, CASE WHEN state IS NULL THEN level::VARCHAR END AS parent_state, 5 AS n_variables, 3 AS n_arcs FROM terms""",
)
def export_json(spark, sf):
    """The export's parameters, read back from its text."""
    text = export.to_json_frame(spark, line_network(spark, sf), "s1", "lines")
    x = F.from_json("json", f"scenario_id string, variables array<struct<variable_id:string>>, parameters {_PARAMETER}, arcs array<struct<source_variable_id:string>>")
    each = text.select(x.alias("x")).select("x.scenario_id", F.size("x.variables").alias("n_variables"), F.size("x.arcs").alias("n_arcs"), F.explode("x.parameters").alias("p"))
    c = F.col("p.coefficients")[0]
    return each.select(
        "scenario_id", "p.parameter_id", "p.name", F.col("p.link_function_name").alias("link"), "p.source.variable_id", "p.source.state_id", (F.round(c["value"], 5) + F.lit(0.0)).alias("value"), F.round(c["stderr"], 7).alias("stderr"), c["condition_type"].alias("kind"),
        F.get(c["conditions"], 0)["parent_variable_id"].alias("parent"), F.get(c["conditions"], 0)["parent_state_id"].alias("parent_state"), "n_variables", "n_arcs",
    )


_SHOWN = "printf('%.4f', round({}, 4) + 0.0)"


def _bugs_sql() -> str:
    def shown(x):
        return f"' || {_SHOWN.format(x)} || '"

    zero, one = "0.0000", "1.0000"
    lines = []
    for node, mean, sd in (("l_extendedprice", shown("0.0::DOUBLE"), shown("1.0::DOUBLE")), ("net", f"{shown('0.0::DOUBLE')} + {shown('r')}*l_extendedprice", shown("sqrt((n - 1) * (1 - r * r) / (n - 2))"))):
        lines += [f"{node} ~ dnorm(mu.{node}, precision.{node}) # Gaussian response", f"mu.{node} <- {mean} # Linear regression", f"precision.{node} <- inverse({sd}) # precision tau = {one}/standard_dev"]
    for node, head, link, share in (("l_linestatus", "dbern(p.l_linestatus) # Bernoulli response", "logit(p.l_linestatus)", "y / (m - y)"), ("l_linenumber", "dpois(lambda.l_linenumber) # Poisson response", "log(lambda.l_linenumber)", "mu")):
        slopes = " + ".join(f"{shown(f'(SELECT max(CASE WHEN k = {k} THEN {share} END) / sum({share}) FROM flags)')}*l_returnflag" for k in (1, 2, 3))
        lines += [f"{node} ~ {head}", f"{link} <- {zero} + {slopes} # logistic regression"]
    lines += ["l_returnflag ~ dcat(p.l_returnflag) # Categorical response", "p.l_returnflag[1] <- phi.l_returnflag[1]/sum(phi.l_returnflag) # soft-max", f"log(phi.l_returnflag[1]) <- {zero} # Reference category"]
    for k in (2, 3):
        lines += [f"p.l_returnflag[{k}] <- phi.l_returnflag[{k}]/sum(phi.l_returnflag) # soft-max", f"log(phi.l_returnflag[{k}]) <- {shown(f'(SELECT ln(max(CASE WHEN k = {k} THEN m END) / max(CASE WHEN k = 1 THEN m END)) FROM flags)')}"]
    return f"WITH {_CELLS} " + " UNION ALL ".join(f"SELECT {i} AS line_no, '{x}' AS line FROM cors" for i, x in enumerate(["model{", *lines, "}"]))


@query("bugs_text", _bugs_sql())
def bugs_text(spark, sf):
    """The model's text; its numbers with four digits."""
    number = re.compile(r"(?<![\w.\[])-?\d+(?:\.\d+)?(?:e[+-]?\d+)?(?![\w\]])")
    text = number.sub(lambda m: f"{round(float(m[0]), 4) + 0.0:.4f}", export.to_bugs(line_network(spark, sf)))
    return spark.createDataFrame(list(enumerate(text.splitlines())), "line_no int, line string")


_GROUP_LINES = [
    "g ~ dnorm(mean_g, tau_g)", "mean_g <- mu_g + 0.5*a + alpha_g", "tau_g <- inverse(sigma_g)", "sigma_g <- 2", "mu_g <- 1.25", "alpha_g ~ dnorm(mu_alpha_g, tau_alpha_g)", "mu_alpha_g <- 0", "tau_alpha_g <- inverse(sigma_alpha_g)", "sigma_alpha_g <- 0.75",
    "b ~ dbern(p_b)", "logit(p_b) <- mu_b + alpha_b", "mu_b <- -0.5", "alpha_b ~ dnorm(mu_alpha_b, tau_alpha_b)", "mu_alpha_b <- 0", "tau_alpha_b <- inverse(sigma_alpha_b^2)", "sigma_alpha_b <- 1.5",
    "p ~ dpois(lambda_p)", "log(lambda_p) <- mu_p + 0.25*a + -1*c + alpha_p", "mu_p <- 3", "alpha_p ~ dnorm(mu_alpha_p, tau_alpha_p)", "mu_alpha_p <- 0", "tau_alpha_p <- inverse(sigma_alpha_p)", "sigma_alpha_p <- 1",
]


@query("bugs_group_text", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(_GROUP_LINES)) + ") t(line_no, line)")
def bugs_group_text(spark, sf):
    lines = export.bugs_group_node("g", "gaussian", [1.25], [[(0.5, "a")]], 2.0, 0.75)
    lines += export.bugs_group_node("b", "binomial", [-0.5], [[]], None, 1.5, compat=False)
    lines += export.bugs_group_node("p", "poisson", [3.0], [[(0.25, "a"), (-1.0, "c")]], None, 1.0)
    return spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")


# --- Marginals ------------------------------------------------------------


def _marginal_sql(grid: str, tail: str, table: str = "lineitem", node: str = "l_extendedprice") -> str:
    """Densities of the mean and the precision of a standardised column: each with
    the other at its best, and its curvature there."""
    goal = f"0.5 * n * (ln(t) - {LN2PI}) - 0.5 * t * (n - 1 + n * b * b) + 0.5 * (ln(0.001) - {LN2PI}) - 0.0005 * b * b + ln(5e-5) - 5e-5 * t"
    return f"""WITH c AS (SELECT count(*)::DOUBLE AS n FROM {table}), mode AS (SELECT n, (n / 2) / ((n - 1) / 2 + 5e-5) AS tau FROM c),
best AS (SELECT n, tau, g - 0.5 * ln((tau * n + 0.001) * (n / 2) / (tau * tau)) + {LN2PI} AS whole FROM (SELECT n, tau, {goal} AS g FROM (SELECT n, tau, tau AS t, 0.0::DOUBLE AS b FROM mode))),
params AS (SELECT n, tau, whole, '{node}|intercept' AS param, 0.0::DOUBLE AS mid, 1 / sqrt(tau * n + 0.001) AS sd FROM best UNION ALL SELECT n, tau, whole, '{node}|precision', tau, 1 / sqrt(n / 2 / (tau * tau)) FROM best),
{grid},
asked AS (SELECT *, CASE WHEN param LIKE '%intercept' THEN x ELSE 0 END AS b, CASE WHEN param LIKE '%intercept' THEN (n / 2) / ((n - 1 + n * x * x) / 2 + 5e-5) ELSE x END AS t FROM points),
f AS (SELECT param, k, x, exp({goal} - 0.5 * ln(CASE WHEN param LIKE '%intercept' THEN n / 2 / (t * t) ELSE t * n + 0.001 END) + 0.5 * {LN2PI} - whole) AS f FROM asked)
{tail}"""


def _price_marginals(spark, sf, **how) -> DataFrame:
    schema = Schema.of({"l_extendedprice": "gaussian", "net": "gaussian"})
    dag = Dag.of(schema.nodes, [("l_extendedprice", "net")])
    return fitting.marginals(lineitem_nodes(spark, sf), schema, dag, nodes=["l_extendedprice"], **how).select("param", F.round("x", 8).alias("x"), F.round("f", 3).alias("f"))


@query("marginal_grid", _marginal_sql("points AS (SELECT *, i AS k, mid + sd * (-5 + i / 3.0::DOUBLE) AS x FROM params, (SELECT unnest(range(0, 31)) AS i))", "SELECT param, round(x, 8) + 0.0 AS x, round(f, 3) AS f FROM f"))
def marginal_grid(spark, sf):
    return _price_marginals(spark, sf, points=31).withColumn("x", F.col("x") + F.lit(0.0))


@query(
    "marginal_adaptive",
    _marginal_sql(
        "points AS (SELECT *, i AS k, mid + sd * i * 0.5::DOUBLE AS x FROM params, (SELECT unnest(range(-160, 161)) AS i) WHERE param LIKE '%intercept' OR mid + sd * i * 0.5::DOUBLE > 0)",
        ", ends AS (SELECT param, min(CASE WHEN k > 0 THEN k END) AS hi, max(CASE WHEN k < 0 THEN k END) AS lo FROM f WHERE k % 8 = 0 AND k <> 0 AND f <= 0.001 GROUP BY param)"
        " SELECT param, round(x, 8) + 0.0 AS x, round(f, 3) AS f FROM f JOIN ends USING (param) WHERE k BETWEEN lo AND hi",
    ),
)
def marginal_adaptive(spark, sf):
    return _price_marginals(spark, sf, control=control("bayes", True, min_pdf=0.001)).withColumn("x", F.col("x") + F.lit(0.0))


@query(
    "marginal_skewed",
    _marginal_sql(
        "points AS (SELECT *, i AS k, mid + sd * (i - 4000) / 400.0::DOUBLE AS x FROM params, (SELECT unnest(range(0, 16001)) AS i) WHERE param LIKE '%precision' AND mid + sd * (i - 4000) / 400.0::DOUBLE > 0)",
        "SELECT param, round(sum(f) * any_value(sd) / 400, 2) AS area, round(sum(x * f) / sum(f), 2) AS mean FROM f JOIN params USING (param) GROUP BY param",
        "supplier",
        "s_acctbal",
    ),
)
def marginal_skewed(spark, sf):
    """Few rows: a precision whose density leans against 0. Its grid finds the steps
    that area and mean need, from a mode and a curvature that fit neither side."""
    schema = Schema.of({"s_acctbal": "gaussian"})
    t = spark.read.parquet(f"{sf}/supplier.parquet").select("s_acctbal")
    found = fitting.marginals(t, schema, Dag.of(schema.nodes), control=control("bayes", True, min_pdf=1e-6))
    even = fitting.regrid(found.filter("param LIKE '%precision'"), 4000)
    step = (F.max("x") - F.min("x")) / 3999
    return even.groupBy("param").agg(F.round(step * F.sum("f"), 2).alias("area"), F.round(F.sum(F.col("x") * F.col("f")) / F.sum("f"), 2).alias("mean"))


_LINE = "SELECT 'a' AS node, 'p' AS param, {x} AS x, 2 * ({x}) + 1 AS f FROM (SELECT unnest(range(0, {n})) AS i)"


@query("density_regrid", f"SELECT node, param, round(x, 8) AS x, round(f, 8) AS f FROM ({_LINE.format(x='i / 10.0::DOUBLE', n=101)})")
def density_regrid(spark, sf):
    """A spline through the points of a straight line is that line."""
    x = F.col("id") * F.col("id") / F.lit(160.0)
    t = spark.range(41).select(F.lit("a").alias("node"), F.lit("p").alias("param"), x.alias("x"), (2 * x + 1).alias("f"))
    return fitting.regrid(t, 101).select("node", "param", F.round("x", 8).alias("x"), F.round("f", 8).alias("f"))


@query("density_mode", "SELECT 'a' AS node, 'p' AS param, 3.25::DOUBLE AS mode")
def density_mode(spark, sf):
    """Where a bell is highest, between two points of its grid."""
    x = F.col("id") / F.lit(2.0)
    t = spark.range(17).select(F.lit("a").alias("node"), F.lit("p").alias("param"), x.alias("x"), F.exp(-0.5 * (x - 3.25) * (x - 3.25)).alias("f"))
    return fitting.mode_of(t, points=8_001).select("node", "param", F.round("mode", 2).alias("mode"))


_BAYES_SUMS = f"c AS (SELECT count(*)::DOUBLE AS n, 0.0::DOUBLE AS sx, count(*) - 1.0::DOUBLE AS sxx, 0.0::DOUBLE AS sy, corr(l_extendedprice, net) * (count(*) - 1) AS sxy, count(*) - 1.0::DOUBLE AS syy FROM {_NET})"


def _bayes_network(spark, sf) -> fitting.Network:
    schema = Schema.of({"l_extendedprice": "gaussian", "net": "gaussian"})
    return fitting.fit(lineitem_nodes(spark, sf), schema, Dag.of(schema.nodes, [("l_extendedprice", "net")]), "bayes")


@query("modes_to_coefficients", f"WITH {_BAYES_SUMS}, {_gauss_laplace('g', 'c')} SELECT 'net' AS node, 'net|intercept' AS name, round(b0, 6) + 0.0 AS estimate FROM g UNION ALL SELECT 'net', 'l_extendedprice', round(b1, 6) FROM g")
def modes_to_coefficients(spark, sf):
    t = fitting.modes_to_coefficients(_bayes_network(spark, sf).coefficients(spark)).filter("node = 'net'")
    return t.select("node", "name", (F.round("estimate", 6) + F.lit(0.0)).alias("estimate"))


@query("mse_from_modes", f"WITH {_BAYES_SUMS}, {_gauss_laplace('g', 'c')}, {_gauss_laplace('e', 'c', True)} SELECT 'net' AS node, round(1 / tau, 8) AS mse FROM g UNION ALL SELECT 'l_extendedprice', round(1 / tau, 8) FROM e")
def mse_from_modes(spark, sf):
    return fitting.mse_from_modes(_bayes_network(spark, sf).coefficients(spark)).select("node", F.round("mse", 8).alias("mse"))


# --- Caches and searches --------------------------------------------------


@query(
    "user_sets_scores",
    f"WITH {_cache_sql(2, False)}, s AS (SELECT * FROM (VALUES (0::BIGINT, 4, 6::BIGINT), (1, 4, 0), (2, 0, 8)) t(row_id, c, m)) SELECT row_id, child, mask, round(bic, 2) AS bic, round(mdl, 2) AS mdl FROM cache JOIN s ON child = c AND mask = m",
)
def user_sets_scores(spark, sf):
    sets = [("net", ["l_extendedprice", "l_discount"]), ("net", []), ("l_quantity", ["l_tax"])]
    return build_cache(lineitem_nodes(spark, sf).select(*_FIVE), _five(), sets=sets).select("row_id", "child", "mask", F.round("bic", 2).alias("bic"), F.round("mdl", 2).alias("mdl"))


@query(
    "rank_deficient_scores",
    f"""WITH {_SEEN}, c AS {_cells('bin', 'gauss')}, {_newton('p', 'c', 'binomial', 0.0, '3 / sum(m)')}, r AS (SELECT 0 AS child, ll AS mlik, 1 AS df, 0 AS np FROM p
UNION ALL SELECT 1, 0.5 * (-n * ({LN2PI} + 1 - ln(n) + ln((n - 1) * (1 - power(corr(l_extendedprice, l_quantity), 2))))), 3, 2 FROM lineitem, total GROUP BY n)
SELECT child, round(mlik, 3) AS mlik, round(-2 * mlik + 2 * df, 3) AS aic, round(-2 * mlik + ln(n) * df + (1 + np) * ln(4.0::DOUBLE), 3) AS mdl FROM r, total""",
)
def rank_deficient_scores(spark, sf):
    """A parent that is twice another one adds nothing to the likelihood; a logistic
    node counts the columns that are left when the first ones have gone, until the
    rest has full rank, a gaussian one the rank."""
    t = lineitem_nodes(spark, sf).withColumn("double_quantity", 2 * F.col("l_quantity"))
    schema = Schema.of({"l_linestatus": "binomial", "l_extendedprice": "gaussian", "l_quantity": "gaussian", "double_quantity": "gaussian"})
    both = ["l_quantity", "double_quantity"]
    return build_cache(t, schema, sets=[("l_linestatus", both), ("l_extendedprice", both)]).select("child", *[F.round(s, 3).alias(s) for s in ("mlik", "aic", "mdl")])


@query(
    "parent_sets_adjusted",
    """WITH m AS (SELECT unnest(range(0, 16))::BIGINT AS m), a AS (SELECT c AS child, m | 16 AS mask, bit_count(m)::INTEGER + 1 AS n_parents, [i FOR i IN range(0, 5) IF ((m | 16) >> i) & 1 = 1] AS parents
 FROM m, (SELECT unnest(range(0, 4))::INTEGER AS c) WHERE (m >> c) & 1 = 0 AND bit_count(m) <= 2)
SELECT CAST(row_number() OVER (ORDER BY child, n_parents, parents) - 1 AS BIGINT) AS row_id, child, mask, n_parents, array_to_string(parents, ',') AS parents FROM a""",
)
def parent_sets_adjusted(spark, sf):
    return _shown(parent_sets(spark, _gauss(5), 2, adjusted=["v4"]))


@query(
    "parent_sets_some_nodes",
    """WITH m AS (SELECT unnest(range(0, 16))::BIGINT AS m), a AS (SELECT c AS child, m AS mask, bit_count(m)::INTEGER AS n_parents, [i FOR i IN range(0, 5) IF (m >> i) & 1 = 1] AS parents
 FROM m, (SELECT unnest([0, 2, 3])::INTEGER AS c) WHERE (m >> c) & 1 = 0 AND m & 2 = 0 AND bit_count(m) <= CASE c WHEN 0 THEN 2 WHEN 2 THEN 1 ELSE 0 END)
SELECT CAST(row_number() OVER (ORDER BY child, n_parents, parents) - 1 AS BIGINT) AS row_id, child, mask, n_parents, array_to_string(parents, ',') AS parents FROM a""",
)
def parent_sets_some_nodes(spark, sf):
    return _shown(parent_sets(spark, _gauss(5), {"v0": 2, "v1": 4, "v2": 1, "v3": 0, "v4": 4}, which=["v0", "v2", "v3"]))


@query("parent_limits", "SELECT * FROM (VALUES ('none', 'v0', 3), ('none', 'v1', 3), ('none', 'v2', 3), ('none', 'v3', 3), ('two', 'v0', 2), ('two', 'v1', 2), ('two', 'v2', 2), ('two', 'v3', 2), ('each', 'v0', 0), ('each', 'v1', 1), ('each', 'v2', 2), ('each', 'v3', 3)) t(kind, node, most)")
def parent_limits_query(spark, sf):
    s = _gauss(4)
    rows = [(k, n, v) for k, lim in (("none", None), ("two", 2), ("each", [0, 1, 2, 9])) for n, v in parent_limits(s, lim).items()]
    return spark.createDataFrame(rows, "kind string, node string, most int")


@query("score_column_bad", "SELECT * FROM (VALUES (0, -1.5::DOUBLE, 1.5::DOUBLE), (1, -1.797e308, -1.797e308), (2, -1.797e308, -1.797e308), (3, -1.797e308, -1.797e308)) t(row_id, mlik, bic)")
def score_column_bad(spark, sf):
    rows = [(0, -1.5, -1.5), (1, None, None), (2, float("nan"), float("nan")), (3, float("-inf"), float("inf"))]
    t = spark.createDataFrame(rows, "row_id int, mlik double, bic double")
    return t.select("row_id", score_column("mlik").alias("mlik"), score_column("bic").alias("bic"))


@query("best_dag_prior2", _dp_sql(_trace_sql(), 2, 2))
def best_dag_prior2(spark, sf):
    return search.best_rows(gauss_cache(spark, sf, 2), len(_FIVE), "bic", 2).select("child", "mask", F.round("score", 2).alias("score"))


_BEST_ARCS = _dp_sql(_trace_sql(", best AS ("), 2)


@query("hillclimb_consensus", _BEST_ARCS + f") SELECT n[p + 1] AS parent, n[child + 1] AS child FROM best, (SELECT unnest(range(0, {len(_FIVE)}))::INTEGER AS p), (SELECT [{', '.join(repr(x) for x in _FIVE)}] AS n) WHERE (mask >> p) & 1 = 1")
def hillclimb_consensus(spark, sf):
    """The searches agree on the exact best network."""
    return search.consensus(search.hill_climb(gauss_cache(spark, sf, 2), _FIVE, "bic", searches=20), _FIVE)


def _heuristic(algo):
    def run(spark, sf):
        found = search.heuristic(gauss_cache(spark, sf, 2), _FIVE, algo, "bic", searches=20)
        return search.top(found, 1).select(F.round("score", 2).alias("score"))

    return run


for _a in ("hc", "tabu", "sa"):
    query(f"heuristic_{_a}", _dp_sql(f" SELECT round(best, 2) AS score FROM g{len(_FIVE)}", 2))(_heuristic(_a))


@query("hillclimb_retained", _dp_sql(f" SELECT round(best, 2) AS score, true AS kept FROM g{len(_FIVE)}", 2, keep=(0, 2)))
def hillclimb_retained(spark, sf):
    """A search over a cache whose sets all retain an arc: its best network has it."""
    retained = Dag.of(_FIVE, [("l_discount", "l_quantity")])
    banned = Dag.of(_FIVE, [("net", c) for c in _FIVE if c != "net"])
    cache = build_cache(lineitem_nodes(spark, sf).select(*_FIVE), _five(), "mle", 2, banned, retained)
    best = search.top(search.hill_climb(cache, _FIVE, "bic", searches=20), 1)
    return best.select(F.round("score", 2).alias("score"), (F.col("masks")[0].bitwiseAND(F.lit(4)) != 0).alias("kept"))


# --- Graphs ---------------------------------------------------------------


@query(
    "break_cycles",
    f"WITH {_N_SQL}, {arcs_sql('e')}, k AS (SELECT min(parent || '>' || child) AS kept FROM e) SELECT seed::INTEGER AS seed, false AS has_cycle, (SELECT count(*) FROM e, k WHERE parent || '>' || child = kept) = 1 AS keeps, (SELECT count(*) FROM e) > 0 AS subset FROM range(3) t(seed)",
)
def break_cycles(spark, sf):
    """The learned network with every arc there and back, freed of cycles; one arc is kept."""
    dag = learned_dag(spark, sf)
    loops = Dag.of(dag.nodes, [*dag.arcs, *((c, p) for p, c in dag.arcs)], acyclic=False)
    kept, out = min(dag.arcs, key=">".join), None
    for seed in range(3):
        d = loops.without_cycles([kept], seed)
        one = graph.cyclic(d.edges(spark), len(dag.nodes)).select(F.lit(seed).alias("seed"), "has_cycle", F.lit(kept in d.arcs).alias("keeps"), F.lit(d.arcs < loops.arcs).alias("subset"))
        out = one if out is None else out.unionByName(one)
    return out


def _essential_sql(of: str, name: str) -> str:
    s = f"{name}_s AS (SELECT child AS node FROM {of} GROUP BY child HAVING count(*) >= 2)"
    return f"{s}, {name} AS (SELECT parent, child FROM {of} UNION SELECT child, parent FROM {of} WHERE child NOT IN (SELECT node FROM {name}_s))"


@query(
    "compare_essential",
    f"""WITH {_TWO_SQL}, {_essential_sql('r', 'er')}, {_essential_sql('t', 'et')}, n AS (SELECT (SELECT count(*) FROM er JOIN et USING (parent, child))::DOUBLE AS tp, (SELECT count(*) FROM er)::DOUBLE AS cp, (SELECT count(*) FROM et)::DOUBLE AS pp,
 (SELECT count(DISTINCT least(parent, child) || '-' || greatest(parent, child)) FROM ((SELECT * FROM er EXCEPT SELECT * FROM et) UNION ALL (SELECT * FROM et EXCEPT SELECT * FROM er))) AS hamming)
SELECT round(tp / cp, 9) AS tpr, round((pp - tp) / ({len(_FIVE) ** 2} - cp), 9) AS fpr, round(tp / pp, 9) AS ppv, hamming FROM n""",
)
def compare_essential(spark, sf):
    c = graph.compare(graph.essential_graph(learned(spark, sf)), graph.essential_graph(learned(spark, sf, 2, 2)), len(_FIVE))
    return c.select(*[F.round(k, 9).alias(k) for k in ("tpr", "fpr", "ppv")], "hamming")


# --- Refusals -------------------------------------------------------------


def _refusals(spark, sf):
    """(case, what must fail)"""
    t = read(spark, sf, "lineitem").select("l_linestatus", "l_returnflag", "l_linenumber", "l_quantity")
    g = _gauss(3)
    nulls = t.withColumn("l_quantity", F.when(F.col("l_linenumber") > 1, F.col("l_quantity")))
    loop = Dag.of(g.nodes, [("v0", "v1"), ("v1", "v0")], acyclic=False)
    return {
        "nulls": lambda: validate(nulls, Schema.of({"l_quantity": "gaussian"})),
        "empty": lambda: validate(t.limit(0), Schema.of({"l_quantity": "gaussian"})),
        "binomial of three values": lambda: validate(t, Schema.of({"l_returnflag": "binomial"})),
        "multinomial of two values": lambda: validate(t, Schema.of({"l_linestatus": "multinomial"})),
        "gaussian text": lambda: validate(t, Schema.of({"l_returnflag": "gaussian"})),
        "missing column": lambda: validate(t, Schema.of({"nowhere": "gaussian"})),
        "unknown distribution": lambda: Schema.of({"a": "normal"}),
        "ambiguous distribution": lambda: Schema.of({"a": ""}),
        "group is a node": lambda: Schema.of({"a": "gaussian"}, group="a"),
        "matrix not square": lambda: Dag.from_matrix([[0, 1]], "ab"),
        "matrix of other numbers": lambda: Dag.from_matrix([[0, 2], [0, 0]], "ab"),
        "own parent": lambda: Dag.from_matrix([[1, 0], [0, 0]], "ab"),
        "cycle": lambda: Dag.of("ab", [("a", "b"), ("b", "a")]),
        "unknown node": lambda: Dag.of("ab", [("a", "c")]),
        "repeated node": lambda: Dag.of("aa"),
        "formula without tilde": lambda: Dag.parse("a|b", "ab"),
        "negative limit": lambda: parent_limits(g, -1),
        "limits of other length": lambda: parent_limits(g, [1]),
        "unknown node in a subset": lambda: g.only(["v9"]),
        "banned and retained": lambda: parent_sets(spark, g, 1, Dag.of(g.nodes, [("v0", "v1")]), Dag.of(g.nodes, [("v0", "v1")])),
        "retained cycle": lambda: parent_sets(spark, g, 1, None, loop),
        "retained beyond the limit": lambda: parent_sets(spark, g, 0, None, Dag.of(g.nodes, [("v0", "v1")])),
        "odds ratio of other values": lambda: info.odds_ratio(t, "l_linenumber", "l_linenumber"),
        "unknown option": lambda: control("mle", depth=3),
        "unknown method": lambda: control("guess"),
        "unknown score": lambda: score_column("dic"),
        "unknown rule": lambda: info.bin_counts(t, Schema.of({"l_quantity": "gaussian"}), "guess"),
        "density over 1": lambda: simulate.random_dag("ab", 1.5),
    }


_CASES = "nulls|empty|binomial of three values|multinomial of two values|gaussian text|missing column|unknown distribution|ambiguous distribution|group is a node|matrix not square|matrix of other numbers|own parent|cycle|unknown node|repeated node|formula without tilde|negative limit|limits of other length|unknown node in a subset|banned and retained|retained cycle|retained beyond the limit|odds ratio of other values|unknown option|unknown method|unknown score|unknown rule|density over 1"


@query("refusals", "SELECT unnest(string_split('" + _CASES + "', '|')) AS what, true AS refused")
def refusals(spark, sf):
    def refused(f):
        try:
            f()
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(k, refused(f)) for k, f in _refusals(spark, sf).items()], "what string, refused boolean")


# --- Simulation -----------------------------------------------------------


@query("simulate_dag", "SELECT * FROM (VALUES (0.0::DOUBLE, 0, false), (1.0, 15, false)) t(density, n_arcs, has_cycle)")
def simulate_dag(spark, sf):
    out = None
    for density in (0.0, 1.0):
        d = simulate.random_dag("abcdef", density, 7)
        one = graph.cyclic(d.edges(spark), 6).select(F.lit(density).alias("density"), F.lit(len(d.arcs)).alias("n_arcs"), "has_cycle")
        out = one if out is None else out.unionByName(one)
    return out


_DRAWN = ("rows", "mean of l_extendedprice", "slope of net", "spread of net", "l_linestatus by l_returnflag", "l_linenumber by l_returnflag", "l_returnflag")


@query("simulate_rows", "SELECT * FROM (VALUES " + ", ".join(f"('{x}', true)" for x in _DRAWN) + ") t(what, agrees)")
def simulate_rows(spark, sf):
    """200,000 drawn rows agree with the network within five standard errors."""
    net, n = line_network(spark, sf), 200_000
    t = simulate.simulate(spark, net, n)
    at = {(f.node, x[0]): x[3] for f in net.nodes.values() for x in f.terms}
    levels = net.schema.levels["l_returnflag"]
    high = net.schema.levels["l_linestatus"][-1]
    slope, sd = at["net", "l_extendedprice"], net.nodes["net"].sigma
    weights = [1.0, *[2.718281828459045 ** at["l_returnflag", f"l_returnflag|intercept.{x}"] for x in levels[1:]]]
    near = lambda got, want, se: F.abs(got - F.lit(float(want))) < 5 * se
    is_ = [(F.col("l_returnflag") == x) for x in levels]
    count = [F.count_if(c) for c in is_]
    up = [F.count_if(c & (F.col("l_linestatus") == high)) / m for c, m in zip(is_, count, strict=True)]
    mean = [F.avg(F.when(c, F.col("l_linenumber"))) for c in is_]
    p = [1 / (1 + 2.718281828459045 ** -at["l_linestatus", f"l_returnflag{x}"]) for x in levels]
    mu = [2.718281828459045 ** at["l_linenumber", f"l_returnflag{x}"] for x in levels]
    every = lambda xs: F.array_min(F.array(*xs))
    checks = [
        F.count(F.lit(1)) == n,
        near(F.avg("l_extendedprice"), 0.0, n**-0.5),
        near(F.regr_slope("net", "l_extendedprice"), slope, sd * n**-0.5),
        near(F.stddev_samp(F.col("net") - slope * F.col("l_extendedprice")), sd, sd * (2 * n) ** -0.5),
        every([near(u, q, F.sqrt(q * (1 - q) / m)) for u, q, m in zip(up, p, count, strict=True)]),
        every([near(u, q, F.sqrt(q / m)) for u, q, m in zip(mean, mu, count, strict=True)]),
        every([near(m / n, w / sum(weights), (w / sum(weights) / n) ** 0.5) for m, w in zip(count, weights, strict=True)]),
    ]
    row = t.agg(*[c.alias(f"c{i}") for i, c in enumerate(checks)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(w).alias("what"), F.col(f"c{i}").alias("agrees")) for i, w in enumerate(_DRAWN)])).alias("x")).select("x.*")


@query(
    "bootstrap_support",
    f"""WITH c AS (SELECT corr(l_extendedprice, net) AS pn, corr(l_discount, net) AS dn, corr(l_extendedprice, l_discount) AS pd FROM {_NET}),
b AS (SELECT (pn - dn * pd) / (1 - pd * pd) AS b1, (dn - pn * pd) / (1 - pd * pd) AS b2, 1 - (pn * pn + dn * dn - 2 * pn * dn * pd) / (1 - pd * pd) AS s2 FROM c),
v AS (SELECT b1 / sqrt(b1 * b1 + b2 * b2 + s2) AS rp, b2 / sqrt(b1 * b1 + b2 * b2 + s2) AS rd FROM b),
t AS (SELECT 'net' AS child, rp * rp + rd * rd AS r2 FROM v UNION ALL SELECT 'l_extendedprice', rp * rp / (1 - rd * rd) FROM v UNION ALL SELECT 'l_discount', rd * rd / (1 - rp * rp) FROM v)
SELECT parent, child FROM (SELECT child FROM t ORDER BY r2 DESC LIMIT 1) m, (VALUES ('l_extendedprice'), ('l_discount'), ('net')) p(parent) WHERE parent <> child""",
)
def bootstrap_support(spark, sf):
    """The arcs that most networks learned from rows drawn from a network have: those
    into the node that the other two explain best in the network drawn from, which
    the SQL tells from the fitted coefficients."""
    net = fitting.fit(lineitem_nodes(spark, sf).select(*_FIVE), _five(), Dag.of(_FIVE, [("l_extendedprice", "net"), ("l_discount", "net")]))
    return simulate.bootstrap_support(spark, net, 50, 2_000, 2).filter("share >= 0.5").select("parent", "child")


@query("bootstrap_support_mixed", "SELECT * FROM (VALUES ('binomial', 'gaussian', true), ('gaussian', 'poisson', true)) t(one, other, often)")
def bootstrap_support_mixed(spark, sf):
    """The same for a network of three distributions, whose arcs may turn round."""
    schema = Schema.of({"a": "gaussian", "b": "binomial", "c": "poisson"}, levels={"b": ("no", "yes")})
    term = lambda name, parent, value: (name, None, parent, value, 0.0)
    nodes = {
        "a": fitting.NodeFit("a", Dist.GAUSSIAN, [term("a|intercept", None, 0.0)], {}, 2, 1.0),
        "b": fitting.NodeFit("b", Dist.BINOMIAL, [term("b|intercept", None, 0.2), term("a", "a", 1.5)], {}, 2),
        "c": fitting.NodeFit("c", Dist.POISSON, [term("c|intercept", None, 0.5), term("a", "a", 0.7)], {}, 2),
    }
    net = fitting.Network(Dag.of(schema.nodes, [("a", "b"), ("a", "c")]), schema, "mle", 0, nodes)
    s = simulate.bootstrap_support(spark, net, 3, 1_000, 1)
    kind = lambda c: F.element_at(F.create_map(*[F.lit(x) for n, d in schema.dists.items() for x in (n, d.value)]), F.col(c))
    pairs = s.groupBy(F.least(kind("parent"), kind("child")).alias("one"), F.greatest(kind("parent"), kind("child")).alias("other")).agg(F.sum("share").alias("share"))
    return pairs.filter("share >= 0.5").select("one", "other", (F.col("share") >= 0.9).alias("often"))


__all__ = ["line_network"]
