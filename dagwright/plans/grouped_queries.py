"""Queries of models with random intercepts, and their SQL: each group's integral by
Laplace's method with its mode by Newton's, the parameters by closing in on a grid."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..operators.models import Priors
from ..schema import Schema
from ..sources.tables import read
from .cache import build_cache
from .queries import query

LN2PI = 1.8378770664093453
#: Rounds in which the grid closes in, each to 0.62 of the width before.
ROUNDS = 42


def _mean(dist: str, eta: str) -> tuple[str, str, str]:
    """(log partition, mean, variance) of one row at ``eta``."""
    if dist == "poisson":
        return f"exp({eta})", f"exp({eta})", f"exp({eta})"
    p = f"(1 / (1 + exp(-({eta}))))"
    return f"(greatest({eta}, 0) + ln(1 + exp(-abs({eta}))))", p, f"({p} * (1 - {p}))"


def _goal(dist: str, b0: str, b1: str, ls: str, prior: Priors | None, p: int) -> tuple[str, str]:
    """(mode of a group's intercept, the group's share of the goal at that mode ``u``)."""
    eta = f"({b0} + {b1} * c.x + u)"
    part, mean, curve = _mean(dist, eta)
    slope = f"(list_sum(list_transform(cells, lambda c: c.y - c.m * {mean})) - u * exp(-2 * {ls}))"
    bend = f"(list_sum(list_transform(cells, lambda c: c.m * {curve})) + exp(-2 * {ls}))"
    mode = f"list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(40), lambda i: 0.0::DOUBLE)), lambda u, i: u + greatest(-1.0, least(1.0, {slope} / {bend})))"
    value = f"(list_sum(list_transform(cells, lambda c: c.y * {eta} - c.m * {part})) - 0.5 * u * u * exp(-2 * {ls}) - lf - 0.5 * ln({bend}) - {ls})"
    return mode, value


def _prior(b0: str, b1: str, ls: str, prior: Priors | None, p: int) -> str:
    if prior is None:
        return "0.0::DOUBLE"
    q = prior.precision
    return (
        f"(0.5 * {p} * (ln({q}::DOUBLE) - {LN2PI}) - 0.5 * {q} * ({b0} * {b0} + {b1} * {b1}) + {prior.shape} * ln({prior.inv_scale}::DOUBLE) - ln(gamma({prior.shape}::DOUBLE))"
        f" - 2 * ({prior.shape} - 1) * {ls} - {prior.inv_scale} * exp(-2 * {ls}))"
    )


def _fit(name: str, source: str, y: str, dist: str, x: str | None, prior: Priors | None) -> list[str]:
    """CTEs that end in ``{name}(b0, b1, ls, goal, n)``."""
    p = 2 if x else 1
    lf = f"lgamma({y} + 1.0::DOUBLE)" if dist == "poisson" else "0.0::DOUBLE"
    out = [
        f"{name}_c AS MATERIALIZED (SELECT g, ({x or '0'})::DOUBLE AS x, count(*)::DOUBLE AS m, sum({y})::DOUBLE AS y, sum({lf}) AS lf FROM {source} GROUP BY ALL)",
        f"{name}_g AS MATERIALIZED (SELECT g, list(struct_pack(x := x, m := m, y := y)) AS cells, sum(lf) AS lf FROM {name}_c GROUP BY g)",
        f"{name}_0 AS MATERIALIZED (SELECT {'ln(sum(y) / sum(m))' if dist == 'poisson' else 'ln(sum(y) / (sum(m) - sum(y)))'} AS b0, 0.0::DOUBLE AS b1, -1.0::DOUBLE AS ls FROM {name}_c)",
    ]
    mode, value = _goal(dist, "b0", "b1", "ls", prior, p)
    width = 2.0
    for k in range(1, ROUNDS + 1):
        moves = list(itertools.product((-1, -0.5, 0, 0.5, 1), (-1, -0.5, 0, 0.5, 1) if x else (0,), (-1, -0.5, 0, 0.5, 1)))
        places = ", ".join(f"({i}, {a * width}::DOUBLE, {b * width}::DOUBLE, {c * width}::DOUBLE)" for i, (a, b, c) in enumerate(moves))
        out.append(
            f"{name}_{k} AS MATERIALIZED (SELECT b0, b1, ls FROM (SELECT b0, b1, ls, sum({value}) + {_prior('b0', 'b1', 'ls', prior, p)} AS goal, i FROM"
            f" (SELECT *, {mode} AS u FROM (SELECT i, b0 + d0 AS b0, b1 + d1 AS b1, ls + d2 AS ls FROM {name}_{k - 1}, (VALUES {places}) t(i, d0, d1, d2)) q, {name}_g) r GROUP BY i, b0, b1, ls) s ORDER BY goal DESC, i LIMIT 1)"
        )
        width *= 0.62
    # The goal there, and its second differences.
    steps = [(0, 0, 0)]
    axes = [a for a in ((1, 0, 0), (0, 1, 0), (0, 0, 1)) if x or a != (0, 1, 0)]
    for i, a in enumerate(axes):
        for b in axes[i:]:
            steps += [tuple(s * u + t * v for u, v in zip(a, b, strict=True)) for s, t in itertools.product((1, -1), (1, -1))]
    h = 0.002
    places = ", ".join(f"({i}, {a * h}::DOUBLE, {b * h}::DOUBLE, {c * h}::DOUBLE)" for i, (a, b, c) in enumerate(steps))
    out.append(
        f"{name}_at AS MATERIALIZED (SELECT i, any_value(b0) AS b0, any_value(b1) AS b1, any_value(ls) AS ls, sum({value}) + {_prior('any_value(b0)', 'any_value(b1)', 'any_value(ls)', prior, p)} AS goal FROM"
        f" (SELECT *, {mode} AS u FROM (SELECT i, b0 + d0 AS b0, b1 + d1 AS b1, ls + d2 AS ls FROM {name}_{ROUNDS}, (VALUES {places}) t(i, d0, d1, d2)) q, {name}_g) r GROUP BY i)"
    )
    curves, k = [], 1
    for i in range(len(axes)):
        for j in range(i, len(axes)):
            v = [f"sum(goal) FILTER (i = {k + s})" for s in range(4)]
            # A precision's curvature is that of the logarithm, stretched.
            stretch = " * ".join(["1.0::DOUBLE", *("exp(2 * ls0) / 2" for t in (i, j) if t == len(axes) - 1)])
            curves.append(f"-({v[0]} - {v[1]} - {v[2]} + {v[3]}) / {4 * h * h} * {stretch} AS h{i}{j}")
            k += 4
    out.append(f"{name}_h AS (SELECT {', '.join(curves)} FROM {name}_at, (SELECT ls AS ls0 FROM {name}_{ROUNDS}) z GROUP BY ls0)")
    det = "h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02)" if x else "h00 * h11 - h01 * h01"
    out.append(f"{name} AS (SELECT b0, b1, ls, goal, ln({det}) AS logdet, (SELECT sum(m) FROM {name}_c) AS n FROM {name}_at, {name}_h WHERE i = 0)")
    return out


def _scores_sql(source: str, models: list[tuple[int, str, str, str, str | None, int, str]], n_vars: int) -> str:
    """``models``: (row id, child name, y, distribution, x, mask, name)."""
    ctes, rows = [source], []
    for row, child_name, y, dist, x, mask, name in models:
        ctes += _fit(name, "src", y, dist, x, None)
        df = 3 if x else 2
        child = {n: i for i, n in enumerate(dict.fromkeys(m[1] for m in models))}[child_name]
        rows.append(
            f"SELECT {row}::BIGINT AS row_id, {child} AS child, '{child_name}' AS child_name, {mask}::BIGINT AS mask, {1 if x else 0} AS n_parents, round(goal, 2) AS mlik, round(-2 * goal + 2 * {df}, 2) AS aic,"
            f" round(-2 * goal + ln(n) * {df}, 2) AS bic, round(-2 * goal + ln(n) * {df} + {df - 1} * ln({n_vars}::DOUBLE), 2) AS mdl, 0 AS error_code FROM {name}"
        )
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(rows)}"


_LABELS = "src AS MATERIALIZED (SELECT source AS g, quality, toxic FROM labels JOIN documents USING (doc_id))"
_BINARY = [(0, "quality", "quality", "binomial", None, 0, "q0"), (1, "quality", "quality", "binomial", "toxic", 2, "q1"), (2, "toxic", "toxic", "binomial", None, 0, "t0"), (3, "toxic", "toxic", "binomial", "quality", 1, "t1")]


def labelled(spark, sf):
    return read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "source"), "doc_id").select("quality", "toxic", "source")


def _rounded(cache):
    return cache.drop("parents").select(*[F.round(c, 2).alias(c) if c in ("mlik", "aic", "bic", "mdl") else F.col(c) for c in cache.columns if c != "parents"])


@query("glmm_scores", _scores_sql(_LABELS, _BINARY, 2))
def glmm_scores(spark, sf):
    """Binary labels with a random intercept for each source."""
    return _rounded(build_cache(labelled(spark, sf), Schema.of({"quality": "binomial", "toxic": "binomial"}, group="source"), "mle", 1))


_LINES = "src AS MATERIALIZED (SELECT source AS g, len(string_split(text, chr(10)))::BIGINT AS lines, (lang = 'en')::INTEGER AS english FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL)"


def counted(spark, sf):
    docs = read(spark, sf, "documents").filter("text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
    return docs.select(F.size(F.split("text", "\n")).cast("long").alias("lines"), (F.col("lang") == "en").cast("int").alias("english"), "source")


@query("glmm_counts", _scores_sql(_LINES, [(0, "lines", "lines", "poisson", None, 0, "l0"), (1, "lines", "lines", "poisson", "english", 2, "l1")], 2))
def glmm_counts(spark, sf):
    """Lines of documents, counts with a random intercept for each source."""
    schema = Schema.of({"lines": "poisson", "english": "binomial"}, group="source")
    return _rounded(build_cache(counted(spark, sf), schema, "mle", sets=[("lines", []), ("lines", ["english"])]))


def _bayes_sql() -> str:
    ctes, rows = [_LABELS, _LINES.replace("src AS", "lines_src AS")], []
    for name, source, y, dist, x in (("q0", "src", "quality", "binomial", None), ("q1", "src", "quality", "binomial", "toxic"), ("l0", "lines_src", "lines", "poisson", None), ("l1", "lines_src", "lines", "poisson", "english")):
        ctes += _fit(name, source, y, dist, x, Priors())
        rows.append(f"SELECT '{y}' AS child_name, {1 if x else 0} AS n_parents, round(goal - 0.5 * logdet + 0.5 * {3 if x else 2} * {LN2PI}, 1) AS mlik FROM {name}")
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(rows)}"


@query("glmm_laplace", _bayes_sql())
def glmm_laplace(spark, sf):
    """Log marginal likelihoods of binary and count nodes with random intercepts."""
    labels = build_cache(labelled(spark, sf), Schema.of({"quality": "binomial", "toxic": "binomial"}, group="source"), "bayes", sets=[("quality", []), ("quality", ["toxic"])], priors=Priors())
    lines = build_cache(counted(spark, sf), Schema.of({"lines": "poisson", "english": "binomial"}, group="source"), "bayes", sets=[("lines", []), ("lines", ["english"])], priors=Priors())
    return labels.unionByName(lines).select("child_name", "n_parents", F.round("mlik", 1).alias("mlik"))
