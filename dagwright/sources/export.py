"""Sinks: DOT, BUGS and JSON text, and what a plot needs."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterable, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Dag
from ..operators.fit import Network
from ..schema import Dist

#: Shape of a node by its distribution.
SHAPES = {"binomial": "box", "gaussian": "circle", "poisson": "oval", "multinomial": "diamond"}


def _shape(dist):
    out = F.lit(None).cast("string")
    for d, s in SHAPES.items():
        out = F.when(dist == d, s).otherwise(out)
    return out


def dot_lines(nodes: DataFrame, edges: DataFrame, directed: bool = True) -> DataFrame:
    """``(section, pos, pos2, line)``: the lines of a DOT file that name nodes
    (section 1) and arcs (section 2); ``nodes`` is (pos, node, dist)."""
    n = nodes.select(F.lit(1).alias("section"), "pos", F.lit(-1).alias("pos2"), F.concat(F.lit('"'), "node", F.lit('"[shape='), _shape(F.col("dist")), F.lit("];")).alias("line"))
    p = nodes.select(F.col("pos").alias("pp"), F.col("node").alias("parent"))
    c = nodes.select(F.col("pos").alias("cp"), F.col("node").alias("child"))
    arc = F.lit("->" if directed else "--")
    e = edges.join(p, "parent").join(c, "child").select(F.lit(2).alias("section"), F.col("pp").alias("pos"), F.col("cp").alias("pos2"), F.concat(F.lit('"'), "parent", F.lit('"'), arc, F.lit('"'), "child", F.lit('";')).alias("line"))
    return n.unionByName(e)


def to_dot(spark: SparkSession, dag: Dag, dists: Mapping[str, str], directed: bool = True) -> str:
    """A whole DOT file."""
    nodes = spark.createDataFrame([(i, n, Dist.of(dists[n]).value) for i, n in enumerate(dag.nodes)], "pos int, node string, dist string")
    rows = dot_lines(nodes, dag.edges(spark), directed).orderBy("section", "pos", "pos2").collect()
    head = "digraph" if directed else "graph"
    part = lambda k: "".join(r["line"] + "\n" for r in rows if r["section"] == k)
    return f"{head} dag {{ \n\n{part(1)}\n\n\n{part(2)}\n}}\n"


def plot_attributes(nodes: DataFrame, edges: DataFrame, strengths: DataFrame | None = None, width: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """``(pos, node, dist, shape)`` and ``(parent, child, label, lwd)``; line widths
    grow from 1 with the arc's strength."""
    n = nodes.withColumn("shape", _shape(F.col("dist")))
    if strengths is None:
        return n, edges.select("parent", "child", F.lit(" ").alias("label"), F.lit(1.0).alias("lwd"))
    e = edges.join(strengths, ["parent", "child"], "left")
    s = strengths.filter("strength > 0").agg(F.min("strength").alias("lo"), F.max("strength").alias("hi"))
    norm = F.when(F.col("hi") > F.col("lo"), F.greatest(F.lit(0.0), (F.col("strength") - F.col("lo")) / (F.col("hi") - F.col("lo")))).otherwise(F.lit(1.0))
    e = e.join(F.broadcast(s), F.lit(True)).select("parent", "child", F.format_number("strength", 2).alias("label"), (F.rint(width * norm) + 1).alias("lwd"))
    return n, e


# --- BUGS -----------------------------------------------------------------


def number(x: float) -> str:
    """Up to 15 significant digits, no trailing zeros."""
    return f"{x:.15g}"


def linear(intercept: float | None, terms: Iterable[tuple[float, str]]) -> str:
    """``a + b*x + ...``"""
    parts = ([] if intercept is None else [number(intercept)]) + [f"{number(b)}*{x}" for b, x in terms]
    return " + ".join(parts) if parts else "0"


def bugs_node(name: str, dist: str, intercepts: Sequence[float], slopes: Sequence[Sequence[tuple[float, str]]], sd: float = 1.0) -> list[str]:
    """Lines of one node. ``intercepts`` and ``slopes`` have an entry, or one for
    each category but the first."""
    dist = Dist.of(dist)
    rhs = linear(intercepts[0] if intercepts else None, slopes[0] if slopes else [])
    if dist is Dist.GAUSSIAN:
        return [f"{name} ~ dnorm(mu.{name}, precision.{name}) # Gaussian response", f"mu.{name} <- {rhs} # Linear regression", f"precision.{name} <- inverse({number(sd)}) # precision tau = 1/standard_dev"]
    if dist is Dist.BINOMIAL:
        return [f"{name} ~ dbern(p.{name}) # Bernoulli response", f"logit(p.{name}) <- {rhs} # logistic regression"]
    if dist is Dist.POISSON:
        return [f"{name} ~ dpois(lambda.{name}) # Poisson response", f"log(lambda.{name}) <- {rhs} # logistic regression"]
    out = [f"{name} ~ dcat(p.{name}) # Categorical response", f"p.{name}[1] <- phi.{name}[1]/sum(phi.{name}) # soft-max", f"log(phi.{name}[1]) <- 0 # Reference category"]
    for i, a in enumerate(intercepts):
        out += [f"p.{name}[{i + 2}] <- phi.{name}[{i + 2}]/sum(phi.{name}) # soft-max", f"log(phi.{name}[{i + 2}]) <- {linear(a, slopes[i] if slopes else [])}"]
    return out


def bugs_group_node(name: str, dist: str, intercepts: Sequence[float], slopes: Sequence[Sequence[tuple[float, str]]], sigma: float | None, sigma_alpha: Sequence[Sequence[float]] | float, compat: bool = True) -> list[str]:
    """Lines of a node with a random intercept; ``compat`` inverts standard
    deviations where precisions belong, as established, else their squares."""
    dist = Dist.of(dist)
    power = "" if compat else "^2"
    if dist is Dist.MULTINOMIAL:
        # alpha_Y[1] also stands in the reference category, as established.
        out = [f"{name} ~ dcat(p_{name})", f"p_{name}[1] <- phi_{name}[1]/sum(phi_{name})", f"log(phi_{name}[1]) <- 0 + alpha_{name}[1]"]
        for i, a in enumerate(intercepts):
            out += [f"p_{name}[{i + 2}] <- phi_{name}[{i + 2}]/sum(phi_{name})", f"log(phi_{name}[{i + 2}]) <- {linear(a, slopes[i] if slopes else [])} + alpha_{name}[{i + 1}]"]
        out.append(f"alpha_{name} ~ dmnorm.vcov(mu_alpha_{name}, sigma_alpha_{name})")
        for i, row in enumerate(sigma_alpha):
            out.append(f"mu_alpha_{name}[{i + 1}] <- 0")
            out += [f"sigma_alpha_{name}[{i + 1}, {j + 1}] <- {number(v)}" for j, v in enumerate(row)]
        return out
    slope = "".join(f" + {number(b)}*{x}" for b, x in (slopes[0] if slopes else []))
    rhs = f"mu_{name}{slope} + alpha_{name}"
    tail = [
        f"mu_{name} <- {number(intercepts[0])}",
        f"alpha_{name} ~ dnorm(mu_alpha_{name}, tau_alpha_{name})",
        f"mu_alpha_{name} <- 0",
        f"tau_alpha_{name} <- inverse(sigma_alpha_{name}{power})",
        f"sigma_alpha_{name} <- {number(float(sigma_alpha))}",
    ]
    if dist is Dist.GAUSSIAN:
        return [f"{name} ~ dnorm(mean_{name}, tau_{name})", f"mean_{name} <- {rhs}", f"tau_{name} <- inverse(sigma_{name}{power})", f"sigma_{name} <- {number(sigma)}", *tail]
    if dist is Dist.BINOMIAL:
        return [f"{name} ~ dbern(p_{name})", f"logit(p_{name}) <- {rhs}", *tail]
    return [f"{name} ~ dpois(lambda_{name})", f"log(lambda_{name}) <- {rhs}", *tail]


def softmaxed(values: Sequence[float]) -> list[float]:
    """How the established text writes the slopes of a multinomial parent."""
    e = np.exp(np.asarray(values, float) - max(values))
    return [float(v) for v in e / e.sum()]


def to_bugs(network: Network) -> str:
    """The whole model as text."""
    schema, out = network.schema, ["model{"]
    for c, f in network.nodes.items():
        states = [str(x) for x in schema.levels[c]][1:] if f.dist is Dist.MULTINOMIAL else [None]
        intercepts, slopes = [], []
        for s in states:
            part = [t for t in f.terms if t[1] == s]
            base = [t[3] for t in part if t[2] is None and not t[0].endswith("|precision")]
            intercepts.append(base[0] if base else 0.0)
            row, done = [], set()
            for t in part:
                if t[2] is None or t[2] in done:
                    continue
                done.add(t[2])
                mine = [u[3] for u in part if u[2] == t[2]]
                row += [(v, t[2]) for v in (softmaxed(mine) if schema.dists[t[2]] is Dist.MULTINOMIAL else mine)]
            slopes.append(row)
        if f.sigma_alpha:
            alpha = (f.covariance or [[v * v if i == j else 0.0 for j in range(len(f.sigma_alpha))] for i, v in enumerate(f.sigma_alpha)]) if f.dist is Dist.MULTINOMIAL else f.sigma_alpha[0]
            out += bugs_group_node(c, f.dist, intercepts, slopes, f.sigma, alpha)
        else:
            out += bugs_node(c, f.dist, intercepts, slopes, f.sigma or 0.0)
    return "\n".join([*out, "}"]) + "\n"


# --- JSON -----------------------------------------------------------------

_COEF = "array<struct<value:double,stderr:double,condition_type:string,conditions:array<struct<parent_variable_id:string,parent_state_id:string>>>>"
_PARAM = f"array<struct<parameter_id:string,name:string,link_function_name:string,source:struct<variable_id:string,state_id:string>,coefficients:{_COEF}>>"
_VARIABLE = "array<struct<variable_id:string,attribute_name:string,model_type:string,states:array<struct<state_id:string,value_name:string,is_baseline:boolean>>>>"
_ARC = "array<struct<source_variable_id:string,target_variable_id:string>>"


def variables(df: DataFrame, dists: Mapping[str, str]) -> DataFrame:
    """``(variable_id, model_type, link, states)``; the states of multinomial
    variables in order, the first the baseline, from the data."""
    out = None
    for c, d in dists.items():
        d = Dist.of(d)
        if d is Dist.MULTINOMIAL:
            row = df.agg(F.array_join(F.sort_array(F.collect_set(F.col(c).cast("string"))), ",").alias("states"))
        else:
            row = df.sparkSession.range(1).select(F.lit(None).cast("string").alias("states"))
        one = row.select(F.lit(c).alias("variable_id"), F.lit(d.value).alias("model_type"), F.lit(d.link).alias("link"), "states")
        out = one if out is None else out.unionByName(one)
    return out


def to_json_frame(spark: SparkSession, network: Network, scenario_id: str | None = None, label: str | None = None) -> DataFrame:
    """One row ``(json)``. Bayesian fits export empty arrays, as established."""
    schema = network.schema
    v, p, a = [], [], []
    if network.method != "mle":
        warnings.warn("a Bayesian fit is exported without variables, parameters and arcs", stacklevel=2)
    else:
        for c, f in network.nodes.items():
            states = [(str(i + 1), str(x), i == 0) for i, x in enumerate(schema.levels[c])] if f.dist is Dist.MULTINOMIAL else None
            v.append((c, c, f.dist.value, states))

            def add(name, state, value, se, kind, conditions=(), link=None, c=c, f=f):
                se = None if network.schema.group or se is None or not math.isfinite(se) else float(se)
                p.append((str(len(p) + 1), name, link or f.dist.link, (c, state), [(float(value), se, kind, list(conditions))]))

            for name, state, parent, value, se in f.terms:
                key = None if state is None else str([str(x) for x in schema.levels[c]].index(state) + 1)
                if parent is None:
                    add("intercept" if state is None else f"prob_{key}", key, value, se, "intercept")
                else:
                    level = next((str(i + 1) for i, x in enumerate(schema.levels.get(parent, ())) if name.removesuffix(f".{state}") == f"{parent}{x}"), None) if schema.dists[parent] is Dist.MULTINOMIAL else None
                    add(name, key, value, se, "linear_term", [(parent, level)])
            if f.dist is Dist.GAUSSIAN and f.sigma is not None and f.sigma_alpha:
                add("sigma", None, f.sigma, None, "variance")
            for x in () if f.covariance else f.sigma_alpha or ():
                add("sigma_alpha", None, x, None, "random_variance")
            # A covariance matrix, by its upper triangle, under the categories' names.
            names = [str(x) for x in schema.levels[c]][1:] if f.covariance else []
            for i, one in enumerate(names):
                for j in range(i, len(names)):
                    both = one if i == j else f"{one}_{names[j]}"
                    add(f"sigma_alpha_{both}", both, f.covariance[i][j], None, "random_variance" if i == j else "random_covariance", link="identity")
        a = [(x, y) for x in network.dag.nodes for y in network.dag.nodes if (x, y) in network.dag.arcs]
    row = spark.createDataFrame([(scenario_id, label, v, p, a)], f"scenario_id string, label string, variables {_VARIABLE}, parameters {_PARAM}, arcs {_ARC}")
    return row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_json(spark: SparkSession, network: Network, path: str, **how) -> None:
    """The export as a text file of a folder that Spark can write."""
    to_json_frame(spark, network, **how).coalesce(1).write.mode("overwrite").text(path)
