"""Registered queries: one for each operator, over whole tables, and their DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import graph
from ..functions import expit, link_name, logit, odds, split_names
from ..graph import Dag
from ..operators import fit as fitting
from ..operators import infotheo as info
from ..operators import search
from ..operators.parent_sets import parent_sets
from ..schema import Schema, one_hot, profile, split_group, standardised, with_levels
from ..sources import export
from ..sources.tables import lineitem_nodes, read
from .cache import build_cache, score_column, summary

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- Profiles, scalars, transforms ----------------------------------------

_PROFILED = ("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_linenumber")


@query("profile_columns", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(DISTINCT {c}) AS \"distinct\" FROM lineitem" for c in _PROFILED))
def profile_columns(spark: SparkSession, sf: str) -> DataFrame:
    return profile(read(spark, sf, "lineitem"), _PROFILED)


@query("zscore", "SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_samp(c_acctbal) FROM customer), 6) AS z FROM customer")
def zscore(spark, sf):
    t = standardised(read(spark, sf, "customer").select("c_custkey", "c_acctbal"), Schema.of({"c_acctbal": "gaussian"}))
    return t.select("c_custkey", F.round("c_acctbal", 6).alias("z"))


@query("onehot_status", "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS \"o_orderstatusF\", CAST(o_orderstatus = 'O' AS INTEGER) AS \"o_orderstatusO\", CAST(o_orderstatus = 'P' AS INTEGER) AS \"o_orderstatusP\" FROM orders")
def onehot_status(spark, sf):
    t = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    levels = with_levels(t, Schema.of({"o_orderstatus": "multinomial"})).levels["o_orderstatus"]
    return one_hot(t, "o_orderstatus", levels).drop("o_orderstatus")


@query("binary_linestatus", "SELECT l_returnflag, CAST(sum(CASE WHEN l_linestatus = (SELECT max(l_linestatus) FROM lineitem) THEN 1 ELSE 0 END) AS BIGINT) AS ones, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def binary_linestatus(spark, sf):
    t = read(spark, sf, "lineitem").select("l_returnflag", "l_linestatus")
    top = with_levels(t, Schema.of({"l_linestatus": "binomial"})).levels["l_linestatus"][-1]
    return t.groupBy("l_returnflag").agg(F.sum((F.col("l_linestatus") == F.lit(top)).cast("long")).alias("ones"), F.count(F.lit(1)).alias("n"))


@query("logit_expit_roundtrip", "SELECT p_partkey, round(ln((p_size / 51.0::DOUBLE) / (1 - p_size / 51.0::DOUBLE)), 9) AS logit, round(p_size / 51.0::DOUBLE, 9) AS back FROM part")
def logit_expit_roundtrip(spark, sf):
    p = F.col("p_size") / F.lit(51.0)
    return read(spark, sf, "part").select("p_partkey", F.round(logit(p), 9).alias("logit"), F.round(expit(logit(p)), 9).alias("back"))


@query("odds", "SELECT p_partkey, CASE WHEN p_size = 50 THEN 'Infinity'::DOUBLE ELSE round((p_size / 50.0::DOUBLE) / (1 - p_size / 50.0::DOUBLE), 9) END AS odds FROM part")
def odds_query(spark, sf):
    o = odds(F.col("p_size") / F.lit(50.0))
    return read(spark, sf, "part").select("p_partkey", F.when(o == float("inf"), o).otherwise(F.round(o, 9)).alias("odds"))


_TYPED = ("l_quantity", "l_linenumber", "l_returnflag", "l_linestatus")


@query(
    "link_names",
    "WITH k AS (SELECT column_name AS node, CASE WHEN data_type = 'DOUBLE' THEN 'gaussian' WHEN data_type IN ('INTEGER', 'BIGINT') THEN 'poisson' WHEN column_name = 'l_linestatus' AND (SELECT count(DISTINCT l_linestatus) FROM lineitem) = 2 THEN 'binomial' ELSE 'multinomial' END AS dist"
    " FROM (SELECT 'l_quantity' AS column_name, typeof(any_value(l_quantity)) AS data_type FROM lineitem UNION ALL SELECT 'l_linenumber', typeof(any_value(l_linenumber)) FROM lineitem UNION ALL SELECT 'l_returnflag', 'VARCHAR' UNION ALL SELECT 'l_linestatus', 'VARCHAR'))"
    " SELECT dist, CASE dist WHEN 'gaussian' THEN 'identity' WHEN 'poisson' THEN 'log' ELSE 'logit' END AS link, CASE dist WHEN 'binomial' THEN 1 WHEN 'gaussian' THEN 2 WHEN 'poisson' THEN 3 ELSE 4 END AS code FROM k",
)
def link_names(spark, sf):
    """Link and code of the distribution of each of some columns of lineitem."""
    from ..schema import Dist

    t = _dist_frame(spark, sf)
    code = F.create_map(*[F.lit(x) for d in Dist for x in (d.value, d.code)])
    return t.select("dist", link_name(F.col("dist")).alias("link"), F.element_at(code, F.col("dist")).alias("code"))


@query("split_names", "SELECT text, len(string_split(text, ' ')) + 2 AS n, array_to_string(string_split(text, ' '), ',') || ',' || p_brand || ',' || p_size AS parts FROM (SELECT p_name AS text, p_brand, p_size FROM part)")
def split_names_query(spark, sf):
    """Names of parts, brand and size behind other separators, taken apart."""
    t = read(spark, sf, "part")
    parts = split_names(F.concat(F.regexp_replace("p_name", " ", " + "), F.lit(" : "), "p_brand", F.lit(" | "), F.col("p_size").cast("string")), "|", ":", "+")
    return t.select(F.col("p_name").alias("text"), F.size(parts).alias("n"), F.array_join(parts, ",").alias("parts"))


@query("group_ids", "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_nationkey) AS INTEGER) AS group_id FROM customer")
def group_ids(spark, sf):
    return split_group(read(spark, sf, "customer").select("c_custkey", "c_nationkey"), Schema.of({"c_custkey": "poisson"}, group="c_nationkey"))


@query(
    "odds_ratio_quality_toxic",
    "SELECT round(count(*) FILTER (WHERE quality = 0 AND toxic = 0) * count(*) FILTER (WHERE quality = 1 AND toxic = 1)::DOUBLE"
    " / ((CASE WHEN count(*) FILTER (WHERE quality = 0 AND toxic = 1) = 0 THEN 0.5 ELSE count(*) FILTER (WHERE quality = 0 AND toxic = 1) END)"
    " * (CASE WHEN count(*) FILTER (WHERE quality = 1 AND toxic = 0) = 0 THEN 0.5 ELSE count(*) FILTER (WHERE quality = 1 AND toxic = 0) END)::DOUBLE), 9) AS odds_ratio FROM labels",
)
def odds_ratio_quality_toxic(spark, sf):
    return info.odds_ratio(read(spark, sf, "labels"), "quality", "toxic").select(F.round("odds_ratio", 9).alias("odds_ratio"))


@query(
    "skewness_by_flag",
    "WITH m AS (SELECT l_returnflag AS f, avg(l_extendedprice) AS mu FROM lineitem GROUP BY 1)"
    " SELECT l_returnflag, round(avg(power(l_extendedprice - mu, 3)) / power(avg(power(l_extendedprice - mu, 2)), 1.5), 6) AS skewness"
    " FROM lineitem JOIN m ON l_returnflag = f GROUP BY l_returnflag",
)
def skewness_by_flag(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.skewness("l_extendedprice"), 6).alias("skewness"))


# --- Discretisation and information theory --------------------------------

_CUTS = {
    "sturges": "log2(n) + 2",
    "doane": "1 + log2(n) + log2(1 + abs(g) / sqrt(6.0::DOUBLE * (n - 2) / ((n + 1.0::DOUBLE) * (n + 3))))",
    "sqrt": "sqrt(n) + 1",
    "rice": "2 * power(n, 1.0::DOUBLE / 3) + 1",
    "scott": "1 / (3.5::DOUBLE * sd / power(n, 1.0::DOUBLE / 3)) + 1",
    "fd": "1 / (2 * (q3 - q1) / power(n, 1.0::DOUBLE / 3)) + 1",
    "scott_range": "(hi - lo) / (3.5::DOUBLE * sd / power(n, 1.0::DOUBLE / 3)) + 1",
    "fd_range": "(hi - lo) / (2 * (q3 - q1) / power(n, 1.0::DOUBLE / 3)) + 1",
    "terrell-scott": "power(2.0::DOUBLE * n, 1.0::DOUBLE / 3)",
    "cencov": "power(n, 1.0::DOUBLE / 3)",
    10: "11",
}


def _stats_sql(name: str, table: str, column: str, method) -> str:
    """CTE ``name`` of one row: lo, hi and number of bins of a column."""
    return f"""{name}_m AS (SELECT avg({column}) AS mu FROM {table}),
{name}_s AS (SELECT count({column}) AS n, min({column}) AS lo, max({column}) AS hi, stddev_samp({column}) AS sd,
  quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3,
  avg(power({column} - mu, 3)) / power(avg(power({column} - mu, 2)), 1.5) AS g FROM {table}, {name}_m),
{name} AS (SELECT lo, hi, greatest(1, CAST(ceil(round({_CUTS[method]}, 9)) AS BIGINT) - 1) AS nb FROM {name}_s)"""


def _bin_sql(name: str, column: str) -> str:
    return f"CAST(greatest(1, least({name}.nb, ceil(({column} - {name}.lo) / (({name}.hi - {name}.lo) / {name}.nb)))) AS INTEGER)"


def _disc(method):
    def run(spark, sf):
        t = read(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("x"))
        return info.contingency(info.discretise(t, Schema.of({"x": "gaussian"}), method)).withColumnRenamed("x", "bin")

    return run


for _m in _CUTS:
    _key = f"disc_{'k10' if _m == 10 else _m.replace('-', '_')}"
    query(_key, f"WITH {_stats_sql('b', 'lineitem', 'l_extendedprice', _m)} SELECT {_bin_sql('b', 'l_extendedprice')} AS bin, count(*) AS n FROM lineitem, b GROUP BY 1")(_disc(_m))


@query("quantiles_exact", "SELECT round(quantile_cont(o_totalprice, 0.25), 6) AS q25, round(quantile_cont(o_totalprice, 0.5), 6) AS q50, round(quantile_cont(o_totalprice, 0.975), 6) AS q975 FROM orders")
def quantiles_exact(spark, sf):
    q = info.quantiles(read(spark, sf, "orders"), "o_totalprice", (0.25, 0.5, 0.975), small=2_000)
    return spark.createDataFrame([tuple(q)], "q25 double, q50 double, q975 double").select(*[F.round(c, 6).alias(c) for c in ("q25", "q50", "q975")])


_COUNTS = "WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, l_linenumber AS d, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2, 3), t AS (SELECT sum(n) AS total FROM c)"


def _counts(spark, sf, *columns):
    return info.contingency(read(spark, sf, "lineitem").select(*columns))


@query("entropy_joint", _COUNTS + " SELECT round(-sum(n / total * log2(n / total)), 9) AS entropy FROM c, t")
def entropy_joint(spark, sf):
    return info.entropy(_counts(spark, sf, "l_returnflag", "l_linestatus", "l_linenumber")).select(F.round("entropy", 9).alias("entropy"))


_MI2 = """WITH j AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
 t AS (SELECT sum(n) AS total FROM j), x AS (SELECT a, sum(n) AS na FROM j GROUP BY a), y AS (SELECT b, sum(n) AS nb FROM j GROUP BY b),
 mi AS (SELECT sum(n / total * ln(n * total / (na * nb))) AS mi FROM j JOIN x USING (a) JOIN y USING (b), t)"""


@query("mi_raw", _MI2 + " SELECT round(mi, 9) AS mi FROM mi")
def mi_raw(spark, sf):
    return info.mutual_information(_counts(spark, sf, "l_returnflag", "l_linestatus")).select(F.round("mi", 9).alias("mi"))


@query("mi_raw_pc", _MI2 + ", h AS (SELECT -sum(na / total * ln(na / total)) AS h, sum(na * log2(1 / na)) AS raw FROM x, t) SELECT round(100 * mi / h, 6) AS mi_pc, round(-100 * mi / raw, 9) AS mi_pc_compat FROM mi, h")
def mi_raw_pc(spark, sf):
    return info.mutual_information(_counts(spark, sf, "l_returnflag", "l_linestatus")).select(F.round("mi_pc", 6).alias("mi_pc"), F.round("mi_pc_compat", 9).alias("mi_pc_compat"))


@query(
    "mi_three_way",
    _COUNTS + ", x AS (SELECT a, sum(n) AS na FROM c GROUP BY a), y AS (SELECT b, sum(n) AS nb FROM c GROUP BY b), z AS (SELECT d, sum(n) AS nd FROM c GROUP BY d)"
    " SELECT round(sum(n / total * ln((n / total) / ((na / total) * (nb / total) * (nd / total)))), 9) AS mi FROM c JOIN x USING (a) JOIN y USING (b) JOIN z USING (d), t",
)
def mi_three_way(spark, sf):
    return info.mutual_information(_counts(spark, sf, "l_returnflag", "l_linestatus", "l_linenumber")).select(F.round("mi", 9).alias("mi"))


_ARCS = [("l_extendedprice", "net"), ("l_discount", "net"), ("l_quantity", "l_tax")]
_NET = "(SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem)"


def _link_sql(method: str) -> str:
    used = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net"]
    ctes = ["src AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_extendedprice * (1 - l_discount) AS net FROM lineitem)"]
    ctes += [_stats_sql(f"s_{c}", "src", c, "doane") for c in used]
    ctes.append("binned AS (SELECT " + ", ".join(f"{_bin_sql(f's_{c}', c)} AS {c}" for c in used) + " FROM src, " + ", ".join(f"s_{c}" for c in used) + ")")
    out = []
    for k, (p, c) in enumerate(_ARCS):
        others = [x for x, y in _ARCS if y == c and x != p]
        sets = {"x": [p], "y": [c], "xy": [p, c], "z": others, "xz": [p, *others], "yz": [c, *others], "xyz": [p, c, *others]}
        for s, cols in sets.items():
            if cols:
                ctes.append(f"h{k}_{s} AS (SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT count(*)::DOUBLE AS n FROM binned GROUP BY {', '.join(cols)}))")
            else:
                ctes.append(f"h{k}_{s} AS (SELECT 0.0::DOUBLE AS h)")
        h = lambda s, k=k: f"h{k}_{s}.h"
        mi, ls = f"({h('x')} + {h('y')} - {h('xy')})", f"({h('xz')} + {h('yz')} - {h('xyz')} - {h('z')})"
        value = {
            "mi.raw": f"{mi} * ln(2.0::DOUBLE)",
            "mi.raw.pc": f"100 * {mi} / {h('y')}",
            "ls": ls,
            "ls.pc": f"CASE WHEN abs({h('yz')} - {h('z')}) > 1e-12 THEN {ls} / ({h('yz')} - {h('z')}) ELSE {ls} END",
            "stat.dist": f"1 - {mi} / greatest({h('x')}, {h('y')})",
        }[method]
        out.append(f"SELECT '{p}' AS parent, '{c}' AS child, round({value}, 8) AS strength FROM {', '.join(f'h{k}_{s}' for s in sets)}")
    return "WITH " + ",\n".join(ctes) + "\n" + " UNION ALL ".join(out)


def _link(method):
    def run(spark, sf):
        t = lineitem_nodes(spark, sf)
        schema = Schema.of(dict.fromkeys(("l_quantity", "l_extendedprice", "l_discount", "l_tax", "net"), "gaussian"))
        return info.link_strength(t, schema, _ARCS, method).select("parent", "child", F.round("strength", 8).alias("strength"))

    return run


for _m in ("mi.raw", "mi.raw.pc", "ls", "ls.pc", "stat.dist"):
    query("link_" + {"mi.raw": "mi", "mi.raw.pc": "mi_pc"}.get(_m, _m.replace(".", "_")), _link_sql(_m))(_link(_m))
query("link_corr", " UNION ALL ".join(f"SELECT '{p}' AS parent, '{c}' AS child, round(-0.5 * ln(1 - corr({p}, {c}) * corr({p}, {c})), 8) AS strength FROM {_NET}" for p, c in _ARCS))(_link("mi.corr"))


# --- Parent sets ----------------------------------------------------------

_FIVE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "net")


def _sets_sql(n: int, limit: int, ban: dict[int, int] | None = None, keep: dict[int, int] | None = None) -> str:
    case = lambda d: "CASE child " + " ".join(f"WHEN {k} THEN {v}" for k, v in d.items()) + " ELSE 0 END" if d else "0"
    return f"""WITH RECURSIVE s(mask, top, k) AS (
  SELECT 0::BIGINT, -1, 0
  UNION ALL
  SELECT mask | (1::BIGINT << p), p, k + 1 FROM s, (SELECT unnest(range(0, {n}))::INTEGER AS p) WHERE p > top AND k < {limit}
), c AS (SELECT unnest(range(0, {n}))::INTEGER AS child)
, a AS (SELECT child, mask, k, [i FOR i IN range(0, {n}) IF (mask >> i) & 1 = 1] AS parents FROM s, c
  WHERE (mask >> child) & 1 = 0 AND mask & ({case(ban)}) = 0 AND mask & ({case(keep)}) = ({case(keep)}))
SELECT CAST(row_number() OVER (ORDER BY child, k, parents) - 1 AS BIGINT) AS row_id, child, mask, k AS n_parents, array_to_string(parents, ',') AS parents FROM a"""


def _shown(sets: DataFrame) -> DataFrame:
    return sets.select("row_id", "child", "mask", "n_parents", F.array_join(F.transform("parents", lambda x: x.cast("string")), ",").alias("parents"))


def _gauss(n: int) -> Schema:
    return Schema.of({f"v{i}": "gaussian" for i in range(n)})


@query("parent_sets_p2", _sets_sql(18, 2))
def parent_sets_p2(spark, sf):
    return _shown(parent_sets(spark, _gauss(18), 2))


@query("parent_sets_ban_retain", _sets_sql(7, 3, ban={0: 0b110, 3: 0b1000001}, keep={1: 0b1, 5: 0b11000}))
def parent_sets_ban_retain(spark, sf):
    nodes = _gauss(7).nodes
    banned = Dag.of(nodes, [("v1", "v0"), ("v2", "v0"), ("v0", "v3"), ("v6", "v3")], acyclic=False)
    retained = Dag.of(nodes, [("v0", "v1"), ("v3", "v5"), ("v4", "v5")])
    return _shown(parent_sets(spark, _gauss(7), 3, banned, retained))


@query("cache_sizes", "SELECT * FROM (VALUES (18, 2, 2772::BIGINT), (7, 3, 294::BIGINT), (10, 4, 2560::BIGINT)) t(n_nodes, max_parents, n_sets)")
def cache_sizes(spark, sf):
    out = None
    for n, k in ((18, 2), (7, 3), (10, 4)):
        one = parent_sets(spark, _gauss(n), k).agg(F.lit(n).alias("n_nodes"), F.lit(k).alias("max_parents"), F.count(F.lit(1)).alias("n_sets"))
        out = one if out is None else out.unionByName(one)
    return out


# --- Scores ---------------------------------------------------------------


def _cache_sql(limit: int, ban_net: bool = True) -> str:
    """CTE ``cache``: scores of the five gaussian nodes with up to ``limit`` parents,
    from correlations."""
    n = len(_FIVE)
    corr = ", ".join(f"corr({a}, {b}) AS r{i}_{j}" for i, a in enumerate(_FIVE) for j, b in enumerate(_FIVE) if i < j)
    r = lambda i, j: f"r{min(i, j)}_{max(i, j)}"
    parents = [j for j in range(n) if not (ban_net and j == n - 1)]
    rows = []
    for c in range(n):
        rows.append((c, 0, 0, "1.0::DOUBLE"))
        for p in parents:
            if p != c and limit >= 1:
                rows.append((c, 1 << p, 1, f"1 - {r(c, p)} * {r(c, p)}"))
        for p in parents:
            for q in parents:
                if limit >= 2 and p < q and c not in (p, q):
                    rows.append((c, (1 << p) | (1 << q), 2, f"1 - ({r(c, p)} * {r(c, p)} + {r(c, q)} * {r(c, q)} - 2 * {r(c, p)} * {r(c, q)} * {r(p, q)}) / (1 - {r(p, q)} * {r(p, q)})"))
    union = " UNION ALL ".join(f"SELECT {c} AS child, {m}::BIGINT AS mask, {k} AS n_parents, {u} AS rest, n FROM cors" for c, m, k, u in rows)
    return f"""cors AS (SELECT count(*)::DOUBLE AS n, {corr} FROM {_NET}),
unexplained AS ({union}),
ll AS (SELECT child, mask, n_parents, n, 0.5 * (-n * (ln(2 * pi()) + 1 - ln(n) + ln((n - 1) * rest))) AS mlik FROM unexplained),
cache AS (SELECT child, mask, n_parents, mlik, -2 * mlik + 2 * (n_parents + 2) AS aic, -2 * mlik + ln(n) * (n_parents + 2) AS bic,
  -2 * mlik + ln(n) * (n_parents + 2) + (1 + n_parents) * ln({n}.0::DOUBLE) AS mdl FROM ll)"""


def _five() -> Schema:
    return Schema.of(dict.fromkeys(_FIVE, "gaussian"))


def _ban_net() -> Dag:
    return Dag.of(_FIVE, [("net", c) for c in _FIVE if c != "net"])


def gauss_cache(spark, sf, limit=1, ban_net=True) -> DataFrame:
    return build_cache(lineitem_nodes(spark, sf).select(*_FIVE), _five(), "mle", limit, _ban_net() if ban_net else None)


def _scores_query(k):
    def run(spark, sf):
        c = gauss_cache(spark, sf, k, ban_net=False).filter(F.col("n_parents") == k)
        return c.select("child", "mask", *[F.round(s, 2).alias(s) for s in ("mlik", "aic", "bic", "mdl")])

    return run


for _k in range(3):
    query(f"gauss_scores_p{_k}", f"WITH {_cache_sql(_k, False)} SELECT child, mask, round(mlik, 2) AS mlik, round(aic, 2) AS aic, round(bic, 2) AS bic, round(mdl, 2) AS mdl FROM cache WHERE n_parents = {_k}")(_scores_query(_k))


def _saturated(df, dists, child, parents, levels=None):
    schema = Schema.of(dists, levels=levels)
    c = build_cache(df.select(*dists), schema, "mle", sets=[(child, parents)])
    return c.select("child_name", "n_parents", *[F.round(s, 4).alias(s) for s in ("mlik", "aic", "bic", "mdl")])


def _saturated_sql(child: str, cells: str, df: str, n_par: str, n_vars: int, k: int) -> str:
    """From ``cells`` of (ll): the four scores."""
    return f"""WITH {cells}, s AS (SELECT sum(ll) AS mlik FROM cell), n AS (SELECT count(*)::DOUBLE AS n FROM {df})
SELECT '{child}' AS child_name, {1 if n_par != '0' else 0} AS n_parents, round(mlik, 4) AS mlik, round(-2 * mlik + 2 * {k}, 4) AS aic,
  round(-2 * mlik + ln(n) * {k}, 4) AS bic, round(-2 * mlik + ln(n) * {k} + (1 + {n_par}) * ln({n_vars}.0::DOUBLE), 4) AS mdl FROM s, n"""


def _bin_cells(by: str, k: int) -> str:
    return f"""g AS (SELECT {by} AS g, count(*)::DOUBLE AS m, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::DOUBLE AS y FROM lineitem GROUP BY 1),
t AS (SELECT {k} / sum(m) AS c FROM g),
p AS (SELECT y, m, (y / m + c / 2) / (1 + c) AS q FROM g, t),
cell AS (SELECT y * ln(q) + (m - y) * ln(1 - q) AS ll FROM p)"""


_BIN = {"l_linestatus": "binomial", "l_returnflag": "multinomial"}


@query("bin_scores_null", _saturated_sql("l_linestatus", _bin_cells("0", 1), "lineitem", "0", 2, 1))
def bin_scores_null(spark, sf):
    return _saturated(read(spark, sf, "lineitem"), _BIN, "l_linestatus", [])


@query("bin_scores_by_flag", _saturated_sql("l_linestatus", _bin_cells("l_returnflag", 3), "lineitem", "3", 2, 3))
def bin_scores_by_flag(spark, sf):
    return _saturated(read(spark, sf, "lineitem"), _BIN, "l_linestatus", ["l_returnflag"])


def _pois_cells(by: str) -> str:
    return f"""g AS (SELECT {by} AS g, avg(l_linenumber)::DOUBLE AS mu FROM lineitem GROUP BY 1),
cell AS (SELECT l_linenumber * ln(mu) - mu - lgamma(l_linenumber + 1.0::DOUBLE) AS ll FROM lineitem JOIN g ON g.g = {by})"""


_POIS = {"l_linenumber": "poisson", "l_returnflag": "multinomial"}


@query("pois_scores_null", _saturated_sql("l_linenumber", _pois_cells("0"), "lineitem", "0", 2, 1))
def pois_scores_null(spark, sf):
    return _saturated(read(spark, sf, "lineitem"), _POIS, "l_linenumber", [])


@query("pois_scores_by_flag", _saturated_sql("l_linenumber", _pois_cells("l_returnflag"), "lineitem", "3", 2, 3))
def pois_scores_by_flag(spark, sf):
    return _saturated(read(spark, sf, "lineitem"), _POIS, "l_linenumber", ["l_returnflag"])


def _multi_cells(by: str) -> str:
    return f"""j AS (SELECT {by} AS g, o_orderstatus AS y, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2),
cell AS (SELECT n * ln(n / sum(n) OVER (PARTITION BY g)) AS ll FROM j)"""


_MULTI = {"o_orderstatus": "multinomial", "o_orderpriority": "multinomial"}


@query("multi_scores_null", _saturated_sql("o_orderstatus", _multi_cells("0"), "orders", "0", 2, 2))
def multi_scores_null(spark, sf):
    return _saturated(read(spark, sf, "orders"), _MULTI, "o_orderstatus", [])


@query("multi_scores_by_multi", _saturated_sql("o_orderstatus", _multi_cells("o_orderpriority"), "orders", "5", 2, 10))
def multi_scores_by_multi(spark, sf):
    return _saturated(read(spark, sf, "orders"), _MULTI, "o_orderstatus", ["o_orderpriority"])


_MIXED = {"l_linestatus": "binomial", "l_linenumber": "poisson", "l_returnflag": "multinomial", "l_quantity": "gaussian"}


# --- Search ---------------------------------------------------------------


def _dp_sql(tail: str, limit: int = 1, prior: int = 1, keep: tuple[int, int] | None = None) -> str:
    """The exact search over scores of up to ``limit`` parents; with prior 2, sets are
    uniform over their sizes; ``keep`` (child, parent) is in all sets of the child."""
    n, full = len(_FIVE), (1 << len(_FIVE)) - 1
    worth = "-bic" if prior == 1 else f"(-bic - ln(CASE n_parents {' '.join(f'WHEN {k} THEN {math.comb(n - 1, k)}' for k in range(limit + 1))} END))"
    kept = f" AND (child <> {keep[0]} OR mask & {1 << keep[1]} <> 0)" if keep else ""
    parts = [
        f"WITH {_cache_sql(limit)}",
        f"subsets AS (SELECT unnest(range(0, {full + 1}))::BIGINT AS s)",
        f"kids AS (SELECT unnest(range(0, {n}))::INTEGER AS i)",
        f"alpha AS (SELECT child, s AS subset, max({worth}) AS best, arg_max(mask, {worth}) AS mask, arg_max(bic, {worth}) AS bic FROM cache, subsets WHERE mask & s = mask AND (s >> child) & 1 = 0{kept} GROUP BY child, s)",
        "g0 AS (SELECT 0::BIGINT AS subset, 0.0::DOUBLE AS best, -1 AS last)",
    ]
    for k in range(1, n + 1):
        parts.append(f"g{k} AS (SELECT g.subset | (1::BIGINT << i) AS subset, max(a.best + g.best) AS best, arg_max(i, a.best + g.best) AS last FROM g{k - 1} g, kids JOIN alpha a ON a.child = i AND TRUE WHERE (g.subset >> i) & 1 = 0 AND a.subset = g.subset GROUP BY 1)")
    return ", ".join(parts) + tail


def _trace_sql(before: str = " ") -> str:
    """The parent sets of the best network; ``before`` stands before the last SELECT."""
    n, full = len(_FIVE), (1 << len(_FIVE)) - 1
    out = f", t{n} AS (SELECT last, subset ^ (1::BIGINT << last) AS rest FROM g{n} WHERE subset = {full})".replace("subset ^ ", "xor(subset, ").replace("<< last) AS", "<< last)) AS")
    for k in range(n - 1, 0, -1):
        out += f", t{k} AS (SELECT g.last, xor(g.subset, 1::BIGINT << g.last) AS rest FROM g{k} g JOIN t{k + 1} t ON g.subset = t.rest)"
    rows = " UNION ALL ".join(f"SELECT last AS child, rest FROM t{k}" for k in range(n, 0, -1))
    return out + f", picked AS ({rows}){before}SELECT p.child, a.mask, round(-a.bic, 2) AS score FROM picked p JOIN alpha a ON a.child = p.child AND a.subset = p.rest"


@query("best_dag_gauss", _dp_sql(_trace_sql()))
def best_dag_gauss(spark, sf):
    return search.best_rows(gauss_cache(spark, sf), len(_FIVE), "bic").select("child", "mask", F.round("score", 2).alias("score"))


@query("dp_levels", _dp_sql(" " + " UNION ALL ".join(f"SELECT subset, round(best, 2) AS best FROM g{k}" for k in range(len(_FIVE) + 1))))
def dp_levels(spark, sf):
    return search.chain_table(gauss_cache(spark, sf), len(_FIVE), "bic").select("subset", F.round("best", 2).alias("best"))


@query("alpha_max", _dp_sql(" SELECT child, subset, round(best, 2) AS best FROM alpha"))
def alpha_max(spark, sf):
    return search.alpha_table(gauss_cache(spark, sf), len(_FIVE), "bic").select("child", "subset", F.round("best", 2).alias("best"))


_SOME = Dag.of(_FIVE, [("l_extendedprice", "net"), ("l_quantity", "l_tax")])


@query("dag_score_lookup", f"WITH {_cache_sql(1)}, d AS (SELECT * FROM (VALUES (0, 0), (1, 0), (2, 0), (3, 1), (4, 2)) t(c, m)) SELECT child, round(bic, 2) AS score FROM cache JOIN d ON child = c AND mask = m")
def dag_score_lookup(spark, sf):
    at = F.array_position(F.array(*[F.lit(x) for x in _FIVE]), F.col("child_name")).cast("int") - 1
    return search.dag_score(gauss_cache(spark, sf), _SOME).select(at.alias("child"), F.round("score", 2).alias("score"))


@query(
    "best_by_parent_limit",
    f"WITH {_cache_sql(1)} SELECT 0 AS max_parents, round(sum(-bic), 2) AS score FROM cache WHERE n_parents = 0 UNION ALL SELECT 1, s FROM (" + _dp_sql(f" SELECT round(best, 2) AS s FROM g{len(_FIVE)}") + ")",
)
def best_by_parent_limit(spark, sf):
    rows = search.best_by_limit(gauss_cache(spark, sf), _FIVE, (0, 1))
    return spark.createDataFrame(rows, "max_parents int, score double").select("max_parents", F.round("score", 2).alias("score"))


@query("score_column_signs", f"WITH {_cache_sql(1)} SELECT child, mask, round(mlik, 2) AS mlik, round(-bic, 2) AS bic FROM cache")
def score_column_signs(spark, sf):
    return gauss_cache(spark, sf).select("child", "mask", F.round(score_column("mlik"), 2).alias("mlik"), F.round(score_column("bic"), 2).alias("bic"))


@query(
    "cache_summary",
    f"WITH {_cache_sql(1)} "
    + " UNION ALL ".join(
        f"SELECT '{s}' AS score, count({s}) AS n, round(min({s}), 2) AS least, round(quantile_cont({s}, 0.25), 2) AS q1, round(quantile_cont({s}, 0.5), 2) AS median, round(quantile_cont({s}, 0.75), 2) AS q3, round(max({s}), 2) AS greatest, round(avg({s}), 2) AS mean FROM cache"
        for s in ("mlik", "aic", "bic", "mdl")
    ),
)
def cache_summary(spark, sf):
    t = summary(gauss_cache(spark, sf))
    return t.select("score", "n", *[F.round(c, 2).alias(c) for c in ("least", "q1", "median", "q3", "greatest", "mean")])


# --- Fits -----------------------------------------------------------------


@query(
    "fit_gauss_1parent",
    f"""WITH r AS (SELECT count(*)::DOUBLE AS n, corr(l_extendedprice, net) AS r FROM {_NET})
SELECT 'net' AS node, 'l_extendedprice' AS term, round(r, 6) AS estimate, round(sqrt((1 - r * r) / (n - 2)), 8) AS stderr FROM r
UNION ALL SELECT 'net', 'net|intercept', 0.0, round(sqrt((n - 1) * (1 - r * r) / (n - 2) / n), 8) FROM r""",
)
def fit_gauss_1parent(spark, sf):
    schema = Schema.of({"l_extendedprice": "gaussian", "net": "gaussian"})
    net = fitting.fit(lineitem_nodes(spark, sf), schema, Dag.of(schema.nodes, [("l_extendedprice", "net")]))
    c = net.coefficients(spark).filter("node = 'net'")
    return c.select("node", "term", (F.round("estimate", 6) + F.lit(0.0)).alias("estimate"), F.round("stderr", 8).alias("stderr"))


@query(
    "score_contribution_gauss",
    """WITH r AS (SELECT count(*)::DOUBLE AS n, avg(p_size) AS mx, avg(p_retailprice) AS my, regr_slope(p_retailprice, p_size) AS b, regr_sxx(p_retailprice, p_size) AS sxx,
  regr_syy(p_retailprice, p_size) - power(regr_sxy(p_retailprice, p_size), 2) / regr_sxx(p_retailprice, p_size) AS ssr FROM part),
l AS (SELECT p_partkey, n, -0.5 * ln(2 * pi() * ssr / (n - 2)) - power(p_retailprice - my - b * (p_size - mx), 2) / (2 * ssr / (n - 2)) AS ll, 1 / n + power(p_size - mx, 2) / sxx AS hat FROM part, r)
SELECT p_partkey, round(ll, 5) AS mlik, round(-2 * ll + 2 * 3 / n, 5) AS aic, round(-2 * ll + 3 / n * ln(n), 5) AS bic, round(-2 * ll + 3 / n * ln(n) + 2 / n * ln(n), 5) AS mdl, round(hat, 7) AS hat FROM l""",
)
def score_contribution_gauss(spark, sf):
    t = read(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    schema = Schema.of({"p_size": "gaussian", "p_retailprice": "gaussian"})
    net = fitting.fit(t, schema, Dag.of(schema.nodes, [("p_size", "p_retailprice")]), centre=False)
    s = fitting.score_contributions(t, net, ["p_partkey"]).filter("node = 'p_retailprice'")
    return s.select("p_partkey", *[F.round(c, 5).alias(c) for c in ("mlik", "aic", "bic", "mdl")], F.round("hat", 7).alias("hat"))


_GRID = "(SELECT 'b' AS node, 'b|intercept' AS param, i / 50.0::DOUBLE AS x, exp(-0.5 * power(i / 50.0::DOUBLE, 2)) AS f FROM (SELECT unnest(range(-200, 201)) AS i))"


def _grid(spark) -> DataFrame:
    x = F.col("id") / F.lit(50.0)
    return spark.range(-200, 201).select(F.lit("b").alias("node"), F.lit("b|intercept").alias("param"), x.alias("x"), F.exp(-0.5 * x * x).alias("f"))


@query("density_area", f"SELECT node, param, round(x, 6) AS x, round(f / ((SELECT sum(f) FROM {_GRID}) * 0.02), 8) AS f FROM {_GRID}")
def density_area(spark, sf):
    return fitting.unit_area(_grid(spark)).select("node", "param", F.round("x", 6).alias("x"), F.round("f", 8).alias("f"))


@query(
    "density_quantiles",
    f"WITH c AS (SELECT node, param, x, sum(f) OVER (ORDER BY x) / sum(f) OVER () AS c FROM {_GRID}), q AS (SELECT unnest([0.025::DOUBLE, 0.25, 0.5, 0.75, 0.975]) AS p)"
    " SELECT node, param, p, round(min(x) FILTER (WHERE c > p), 6) AS x FROM c, q GROUP BY node, param, p",
)
def density_quantiles(spark, sf):
    return fitting.density_quantiles(_grid(spark)).select("node", "param", "p", F.round("x", 6).alias("x"))


# --- Graphs ---------------------------------------------------------------
# Networks that the engine learns from lineitem: the best ones with one parent at
# most, and with two under the prior that is uniform over sizes.

_NODES = _FIVE
_N_SQL = f"nodes(pos, node) AS (VALUES {', '.join(f'({i}, {n!r})' for i, n in enumerate(_NODES))})"


def arcs_sql(name: str, limit: int = 1, prior: int = 1) -> str:
    """CTE ``name(parent, child)``; ``nodes`` stands before it."""
    return f"{name} AS MATERIALIZED (SELECT p.node AS parent, c.node AS child FROM ({_dp_sql(_trace_sql(), limit, prior)}) q JOIN nodes c ON c.pos = q.child JOIN nodes p ON (q.mask >> p.pos) & 1 = 1)"


def learned_dag(spark, sf, limit: int = 1, prior: int = 1) -> Dag:
    return search.most_probable(gauss_cache(spark, sf, limit), _NODES, "bic", prior).dag


def learned(spark, sf, limit: int = 1, prior: int = 1) -> DataFrame:
    """``(parent, child)`` of a learned network."""
    return learned_dag(spark, sf, limit, prior).edges(spark)


_E_SQL = f"{_N_SQL}, {arcs_sql('e')}"
_TWO_SQL = f"{_N_SQL}, {arcs_sql('r')}, {arcs_sql('t', 2, 2)}"


@query("dag_edges", f"WITH {_E_SQL} SELECT parent, child FROM e")
def dag_edges(spark, sf):
    """The learned network written as a formula, and read back."""
    dag = learned_dag(spark, sf)
    text = "~ " + " + ".join(f"{c}|{':'.join(dag.parents(c))}" for c in _NODES if dag.parents(c))
    return Dag.parse(text, _NODES).edges(spark)


@query("markov_blanket", f"WITH {_E_SQL} SELECT DISTINCT node FROM (SELECT child AS o, parent AS node FROM e UNION ALL SELECT parent, child FROM e UNION ALL SELECT x.parent, y.parent FROM e x JOIN e y ON x.child = y.child) WHERE o IN ('l_discount', 'l_extendedprice') AND node <> o")
def markov_blanket(spark, sf):
    return graph.markov_blanket(learned(spark, sf), ["l_discount", "l_extendedprice"])


@query(
    "info_dag",
    f"""WITH {_E_SQL}, p AS (SELECT child AS o, parent AS x FROM e UNION SELECT parent, child FROM e UNION SELECT a.child, b.child FROM e a JOIN e b ON a.parent = b.parent),
m AS (SELECT node, count(x) AS mb FROM nodes LEFT JOIN p ON node = o AND x <> o GROUP BY node), t AS (SELECT count(*) AS arcs FROM e)
SELECT count(*) AS n_nodes, min(arcs) AS n_arcs, avg(mb) AS mb_average, 2 * min(arcs)::DOUBLE / count(*) AS nh_average, min(arcs)::DOUBLE / count(*) AS parent_average, min(arcs)::DOUBLE / count(*) AS children_average FROM m, t""",
)
def info_dag(spark, sf):
    return graph.summary(learned(spark, sf), graph.node_frame(spark, _NODES))


_PLACES = len(_NODES) ** 2


@query(
    "compare_dags",
    f"""WITH {_TWO_SQL}, n AS (SELECT
 (SELECT count(*) FROM r JOIN t USING (parent, child))::DOUBLE AS tp, (SELECT count(*) FROM r)::DOUBLE AS cp, (SELECT count(*) FROM t)::DOUBLE AS pp,
 (SELECT count(DISTINCT least(parent, child) || '-' || greatest(parent, child)) FROM ((SELECT * FROM r EXCEPT SELECT * FROM t) UNION ALL (SELECT * FROM t EXCEPT SELECT * FROM r))) AS hamming)
SELECT round(tp / cp, 9) AS tpr, round((pp - tp) / ({_PLACES} - cp), 9) AS fpr, round(({_PLACES} - (pp - tp) - (cp - tp)) / {_PLACES}, 9) AS accuracy, round((cp - tp) / pp, 9) AS fdr,
 round(sqrt(tp / pp * (tp / cp)), 9) AS g_measure, round(2 / (1 / (tp * pp) + 1 / (tp * cp)), 9) AS f1, round(tp / pp, 9) AS ppv, round((cp - tp) / pp, 9) AS "for", hamming,
 round((pp - tp) / pp, 9) AS fdr_std, round(2 * tp / (cp + pp), 9) AS f1_std, round((cp - tp) / ({_PLACES} - pp), 9) AS for_std FROM n""",
)
def compare_dags(spark, sf):
    c = graph.compare(learned(spark, sf), learned(spark, sf, 2, 2), len(_NODES))
    return c.select(*[F.col(k) if k == "hamming" else F.round(k, 9).alias(k) for k in c.columns])


def _essential(kind):
    return lambda spark, sf: graph.essential_graph(learned(spark, sf, 2, 2), kind)


for _kind, _extra in (("minimal", ""), ("completed", " AND parent NOT IN (SELECT node FROM s)")):
    query(
        f"essential_graph_{_kind[:3]}",
        f"WITH {_N_SQL}, {arcs_sql('e', 2, 2)}, s AS (SELECT child AS node FROM e GROUP BY child HAVING count(*) >= 2) SELECT parent, child FROM e UNION SELECT child, parent FROM e WHERE child NOT IN (SELECT node FROM s){_extra}",
    )(_essential(_kind))


@query(
    "has_cycle",
    f"WITH RECURSIVE {_E_SQL}, f AS (SELECT 'dag' AS name, * FROM e UNION ALL SELECT 'loop', * FROM e UNION ALL SELECT 'loop', child, parent FROM e),"
    " r(name, parent, child) AS (SELECT * FROM f UNION SELECT r.name, r.parent, f.child FROM r JOIN f ON r.child = f.parent AND r.name = f.name)"
    " SELECT name, coalesce(bool_or(parent = child), false) AS has_cycle FROM r GROUP BY name",
)
def has_cycle(spark, sf):
    """The learned network, and the same with all arcs there and back."""
    arcs = learned(spark, sf)
    first = graph.cyclic(arcs, len(_NODES)).select(F.lit("dag").alias("name"), "has_cycle")
    loop = arcs.unionByName(arcs.select(F.col("child").alias("parent"), F.col("parent").alias("child")))
    return first.unionByName(graph.cyclic(loop, len(_NODES)).select(F.lit("loop").alias("name"), "has_cycle"))


#: Columns whose distribution is told from the table: text by its number of values.
_TOLD = ("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")


def _dist_frame(spark, sf) -> DataFrame:
    """``(pos, node, dist)`` of lineitem's columns."""
    t = read(spark, sf, "lineitem")
    kinds = dict(t.dtypes)
    told = [F.when(F.countDistinct(c) == 2, "binomial").otherwise("multinomial") if kinds[c] == "string" else F.lit("poisson" if "int" in kinds[c] else "gaussian") for c in _TOLD]
    row = t.agg(*[d.alias(c) for c, d in zip(_TOLD, told, strict=True)], F.count(F.lit(1)).alias("n"))
    each = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("node"), F.col(c).alias("dist")) for i, c in enumerate(_TOLD)])
    return row.select(F.explode(each).alias("x")).select("x.*")


_D_SQL = "d AS (SELECT CASE WHEN count(DISTINCT l_returnflag) = 2 THEN 'binomial' ELSE 'multinomial' END AS d0, CASE WHEN count(DISTINCT l_linestatus) = 2 THEN 'binomial' ELSE 'multinomial' END AS d1 FROM lineitem), nodes(pos, node, dist) AS (SELECT 0, 'l_returnflag', d0 FROM d UNION ALL SELECT 1, 'l_linestatus', d1 FROM d UNION ALL SELECT 2, 'l_linenumber', 'poisson' UNION ALL SELECT 3, 'l_quantity', 'gaussian')"
_SHAPE_SQL = "CASE dist WHEN 'binomial' THEN 'box' WHEN 'gaussian' THEN 'circle' WHEN 'poisson' THEN 'oval' ELSE 'diamond' END"


def _gaussian_frame(spark, sf) -> DataFrame:
    columns = lineitem_nodes(spark, sf).select(*_NODES).dtypes
    return spark.createDataFrame([(i, c, "gaussian" if k == "double" else "poisson") for i, (c, k) in enumerate(columns)], "pos int, node string, dist string")


@query(
    "dot_lines",
    f"""WITH {_E_SQL} SELECT 1 AS section, pos, -1 AS pos2, '"' || node || '"[shape=circle];' AS line FROM nodes
UNION ALL SELECT 2, p.pos, c.pos, '"' || parent || '"->"' || child || '";' FROM e JOIN nodes p ON p.node = parent JOIN nodes c ON c.node = child""",
)
def dot_lines(spark, sf):
    return export.dot_lines(_gaussian_frame(spark, sf), learned(spark, sf))


@query("export_arcs", f"WITH {_E_SQL} SELECT parent AS source_variable_id, child AS target_variable_id FROM e")
def export_arcs(spark, sf):
    return learned(spark, sf).select(F.col("parent").alias("source_variable_id"), F.col("child").alias("target_variable_id"))


@query(
    "export_variables",
    "SELECT 'o_orderstatus' AS variable_id, 'multinomial' AS model_type, 'logit' AS link, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT o_orderstatus AS s FROM orders)) AS states UNION ALL SELECT 'o_totalprice', 'gaussian', 'identity', NULL",
)
def export_variables(spark, sf):
    return export.variables(read(spark, sf, "orders"), {"o_orderstatus": "multinomial", "o_totalprice": "gaussian"})


@query("plot_nodes", f"WITH {_D_SQL} SELECT pos, node, dist, {_SHAPE_SQL} AS shape FROM nodes")
def plot_nodes(spark, sf):
    return export.plot_attributes(_dist_frame(spark, sf), learned(spark, sf))[0]


_S_SQL = "s AS (SELECT parent, child, CASE " + " ".join(f"WHEN least(parent, child) = '{min(a, b)}' AND greatest(parent, child) = '{max(a, b)}' THEN (SELECT round(abs(corr({a}, {b})), 2) FROM {_NET})" for i, a in enumerate(_NODES) for b in _NODES[i + 1 :]) + " END AS strength FROM e)"


@query("plot_edges", f"WITH {_E_SQL}, {_S_SQL}, m AS (SELECT min(strength) AS lo, max(strength) AS hi FROM s) SELECT parent, child, printf('%.2f', strength) AS label, round_even(5 * coalesce((strength - lo) / nullif(hi - lo, 0), 1), 0) + 1 AS lwd FROM s, m")
def plot_edges(spark, sf):
    """Arcs as thick as their ends' correlation."""
    arcs = sorted(learned_dag(spark, sf).arcs)
    t = lineitem_nodes(spark, sf)
    strength = t.agg(*[F.round(F.abs(F.corr(p, c)), 2).alias(f"s{i}") for i, (p, c) in enumerate(arcs)])
    each = F.array(*[F.struct(F.lit(p).alias("parent"), F.lit(c).alias("child"), F.col(f"s{i}").alias("strength")) for i, (p, c) in enumerate(arcs)])
    return export.plot_attributes(_gaussian_frame(spark, sf), learned(spark, sf), strength.select(F.explode(each).alias("x")).select("x.*"))[1]


from . import grouped_queries, model_queries  # noqa: E402, F401  register their queries
