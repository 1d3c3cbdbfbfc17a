"""Which distribution each column has, and validation of tables against it."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored


#: Values of a discrete column: each is a column of a design.
MAX_LEVELS = 10_000


class Dist(str, Enum):
    BINOMIAL = "binomial"
    GAUSSIAN = "gaussian"
    POISSON = "poisson"
    MULTINOMIAL = "multinomial"

    @property
    def code(self) -> int:
        """1 binomial, 2 gaussian, 3 poisson, 4 multinomial."""
        return list(Dist).index(self) + 1

    @property
    def link(self) -> str:
        return {"binomial": "logit", "gaussian": "identity", "poisson": "log", "multinomial": "logit"}[self.value]

    @property
    def discrete(self) -> bool:
        return self in (Dist.BINOMIAL, Dist.MULTINOMIAL)

    @classmethod
    def of(cls, name: str | Dist) -> Dist:
        """A distribution by any unambiguous beginning of its name, in any case."""
        if isinstance(name, Dist):
            return name
        found = [d for d in cls if name and d.value.startswith(str(name).lower())]
        if len(found) != 1:
            raise ValueError(f"unknown distribution {name!r}; one of {[d.value for d in cls]}")
        return found[0]


@dataclass(frozen=True)
class Schema:
    """Columns in order with their distributions; optionally the column that
    groups observations, and the levels of discrete columns."""

    dists: Mapping[str, Dist]
    group: str | None = None
    levels: Mapping[str, tuple] | None = None

    @classmethod
    def of(cls, dists: Mapping[str, str | Dist], group: str | None = None, levels: Mapping[str, Iterable] | None = None) -> Schema:
        if group is not None and group in dists:
            raise ValueError(f"the group column {group!r} is no node")
        return cls({k: Dist.of(v) for k, v in dists.items()}, group, {k: tuple(v) for k, v in (levels or {}).items()})

    @property
    def nodes(self) -> list[str]:
        return list(self.dists)

    def only(self, nodes: Iterable[str]) -> Schema:
        """The schema of some nodes, in the order of the schema."""
        nodes = set(nodes)
        if unknown := nodes - set(self.dists):
            raise ValueError(f"no such nodes: {sorted(unknown)}")
        return Schema({k: v for k, v in self.dists.items() if k in nodes}, self.group, self.levels)

    def codes(self) -> dict[str, int]:
        return {k: d.code for k, d in self.dists.items()}

    def by_dist(self) -> dict[str, list[int]]:
        """Positions of the columns of each distribution."""
        return {d.value: [i for i, x in enumerate(self.dists.values()) if x is d] for d in Dist}


def profile(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``(column, n, nulls, distinct)`` of each column; distinct is exact."""
    columns = list(columns)
    row = df.agg(F.count(F.lit(1)).alias("n"), *[f(c) for c in columns for f in (lambda c: F.count_if(F.col(c).isNull()).alias(f"nulls {c}"), lambda c: F.count_distinct(c).alias(f"distinct {c}"))])
    entry = [F.struct(F.lit(c).alias("column"), F.col("n"), F.col(f"nulls {c}").alias("nulls"), F.col(f"distinct {c}").alias("distinct")) for c in columns]
    return row.select(F.explode(F.array(*entry)).alias("x")).select("x.*")


def validate(df: DataFrame, schema: Schema) -> dict[str, list[int]]:
    """Checks a table in two scans without a shuffle of values; returns the
    column positions by distribution, or raises ValueError.

    No nulls; gaussian and poisson columns are numbers with more than two values;
    binomial columns have exactly two values, multinomial ones more; the group
    column has two at least.
    """
    want = schema.nodes + ([schema.group] if schema.group else [])
    if missing := [c for c in want if c not in df.columns]:
        raise ValueError(f"columns missing from the table: {missing}")
    types = dict(df.dtypes)
    numbers = ("double", "float", "int", "bigint", "smallint", "tinyint")
    for c, d in schema.dists.items():
        if d in (Dist.GAUSSIAN, Dist.POISSON) and not types[c].startswith((*numbers, "decimal")):
            raise ValueError(f"{c} is {d.value} but of type {types[c]}")
    first = df.agg(F.count(F.lit(1)).alias("n"), *[f for c in want for f in (F.count(c).alias(f"n {c}"), F.min(c).alias(f"min {c}"), F.max(c).alias(f"max {c}"))]).first()
    if not first["n"]:
        raise ValueError("the table is empty")
    if nulls := [c for c in want if first[f"n {c}"] < first["n"]]:
        raise ValueError(f"missing values in {nulls}")
    # More than two values: some row is neither the smallest nor the largest.
    between = df.agg(*[F.count_if((F.col(c) != F.lit(first[f"min {c}"])) & (F.col(c) != F.lit(first[f"max {c}"]))).alias(c) for c in want]).first()
    for c in want:
        n = 3 if between[c] else 1 + (first[f"min {c}"] != first[f"max {c}"])
        d = schema.dists.get(c)
        if d is None and n < 2:
            raise ValueError(f"the group column {c} has one value")
        if d is Dist.BINOMIAL and n != 2:
            raise ValueError(f"{c} is binomial but hasn't two values")
        if d is not None and d is not Dist.BINOMIAL and n < 3:
            raise ValueError(f"{c} is {d.value} but hasn't more than two values")
    return schema.by_dist()


def split_group(df: DataFrame, schema: Schema) -> DataFrame:
    """The nodes' columns and ``group_id``, 1, 2, ... by the group's sorted values."""
    if not schema.group:
        raise ValueError("the schema has no group column")
    # Ids come from the distinct values; the rows are joined to them.
    # They are sorted in ranges, and numbered within each; what comes before a range is one count.
    values = stored(df.select(F.col(schema.group).alias("g")).distinct().repartitionByRange("g").withColumn("part", F.spark_partition_id()), "groups")
    parts = values.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    before = parts.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = values.join(F.broadcast(before), "part")
    ids = numbered.select("g", (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("g"))).cast("int").alias("group_id"))
    return df.join(ids, df[schema.group] == ids["g"]).select(*schema.nodes, "group_id")


def with_levels(df: DataFrame, schema: Schema) -> Schema:
    """The schema with the sorted levels of its discrete columns, MAX_LEVELS at most:
    a column of ids that is declared discrete must not fill the driver."""
    discrete = [c for c, d in schema.dists.items() if d.discrete]
    if not discrete:
        return schema
    about = df.agg(*[F.approx_count_distinct(c).alias(c) for c in discrete]).first()
    if many := [c for c in discrete if about[c] > MAX_LEVELS]:
        raise ValueError(f"{many} have over {MAX_LEVELS} values: not discrete")
    row = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in discrete]).first()
    return Schema(schema.dists, schema.group, {c: tuple(row[c]) for c in discrete})


def parent_limits(schema: Schema, limit: int | Iterable[int] | Mapping[str, int] | None) -> dict[str, int]:
    """Most parents of each node: None is no limit, one number holds for all;
    never more than there are other nodes."""
    nodes = schema.nodes
    if limit is None:
        out = dict.fromkeys(nodes, len(nodes) - 1)
    elif isinstance(limit, Mapping):
        if set(limit) != set(nodes):
            raise ValueError("limits must name every node")
        out = {n: int(limit[n]) for n in nodes}
    elif isinstance(limit, int):
        out = dict.fromkeys(nodes, limit)
    else:
        limit = list(limit)
        if len(limit) != len(nodes):
            raise ValueError("one limit for each node")
        out = dict(zip(nodes, map(int, limit), strict=True))
    if any(v < 0 for v in out.values()):
        raise ValueError("a limit is negative")
    return {n: min(v, len(nodes) - 1) for n, v in out.items()}


def standardised(df: DataFrame, schema: Schema) -> DataFrame:
    """Every gaussian column as (x - mean) / sample standard deviation; the
    statistics are one row, computed in one scan."""
    cols = [c for c, d in schema.dists.items() if d is Dist.GAUSSIAN]
    if not cols:
        return df
    s = df.agg(*[f for c in cols for f in (F.avg(c).alias(f"m {c}"), F.stddev_samp(c).alias(f"s {c}"))]).first()
    return df.withColumns({c: (F.col(c) - F.lit(s[f"m {c}"])) / F.lit(s[f"s {c}"]) for c in cols})


def coded(df: DataFrame, schema: Schema) -> DataFrame:
    """Binomial columns as 0/1 by the order of their levels, numbers as double."""
    out = {}
    for c, d in schema.dists.items():
        if d is Dist.BINOMIAL:
            out[c] = (F.col(c) == F.lit(schema.levels[c][-1])).cast("int")
        elif d is not Dist.MULTINOMIAL:
            out[c] = F.col(c).cast("double")
    return df.withColumns(out)


def one_hot(df: DataFrame, column: str, levels: Iterable) -> DataFrame:
    """0/1 columns ``<column><level>``, one for every level; no reference level is dropped."""
    return df.withColumns({f"{column}{x}": F.when(F.col(column) == F.lit(x), 1).otherwise(0) for x in levels})
