"""Design columns, and cross-products of all of them in one scan."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Dist, Schema

#: Up to so many columns, cross-products are Spark aggregates; beyond, matrix products by Arrow batch.
WIDE = 8
#: Tasks that merge what the scan's tasks found.
MERGERS = 16


@dataclass(frozen=True)
class Design:
    """Numeric columns of the nodes: column 0 is the intercept, a multinomial node
    has one 0/1 column for every level, any other node one column."""

    schema: Schema
    names: tuple[str, ...]
    #: columns of each node
    of: tuple[tuple[int, ...], ...]

    @classmethod
    def build(cls, schema: Schema) -> Design:
        names, of = ["(intercept)"], []
        for c, d in schema.dists.items():
            cols = [f"{c}{x}" for x in schema.levels[c]] if d is Dist.MULTINOMIAL else [c]
            of.append(tuple(range(len(names), len(names) + len(cols))))
            names += cols
        return cls(schema, tuple(names), tuple(of))

    def frame(self, df: DataFrame, group: bool = False, keep=()) -> DataFrame:
        """``x1, x2, ...`` as doubles (and the group as ``g``), after columns to keep."""
        out = [F.col(k) for k in keep]
        for i, (c, d) in enumerate(self.schema.dists.items()):
            if d is Dist.MULTINOMIAL:
                out += [F.when(F.col(c) == F.lit(x), 1.0).otherwise(0.0).alias(f"x{k}") for k, x in zip(self.of[i], self.schema.levels[c], strict=True)]
            elif d is Dist.BINOMIAL:
                out.append(F.when(F.col(c) == F.lit(self.schema.levels[c][-1]), 1.0).otherwise(0.0).alias(f"x{self.of[i][0]}"))
            else:
                out.append(F.col(c).cast("double").alias(f"x{self.of[i][0]}"))
        return df.select(*out, *([F.col(self.schema.group).alias("g")] if group else []))

    def columns(self, parents) -> list[int]:
        """Design columns of a parent set: the intercept, unless a multinomial
        parent's columns add up to it."""
        dists = list(self.schema.dists.values())
        out = [] if any(dists[p] is Dist.MULTINOMIAL for p in parents) else [0]
        return out + [k for p in parents for k in self.of[p]]


@dataclass(frozen=True)
class Moments:
    """Number of rows, means, and centred cross-products of the design columns
    (the intercept's are 0)."""

    n: float
    mean: np.ndarray
    cross: np.ndarray

    def raw(self, cols) -> np.ndarray:
        """X'X of some columns; the intercept is a column of ones."""
        m = self.mean[cols]
        return self.cross[np.ix_(cols, cols)] + self.n * np.outer(m, m)

    def standardised(self, cols) -> Moments:
        """As if some columns had been centred and divided by their sample
        standard deviation."""
        scale, mean = np.ones(len(self.mean)), self.mean.copy()
        for c in cols:
            scale[c] = 1 / np.sqrt(self.cross[c, c] / (self.n - 1))
            mean[c] = 0.0
        return Moments(self.n, mean, self.cross * np.outer(scale, scale))


def moments(df: DataFrame, design: Design) -> Moments:
    """One scan, one row for each task to the aggregation: partial sums only."""
    x = design.frame(df)
    p = len(design.names)
    mean, cross = np.ones(p), np.zeros((p, p))
    if p - 1 <= WIDE:
        aggs = [F.count(F.lit(1)).alias("n")]
        for i in range(1, p):
            aggs.append(F.avg(f"x{i}").alias(f"m{i}"))
            aggs += [F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for j in range(i, p)]
        row = x.agg(*aggs).first()
        n = row["n"]
        if not n:
            raise ValueError("the table is empty")
        for i in range(1, p):
            mean[i] = row[f"m{i}"]
            for j in range(i, p):
                cross[i, j] = cross[j, i] = row[f"c{i}_{j}"] * n
        return Moments(float(n), mean, cross)

    def merged(parts):
        """Chan's formula: number, means and centred products of parts taken together."""
        n, m, c = 0.0, np.zeros(p - 1), np.zeros((p - 1, p - 1))
        for k, mk, ck in parts:
            d = mk - m
            c += ck + np.outer(d, d) * (n * k / (n + k))
            m, n = m + d * k / (n + k), n + k
        return n, m, c

    def row(n, m, c):
        return pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([m.tolist()]), pa.array([c.ravel().tolist()])], names=["n", "m", "c"])

    def partial(batches):
        def parts():
            for b in batches:
                if b.num_rows:
                    a = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(p - 1)])
                    mk = a.mean(axis=0)
                    yield len(a), mk, (a - mk).T @ (a - mk)

        n, m, c = merged(parts())
        if n:
            yield row(n, m, c)

    def each(batches):
        for b in batches:
            for r in b.to_pylist():
                yield r["n"], np.array(r["m"]), np.array(r["c"]).reshape(p - 1, p - 1)

    def together(batches):
        n, m, c = merged(each(batches))
        if n:
            yield row(n, m, c)

    # One job: a row of p * p numbers for each task, these merged in MERGERS tasks, as
    # they come, and what is left in the driver.
    kind = "n double, m array<double>, c array<double>"
    rows = x.mapInArrow(partial, kind).repartition(MERGERS).mapInArrow(together, kind).collect()
    n, m, c = merged((r["n"], np.array(r["m"]), np.array(r["c"]).reshape(p - 1, p - 1)) for r in rows)
    if not n:
        raise ValueError("the table is empty")
    mean[1:], cross[1:, 1:] = m, c
    return Moments(n, mean, cross)
