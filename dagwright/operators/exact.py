"""Exact structure search over the lattice of node sets, layer by layer.

A set of nodes is a number; its low bits are a place in a block's arrays, its high
bits name the block. Blocks with k high bits make layer k. A block needs the scores
of the parent sets within its nodes and what the blocks of one high bit less hand
on, so a layer is one cogroup of two tables by block; no task sees more than a block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, stored

#: Low bits of a block, at most: arrays of 4,096 numbers for each node.
LOW = 12


def low_bits(n: int) -> int:
    return min(LOW, n // 2)


@cache
def _levels(low: int) -> list[np.ndarray]:
    every = np.arange(1 << low)
    return [every[np.bitwise_count(every) == k] for k in range(low + 1)]


def _undominated(sets: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    """Without the sets that some set of one parent less is as good as: wherever
    they fit, that one does, or what is in turn as good as it."""
    members = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda p: F.col("mask").bitwiseAND(F.pow(F.lit(2), p).cast("long")) != 0)
    less = sets.select(*by, "child", "row_id", "value", "mask", F.explode(members).alias("p")).select(*by, "child", "row_id", "value", (F.col("mask") - F.pow(F.lit(2), F.col("p")).cast("long")).alias("mask"))
    other = sets.select(*by, "child", "mask", F.col("value").alias("v2"), F.col("row_id").alias("r2"))
    beaten = less.join(other, [*by, "child", "mask"]).filter("v2 > value OR (v2 = value AND r2 < row_id)").select(*by, "row_id").distinct()
    return sets.join(beaten, [*by, "row_id"], "left_anti")


def entries(sets: DataFrame, n: int, by: Sequence[str] = (), rows: bool = False) -> DataFrame:
    """``(by..., hi, child, lo, value[, row_id])``: for every block the best of the
    sets whose high bits lie within its own and whose low bits are ``lo``, of
    equal ones the first. ``sets`` has ``(by..., row_id, child, mask, value)``."""
    low = low_bits(n)
    part = F.shiftright("mask", low)
    sets = _undominated(sets, n, by)
    placed = sets.select(*by, "row_id", "child", "value", F.col("mask").bitwiseAND(F.lit((1 << low) - 1)).cast("int").alias("lo"), part.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << n - low) - 1).cast("long"))).alias("hi"))
    own = F.expr(f"child >= {low} AND (shiftright(hi, greatest(child - {low}, 0)) & 1) = 1")
    placed = placed.filter((F.col("hi").bitwiseAND(F.col("part")) == F.col("part")) & ~own)
    best = [F.max(F.struct("value", (-F.col("row_id")).alias("r"))).alias("b")] if rows else [F.max("value").alias("value")]
    out = placed.groupBy(*by, "hi", "child", "lo").agg(*best)
    return out.select(*by, "hi", "child", "lo", F.col("b.value").alias("value"), (-F.col("b.r")).alias("row_id")) if rows else out


def _best_within(pdf: pd.DataFrame, n: int, low: int) -> np.ndarray:
    """Best value of each child over the subsets of each place of a block."""
    best = np.full((n, 1 << low), -np.inf)
    best[pdf["child"].to_numpy(), pdf["lo"].to_numpy()] = pdf["value"].to_numpy()
    for b in range(low):
        v = best.reshape(n, -1, 2, 1 << b)
        np.maximum(v[:, :, 1], v[:, :, 0], out=v[:, :, 1])
    return best


def layers(found: DataFrame, n: int, by: Sequence[str] = ()) -> list[DataFrame]:
    """``(by..., hi, j, vec, last)`` for each layer: with j = -1, a block's best
    scores of a network over each set, and the set's last node (of equal ones the
    first); with j >= 0, what it hands on to the block ``hi`` that has node j more."""
    low = low_bits(n)
    high = n - low
    types = dict(found.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in by), "hi long, j int, vec binary, last binary"])
    k = len(by)

    def block(key, handed, within):
        hi, size = int(key[k]), 1 << low
        best = _best_within(within, n, low)
        g, last = np.full(size, -np.inf), np.full(size, -1, np.int8)
        if hi == 0:
            g[0] = 0.0
        before = [(int(j), np.frombuffer(v)) for j, v in sorted(zip(handed["j"], handed["vec"], strict=True), key=lambda r: r[0]) if j >= 0]
        for s in _levels(low):
            for i in range(low):
                mine = s[(s >> i & 1) == 1]
                rest = mine ^ (1 << i)
                v = best[i, rest] + g[rest]
                better = v > g[mine]
                g[mine[better]], last[mine[better]] = v[better], i
            for j, vec in before:
                better = vec[s] > g[s]
                g[s[better]], last[s[better]] = vec[s][better], j
        rows = [(*key[:k], hi, -1, g.tobytes(), last.tobytes())]
        for j in range(low, n):
            bit = 1 << j - low
            if not hi & bit:
                v = best[j] + g
                if np.isfinite(v).any():
                    rows.append((*key[:k], hi | bit, j, v.tobytes(), None))
        return pd.DataFrame(rows, columns=[*by, "hi", "j", "vec", "last"]).astype({"j": "int32"})

    start = found.select(*by).distinct() if by else found.sparkSession.range(1).select()
    handed = start.select(*by, F.lit(0).cast("long").alias("hi"), F.lit(-1).alias("j"), F.lit(None).cast("binary").alias("vec"))
    out: list[DataFrame] = []
    for layer in range(high + 1):
        within = found.filter(F.bit_count("hi") == layer)
        both = handed.groupBy(*by, "hi").cogroup(within.groupBy(*by, "hi"))
        out.append(stored(both.applyInPandas(block, schema), "layer"))
        handed = out[-1].filter("j >= 0").select(*by, "hi", "j", "vec")
    return out


def paths(tables: list[DataFrame], n: int, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., child, rest)``: each node and the set of nodes before it in the best
    order, walked back from all nodes, a layer at a time; child -1 where no
    network is possible."""
    low = low_bits(n)
    types = dict(tables[0].dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in by), "child int, rest long, at long"])
    full = (1 << n) - 1

    def walk(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                keys, s, last = tuple(r[: len(by)]), int(r.at), np.frombuffer(r.last, np.int8)
                while s:
                    i = int(last[s & (1 << low) - 1])
                    if i < 0:
                        out.append((*keys, -1, s, -1))
                        break
                    s ^= 1 << i
                    # A high node's set belongs to another block, where the walk goes on.
                    out.append((*keys, i, s, s if i >= low else -1))
                    if i >= low:
                        break
            yield pd.DataFrame(out, columns=[*by, "child", "rest", "at"]).astype({"child": "int32", "rest": "int64", "at": "int64"})

    at = tables[-1].filter("j = -1").select(*by, F.lit(full).cast("long").alias("at")).distinct()
    out = None
    for table in reversed(tables):
        blocks = table.filter("j = -1").select(*by, "hi", "last")
        here = at.withColumn("hi", F.shiftright("at", low)).join(blocks, [*by, "hi"]).select(*by, "at", "last")
        steps = stored(here.mapInPandas(walk, schema), "path")
        out = steps if out is None else out.unionByName(steps)
        at = steps.filter("at >= 0").select(*by, "at")
    return out.select(*by, "child", "rest")


def best_sets(sets: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., child, row_id, mask, score)``: each node's parent set in the best
    network. ``sets`` has ``(by..., row_id, child, mask, score, value)``, ``value``
    being the score with the structural prior. Row id null: no network is possible."""
    found = stored(entries(sets.select(*by, "row_id", "child", "mask", "value"), n, by), "entries")
    tables = layers(found, n, by)
    path = stored(paths(tables, n, by), "best")
    # One row for each node; the best set within the nodes before it, of equal ones the first.
    of = path.withColumnRenamed("child", "node")
    fits = sets.join(F.broadcast(of) if not by else of, [F.col("node") == F.col("child"), *(sets[c] == of[c] for c in by)] if by else F.col("node") == F.col("child"))
    fits = fits.filter(F.col("mask").bitwiseAND(F.bitwise_not("rest")) == 0)
    key = [sets[c] for c in by]
    top = fits.groupBy(*key, "child").agg(F.max(F.struct("value", (-F.col("row_id")).alias("r"), "mask", "score")).alias("b"))
    best = top.select(*by, "child", (-F.col("b.r")).alias("row_id"), F.col("b.mask").alias("mask"), F.col("b.score").alias("score"))
    none = path.filter("child < 0").select(*by, "child", F.lit(None).cast("long").alias("row_id"), F.lit(None).cast("long").alias("mask"), F.lit(None).cast("double").alias("score"))
    out = stored(best.unionByName(none), "networks")
    dropped(found, path, *tables)
    return out


def subset_best(sets: DataFrame, n: int) -> DataFrame:
    """``(child, subset, best, row_id)``: for every child and every set of other
    nodes the best parent set within it, of equal ones the first."""
    low = low_bits(n)

    def fill(pdf):
        size = 1 << low
        best, row = np.full((n, size), -np.inf), np.full((n, size), np.iinfo(np.int64).max, np.int64)
        at = pdf["child"].to_numpy(), pdf["lo"].to_numpy()
        best[at], row[at] = pdf["value"].to_numpy(), pdf["row_id"].to_numpy()
        for b in range(low):
            v, r = best.reshape(n, -1, 2, 1 << b), row.reshape(n, -1, 2, 1 << b)
            take = (v[:, :, 0] > v[:, :, 1]) | ((v[:, :, 0] == v[:, :, 1]) & (r[:, :, 0] < r[:, :, 1]))
            v[:, :, 1], r[:, :, 1] = np.where(take, v[:, :, 0], v[:, :, 1]), np.where(take, r[:, :, 0], r[:, :, 1])
        c, s = np.nonzero(np.isfinite(best))
        own = (c >= low) | (s >> np.minimum(c, 62) & 1 == 0)
        c, s = c[own], s[own]
        return pd.DataFrame({"child": c.astype("int32"), "subset": (int(pdf["hi"].iloc[0]) << low) | s, "best": best[c, s], "row_id": row[c, s]})

    return entries(sets, n, rows=True).groupBy("hi").applyInPandas(fill, "child int, subset long, best double, row_id long")


def subset_networks(tables: list[DataFrame], n: int) -> DataFrame:
    """``(subset, best, last)`` of every set that has a network, from :func:`layers`."""
    low = low_bits(n)

    def spread(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                g, last = np.frombuffer(r.vec), np.frombuffer(r.last, np.int8)
                ok = np.flatnonzero(np.isfinite(g))
                yield pd.DataFrame({"subset": (int(r.hi) << low) | ok, "best": g[ok], "last": last[ok].astype("int32")})

    out = None
    for t in tables:
        x = t.filter("j = -1").select("hi", "vec", "last").mapInPandas(spread, "subset long, best double, last int")
        out = x if out is None else out.unionByName(x)
    return out


def prior_column(n: int, choice: int) -> Column:
    """ln of the structural prior of a set of ``n_parents``: 1 uniform, 2 uniform over sizes."""
    if choice not in (1, 2):
        raise ValueError("the prior is 1 or 2")
    if choice == 1:
        return F.lit(0.0)
    return F.element_at(F.array(*[F.lit(-math.log(math.comb(n - 1, k))) for k in range(n)]), F.col("n_parents") + 1)
