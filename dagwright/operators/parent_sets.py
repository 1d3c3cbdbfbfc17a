"""Enumeration of the parent sets of each node, as a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Dag
from ..schema import Schema, parent_limits

#: Masks are longs.
MAX_NODES = 62


def check_constraints(banned: Dag | None, retained: Dag | None, limits: Mapping[str, int]) -> None:
    """Retained arcs must fit the limits and be acyclic; no arc is both banned and retained."""
    if retained is None:
        return
    if retained.has_cycle():
        raise ValueError("the retained arcs have a cycle")
    for n in retained.nodes:
        if len(retained.parents(n)) > limits[n]:
            raise ValueError(f"{n} retains more parents than its limit")
    if banned is not None and (both := banned.arcs & retained.arcs):
        raise ValueError(f"banned and retained: {sorted(both)}")


def parent_sets(
    spark: SparkSession,
    schema: Schema,
    limit: int | Iterable[int] | Mapping[str, int] | None = None,
    banned: Dag | None = None,
    retained: Dag | None = None,
    which: Iterable[str] | None = None,
    adjusted: Iterable[str] = (),
) -> DataFrame:
    """``(row_id, child, child_name, parents array<int>, mask, n_parents)``.

    By child, then number of parents, then parents in column order, the empty set
    first; ``row_id`` counts from 0 in that order. ``banned`` may have cycles.
    ``which`` keeps some nodes as children and parents; ``adjusted`` nodes are
    parents of every child besides the enumerated ones (and no children). The
    sets grow one node at a time from those of one less, so the largest level is
    built in parallel and the constraints prune it at once.
    """
    nodes = schema.nodes
    if len(nodes) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} nodes")
    limits = parent_limits(schema, limit)
    check_constraints(banned, retained, limits)
    adjusted, which = set(adjusted), set(which) if which is not None else set(nodes)
    if unknown := (adjusted | which) - set(nodes):
        raise ValueError(f"no such nodes: {sorted(unknown)}")
    at = {n: i for i, n in enumerate(nodes)}
    free = [at[n] for n in nodes if n in which and n not in adjusted]
    ban = (banned or Dag(tuple(nodes), frozenset())).masks()
    keep = (retained or Dag(tuple(nodes), frozenset())).masks()
    extra = sum(1 << at[n] for n in adjusted)
    rows = [(i, nodes[i], limits[nodes[i]], ban[nodes[i]] & ~extra, keep[nodes[i]]) for i in free]
    children = spark.createDataFrame(rows, "child int, child_name string, most int, ban long, keep long")
    allowed = sum(1 << i for i in free)
    bits = F.array(*[F.lit(i) for i in free])
    level = children.select("child", "child_name", "most", "ban", "keep", F.lit(0).cast("long").alias("mask"), F.lit(-1).alias("last"), F.lit(0).alias("n"))
    levels = [level]
    for _ in range(max((limits[nodes[i]] for i in free), default=0)):
        more = level.filter("n < most").withColumn("p", F.explode(F.filter(bits, lambda b: b > F.col("last"))))
        bit = F.expr("shiftleft(1L, p)")
        more = more.filter((F.col("p") != F.col("child")) & (F.col("ban").bitwiseAND(bit) == 0))
        level = more.select("child", "child_name", "most", "ban", "keep", F.col("mask").bitwiseOR(bit).alias("mask"), F.col("p").alias("last"), (F.col("n") + 1).alias("n"))
        levels.append(level)
    sets = levels[0]
    for x in levels[1:]:
        sets = sets.unionByName(x)
    kept = F.col("keep").bitwiseAND(F.lit(allowed))
    sets = sets.filter(F.col("mask").bitwiseAND(kept) == kept).withColumn("mask", F.col("mask").bitwiseOR(F.lit(extra).cast("long")))
    members = F.expr(f"filter(sequence(0, {max(len(nodes) - 1, 0)}), i -> (mask & shiftleft(1L, i)) <> 0)")
    sets = sets.select("child", "child_name", members.alias("parents"), "mask", F.bit_count("mask").alias("n_parents"))
    # Numbered within each child in parallel; what comes before a child is one count each.
    order = Window.partitionBy("child").orderBy("n_parents", "parents")
    counts = sets.groupBy("child").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("child", F.coalesce(F.sum("c").over(Window.orderBy("child").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = sets.withColumn("k", F.row_number().over(order) - 1).join(F.broadcast(before), "child")
    return numbered.select((F.col("before") + F.col("k")).alias("row_id"), "child", "child_name", "parents", "mask", "n_parents")


def user_sets(spark: SparkSession, schema: Schema, sets: Iterable[tuple[str, Iterable[str]]]) -> DataFrame:
    """The same table from given (child, parents) pairs, in their order."""
    at = {n: i for i, n in enumerate(schema.nodes)}
    rows = []
    for k, (child, parents) in enumerate(sets):
        p = sorted(at[x] for x in parents)
        if at[child] in p:
            raise ValueError(f"{child} is its own parent")
        rows.append((k, at[child], child, p, sum(1 << i for i in p), len(p)))
    return spark.createDataFrame(rows, "row_id long, child int, child_name string, parents array<int>, mask long, n_parents int")
