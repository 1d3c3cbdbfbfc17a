"""Directed acyclic graphs of columns: parsing, checks, metrics.

A DAG is small (one node for each column of a table), so it is held in the
driver; ``edges`` and the operators below take and give DataFrames of
``(parent, child)``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dag:
    nodes: tuple[str, ...]
    #: (parent, child)
    arcs: frozenset[tuple[str, str]]

    @classmethod
    def of(cls, nodes: Iterable[str], arcs: Iterable[tuple[str, str]] = (), acyclic: bool = True) -> Dag:
        nodes, arcs = tuple(nodes), frozenset(map(tuple, arcs))
        if len(set(nodes)) < len(nodes):
            raise ValueError("node names repeat")
        for a in arcs:
            if unknown := set(a) - set(nodes):
                raise ValueError(f"no such nodes: {sorted(unknown)}")
        dag = cls(nodes, arcs)
        if acyclic and dag.has_cycle():
            raise ValueError("the graph has a cycle")
        return dag

    @classmethod
    def parse(cls, formula: str, nodes: Iterable[str], acyclic: bool = True) -> Dag:
        """``~ a|b:c + d|.``: a's parents are b and c, d's all others; a term
        without a bar adds nothing. Names are matched whole."""
        nodes = tuple(nodes)
        body = formula.strip()
        if not body.startswith("~"):
            raise ValueError("a formula starts with ~")
        arcs = set()
        for term in filter(None, (re.sub(r"\s", "", t) for t in body[1:].split("+"))):
            child, bar, parents = term.partition("|")
            for side in (child, parents):
                for name in side.split(":") if side else ():
                    if name != "." and name not in nodes:
                        raise ValueError(f"{name!r} is no node")
            if not bar:
                continue
            some = lambda side: set(nodes) if "." in side.split(":") else set(side.split(":"))
            arcs |= {(p, c) for c in some(child) for p in some(parents) if p != c}
        return cls.of(nodes, arcs, acyclic)

    @classmethod
    def from_matrix(cls, matrix, nodes: Iterable[str], acyclic: bool = True) -> Dag:
        """From a square 0/1 matrix: row child, column parent."""
        nodes = tuple(nodes)
        if len(matrix) != len(nodes) or any(len(r) != len(nodes) for r in matrix):
            raise ValueError("the matrix isn't square in the nodes")
        for r in matrix:
            for v in r:
                if min(abs(v), abs(v - 1)) > 1e-8:
                    raise ValueError("a matrix holds 0 and 1")
        if acyclic and any(abs(matrix[i][i]) > 1e-8 for i in range(len(nodes))):
            raise ValueError("a node is its own parent")
        return cls.of(nodes, [(nodes[j], nodes[i]) for i, r in enumerate(matrix) for j, v in enumerate(r) if v > 0.5], acyclic)

    def matrix(self) -> list[list[int]]:
        return [[int((p, c) in self.arcs) for p in self.nodes] for c in self.nodes]

    def parents(self, node: str) -> list[str]:
        return [p for p in self.nodes if (p, node) in self.arcs]

    def children(self, node: str) -> list[str]:
        return [c for c in self.nodes if (node, c) in self.arcs]

    def order(self) -> list[str]:
        """Nodes so that parents come first; a shorter list if there is a cycle."""
        left, out = {n: len(self.parents(n)) for n in self.nodes}, []
        free = [n for n in self.nodes if not left[n]]
        while free:
            n = free.pop(0)
            out.append(n)
            for c in self.children(n):
                left[c] -= 1
                if not left[c]:
                    free.append(c)
        return out

    def has_cycle(self) -> bool:
        return len(self.order()) < len(self.nodes)

    def masks(self) -> dict[str, int]:
        """Parent set of each node as a bit mask over the nodes."""
        return {c: sum(1 << i for i, p in enumerate(self.nodes) if (p, c) in self.arcs) for c in self.nodes}

    @classmethod
    def from_masks(cls, masks: Mapping[str, int], nodes: Iterable[str]) -> Dag:
        nodes = tuple(nodes)
        return cls.of(nodes, [(nodes[i], c) for c, m in masks.items() for i in range(len(nodes)) if m >> i & 1])

    def without_cycles(self, keep: Iterable[tuple[str, str]] = (), seed: int = 0) -> Dag:
        """Breaks cycles: as long as there is one, a random node in the remaining
        core loses its outgoing arcs, but for those to keep."""
        import random

        r, keep, dag = random.Random(seed), set(keep), self
        while dag.has_cycle():
            done = set(dag.order())
            core = [n for n in self.nodes if n not in done and any(p == n and c not in done and (p, c) not in keep for p, c in dag.arcs)]
            if not core:
                raise ValueError("the arcs to keep form a cycle")
            n = r.choice(core)
            dag = Dag(self.nodes, frozenset(a for a in dag.arcs if a[0] != n or a in keep or a[1] in done))
        return dag

    def edges(self, spark: SparkSession) -> DataFrame:
        """``(parent, child)``, by parent, then child, in node order."""
        rows = [(p, c) for p in self.nodes for c in self.nodes if (p, c) in self.arcs]
        return spark.createDataFrame(rows, "parent string, child string")


def node_frame(spark: SparkSession, nodes: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(i, n) for i, n in enumerate(nodes)], "pos int, node string")


def reachable(edges: DataFrame, n_nodes: int) -> DataFrame:
    """Transitive closure ``(parent, child)``, by doubling path lengths."""
    now = edges.select("parent", "child").distinct()
    length = 1
    while length < n_nodes:
        step = now.alias("a").join(now.alias("b"), F.col("a.child") == F.col("b.parent")).select("a.parent", "b.child")
        now = now.union(step).distinct()
        length *= 2
    return now


def cyclic(edges: DataFrame, n_nodes: int) -> DataFrame:
    """One row ``(has_cycle)``: some node reaches itself."""
    return reachable(edges, n_nodes).agg(F.coalesce(F.max(F.col("parent") == F.col("child")), F.lit(False)).alias("has_cycle"))


def markov_blanket(edges: DataFrame, nodes: Iterable[str]) -> DataFrame:
    """``(node)``: parents, children and the children's other parents of some
    nodes, the union over them; a node of the set itself only as another's."""
    nodes = list(nodes)
    e = edges.select("parent", "child").distinct()
    parents = e.select(F.col("child").alias("of"), F.col("parent").alias("node"))
    children = e.select(F.col("parent").alias("of"), F.col("child").alias("node"))
    both = e.alias("a").join(e.alias("b"), F.col("a.child") == F.col("b.child")).select(F.col("a.parent").alias("of"), F.col("b.parent").alias("node"))
    return parents.union(children).union(both).filter(F.col("of").isin(nodes) & (F.col("of") != F.col("node"))).select("node").distinct()


def summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: ``n_nodes, n_arcs, mb_average, nh_average, parent_average,
    children_average``. The Markov-blanket size counts parents, children and
    siblings (nodes with a parent in common): the established report does, and
    results must be comparable; :func:`markov_blanket` has the true blanket."""
    e = edges.select("parent", "child").distinct()
    pairs = (
        e.select(F.col("child").alias("of"), F.col("parent").alias("x"))
        .union(e.select(F.col("parent").alias("of"), F.col("child").alias("x")))
        .union(e.alias("a").join(e.alias("b"), F.col("a.parent") == F.col("b.parent")).select(F.col("a.child").alias("of"), F.col("b.child").alias("x")))
        .filter("of <> x")
        .distinct()
    )
    sizes = nodes.join(pairs, F.col("node") == F.col("of"), "left").groupBy("node").agg(F.count("x").alias("mb"))
    arcs = e.agg(F.count(F.lit(1)).alias("n_arcs"))
    total = sizes.agg(F.count(F.lit(1)).alias("n_nodes"), F.avg("mb").alias("mb_average"))
    # Two tables of one row each.
    return total.join(arcs, F.lit(True)).select(
        "n_nodes", "n_arcs", "mb_average", (2 * F.col("n_arcs") / F.col("n_nodes")).alias("nh_average"), (F.col("n_arcs") / F.col("n_nodes")).alias("parent_average"), (F.col("n_arcs") / F.col("n_nodes")).alias("children_average")
    )


def compare(reference: DataFrame, test: DataFrame, n_nodes: int) -> DataFrame:
    """One row of agreement measures of two edge sets over ``n_nodes`` nodes.

    ``fdr``, ``f1`` and ``for`` follow the established report (missed arcs over
    predicted ones; the harmonic mean of true positives over products of counts),
    ``*_std`` the textbook. Hamming counts a reversed arc once. Measures over
    an empty set are null.
    """
    r = reference.select("parent", "child").distinct().withColumn("r", F.lit(1))
    t = test.select("parent", "child").distinct().withColumn("t", F.lit(1))
    both = r.join(t, ["parent", "child"], "full").na.fill(0, ["r", "t"])
    pair = F.concat_ws("\u0001", F.least("parent", "child"), F.greatest("parent", "child"))
    c = both.agg(
        F.coalesce(F.sum(F.col("r") * F.col("t")), F.lit(0)).alias("tp"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("cp"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("pp"),
        F.count_distinct(F.when(F.col("r") != F.col("t"), pair)).alias("hamming"),
    )
    n2 = n_nodes * n_nodes
    tp, cp, pp = (F.col(x).cast("double") for x in ("tp", "cp", "pp"))
    fp, fn = pp - tp, cp - tp
    over = lambda a, b: F.when(b != 0, a / b)
    return c.select(
        over(tp, cp).alias("tpr"),
        over(fp, n2 - cp).alias("fpr"),
        ((n2 - fp - fn) / n2).alias("accuracy"),
        over(fn, pp).alias("fdr"),
        F.sqrt(over(tp, pp) * over(tp, cp)).alias("g_measure"),
        F.when((tp > 0) & (pp > 0) & (cp > 0), 2 / (1 / (tp * pp) + 1 / (tp * cp))).alias("f1"),
        over(tp, pp).alias("ppv"),
        over(fn, pp).alias("for"),
        F.col("hamming").cast("long").alias("hamming"),
        over(fp, pp).alias("fdr_std"),
        over(2 * tp, cp + pp).alias("f1_std"),
        over(fn, n2 - pp).alias("for_std"),
    )


def essential_graph(edges: DataFrame, kind: str = "minimal", strict: bool = False) -> DataFrame:
    """``(parent, child)`` of the partially directed graph; an undirected arc is
    there both ways.

    Arcs into a node of two or more parents stay directed; with ``completed``,
    they also stay so where the node is the parent (its children's arcs).
    ``strict`` asks for two parents that aren't joined themselves.
    """
    if kind not in ("minimal", "completed"):
        raise ValueError("kind is 'minimal' or 'completed'")
    e = edges.select("parent", "child").distinct()
    if strict:
        joined = e.union(e.select(F.col("child").alias("parent"), F.col("parent").alias("child")))
        pairs = e.alias("a").join(e.alias("b"), (F.col("a.child") == F.col("b.child")) & (F.col("a.parent") < F.col("b.parent")))
        pairs = pairs.select(F.col("a.parent").alias("x"), F.col("b.parent").alias("y"), F.col("a.child").alias("node"))
        sinks = pairs.join(joined, (F.col("x") == F.col("parent")) & (F.col("y") == F.col("child")), "left_anti").select("node").distinct()
    else:
        sinks = e.groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("node")
    ends = [F.col("child") == F.col("node")]
    if kind == "completed":
        ends.append(F.col("parent") == F.col("node"))
    undirected = e
    for on in ends:
        undirected = undirected.join(sinks, on, "left_anti")
    return e.union(undirected.select(F.col("child").alias("parent"), F.col("parent").alias("child"))).distinct()
