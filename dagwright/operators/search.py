"""Structure search over a score cache."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Dag
from ..plans.cache import score_column
from ..storage import Growing, dropped, stored
from . import exact

WORST = -1.797e308
#: Parent sets whose index every worker may hold: some 130 MB.
MAX_SHARED = 4_000_000
#: Searches that one scan of a larger cache advances.
TOGETHER = 500
FOUND = "search_id long, score double, masks array<long>, path array<double>"
NO_SET = "some node has no parent set that fits; is a retained or user set missing?"


@dataclass(frozen=True)
class Found:
    dag: Dag
    score: float
    row_ids: tuple[int, ...] = ()


def prior_terms(n_nodes: int, k: int, choice: int = 1) -> float:
    """ln of the structural prior of a set of k parents: 1 uniform, 2 uniform over sizes."""
    if choice not in (1, 2):
        raise ValueError("the prior is 1 or 2")
    return 0.0 if choice == 1 else -math.log(math.comb(n_nodes - 1, k))


def _prepared(cache: DataFrame, score: str) -> DataFrame:
    return cache.select("row_id", "child", "mask", "n_parents", score_column(score).cast("double").alias("score"))


def _valued(cache: DataFrame, n: int, score: str, prior: int) -> DataFrame:
    """The cache's sets with ``value``, the score and the structural prior."""
    return _prepared(cache, score).withColumn("value", F.col("score") + exact.prior_column(n, prior))


def alpha_table(cache: DataFrame, n: int, score: str = "bic", prior: int = 1) -> DataFrame:
    """``(child, subset, best, row_id)``: for every child and every subset of the
    other nodes, the best cached parent set within it; block by block of the lattice."""
    return exact.subset_best(_valued(cache, n, score, prior), n)


def chain_table(cache: DataFrame, n: int, score: str = "bic", prior: int = 1) -> DataFrame:
    """``(subset, best, last)``: the best score of a network over each subset of
    the nodes, and the node that comes last in it."""
    found = stored(exact.entries(_valued(cache, n, score, prior), n), "entries")
    return exact.subset_networks(exact.layers(found, n), n)


def best_rows(cache: DataFrame, n: int, score: str = "bic", prior: int = 1) -> DataFrame:
    """``(child, row_id, mask, score)``: the parent set of each node in the most
    probable network. The work doubles with every node, as the lattice of node
    sets does; it lies in blocks, a layer of them at a time (``operators/exact``)."""
    out = exact.best_sets(_valued(cache, n, score, prior), n)
    if out.filter("row_id IS NULL").count() or out.count() < n:
        raise ValueError(NO_SET)
    return out


def most_probable(cache: DataFrame, nodes: Sequence[str], score: str = "bic", prior: int = 1) -> Found:
    """The network of the best total score, exactly."""
    rows = best_rows(cache, len(nodes), score, prior).collect()
    dag = Dag.from_masks({nodes[r["child"]]: r["mask"] for r in rows}, nodes)
    return Found(dag, sum(r["score"] for r in rows), tuple(r["row_id"] for r in rows))


def dag_score(cache: DataFrame, dag: Dag, score: str = "bic") -> DataFrame:
    """``(child_name, row_id, score)`` of the network's parent sets, by an equi-join;
    a set that isn't cached has nulls."""
    spark = cache.sparkSession
    want = spark.createDataFrame(list(dag.masks().items()), "name string, set long")
    have = cache.select("child_name", "mask", "row_id", F.col(score).alias("score"))
    # One row for each node goes to the cache; what it doesn't meet is added after.
    hits = have.join(F.broadcast(want), (F.col("name") == F.col("child_name")) & (F.col("set") == F.col("mask"))).select("name", "row_id", "score")
    return want.join(F.broadcast(hits.withColumnRenamed("name", "child_name")), F.col("name") == F.col("child_name"), "left").select(F.col("name").alias("child_name"), "row_id", "score")


def best_by_limit(cache: DataFrame, nodes: Sequence[str], limits: Sequence[int], score: str = "bic") -> list[tuple[int, float]]:
    """(limit, best total score) for growing parent limits, from one cache; stops
    where a larger limit gains nothing."""
    out: list[tuple[int, float]] = []
    for k in limits:
        value = most_probable(cache.filter(F.col("n_parents") <= k), nodes, score).score
        out.append((k, value))
        if len(out) > 1 and out[-1][1] <= out[-2][1] + 1e-9 * (1 + abs(value)):
            break
    return out


# --- Heuristics: every search is a row; an index of the cache is shared ----


class Index:
    """Each node's cached sets twice: by mask, to look sets up, and by falling
    score, to find the best one that makes no cycle. Of equal sets the first row
    counts, of equal scores too. Some 32 bytes a set."""

    def __init__(self, n: int, child, mask, score, row_id):
        self.n = n
        order = np.lexsort((row_id, mask, child))
        child, mask, score, row_id = child[order], mask[order], score[order], row_id[order]
        fresh = np.r_[True, (child[1:] != child[:-1]) | (mask[1:] != mask[:-1])][: len(child)]
        child, mask, score, row_id = child[fresh], mask[fresh], score[fresh], row_id[fresh]
        cuts = np.searchsorted(child, np.arange(n + 1))
        parts = [slice(x, y) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        self.masks, self.scores = [mask[x] for x in parts], [score[x] for x in parts]
        ranks = [np.lexsort((row_id[x], -score[x])) for x in parts]
        self.ranked = [m[r] for m, r in zip(self.masks, ranks, strict=True)]
        self.falling = [v[r] for v, r in zip(self.scores, ranks, strict=True)]
        #: what every cached set of a node has: retained parents
        self.kept = [int(np.bitwise_and.reduce(m)) if len(m) else 0 for m in self.masks]

    def look_up(self, i: int, masks: np.ndarray) -> np.ndarray:
        """Scores of node i with each of these sets; NaN where one isn't cached."""
        have = self.masks[i]
        if not len(have):
            return np.full(len(masks), np.nan)
        at = np.minimum(np.searchsorted(have, masks), len(have) - 1)
        return np.where(have[at] == masks, self.scores[i][at], np.nan)

    def score(self, i: int, mask: int) -> float:
        v = self.look_up(i, np.array([mask], np.int64))[0]
        return WORST if np.isnan(v) else float(v)

    def total(self, masks) -> float:
        return sum(self.score(i, int(m)) for i, m in enumerate(masks))

    def first_free(self, i: int, barred: int, start: int = 0) -> int:
        """Place, by falling score from ``start`` on, of the first set without any
        barred node; the number of sets if there is none."""
        masks, size = self.ranked[i], 64
        while start < len(masks):
            if len(free := np.flatnonzero((masks[start : start + size] & barred) == 0)):
                return start + int(free[0])
            start, size = start + size, 4 * size
        return len(masks)


class Running:
    """The network of a search: parent sets, and the ancestors of each node as bits,
    renewed only for a changed node and those below it."""

    def __init__(self, masks):
        self.masks, self.above = [0] * len(masks), [0] * len(masks)
        for i, m in enumerate(masks):
            self.put(i, int(m))

    def put(self, i: int, mask: int) -> None:
        self.masks[i] = mask
        # An ancestor has fewer ancestors than its descendant: parents come first.
        for j in [i, *sorted((j for j, a in enumerate(self.above) if a >> i & 1), key=lambda j: self.above[j].bit_count())]:
            above, m = 0, self.masks[j]
            while m:
                low = m & -m
                above |= low | self.above[low.bit_length() - 1]
                m ^= low
            self.above[j] = above

    def below(self, i: int) -> int:
        """Descendants of a node: what its parents must not have."""
        return sum(1 << j for j, a in enumerate(self.above) if a >> i & 1)


def _random_masks(index: Index, rng) -> list[int]:
    """For each node a random cached set of nodes that come before it in a random
    order, which the retained arcs agree with: the network has no cycle, and every
    set is cached."""
    masks, done, left = [0] * index.n, 0, list(rng.permutation(index.n))
    while left:
        # The next node is the first in the random order that has a set within the nodes so far.
        for i in left:
            if len(options := index.masks[i][(index.masks[i] & ~done) == 0]):
                break
        else:
            raise ValueError(NO_SET)
        masks[i] = int(options[int(rng.integers(len(options)))])
        done |= 1 << int(i)
        left.remove(i)
    return masks


def _random_triangle(index: Index, rng) -> list[int]:
    """A start for single-arc changes: a random order, and for each node a draw of
    arcs from those before it, as many as the largest cached set has if twice the
    number of nodes came before. Arcs go from a draw, at random, until its set is
    cached; where none is, it is a random cached set."""
    most = max((int(np.bitwise_count(m).max(initial=0)) for m in index.masks), default=0)
    masks, done, before, left = [0] * index.n, 0, [], list(rng.permutation(index.n))
    while left:
        i = next((i for i in left if (((index.masks[i] & ~done) == 0).any())), None)
        if i is None:
            raise ValueError(NO_SET)
        drawn = [p for p, x in zip(before, rng.permutation(2 * index.n), strict=False) if x < most and not index.kept[i] >> p & 1]
        rng.shuffle(drawn)
        # Each draw with the last arcs taken off, the longest first, down to the retained arcs alone.
        tries = np.array([index.kept[i] | sum(1 << p for p in drawn[:k]) for k in range(len(drawn), -1, -1)], np.int64)
        tries = tries[~np.isnan(index.look_up(i, tries)) & ((tries & ~done) == 0)]
        options = tries[:1] if len(tries) else index.masks[i][(index.masks[i] & ~done) == 0]
        masks[i] = int(options[int(rng.integers(len(options)))])
        done |= 1 << int(i)
        before.append(int(i))
        left.remove(i)
    return masks


def _climb(index: Index, masks: list[int]) -> tuple[list[int], list[float]]:
    """Steepest ascent over single-node changes of parent set. A node's best free
    set is looked for anew only when what is below the node changes, and further
    down only if nothing has left it."""
    net, n = Running(masks), index.n
    now = [index.score(i, m) for i, m in enumerate(net.masks)]
    path, barred, place = [sum(now)], [-1] * n, [0] * n
    while True:
        best = None
        for i in range(n):
            below = net.below(i)
            if below != barred[i]:
                start = place[i] if barred[i] >= 0 and not barred[i] & ~below else 0
                barred[i], place[i] = below, index.first_free(i, below, start)
            if place[i] == len(index.ranked[i]):
                continue
            gain = float(index.falling[i][place[i]]) - now[i]
            if gain > (best[0] if best else 1e-12 * (1 + abs(now[i]))):
                best = gain, i
        if best is None:
            return net.masks, path
        i = best[1]
        now[i] = float(index.falling[i][place[i]])
        net.put(i, int(index.ranked[i][place[i]]))
        path.append(sum(now))


def _walk(index: Index, masks: list[int], rng, algo: str, steps: int, memory: int, cooling: float) -> tuple[list[int], list[float]]:
    """Single-arc changes in random order: first improvement (hc), the same with
    recent moves barred (tabu), or worse moves within a falling threshold (sa).
    What a node's changes score is looked up when its set changes."""
    n, net = index.n, Running(masks)
    now = np.array([index.score(i, m) for i, m in enumerate(net.masks)])
    bits = 1 << np.arange(n, dtype=np.int64)
    # A set outside the cache is no move: its score is NaN.
    there = np.stack([index.look_up(i, net.masks[i] ^ bits) for i in range(n)])
    best, best_score, path = list(net.masks), float(now.sum()), [float(now.sum())]
    first = np.abs(now)
    tabu: list[int] = []
    heat = 1.0
    for _ in range(steps):
        # An arc from a node below its child would close a cycle; one that is there goes at will.
        below = np.array([net.below(i) for i in range(n)], np.int64)
        free = (below[:, None] & bits) == 0
        np.fill_diagonal(free, False)
        free.reshape(-1)[tabu] = False
        gains = there - now[:, None]
        good = free & (gains > 0)
        if algo == "sa":
            good |= free & (-gains < np.where(first < -WORST, heat * first / n, 0.0)[:, None])
        order = rng.permutation(n * n)
        good = good.reshape(-1)[order]
        heat *= cooling
        moved = good.any()
        if moved:
            i, p = divmod(int(order[good.argmax()]), n)
            net.put(i, net.masks[i] ^ 1 << p)
            now[i] = there[i, p]
            there[i] = index.look_up(i, net.masks[i] ^ bits)
            if algo == "tabu":
                tabu = [*tabu, i * n + p][-memory:]
        path.append(float(now.sum()))
        if path[-1] > best_score:
            best, best_score = list(net.masks), path[-1]
        if not moved and algo != "sa":
            break
    return best, path


def _index(table: DataFrame, n: int) -> Index:
    pdf = table.select("child", "mask", "score", "row_id").toPandas()
    return Index(n, *(pdf[c].to_numpy(t) for c, t in (("child", np.int64), ("mask", np.int64), ("score", float), ("row_id", np.int64))))


def _searches(table: DataFrame, size: int, n: int, seed: int, one) -> DataFrame:
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast(_index(table, size))
    dropped(table)

    def kernel(batches):
        index = shared.value
        for pdf in batches:
            out = []
            for s in pdf["id"]:
                masks, path = one(index, np.random.default_rng([seed, int(s)]))
                out.append((int(s), index.total(masks), [int(m) for m in masks], [float(v) for v in path]))
            yield pd.DataFrame(out, columns=["search_id", "score", "masks", "path"])

    parts = max(1, min(n, spark.sparkContext.defaultParallelism))
    return spark.range(0, n, 1, parts).mapInPandas(kernel, FOUND)


# --- The same climb over a cache of any size: a scan for all searches' steps ----


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed bits of each number."""
    for k in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(k)
    return x ^ (x >> np.uint64(32))


def _best_free(table: DataFrame, barred: np.ndarray, seed: int | None = None) -> dict[tuple[int, int], tuple[int, float]]:
    """Of each (search, node) the best cached set without any node that the search
    bars, and its score; with a seed, a random one. Each task keeps one set for each
    search and node; the driver gets these alone."""
    shared = table.sparkSession.sparkContext.broadcast(barred)

    def rows(batches):
        held: dict[tuple[int, int], tuple] = {}
        for b in batches:
            child, mask, score, row_id = (b.column(c).to_numpy(zero_copy_only=False) for c in ("child", "mask", "score", "row_id"))
            for i in np.unique(child):
                at = np.flatnonzero(child == i)
                for s, bars in enumerate(shared.value[:, i]):
                    free = at[(mask[at] & bars) == 0]
                    if len(free):
                        key = score[free] if seed is None else _mixed(row_id[free].astype(np.uint64) ^ _mixed(np.array([seed * 1_000_003 + s], np.uint64))).astype(float)
                        top = free[np.lexsort((row_id[free], -key))[0]]
                        found = float(key.max()), -int(row_id[top]), int(mask[top]), float(score[top])
                        held[s, int(i)] = max(held.get((s, int(i)), found), found)
        cols = list(zip(*[(s, i, *v) for (s, i), v in held.items()], strict=True)) or [()] * 6
        types = pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["search", "child", "key", "first", "mask", "score"])

    best = table.select("child", "mask", "score", "row_id").mapInArrow(rows, "search long, child long, key double, first long, mask long, score double")
    best = best.groupBy("search", "child").agg(F.max_by(F.struct("mask", "score"), F.struct("key", "first")).alias("x")).select("search", "child", "x.*")
    out = {(r["search"], r["child"]): (r["mask"], r["score"]) for r in best.collect()}
    shared.destroy()
    return out


def _climb_by_scan(table: DataFrame, n: int, searches: range, seed: int, first: list[int] | None) -> list[tuple]:
    """:func:`hill_climb` where no worker holds the cache: every scan of it is a step
    of all searches, whose networks, a mask for each node, the driver holds."""
    ids, full = list(searches), (1 << n) - 1
    if first is None:
        masks, done = [[0] * n for _ in ids], [0] * len(ids)
        left = [list(np.random.default_rng([seed, s]).permutation(n)) for s in ids]
        for step in range(n):
            found = _best_free(table, np.array([[full & ~d] * n for d in done], np.int64), seed + searches.start + step * 7919)
            for s, todo in enumerate(left):
                i = next((int(i) for i in todo if (s, int(i)) in found), None)
                if i is None:
                    raise ValueError(NO_SET)
                masks[s][i] = found[s, i][0]
                done[s] |= 1 << i
                todo.remove(i)
    else:
        masks = [list(first) for _ in ids]
    nets = [Running(m) for m in masks]
    want = table.sparkSession.createDataFrame(sorted({(i, m) for net in nets for i, m in enumerate(net.masks)}), "child int, mask long")
    known = {(r["child"], r["mask"]): r["score"] for r in table.join(F.broadcast(want), ["child", "mask"]).groupBy("child", "mask").agg(F.min_by("score", "row_id").alias("score")).collect()}
    now = [[known.get((i, m), WORST) for i, m in enumerate(net.masks)] for net in nets]
    paths, live = [[sum(v)] for v in now], list(range(len(ids)))
    while live:
        found, still = _best_free(table, np.array([[nets[s].below(i) for i in range(n)] for s in live], np.int64)), []
        for k, s in enumerate(live):
            best = None
            for i in range(n):
                gain = found[k, i][1] - now[s][i] if (k, i) in found else 0.0
                if gain > (best[0] if best else 1e-12 * (1 + abs(now[s][i]))):
                    best = gain, i
            if best:
                mask, now[s][best[1]] = found[k, best[1]]
                nets[s].put(best[1], mask)
                paths[s].append(sum(now[s]))
                still.append(s)
        live = still
    return [(s, sum(v), net.masks, path) for s, v, net, path in zip(ids, now, nets, paths, strict=True)]


def hill_climb(cache: DataFrame, nodes: Sequence[str], score: str = "mlik", searches: int = 1, seed: int = 42, start: Dag | None = None) -> DataFrame:
    """``(search_id, score, masks, path)``: steepest ascent from random networks,
    or from a given one. Up to MAX_SHARED parent sets the searches run in parallel,
    each with an index of the cache; beyond, the cache stays where it is and each
    scan of it is one step of up to TOGETHER searches. Both ways take the same steps
    from a given network; random networks come from different draws."""
    first = list(start.masks()[n] for n in nodes) if start else None
    table = stored(_prepared(cache, score), "cache")
    if table.count() <= MAX_SHARED:
        return _searches(table, len(nodes), searches, seed, lambda c, rng: _climb(c, _started(c.kept, first) or _random_masks(c, rng)))
    if first:
        kept = {r["child"]: r["kept"] for r in table.groupBy("child").agg(F.bit_and("mask").alias("kept")).collect()}
        _started([kept.get(i, 0) for i in range(len(nodes))], first)
    out = Growing(cache.sparkSession, FOUND, "searches")
    for a in range(0, searches, TOGETHER):
        out.add(_climb_by_scan(table, len(nodes), range(a, min(a + TOGETHER, searches)), seed, first))
    dropped(table)
    return out.frame()


def _started(kept: Sequence[int], first: list[int] | None) -> list[int] | None:
    """The network a search begins with; one that lacks retained arcs is an error."""
    if first is not None and any(k & ~m for k, m in zip(kept, first, strict=True)):
        raise ValueError("the first network lacks arcs that all cached sets retain")
    return None if first is None else list(first)


def heuristic(cache: DataFrame, nodes: Sequence[str], algo: str = "hc", score: str = "mlik", searches: int = 1, seed: int = 42, start: Dag | None = None, steps: int = 100, memory: int = 10, temperature: float = 0.9) -> DataFrame:
    """As :func:`hill_climb` by single-arc changes: ``hc``, ``tabu`` or ``sa``, from
    the lower triangle of a random order. At most MAX_SHARED parent sets."""
    if algo not in ("hc", "tabu", "sa"):
        raise ValueError("algo is 'hc', 'tabu' or 'sa'")
    first = list(start.masks()[n] for n in nodes) if start else None
    table = stored(_prepared(cache, score), "cache")
    if (sets := table.count()) > MAX_SHARED:
        raise ValueError(f"a search by single arcs holds {MAX_SHARED} parent sets at most, not {sets}; lower the parent limit, ban arcs or climb by sets")
    return _searches(table, len(nodes), searches, seed, lambda c, rng: _walk(c, _started(c.kept, first) or _random_triangle(c, rng), rng, algo, steps, memory, temperature))


def support(searches: DataFrame, nodes: Sequence[str]) -> DataFrame:
    """``(parent, child, n, share)`` of the arcs over the searches."""
    names = F.array(*[F.lit(x) for x in nodes])
    arcs = searches.select(F.posexplode("masks").alias("c", "mask")).select(
        F.element_at(names, F.col("c") + 1).alias("child"), F.explode(F.expr(f"filter(sequence(0, {len(nodes) - 1}), i -> (mask & shiftleft(1L, i)) <> 0)")).alias("p")
    )
    total = searches.agg(F.count(F.lit(1)).alias("total"))
    return arcs.select(F.element_at(names, F.col("p") + 1).alias("parent"), "child").groupBy("parent", "child").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total), F.lit(True)).select("parent", "child", "n", (F.col("n") / F.col("total")).alias("share"))


def consensus(searches: DataFrame, nodes: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """``(parent, child)`` of the arcs in at least ceil(searches * threshold) of the networks."""
    s = support(searches, nodes)
    need = F.ceil(F.round(F.col("n") / F.col("share")) * F.lit(threshold))
    return s.filter((F.col("n") >= need) & (F.col("n") > 0)).select("parent", "child")


def top(searches: DataFrame, k: int = 10) -> DataFrame:
    """The k best searches."""
    return searches.orderBy(F.desc("score"), "search_id").limit(k)
