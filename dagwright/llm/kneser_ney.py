"""Character n-gram model with modified Kneser-Ney smoothing, counted by Spark.

A text is its words with one space between them, marks before and an end mark
after it; n-grams run across words. Tables are sorted arrays of hashed n-grams
under keys of 64 bits, pruned by nothing: they grow with what the corpus has.
The most frequent HOT entries are broadcast; what else a block of documents asks
for is joined to it by shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, mix64, written

ORDER = 4
#: Marks: no code points.
START, END = 0x110000, 0x110001
#: Symbols that are worked on at once, slots for n-grams of a group that were met
#: before, groups that have some, and rows of counts that a group holds before it
#: sends them on: memory and time, not results, depend on them.
PIECE, SLOTS, GROUPS, HELD = 1 << 16, 1 << 18, 16, 1 << 19
#: Entries of the tables that are broadcast, 12 bytes each (48 MB) and a few more in transit.
HOT = 1 << 22
#: Rows of discounts that are broadcast, some 60 bytes each; more are joined by shuffle.
FEW = 200_000
#: Back-off weights have the context's order and this as their kind.
BACK = 100


def symbols(words: list[list[bytes]], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, document of each) of some documents' words; what stands before a
    document belongs to none (-1)."""
    codes, doc, before = [], [], np.full(order - 1, START, np.uint32)
    for i, w in enumerate(words):
        text = b" ".join(w).decode("utf-8", "surrogatepass")
        codes += before, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), np.array([END], np.uint32)
        doc += np.full(order - 1, -1), np.full(len(text) + 1, i)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *codes]).astype(np.uint64), np.concatenate([none, *doc]).astype(np.int64)


def pieces(codes: np.ndarray, doc: np.ndarray, order: int = ORDER) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(hashes, positions, documents) of the symbols piece by piece: ``hashes[k][j]``
    are the k symbols that end at j; positions are those of documents."""
    for s in range(0, len(codes), PIECE):
        a = max(0, s - order + 1)
        c = codes[a : s + PIECE]
        h = [np.zeros(len(c), np.uint64)]
        for k in range(1, order + 1):
            new = (c + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            if k > 1:
                new[1:] ^= mix64(h[-1][:-1])
            h.append(new)
        at = np.flatnonzero(doc[a : s + PIECE] >= 0)
        at = at[at >= s - a]
        yield h, at, doc[a:][at]


def _context(h: list[np.ndarray], k: int, at: np.ndarray) -> np.ndarray:
    return h[k - 1][at - 1] if k > 1 else np.zeros(len(at), np.uint64)


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys ^ (keys >> np.uint64(29))) & np.uint64(SLOTS - 1)).astype(np.int64)


class Counts:
    """N-grams of one group's documents: of each order the keys, contexts, suffixes
    and numbers (of the highest order; the others' follow from it). Keys met before
    are counted in slots; a key whose slot another one needs is sent on."""

    def __init__(self, order: int = ORDER):
        self.order, self.size = order, 0
        #: by order: (key, context, suffix, n)
        self.new: list[list[tuple]] = [[] for _ in range(order + 1)]
        self.more: list[tuple[np.ndarray, np.ndarray]] = []
        self.key, self.n = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64)

    def add(self, words: list[list[bytes]]) -> None:
        for h, at, _ in pieces(*symbols(words, self.order), self.order):
            key = h[self.order][at]
            slot = _slot(key)
            met = self.key[slot] == key
            self.n += np.bincount(slot[met], minlength=SLOTS)
            at = at[~met]
            key, first, n = np.unique(key[~met], return_index=True, return_counts=True)
            slot = _slot(key)
            old = np.unique(slot)
            old = old[self.n[old] > 0]
            self.more.append((self.key[old], self.n[old]))
            self.key[slot], self.n[slot] = key, 0
            at = at[first]
            for k in range(self.order, 0, -1):
                if k < self.order:
                    key, first = np.unique(h[k][at], return_index=True)
                    at, n = at[first], np.zeros(len(first), np.int64)
                self.new[k].append((key, _context(h, k, at), h[k - 1][at], n))
                self.size += len(key)

    def batches(self, group: str) -> Iterator[pa.RecordBatch]:
        """What was counted since the last call; a key's context and suffix are null
        where they were sent before."""
        left = self.n > 0
        self.more.append((self.key[left], self.n[left]))
        for k in range(self.order, 0, -1):
            none = np.zeros(0, np.uint64)
            cols = [np.concatenate(c) for c in zip((none, none, none, none.astype(np.int64)), *self.new[k], strict=True)]
            new = len(cols[0])
            if k == self.order:
                key, n = (np.concatenate(c) for c in zip(*self.more, strict=True))
                none = np.zeros(len(key), np.uint64)
                cols = [np.concatenate(c) for c in zip(cols, (key, none, none, n), strict=True)]
            if not len(cols[0]):
                continue
            key, first, where = np.unique(cols[0], return_index=True, return_inverse=True)
            n, known = np.bincount(where, cols[3], len(key)).astype(np.int64), first >= new
            whole = lambda x, mask=None: pa.array(x.astype(np.uint64).view(np.int64), mask=mask)
            yield pa.RecordBatch.from_arrays(
                [pa.array([group] * len(key), pa.string()), pa.array(np.full(len(key), k, np.int32)), whole(key), whole(cols[1][first], known), whole(cols[2][first], known), pa.array(n)], names=["grp", "k", "key", "context", "suffix", "n"]
            )
        self.n[:], self.more, self.new, self.size = 0, [], [[] for _ in self.new], 0


COUNTS = "grp string, k int, key long, context long, suffix long, n long"


def count(groups: Iterable[tuple[str, list[list[bytes]]]], order: int = ORDER) -> Iterator[pa.RecordBatch]:
    """Partial counts (``COUNTS``) of (group, documents' words)."""
    held: dict[str, Counts] = {}
    for group, words in groups:
        if group not in held and len(held) >= GROUPS:
            first = next(iter(held))
            yield from held.pop(first).batches(first)
        mine = held.setdefault(group, Counts(order))
        mine.add(words)
        if mine.size > HELD:
            yield from mine.batches(group)
    for group, mine in held.items():
        yield from mine.batches(group)


def fit(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """``(grp, k, key, p, weight)``: the models' tables from partial counts.

    Modified Kneser-Ney: the highest order has its counts, lower ones the number
    of distinct symbols seen before them; three discounts for each order of a
    group from its counts of counts; interpolated. Kind k: discounted probability
    of an n-gram of k symbols; BACK + k: back-off weight of a context of k - 1;
    0: probability of each symbol under no n-gram at all.
    """
    # Rows of a key are added up before the shuffle.
    table = written(rows.groupBy("grp", "k", "key").agg(F.min("context").alias("context"), F.min("suffix").alias("suffix"), F.sum("n").alias("n")), "counts")
    left = table.filter("k > 1").groupBy("grp", (F.col("k") - 1).alias("k"), F.col("suffix").alias("key")).agg(F.count(F.lit(1)).alias("a"))
    lower = table.filter(F.col("k") < order).join(left, ["grp", "k", "key"]).select("grp", "k", "key", "context", "a")
    seen = written(table.filter(F.col("k") == order).select("grp", "k", "key", "context", F.col("n").alias("a")).unionByName(lower), "adjusted")
    dropped(table)
    n1, n2, n3, n4 = (F.count_if(F.col("a") == i) for i in range(1, 5))
    # Where a count of counts is 0, no discount can be told: the plain estimates' usual values stand in.
    y = F.when((n1 > 0) & (n2 > 0), n1 / (n1 + 2 * n2)).otherwise(0.5)

    def discount(i, hi, lo):
        return F.greatest(F.lit(0.05), F.least(F.lit(float(i)), F.when((hi > 0) & (lo > 0), i - (i + 1) * y * hi / lo).otherwise(0.5 * i)))

    discounts = written(seen.groupBy("grp", "k").agg(discount(1, n2, n1).alias("d1"), discount(2, n3, n2).alias("d2"), discount(3, n4, n3).alias("d3")), "discounts")
    # One row for each group and order: by shuffle, all n-grams of a language would meet in one task.
    discounts = F.broadcast(discounts) if discounts.count() <= FEW else discounts
    d = F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
    off = seen.join(discounts, ["grp", "k"]).withColumn("d", d)
    contexts = off.groupBy("grp", "k", "context").agg(F.sum("a").alias("total"), F.sum("d").alias("off"))
    probs = off.join(contexts.select("grp", "k", "context", "total"), ["grp", "k", "context"]).select("grp", "k", "key", ((F.col("a") - F.col("d")) / F.col("total")).cast("float").alias("p"), F.col("a").alias("weight"))
    backs = contexts.select("grp", (F.col("k") + BACK).alias("k"), F.col("context").alias("key"), (F.col("off") / F.col("total")).cast("float").alias("p"), F.col("total").alias("weight"))
    # One symbol more than was seen stands for all others.
    flat = seen.filter("k = 1").groupBy("grp").agg((1.0 / (F.count(F.lit(1)) + 1)).cast("float").alias("p"))
    flat = flat.select("grp", F.lit(0).alias("k"), F.lit(0).cast("long").alias("key"), "p", F.lit((1 << 63) - 1).alias("weight"))
    out = written(probs.unionByName(backs).unionByName(flat), "tables")
    dropped(seen)
    return out


def _packed(batches):
    """Rows (grp, k, key, p) as one row of bytes for each group and kind of a batch."""
    for b in batches:
        at: dict[tuple, list[int]] = {}
        for i, pair in enumerate(zip(b.column("grp").to_pylist(), b.column("k").to_pylist(), strict=True)):
            at.setdefault(pair, []).append(i)
        key, p = b.column("key").to_numpy(), b.column("p").to_numpy()
        cols = [[g for g, _ in at], [k for _, k in at], [key[i].tobytes() for i in at.values()], [p[i].tobytes() for i in at.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["grp", "k", "key", "p"])


def sorted_tables(parts: Iterable[tuple]) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """Sorted (keys, values) by (group, kind) from parts (group, kind, keys, values)."""
    found: dict[tuple, list] = {}
    for grp, k, key, p in parts:
        found.setdefault((grp, k), []).append((key, p))
    out = {}
    for at, x in found.items():
        key, p = (np.concatenate(c) for c in zip(*x, strict=True))
        ascending = np.argsort(key)
        out[at] = key[ascending], p[ascending]
    return out


#: Steps of a histogram of weights to a doubling.
STEPS = 16


def heaviest(tables: DataFrame, most: int) -> DataFrame:
    """Up to ``most`` entries of the greatest weight: all that lie above a step of
    the histogram of weights, of which the driver gets a few hundred counts."""
    step = F.floor(F.log2(F.greatest(F.col("weight").cast("double"), F.lit(1.0))) * STEPS)
    cut, total = None, 0
    for r in sorted(tables.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        total += r["count"]
        if total > most:
            break
        cut = r["step"]
    return tables.filter(step >= cut) if cut is not None else tables.filter(F.lit(False))


def hot(tables: DataFrame) -> tuple[dict, bool]:
    """At most HOT entries, those of the greatest weight, and whether these are all."""
    whole = tables.count() <= HOT
    top = tables if whole else heaviest(tables, HOT)
    packed = written(top.select("grp", "k", "key", "p").mapInArrow(_packed, "grp string, k int, key binary, p binary"), "hot")
    rows = packed.toArrow()
    dropped(packed)
    cols = [rows.column(c).to_pylist() for c in ("grp", "k", "key", "p")]
    return sorted_tables((g, k, np.frombuffer(key, np.int64).view(np.uint64), np.frombuffer(p, np.float32)) for g, k, key, p in zip(*cols, strict=True)), whole


def _look(tables: list, keys: np.ndarray, missing: float) -> np.ndarray:
    out = np.full(len(keys), missing)
    for have, value in tables:
        if len(have):
            at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
            out = np.where(have[at] == keys, value[at], out)
    return out


def has(tables: dict, group: str, k: int, keys: np.ndarray) -> np.ndarray:
    """Which keys a table has."""
    have = tables.get((group, k), (np.zeros(0, np.uint64),))[0]
    return have[np.minimum(np.searchsorted(have, keys), len(have) - 1)] == keys if len(have) else np.zeros(len(keys), bool)


class Scorer:
    """Negative log2 probabilities under models whose tables lie in ``parts``."""

    def __init__(self, parts: list[dict], order: int = ORDER):
        self.parts, self.order = parts, order
        #: of each group, the n-grams met last and their bits
        self.met: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def bits(self, group: str, words: list[list[bytes]]) -> np.ndarray:
        """Of each document under the group's model; nan where it has none."""
        of = lambda k: [t[group, k] for t in self.parts if (group, k) in t]
        out, flat = np.zeros(len(words)), of(0)
        if not flat:
            return np.full(len(words), np.nan)
        if group not in self.met and len(self.met) >= GROUPS:
            del self.met[next(iter(self.met))]
        keys, costs = self.met.setdefault(group, (np.zeros(SLOTS, np.uint64), np.zeros(SLOTS)))
        for h, at, doc in pieces(*symbols(words, self.order), self.order):
            key = h[self.order][at]
            slot = _slot(key)
            new = np.flatnonzero(keys[slot] != key)
            cost = costs[slot]
            if len(new):
                key, first, where = np.unique(key[new], return_index=True, return_inverse=True)
                some, p = at[new[first]], np.full(len(key), float(flat[0][1][0]))
                for k in range(1, self.order + 1):
                    p = _look(of(k), h[k][some], 0.0) + _look(of(BACK + k), _context(h, k, some), 1.0) * p
                found, slot = -np.log2(p), _slot(key)
                cost[new] = found[where]
                keys[slot], costs[slot] = key, found
            out += np.bincount(doc, cost, len(words))
        return out


def wanted(known: dict, group: str, words: list[list[bytes]], order: int = ORDER) -> Iterator[tuple[int, np.ndarray]]:
    """(kind, keys) that documents ask for and ``known`` doesn't have."""
    flat = np.zeros(1, np.uint64)
    found: dict[int, list] = {0: [flat[~has(known, group, 0, flat)]]}
    for h, at, _ in pieces(*symbols(words, order), order):
        at = at[np.unique(h[order][at], return_index=True)[1]]
        for k in range(1, order + 1):
            for kind, keys in ((k, h[k][at]), (BACK + k, _context(h, k, at))):
                keys = np.unique(keys)
                found.setdefault(kind, []).append(keys[~has(known, group, kind, keys)])
    for kind, keys in found.items():
        yield kind, np.unique(np.concatenate(keys))
