"""Grouped models over scans: each group's intercepts are a row of a table that is
carried from step to step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mixed as X
from ..operators import models as M
from ..storage import dropped, stored

#: Rows of a group beyond which it is dealt out over several parts, and rows of a block.
PART, BLOCK = 50_000, 4_096
#: Newton steps of the intercepts at one place of the parameters, at most.
STEPS = 200


def blocks_of(rows: DataFrame, width: int) -> DataFrame:
    """``(g, part, n_parts, data)``: the rows ``(x1.., g, w)`` packed as matrices,
    each of one group and at most ``BLOCK`` rows. A group of over ``PART`` rows has
    several parts, told by a hash of the row, so that no join or task gets it
    whole."""
    columns = [*(f"x{i}" for i in range(1, width)), "w"]
    rows = rows.withColumn("g", F.col("g").cast("string"))
    large = rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("n_parts")).filter("n_parts > 1").withColumnRenamed("g", "large")
    rows = rows.join(large, F.col("g").eqNullSafe(F.col("large")), "left")
    n_parts = F.coalesce("n_parts", F.lit(1))
    rows = rows.select("g", n_parts.alias("n_parts"), F.pmod(F.xxhash64(*columns), n_parts).cast("int").alias("part"), *columns)

    def pack(batches):
        key, held, size = None, [], 0
        names = ["g", "part", "n_parts", "data"]

        def block():
            return (*key, np.concatenate(held).tobytes())

        for b in batches:
            out = []
            keys = list(zip(*(b.column(c).to_pylist() for c in names[:3]), strict=True))
            x = np.column_stack([b.column(c).to_numpy() for c in columns]).astype(float) if b.num_rows else np.zeros((0, width))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if key is not None and (keys[s] != key or size >= BLOCK):
                    out.append(block())
                    held, size = [], 0
                key = keys[s]
                held.append(x[s:e])
                size += e - s
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=_BLOCKS)
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, block(), strict=True))], schema=_BLOCKS)

    return rows.repartition("g", "part").sortWithinPartitions("g", "part").mapInArrow(pack, "g string, part int, n_parts int, data binary")


_BLOCKS = pa.schema([("g", pa.string()), ("part", pa.int32()), ("n_parts", pa.int32()), ("data", pa.binary())])


class Groups:
    """The groups of a design and their intercepts in all models that advance
    together. Rows are stored once as blocks; the state is ``(g, part, n_parts, u)``
    with the intercepts of all models in one array, a copy for each part."""

    def __init__(self, rows: DataFrame, width: int):
        self.width = width
        self.blocks = stored(blocks_of(rows, width), "blocks")
        keys = self.blocks.select("g", "part", "n_parts").distinct()
        self.state = stored(keys.withColumn("u", F.lit(b"")), "intercepts")
        #: where the state has the intercepts of a model
        self.at: dict[int, int] = {}

    def close(self) -> None:
        dropped(self.blocks, self.state)

    def terms(self, asks: list[tuple[int, M.Model, list[np.ndarray]]]) -> dict[int, list[np.ndarray]]:
        """Value and slope of each model's sum over groups at each of its points:
        Newton steps of all intercepts, one job each, from where the model's were
        left, then one job for the sums. What the driver gets is a number for each
        model, point and parameter."""
        places, size = [], 0
        for i, model, points in asks:
            for theta in points:
                places.append((i, model, theta, size, self.at.get(i)))
                size += model.blocks
        spark = self.state.sparkSession
        sent = spark.sparkContext.broadcast(places)
        state, first = self.state, True
        for _ in range(STEPS):
            new = stored(_advanced(self.blocks, state, self.width, sent, size, first), "intercepts")
            far = new.agg(F.max("far")).first()[0]
            if not first:
                dropped(state)
            state, first = new, False
            if far is None or far < X.STILL:
                break
        total: dict[int, float] = {r["k"]: r["v"] for r in _totals(self.blocks, state, self.width, sent, size).collect()}
        out: dict[int, list[np.ndarray]] = {i: [] for i, _, _ in asks}
        k = 0
        for i, model, _, _, _ in places:
            n = 1 + X.dimension(model)
            out[i].append(np.array([total.get(k + j, 0.0) for j in range(n)]))
            k += n
        dropped(self.state)
        # The next call starts from each model's first point.
        self.state, self.at = state, {}
        for i, _, _, s, _ in places:
            self.at.setdefault(i, s)
        sent.unpersist()
        return out


def _unpacked(u: bytes, size: int, places, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(intercepts, the best so far, its value by place) from a state's array."""
    if not first:
        v = np.frombuffer(u)
        return v[:size], v[size : 2 * size], v[2 * size :]
    old = np.frombuffer(u)
    now = np.zeros(size)
    for _, model, _, s, was in places:
        if was is not None and len(old):
            now[s : s + model.blocks] = old[was : was + model.blocks]
    return now, now, np.full(len(places), -np.inf)


def _sums(blocks: DataFrame, state: DataFrame, width: int, sent, size: int, first: bool, deep: bool) -> DataFrame:
    """``(g, n_parts, u, sums)``: each group's sums over all models and points, in
    as many rows as batches had the group."""

    def add(batches):
        places = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            keys, which = np.unique(np.array(["\x00" if x is None else "\x01" + x for x in b.column("g").to_pylist()], dtype=object).astype(str), return_inverse=True)
            where = np.unique(which, return_index=True)[1]
            u = [_unpacked(b.column("u")[int(i)].as_py(), size, places, first)[0] for i in where]
            u = np.array(u).reshape(len(keys), size)
            parts = [np.frombuffer(x.as_py()).reshape(-1, width) for x in b.column("data")]
            rows = np.concatenate(parts)
            g = np.repeat(which, [len(x) for x in parts])
            a = np.column_stack([np.ones(len(rows)), rows[:, :-1]])
            found = [X.row_sums(model, theta, u[:, s : s + model.blocks], a, rows[:, -1], g, len(keys), deep) for _, model, theta, s, _ in places]
            sums = np.column_stack(found)
            yield pa.RecordBatch.from_arrays(
                [b.column("g").take(pa.array(where)), b.column("n_parts").take(pa.array(where)), b.column("u").take(pa.array(where)), pa.array([x.tobytes() for x in sums], pa.binary())],
                names=["g", "n_parts", "u", "sums"],
            )

    joined = blocks.join(state.select(F.col("g").alias("of"), F.col("part").alias("of_part"), "u"), F.col("g").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    return joined.select("g", "n_parts", "u", "data").mapInArrow(add, "g string, n_parts int, u binary, sums binary")


def _by_group(batches) -> Iterator[tuple[str, int, bytes, np.ndarray]]:
    """Sorted rows of :func:`_sums`, added up group by group."""
    key, total, n_parts, u = None, None, 0, b""
    for b in batches:
        for g, n, state, s in zip(b.column("g").to_pylist(), b.column("n_parts").to_pylist(), b.column("u"), b.column("sums"), strict=True):
            if key is None or key[0] != g:
                if key:
                    yield key[0], n_parts, u, total
                key, total, n_parts, u = (g,), np.zeros(len(s.as_py()) // 8), n, state.as_py()
            total = total + np.frombuffer(s.as_py())
    if key:
        yield key[0], n_parts, u, total


def _advanced(blocks: DataFrame, state: DataFrame, width: int, sent, size: int, first: bool) -> DataFrame:
    """The state after one Newton step of every group's intercepts."""

    def step(batches):
        places = sent.value
        for some in _some(_by_group(batches), 512):
            sums = np.array([s for _, _, _, s in some])
            states = [_unpacked(u, size, places, first) for _, _, u, _ in some]
            u, before, best = (np.array([x[i] for x in states]) for i in range(3))
            out, kept, value, far, c = u.copy(), before.copy(), best.copy(), np.zeros(len(some)), 0
            for j, (_, model, theta, s, _) in enumerate(places):
                k = model.blocks
                n = 1 + k + k * k
                v, move = X.newton_step(model, theta, u[:, s : s + k], sums[:, c : c + n])
                out[:, s : s + k], kept[:, s : s + k], value[:, j], d = X.settle(u[:, s : s + k], v, move, before[:, s : s + k], best[:, j])
                far, c = np.maximum(far, d), c + n
            rows = [(g, p, n_parts, np.r_[out[i], kept[i], value[i]].tobytes(), float(far[i])) for i, (g, n_parts, _, _) in enumerate(some) for p in range(n_parts)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.float64()], strict=True)], names=["g", "part", "n_parts", "u", "far"])

    found = _sums(blocks, state, width, sent, size, first, False)
    return found.repartition("g").sortWithinPartitions("g").mapInArrow(step, "g string, part int, n_parts int, u binary, far double")


def _totals(blocks: DataFrame, state: DataFrame, width: int, sent, size: int) -> DataFrame:
    """``(k, v)``: values and slopes of all models and points, one after another, over all groups."""

    def total(batches):
        places = sent.value
        out = None
        for some in _some(_by_group(batches), 512):
            sums = np.array([s for _, _, _, s in some])
            u = np.array([_unpacked(x, size, places, False)[0] for _, _, x, _ in some])
            found, c = [], 0
            for _, model, theta, s, _ in places:
                k, p = model.blocks, len(model.cols)
                n = 1 + k + k * k + k * p + k * k * p + k**3 + k**3 * p
                v, slope = X.value_slope(model, theta, u[:, s : s + k], sums[:, c : c + n])
                found.append(np.r_[v.sum(), slope.sum(axis=0)])
                c += n
            found = np.concatenate(found)
            out = found if out is None else out + found
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], names=["k", "v"])

    found = _sums(blocks, state, width, sent, size, False, True)
    return found.repartition("g").sortWithinPartitions("g").mapInArrow(total, "k long, v double").groupBy("k").agg(F.sum("v").alias("v"))


def _some(rows: Iterator, n: int) -> Iterator[list]:
    out = []
    for r in rows:
        out.append(r)
        if len(out) == n:
            yield out
            out = []
    if out:
        yield out
