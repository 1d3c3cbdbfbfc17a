"""Heuristic search: the index against plain loops, and a cache that no worker holds."""

import time

import numpy as np
import pytest

from dagwright.graph import Dag
from dagwright.operators import search
from dagwright.plans.cache import build_cache
from dagwright.schema import Schema


def sets_of(rng, n, size, most=3):
    """Random sets of each node, the empty one among them; some scores are equal."""
    out = []
    for i in range(n):
        others = [p for p in range(n) if p != i]
        masks = {0} | {sum(1 << int(p) for p in rng.choice(others, rng.integers(1, most + 1), replace=False)) for _ in range(size)}
        out += [(i, m, float(rng.integers(-40, 0))) for m in sorted(masks, key=lambda m: rng.random())]
    return [(*x, k) for k, x in enumerate(out)]


def index_of(rows, n):
    child, mask, score, row_id = (np.array(c) for c in zip(*rows, strict=True))
    return search.Index(n, child, mask, score, row_id)


def cyclic(masks):
    left = {i: m for i, m in enumerate(masks)}
    while left:
        free = [i for i, m in left.items() if not any(m >> j & 1 for j in left)]
        if not free:
            return True
        for i in free:
            del left[i]
    return False


def climb(rows, n, masks):
    """Steepest ascent, every set of every node tried at every step."""
    masks, known = list(masks), {}
    for i, m, v, _ in rows:
        known.setdefault((i, m), v)
    while True:
        best = None
        for i, m, v, _ in rows:
            gain = v - known[i, masks[i]]
            if gain > (best[0] if best else 1e-12) and not cyclic([*masks[:i], m, *masks[i + 1 :]]):
                best = gain, i, m
        if best is None:
            return masks
        masks[best[1]] = best[2]


def test_index_climbs_like_plain_loops():
    for seed in range(12):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(4, 8))
        rows = sets_of(rng, n, 25)
        index = index_of(rows, n)
        start = search._random_masks(index, np.random.default_rng(seed))
        assert not cyclic(start)
        masks, path = search._climb(index, start)
        assert masks == climb(rows, n, start) and not cyclic(masks)
        assert path == sorted(path) and path[-1] == index.total(masks)


def test_ancestors_are_kept_up_to_date():
    rng = np.random.default_rng(5)
    net = search.Running([0] * 9)
    for _ in range(400):
        i = int(rng.integers(9))
        mask = sum(1 << int(p) for p in rng.choice(9, 3, replace=False)) & ~net.below(i) & ~(1 << i)
        net.put(i, mask)
        assert not cyclic(net.masks)
        for j in range(9):
            above, todo = 0, [j]
            while todo:
                new = net.masks[todo.pop()] & ~above
                above |= new
                todo += [p for p in range(9) if new >> p & 1]
            assert net.above[j] == above


@pytest.mark.parametrize("algo", ["hc", "tabu", "sa"])
def test_single_arcs_stay_in_the_cache(algo):
    for seed in range(8):
        rng = np.random.default_rng(seed)
        rows = sets_of(rng, 6, 40)
        index, known = index_of(rows, 6), {(i, m) for i, m, _, _ in rows}
        start = search._random_triangle(index, rng)
        assert not cyclic(start) and all((i, m) in known for i, m in enumerate(start))
        masks, path = search._walk(index, start, rng, algo, 60, 5, 0.9)
        assert not cyclic(masks) and all((i, m) in known for i, m in enumerate(masks))
        assert index.total(masks) == max(path) >= path[0]
        if algo == "hc":
            assert path == sorted(path)
            # No single arc is left that gains.
            for i, m in enumerate(masks):
                for p in range(6):
                    other = m ^ 1 << p
                    if p != i and (i, other) in known and not cyclic([*masks[:i], other, *masks[i + 1 :]]):
                        assert index.score(i, other) <= index.score(i, m) or len(path) == 61


def test_triangles_have_arcs_of_random_orders():
    # All sets of up to two parents are cached: draws stand as they are, and orders differ.
    rows = [(i, m, -1.0, 0) for i in range(6) for m in range(64) if not m >> i & 1 and m.bit_count() < 3]
    index = index_of([(*x[:3], k) for k, x in enumerate(rows)], 6)
    starts = {tuple(search._random_triangle(index, np.random.default_rng(s))) for s in range(200)}
    arcs = np.mean([sum(m.bit_count() for m in s) for s in starts])
    # Two of twelve places are arcs: 15 * 2 / 12 in the mean over all orders.
    assert len(starts) > 100 and 2.0 < arcs < 3.5


def test_no_set_fits():
    index = index_of([(0, 2, -1.0, 0), (1, 1, -1.0, 1)], 2)
    for start in (search._random_masks, search._random_triangle):
        with pytest.raises(ValueError, match="no parent set"):
            start(index, np.random.default_rng(1))


def test_a_cache_that_no_worker_holds(spark, monkeypatch):
    t = spark.range(400).selectExpr(*[f"randn({k}) + {0.4 * k} * (id % 7) as v{k}" for k in range(5)])
    names = t.columns
    retained = Dag.of(names, [("v3", "v0")])
    cache = build_cache(t, Schema.of(dict.fromkeys(names, "gaussian")), "mle", 2, None, retained)
    start = Dag.of(names, [("v3", "v0"), ("v0", "v1")])
    near = search.hill_climb(cache, names, "bic", 3, start=start).orderBy("search_id").collect()
    top = search.top(search.hill_climb(cache, names, "bic", 10), 1).first()
    monkeypatch.setattr(search, "MAX_SHARED", 10)
    monkeypatch.setattr(search, "TOGETHER", 4)
    far = search.hill_climb(cache, names, "bic", 3, start=start).orderBy("search_id").collect()
    assert [(r["masks"], r["score"]) for r in far] == [(r["masks"], r["score"]) for r in near]
    assert all(np.allclose(a["path"], b["path"]) for a, b in zip(far, near, strict=True))
    # Random starts: all searches keep the retained arc, and the best is as good.
    got = search.hill_climb(cache, names, "bic", 10).collect()
    assert sorted(r["search_id"] for r in got) == list(range(10)) and len({tuple(r["masks"]) for r in got}) > 1
    for r in got:
        dag = Dag.from_masks(dict(zip(names, r["masks"], strict=True)), names)
        assert ("v3", "v0") in dag.arcs and r["path"] == sorted(r["path"])
    assert abs(max(r["score"] for r in got) - top["score"]) < 1e-6
    with pytest.raises(ValueError, match="lacks arcs"):
        search.hill_climb(cache, names, "bic", 1, start=Dag.of(names))
    with pytest.raises(ValueError, match="at most"):
        search.heuristic(cache, names, "hc", "bic", 1)


def test_many_sets_take_seconds():
    rng, n, each = np.random.default_rng(3), 40, 50_000
    child = np.repeat(np.arange(n), each)
    mask = np.bitwise_or.reduce([1 << rng.integers(0, n, n * each) for _ in range(4)]) & ~(1 << child)
    mask[::each] = 0
    index = search.Index(n, child, mask, rng.normal(size=n * each), np.arange(n * each))
    since = time.time()
    for s in range(20):
        masks, path = search._climb(index, search._random_masks(index, np.random.default_rng(s)))
        assert not cyclic(masks) and path == sorted(path)
    # Two million sets, twenty searches.
    assert time.time() - since < 60
