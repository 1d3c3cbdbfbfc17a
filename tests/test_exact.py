"""Exact search by layers of the lattice, against all orders' dynamic program in one place."""

import numpy as np
import pytest

from dagwright.operators import exact, search


def cache_of(spark, n, rng, most=3, ties=False, keep=1.0):
    rows, k = [], 0
    for c in range(n):
        for mask in sorted(range(1 << n), key=lambda m: (m.bit_count(), m)):
            if mask >> c & 1 or mask.bit_count() > most or (mask and rng.random() > keep):
                continue
            v = float(rng.integers(0, 4)) if ties else float(rng.normal())
            rows.append((k, c, mask, mask.bit_count(), v))
            k += 1
    return rows, spark.createDataFrame(rows, "row_id long, child int, mask long, n_parents int, mlik double")


def whole(rows, n, prior):
    """(best, row) by child and subset, (score, last) by subset."""
    size = 1 << n
    best, row = np.full((n, size), -np.inf), np.full((n, size), -1)
    for k, c, mask, p, v in rows:
        v += search.prior_terms(n, p, prior)
        for s in range(size):
            if mask & ~s == 0 and v > best[c, s]:
                best[c, s], row[c, s] = v, k
    g, last = np.full(size, -np.inf), np.full(size, -1)
    g[0] = 0
    for s in range(1, size):
        for i in range(n):
            if s >> i & 1 and best[i, s ^ 1 << i] + g[s ^ 1 << i] > g[s]:
                g[s], last[s] = best[i, s ^ 1 << i] + g[s ^ 1 << i], i
    return best, row, g, last


@pytest.mark.parametrize(("n", "ties", "prior", "keep", "low"), [(5, False, 1, 1.0, None), (6, True, 1, 0.7, None), (5, False, 2, 1.0, 1), (3, True, 1, 1.0, 0), (7, True, 2, 0.5, 2)])
def test_layers_are_the_whole_program(spark, monkeypatch, n, ties, prior, keep, low):
    if low is not None:
        monkeypatch.setattr(exact, "LOW", low)
    rows, cache = cache_of(spark, n, np.random.default_rng(n), ties=ties, keep=keep)
    best, row, g, last = whole(rows, n, prior)
    alpha = {(r["child"], r["subset"]): (r["best"], r["row_id"]) for r in search.alpha_table(cache, n, "mlik", prior).collect()}
    assert alpha == {(c, s): (best[c, s], row[c, s]) for c in range(n) for s in range(1 << n) if not s >> c & 1}
    chain = {r["subset"]: (r["best"], r["last"]) for r in search.chain_table(cache, n, "mlik", prior).collect()}
    assert chain == {s: (g[s], last[s]) for s in range(1 << n)}
    want, s = {}, (1 << n) - 1
    while s:
        i = last[s]
        s ^= 1 << i
        want[i] = row[i, s]
    assert {r["child"]: r["row_id"] for r in search.best_rows(cache, n, "mlik", prior).collect()} == want


def test_many_networks_at_once(spark):
    """A column of the sets tells searches apart; each finds what it finds alone."""
    rng, n, every, want = np.random.default_rng(3), 4, [], {}
    for rep in range(5):
        rows, _ = cache_of(spark, n, rng, 2)
        best, row, _, last = whole(rows, n, 1)
        s = (1 << n) - 1
        while s:
            i = last[s]
            s ^= 1 << i
            want[rep, i] = row[i, s]
        every += [(rep, k, c, m, v, v) for k, c, m, _, v in rows]
    sets = spark.createDataFrame(every, "rep long, row_id long, child int, mask long, score double, value double")
    got = exact.best_sets(sets, n, ["rep"])
    assert {(r["rep"], r["child"]): r["row_id"] for r in got.collect()} == want


def test_a_node_without_sets_is_an_error(spark):
    _, cache = cache_of(spark, 4, np.random.default_rng(1))
    for some in (cache.filter("child <> 2"), cache.filter("child <> 0 OR mask > 0").filter("child <> 1 OR mask > 0").filter("child <> 2 OR mask > 0").filter("child <> 3 OR mask > 0"), cache.limit(0)):
        with pytest.raises(ValueError):
            search.best_rows(some, 4, "mlik")
