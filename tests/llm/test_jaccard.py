import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, rows

from dagwright.llm import components, jaccard


def shingle_set(text):
    w = (text or "").encode()
    w = bytes(b + 32 if 65 <= b <= 90 else b for b in w).split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(docs):
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(docs))


def corpus(seed, n=120):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(40))
    passage = [word() for _ in range(60)]
    docs = []
    for i in range(n):
        if i and r.random() < 0.55:
            w = (docs[r.randrange(len(docs))][1] or "").split()
            for _ in range(r.randrange(0, 4)):
                if w:
                    w[r.randrange(len(w))] = word()
            if r.random() < 0.3:
                w = w[: max(1, int(len(w) * r.uniform(0.7, 1)))]
        else:
            w = [word() for _ in range(r.choice([0, 1, 2, 4, 5, 6, 30, 80, 200]))]
            if r.random() < 0.3:
                w += passage
        docs.append((i * 3, " ".join(w).upper() if r.random() < 0.2 else "\n".join([" ".join(w[:5]), " ".join(w[5:])])))
    return docs


def classes(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize("seed,frequent,tile,partners", [(1, 1 << 16, 4096, 4), (2, 1, 4096, 1), (3, 10, 5, 1), (4, 200, 3, 2)])
def test_is_brute_force(spark, monkeypatch, seed, frequent, tile, partners):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "PARTNERS", partners)
    docs = corpus(seed)
    got = classes(jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == brute(docs)


def test_odd_tables(spark):
    schema = "doc_id long, text string, fp string, n int, component_id int, label int"
    assert jaccard.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(str(i % 977) + "x" for i in range(60_000))
    t = spark.createDataFrame([(5, None, "a", 1, 2, 3), (6, "", "a", 1, 2, 3), (7, " \n\t", "a", 1, 2, 3), (8, "One two", None, None, None, None), (3, "one\x0btwo", "", 0, 0, 0), (8, "one two", "b", 1, 1, 1), (9, long, "", 0, 0, 0), (2, long, "", 0, 0, 0), (4, "one two", "", 0, 0, 0)], schema)
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(t).collect())
    assert got == [(2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 3), (8, 3), (9, 2)]
    kept = jaccard.keep_one(t)
    assert kept.columns == t.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5, 6, 7]


def test_one_row_of_a_class_is_kept(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "xyz")
    schema = "doc_id long, text string, k string, best int, root int, note map<string,int>"
    rows_ = [(1, a), (1, a), (1, b), (2, b), (3, a), (None, a), (None, c), (None, c), (4, None), (4, None), (5, ""), (7, c + " more")]
    t = spark.createDataFrame([(*r, "k", 1, 2, {"m": 1}) for r in rows_], schema)
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.keep_one(t).collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (4, None), (4, None), (5, ""), (7, c + " more")], key=str)
    only = spark.createDataFrame([(None, c), (None, c), (None, c + " d")], "doc_id string, text string")
    assert jaccard.keep_one(only).count() == 1 and jaccard.keep_one(only.limit(0)).count() == 0


def test_query(spark, sf):
    got = jaccard.op2_jaccard(spark, sf).toPandas()
    assert rows(got) == rows(connect(sf).execute(jaccard.OP2_SQL).df())


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1, max_size=120), st.sets(st.integers(0, 400), min_size=1, max_size=120), st.integers(0, 100))
def test_bounds_never_lose_a_link(a, b, share):
    b = set(list(a)[: len(a) * share // 100]) | set(list(b)[: max(0, len(a) * (100 - share) // 100)]) or b
    x, y = (np.unique(jaccard.mix64(np.array(sorted(s), np.uint64))) for s in (a, b))
    link = 100 * len(a & b) >= 80 * len(a | b)
    assert jaccard.linked(x, y) == link
    if link:
        assert jaccard.may_link(len(x), jaccard.bitmap(x), len(y), jaccard.bitmap(y))
        small, large = sorted((x, y), key=len)
        first = np.intersect1d(x, y)[0]
        assert np.searchsorted(large, first) < jaccard.prefix_sizes(len(large))[0]
        assert np.searchsorted(small, first) < jaccard.prefix_sizes(len(small))[1]


@settings(max_examples=15, deadline=None)
@given(edges=st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}
