import random

import pytest
from oracle import connect, rows
from pyspark.sql import functions as F

from dagwright.llm import hamming


def brute(codes, queries, k):
    out = []
    for q, a in queries:
        best = sorted((bin((a ^ b) & (1 << 64) - 1).count("1"), i) for i, b in codes)[:k]
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("segments,k", [(4, 5), (8, 1), (8, 30)])
def test_is_brute_force(spark, segments, k):
    r = random.Random(segments)
    codes = [(i, r.getrandbits(64) - (1 << 63)) for i in range(60)]
    hot = codes[0][1]
    codes += [(100 + i, hot) for i in range(40)] + [(200 + i, hot ^ (1 << i)) for i in range(20)]
    queries = [codes[0], codes[5], (999, 0), codes[60]]
    index = spark.createDataFrame([*codes, (1000, None)], "id long, code long")
    asked = spark.createDataFrame([*queries, (1001, None)], "id long, code long")
    got = [tuple(x) for x in hamming.search(index, asked, k, segments).select("query_id", "rank", "id", "distance").collect()]
    assert sorted(got) == brute(codes, queries, k)


def test_vectors(spark):
    t = spark.createDataFrame([(0, [1.0] * 64, 1), (100, None, 2), (200, [None, float("nan")] + [1.0] * 62, 3), (3, [], 4), (None, [1.0] * 64, 5), (300, [1.0] * 64, 6)], "vec_id long, embedding array<double>, code int")
    got = {(r["query_id"], r["vec_id"]): r["distance"] for r in hamming.top_k_vectors(t, 3, segments=8).collect()}
    assert got == {(0, 0): 0, (0, 300): 0, (0, 200): 2, (300, 0): 0, (300, 300): 0, (300, 200): 2, (200, 200): 0, (200, 0): 2, (200, 300): 2}
    assert hamming.top_k_vectors(t.limit(0)).count() == 0


def test_query(spark, sf):
    got = hamming.op1_hamming_topk(spark, sf).toPandas()
    assert rows(got) == rows(connect(sf).execute(hamming.OP1_SQL).df())
    # exact: whatever brute force finds is found
    assert got.groupby("query_id").size().eq(10).all()


def test_sign_code(spark):
    t = spark.createDataFrame([([1.0, -1.0, 2.0],), (None,)], "embedding array<double>")
    assert [r[0] for r in t.select(hamming.sign_code()).collect()] == [5, None]
    assert spark.range(1).select(F.lit(1)).count() == 1
