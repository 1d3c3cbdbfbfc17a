"""Exact top-k search over binary codes: incremental multi-index hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Width of a code; one bit for each dimension.
BITS = 64


def sign_code(vector: str = "embedding") -> Column:
    """64-bit code of a vector: bit i is set where dimension i is above 0. Null
    and NaN entries and missing dimensions leave a bit at 0; a vector of more
    dimensions than a code has bits is an error. A null vector has a null code."""
    fits = F.when(F.size(vector) <= BITS, F.lit(True)).otherwise(F.raise_error(F.lit(f"a vector has over {BITS} dimensions")).cast("boolean"))
    code = F.expr(
        f"aggregate(slice({vector}, 1, {BITS}), named_struct('c', 0L, 'i', 0), "
        "(s, x) -> named_struct('c', s.c | if(coalesce(x > 0 and not isnan(x), false), shiftleft(1L, s.i), 0L), 'i', s.i + 1), s -> s.c)"
    )
    return F.when(F.col(vector).isNotNull() & fits, code)


def _segment(code: str, j: int, width: int) -> str:
    return f"cast(shiftrightunsigned({code}, {j * width}) & {(1 << width) - 1}L as int)"


def search(index: DataFrame, queries: DataFrame, k: int = 10, segments: int = 4) -> DataFrame:
    """The k nearest rows of ``index`` (id, code) for each row of ``queries``
    (id, code), by (Hamming distance, id): ``(query_id, rank, id, distance)``.

    Codes are cut into ``segments`` parts. If two codes differ in at most
    ``segments * (r + 1) - 1`` bits, one part differs in at most r. So level r
    probes every part with every mask of weight r, verifies whole codes, and a
    query is done once its kth distance is at most ``segments * (r + 1) - 1``:
    nothing nearer can be left unseen. Level r = part width covers all codes.
    Codes are verified within the join, which lets through only what is as near
    as the kth neighbour found so far.

    Rows with one code are one entry of the index, with their k smallest ids, so
    a code that many rows share costs what a single one does; equal query codes
    are searched once. Rows with a null code or id are neither found nor searched; with
    fewer than k rows in the index, all are returned. Ties go to smaller ids.
    Rows that repeat an id are rows of their own.
    """
    width = BITS // segments
    # Two ranks: the first, by salt, thins a code that very many rows share.
    salt = F.pmod(F.hash("id"), F.lit(64))
    thin = Window.partitionBy("code", "salt").orderBy("id")
    ids = (
        index.filter("code is not null and id is not null")
        .withColumn("salt", salt)
        .withColumn("n", F.row_number().over(thin))
        .filter(F.col("n") <= k)
        .groupBy("code")
        .agg(F.slice(F.sort_array(F.collect_list("id")), 1, k).alias("ids"))
    )
    ids = written(ids, "codes")
    parts = F.explode(F.array(*[F.struct(F.lit(j).alias("part"), F.expr(_segment("code", j, width)).alias("value")) for j in range(segments)]))
    table = written(ids.select("code", "ids", parts.alias("p")).select("p.*", "code", "ids"), "parts")
    todo = written(queries.filter("code is not null").select(F.col("code").alias("q")).distinct().withColumn("bound", F.lit(BITS)), "queries")
    best = None
    done: list[DataFrame] = []
    xor = "(q ^ code)"
    apart = [f"bit_count({_segment(xor, j, width)})" for j in range(segments)]
    for level in range(width + 1):
        masks = F.expr(f"filter(sequence(0, {(1 << width) - 1}), m -> bit_count(m) = {level})")
        # Few rows become many: they are dealt out first.
        probe = todo.repartition(2 * todo.sparkSession.sparkContext.defaultParallelism, "q").select("q", "bound", F.explode(masks).alias("mask")).select(
            "q", "bound", F.explode(F.array(*[F.struct(F.lit(j).alias("part"), (F.expr(_segment("q", j, width)).bitwiseXOR(F.col("mask"))).alias("value")) for j in range(segments)])).alias("p")
        ).select("q", "bound", "p.*")
        # The planner sees the probes' size from before the explode: no broadcast.
        # A pair meets again at other parts and levels; it counts where its nearest part lies.
        nearest = f"least({', '.join(apart)})" if segments > 1 else apart[0]
        first = f"part = array_position(array({', '.join(apart)}), {nearest}) - 1"
        met = probe.hint("merge").join(table, ["part", "value"])
        met = met.filter(F.expr(f"bit_count({xor}) <= bound and {nearest} = {level} and {first}"))
        found = met.select("q", F.expr(f"bit_count({xor})").alias("distance"), F.explode("ids").alias("id"))
        if best is not None:
            found = best.unionByName(found)
        top = Window.partitionBy("q").orderBy("distance", "id")
        covered = segments * (level + 1) - 1 if level < width else BITS
        best = found.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)
        full = F.count(F.lit(1)).over(Window.partitionBy("q")) >= k
        kth = F.max("distance").over(Window.partitionBy("q"))
        best = written(best.withColumn("done", (full & (kth <= covered)) | F.lit(level == width)), "best")
        done.append(best.filter("done").select("q", "rank", "id", "distance"))
        best = best.filter("not done").select("q", "distance", "id")
        kth = best.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("kth"))
        todo = todo.join(done[-1].select("q").distinct(), "q", "left_anti").join(kth, "q", "left")
        todo = written(todo.select("q", F.least("bound", F.coalesce("kth", F.lit(BITS))).alias("bound")), "queries")
        if level == width or todo.isEmpty():
            break
    hits = done[0]
    for more in done[1:]:
        hits = hits.unionByName(more)
    asked = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q"))
    return asked.join(hits, "q").select("query_id", "rank", "id", "distance")


def top_k_vectors(vectors: DataFrame, k: int = 10, every: int = 100, segments: int = 4) -> DataFrame:
    """Searches all rows of ``vectors`` (vec_id, embedding) for every row whose
    vec_id is divisible by ``every``: ``(query_id, rank, vec_id, distance)``.
    A query finds itself too. Rows with a null vec_id or embedding are left out."""
    codes = written(vectors.select(F.col("vec_id").alias("id"), sign_code().alias("code")), "sign-codes")
    return search(codes, codes.filter(F.col("id") % every == 0), k, segments).withColumnRenamed("id", "vec_id")


def op1_hamming_topk(spark, sf_dir: str) -> DataFrame:
    return top_k_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH codes AS (
  SELECT vec_id, CAST(array_to_string([CASE WHEN x > 0 THEN '1' ELSE '0' END FOR x IN embedding], '') AS BIT) AS code FROM embeddings
), pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(bit_count(xor(q.code, v.code)) AS INTEGER) AS distance
  FROM codes q, codes v WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance FROM pairs
)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""
