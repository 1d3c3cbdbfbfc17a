"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, uniform, written

#: More sources than this are joined by shuffle; fewer are broadcast (at most a few MB).
BROADCAST_SOURCES = 20_000


def _running(df: DataFrame, order: list, **sums) -> DataFrame:
    """``df`` with the sum of each of ``sums`` over the rows before a row in an
    order: rows are sorted in ranges and added up within each; what comes before a
    range is one row for each range."""
    at = written(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    whole = at.groupBy("range").agg(*[F.sum(v).alias(f"{k}_range") for k, v in sums.items()])
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("range", *[F.coalesce(F.sum(f"{k}_range").over(before), F.lit(0)).alias(f"{k}_range") for k in sums])
    here = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = at.join(F.broadcast(whole), "range")
    return joined.select(*df.columns, *[(F.col(f"{k}_range") + F.coalesce(F.sum(v).over(here), F.lit(0))).cast("long").alias(k) for k, v in sums.items()])


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """Target size of each source: ``(source, source_size, target)``.

    ``sizes`` has ``source`` and ``size``. Sources in code-point order, null
    last, get the weights in turn and share ``share[0] / share[1]`` of all
    sizes; no target exceeds ``cap`` times its source's size, and what is over
    goes to the others by weight until none is above. That fixed point is a
    water level: with sources by size / weight, the first ones are full, and all
    others hold level * weight. If even all caps hold less than the share, every
    source is full. A source of size 0 gets 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    up, down = share
    # There may be as many sources as hosts: both orders are made in ranges, not in one task.
    ranked = _running(per, [F.col("source").isNull(), F.col("source")], rank=F.lit(1).cast("long"))
    ranked = ranked.withColumn("w", F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    filled = _running(ranked, [F.col("source_size") / F.col("w"), F.col("rank")], full=F.col("source_size"), before_w=F.col("w"))
    every = filled.agg(F.sum("source_size").alias("total"), F.sum("w").alias("all_w"))
    level = (
        filled.join(F.broadcast(every), F.lit(True))
        .withColumn("rest_w", F.col("all_w") - F.col("before_w"))
        # level if this source and all after it are not full, times down
        .withColumn("num", F.lit(up) * F.col("total") - F.lit(down * cap) * F.col("full"))
        .withColumn("open", F.col("num") <= F.lit(down * cap) * F.col("rest_w") * (F.col("source_size") / F.col("w")))
    )
    # The first open source in fill order fixes the level: one row, as the sums above.
    first = level.agg(F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("w"), F.col("rank"), F.col("num"), F.col("rest_w")))).alias("at"))
    fixed = filled.join(F.broadcast(first), F.lit(True))
    share_of = F.col("at.num") / (F.lit(down) * F.col("at.rest_w")) * F.col("w")
    return fixed.select(
        "source",
        "source_size",
        F.when(F.col("at").isNull(), F.lit(float(cap)) * F.col("source_size"))
        .otherwise(F.least(F.lit(float(cap)) * F.col("source_size"), share_of))
        .alias("target"),
    )


def _with_targets(docs: DataFrame, weights, share, cap) -> DataFrame:
    """``docs`` (source, size, ...) with source_size, target and copies."""
    targets = written(source_targets(docs, weights, share, cap), "targets").withColumnRenamed("source", "source_of")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return docs.join(targets, F.col("source").eqNullSafe(F.col("source_of"))).drop("source_of").withColumn("rate", rate)


def copies(doc_id, rate, seed: int):
    """floor(rate) copies plus one with probability rate - floor(rate)."""
    whole = F.floor(rate)
    return (whole + F.when(uniform(doc_id, seed) < rate - whole, 1).otherwise(0)).cast("long")


def mix_sources(
    documents: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: tuple[int, int] = (3, 2),
    cap: int = 2,
    seed: int = 17,
) -> DataFrame:
    """The mixed documents: each of ``documents`` floor(rate) times, and once
    more with probability rate - floor(rate), drawn from a hash of its doc_id.

    Columns and rows are those of the input, repeated; ``rate`` is the source's
    target over its size. A null source is a source of its own, a null or empty
    text has size 0 and follows its source's rate, rows with one doc_id share
    one draw, a null doc_id draws as an empty one. An empty table gives an empty
    table. Extra columns, whatever their names, pass through untouched.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    sized = documents.select(row, F.col("doc_id"), F.col("source").alias("source"), n_words(F.col("text")).alias("size"))
    targets = written(source_targets(sized, weights, share, cap), "targets").select(F.col("source").alias("source_of"), "source_size", "target")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    n = copies(F.col("doc_id"), rate, seed)
    out = sized.join(targets, F.col("source").eqNullSafe(F.col("source_of"))).withColumn("n", n).filter("n > 0")
    return out.select("row", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).select("row.*")


def mix_report(documents: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), cap: int = 2, seed: int = 17) -> DataFrame:
    """What :func:`mix_sources` takes of each document: ``(doc_id, size,
    source_size, target, taken)``; sizes and taken count words."""
    sized = written(documents.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    return _with_targets(sized, weights, share, cap).select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * copies(F.col("doc_id"), F.col("rate"), seed)).cast("long").alias("taken")
    )


def op5_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM per
), filled AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(w) OVER () AS BIGINT) AS all_w,
         CAST(coalesce(sum(source_size) OVER f, 0) AS BIGINT) AS full_size, CAST(coalesce(sum(w) OVER f, 0) AS BIGINT) AS full_w
  FROM ranked WINDOW f AS (ORDER BY source_size / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), opened AS (
  SELECT *, 3 * total - 4 * full_size AS num, all_w - full_w AS rest_w FROM filled
), level AS (
  SELECT num, rest_w FROM opened WHERE num <= 4 * rest_w * (source_size / w) ORDER BY source_size / w, rank LIMIT 1
), targets AS (
  SELECT source, source_size,
         coalesce(least(2.0::DOUBLE * source_size, (SELECT num / (2 * rest_w) FROM level) * w), 2.0::DOUBLE * source_size) AS target
  FROM ranked
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         CAST(('0x' || substr(md5(coalesce(CAST(s.doc_id AS VARCHAR), '') || '|17'), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""
