"""Line dedup over overlapping three-line windows (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, written


#: A line is known by its length and two independent hashes, a window by those of its lines.
_HASH = "struct(xxhash64({0}) AS a, hash({0}) AS b, length({0}) AS n)"


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n")


def _line(x: Column) -> Column:
    """Two independent hashes of a line, 128 bits, and whether it has a word."""
    return F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), (F.length(F.translate(x, SPACES, "")) > 0).alias("word"))


def repeated_positions(documents: DataFrame) -> DataFrame:
    """Line positions to remove: ``(doc_id, text_hash, covered)``, one row for
    each document that has any, ``covered`` the merged, distinct positions."""
    hashed = documents.filter(F.col("text").contains("\n")).select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.transform(_lines("text"), _line).alias("l"),
    )
    three = F.expr("transform(sequence(0, size(l) - 3), i -> struct(i AS pos, l[i] AS a, l[i+1] AS b, l[i+2] AS c))")
    windows = (
        hashed.filter("size(l) >= 3")
        .select("doc_id", "text_hash", F.explode(three).alias("x"))
        .filter("x.a.word or x.b.word or x.c.word")
        .select("doc_id", "text_hash", F.col("x.pos").alias("pos"), F.xxhash64("x.a.h", "x.b.h", "x.c.h").alias("w"), F.xxhash64("x.a.g", "x.b.g", "x.c.g").alias("v"))
    )
    windows = written(windows, "windows")
    here = F.struct("doc_id", "pos", "text_hash")
    # Partial aggregation: a window that a third of the corpus has is one row per task here.
    firsts = windows.groupBy("w", "v").agg(F.count(F.lit(1)).alias("n"), F.min(here).alias("first")).filter("n > 1").select("w", "v", "first")
    later = windows.join(firsts, ["w", "v"]).filter(~here.eqNullSafe(F.col("first")))
    return (
        later.groupBy("doc_id", "text_hash")
        .agg(F.collect_set("pos").alias("at"))
        .select("doc_id", "text_hash", F.array_distinct(F.flatten(F.transform("at", lambda p: F.array(p, p + 1, p + 2)))).alias("covered"))
    )


def dedup_lines(documents: DataFrame) -> DataFrame:
    """``documents`` with the lines removed that later occurrences of repeated
    three-line windows cover; adds ``n_lines`` and ``n_removed`` (long).

    Lines are what ``\\n`` separates. A window is three consecutive lines with a
    word in one at least, known by 128 bits of hashes of its lines. The occurrence with
    the smallest (doc_id, position) anywhere stays; every other one covers its
    three positions, covered positions are merged, and their lines go. Texts of
    fewer than three lines stay as they are, as do null and empty texts (1 line
    for an empty text, 0 for null). A document all of whose lines go has an
    empty text. Rows that repeat doc_id and text are one occurrence and fare
    alike. A null doc_id comes before all others. An empty table gives an empty
    table. Extra columns pass through; one named n_lines or n_removed is
    replaced.
    """
    extra = [c for c in documents.columns if c not in ("doc_id", "text", "n_lines", "n_removed")]
    # A struct has one field at least; its name must not be a column's.
    filler = "_" * (1 + max(map(len, documents.columns)))
    row = F.struct(F.lit(0).alias(filler), *[F.col(f"`{c}`") for c in extra]).alias("row")
    left = documents.select("doc_id", "text", row, F.xxhash64("text").alias("text_hash"))
    gone = repeated_positions(documents.select("doc_id", "text")).select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash"), "covered")
    joined = left.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("text_hash") == F.col("g_hash")), "left")
    # Within the lambda the split lines are one bound value, not split again for every position.
    rest = F.expr(
        "transform(array(struct(split(text, '\\n') AS l, covered AS c)), s -> "
        "array_join(transform(array_except(sequence(0, size(s.l) - 1), s.c), i -> s.l[i]), '\\n'))[0]"
    )
    lines = F.coalesce(F.length("text") - F.length(F.translate("text", "\n", "")) + 1, F.lit(0)).cast("long")
    out = joined.select(
        "doc_id",
        F.when(F.col("covered").isNull(), F.col("text")).otherwise(rest).alias("text"),
        "row",
        lines.alias("n_lines"),
        F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"),
    )
    places = {c: F.col(f"row.`{c}`").alias(c) for c in extra}
    return out.select(*[places.get(c, F.col(c)) for c in documents.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs)


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents
), windows AS (
  SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS pos FROM lines WHERE len(l) >= 3
), keyed AS (
  SELECT doc_id, pos, l[pos + 1] || chr(10) || l[pos + 2] || chr(10) || l[pos + 3] AS w FROM windows
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS rn
  FROM keyed WHERE regexp_matches(w, '[^\x20\x09-\x0D]')
), covered AS (
  SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM ranked WHERE rn > 1
), each_line AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM lines
), kept AS (
  SELECT e.doc_id, string_agg(CASE WHEN c.pos IS NULL THEN line END, chr(10) ORDER BY e.pos) AS text,
         count(*) AS n_lines, count(c.pos) AS n_removed
  FROM each_line e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.pos = c.pos GROUP BY e.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(CASE WHEN d.text IS NULL THEN 0 ELSE coalesce(k.n_lines, 1) END AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
