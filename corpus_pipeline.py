"""From raw documents to token ids, in five stages; part of ``dagwright.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagwright.llm import bpe, jaccard, langid, line_dedup, mixing
from dagwright.llm.common import written

#: A document whose language is less probable than this among the learned ones is
#: rejected, and one whose n-grams fit it so many nats worse than its own do.
MIN_LANGUAGE_SCORE, MIN_FIT = 0.5, -3.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language that the labelled ones teach; ``lang``
    becomes the predicted language."""
    # Columns that are named like a prediction's step aside.
    aside = {c: "_" * max(map(len, docs.columns)) + c for c in docs.columns if c in ("lang_pred", "score", "fit")}
    known = langid.predict(docs.withColumnsRenamed(aside), langid.train(docs), fit=True)
    known = known.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE) & (F.col("fit") >= MIN_FIT))
    return known.select(*[F.col(f"`{aside.get(c, 'lang_pred' if c == 'lang' else c)}`").alias(c) for c in docs.columns])


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later occurrences of repeated three-line windows; every document
    stays, ``n_chars`` follows its text."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and thins documents towards their sources' targets."""
    return mixing.mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every document."""
    import public_tokenizers

    ids = bpe.encode(docs, str(public_tokenizers.path("byte_bpe_50k.json")))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language identification is no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
