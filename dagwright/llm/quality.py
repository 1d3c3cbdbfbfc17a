"""Quality rules: base counts, and bands of n-gram perplexity by language."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kneser_ney
from .common import SPACES, mix64, sliced, written

#: Fixed value: the symbols that the rules count.
SYMBOLS = "#*$%&|<>"
#: A document passes with log2 perplexity within so many robust standard
#: deviations (1.4826 times the median deviation) of its language's median.
BAND = (3.5, 3.5)
#: The deviation counts as this share of the median at least.
LEAST_SPREAD = 0.005
#: A text counts as if it had so many more symbols of the median's bits: what a
#: short one shows is little.
PRIOR = 300
MIN_WORDS, WINDOW, REPEATED = 10, 5, 20
#: Name of the group of documents without a language.
NO_LANGUAGE = "und"
#: Characters of a block of documents.
BLOCK = 1 << 22


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text and
    its words."""
    chars = len(text) - sum(map(text.count, SPACES))
    lines = Counter(x for x in text.encode("utf-8", "surrogatepass").split(b"\n") if x.split()) if "\n" in text else {}
    dup = sum(n - 1 for n in lines.values())
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, _repeated(words)


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a 5-word window which the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    w = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        w = w * np.uint64(0x9E3779B97F4A7C15) + h[i : n + i]
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    inside = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(inside, at, 1)
    np.add.at(inside, at + WINDOW, -1)
    return int((np.cumsum(inside) > 0).sum())


def _groups(langs: list, words: list[list[bytes]], other: bool) -> dict[str, list[int]]:
    """Documents by language and half; a document's half is a hash of its words, so
    that copies are in one. ``other``: by the half that they are not in."""
    out: dict[str, list[int]] = {}
    for i, (lang, w) in enumerate(zip(langs, words, strict=True)):
        if w:
            half = (xxhash.xxh3_64_intdigest(b" ".join(w)) & 1) ^ other
            out.setdefault(f"{half}{lang or NO_LANGUAGE}", []).append(i)
    return out


def _words(batch) -> list[list[bytes]]:
    return [x.as_py().encode("utf-8", "surrogatepass").split() if x.is_valid else [] for x in batch.column("text")]


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")


def train(documents: DataFrame) -> DataFrame:
    """Tables of the models, two for each language (null: ``und``): each half of
    all documents has one, and the other half is judged by it. No text is judged
    by a model that has seen it or a copy of it."""

    def groups(batches):
        for b in sliced(batches):
            words = _words(b)
            for group, at in _groups(b.column("lang").to_pylist(), words, False).items():
                yield group, [words[i] for i in at]

    return kneser_ney.fit(_texts(documents).mapInArrow(lambda batches: kneser_ney.count(groups(batches)), kneser_ney.COUNTS))


_MEASURES = "lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ppl double"
_NAMES = ["doc_id", *(x.split()[0] for x in _MEASURES.split(", "))]


def _measured(batch, scorer: kneser_ney.Scorer):
    """The measures of a batch of documents."""
    langs, words = batch.column("lang").to_pylist(), _words(batch)
    base = [base_counts(x.as_py() or "", w) for x, w in zip(batch.column("text"), words, strict=True)]
    cols = [np.array(c, np.int64) for c in zip(*base, strict=True)] or [np.zeros(0, np.int64)] * 5
    bits = np.full(len(words), np.nan)
    for group, at in _groups(langs, words, True).items():
        bits[at] = scorer.bits(group, [words[i] for i in at])
    # A text's symbols: the words' characters, the spaces between them and the end.
    ppl = bits / np.maximum(cols[0] + cols[1], 1)
    return [batch.column("doc_id"), pa.array([x or NO_LANGUAGE for x in langs], pa.string()), *map(pa.array, cols), pa.array(ppl, mask=np.isnan(ppl))]


def measure(documents: DataFrame, tables: DataFrame) -> DataFrame:
    """``(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, log_ppl)``; log_ppl is bits per symbol under the model of the
    language's other half, null without words or without such a model."""
    docs = _texts(documents)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, {_MEASURES}"
    known, whole = kneser_ney.hot(tables)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    if not whole:
        return _measure_blocks(docs, tables, shared, schema)

    def rows(batches):
        scorer = kneser_ney.Scorer([shared.value])
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays(_measured(b, scorer), names=_NAMES)

    return docs.mapInArrow(rows, schema)


def _measure_blocks(docs: DataFrame, tables: DataFrame, shared, schema: str) -> DataFrame:
    """As :func:`measure` with models beyond what is broadcast: blocks of documents
    get the other entries that they ask for by a join."""
    n = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    where = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n // BLOCK + 1)).alias("block")
    blocks = docs.select("*", where)

    def ask(table: pa.Table) -> pa.Table:
        words, out = _words(table), []
        for group, at in _groups(table.column("lang").to_pylist(), words, True).items():
            for k, keys in kneser_ney.wanted(shared.value, group, [words[i] for i in at]):
                size = len(keys)
                out.append([pa.array(np.full(size, table.column("block")[0].as_py())), pa.array([group] * size, pa.string()), pa.array(np.full(size, k, np.int32)), pa.array(keys.view(np.int64))])
        kinds = pa.int64(), pa.string(), pa.int32(), pa.int64()
        cols = [pa.chunked_array([x[i] for x in out], t) for i, t in enumerate(kinds)]
        return pa.Table.from_arrays(cols, names=["block", "grp", "k", "key"])

    asked = blocks.groupBy("block").applyInArrow(ask, "block long, grp string, k int, key long")
    given = asked.join(tables.select("grp", "k", "key", "p").hint("merge"), ["grp", "k", "key"])

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = (right.column(c).to_pylist() for c in ("grp", "k"))
        key, p = right.column("key").to_numpy().view(np.uint64), right.column("p").to_numpy()
        at: dict[tuple, list[int]] = {}
        for i, pair in enumerate(zip(names, kinds, strict=True)):
            at.setdefault(pair, []).append(i)
        rest = kneser_ney.sorted_tables((*pair, key[i], p[i]) for pair, i in at.items())
        return pa.Table.from_arrays([x if isinstance(x, pa.Array) else x.combine_chunks() for x in _measured(left, kneser_ney.Scorer([shared.value, rest]))], names=_NAMES)

    return blocks.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(tell, schema)


def bands(measured: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """``(lang, mid, lower, upper)``: the median of log_ppl, and the bands of
    :func:`leaned` around it, ``band[0]`` robust standard deviations down and
    ``band[1]`` up, over all documents that have a log_ppl. Values are counted in
    steps of 0.001, so a language has a bounded number of them."""
    steps = lambda v, *by: by[0].groupBy("lang", *by[1:], F.round(v, 3).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    seen = measured.filter("log_ppl is not null")
    mid = steps(F.col("log_ppl"), seen).groupBy("lang").agg(F.expr("percentile(v, 0.5, n)").alias("mid"))
    off = steps(F.abs(leaned() - F.col("mid")), seen.join(mid, "lang"), "mid").groupBy("lang", "mid").agg(F.expr("percentile(v, 0.5, n)").alias("mad"))
    spread = F.greatest(1.4826 * F.col("mad"), LEAST_SPREAD * F.col("mid"))
    return off.select("lang", "mid", (F.col("mid") - band[0] * spread).alias("lower"), (F.col("mid") + band[1] * spread).alias("upper"))


def leaned():
    """log_ppl, leaned towards ``mid`` by PRIOR symbols."""
    n = F.col("word_chars") + F.col("n_words")
    return F.col("mid") + (F.col("log_ppl") - F.col("mid")) * n / (n + PRIOR)


def judge(documents: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Quality verdict on every row of ``documents`` (doc_id, text, lang):
    ``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, lang, log_ppl, leaned, lower, upper)``.

    base_failed: fewer than 10 words, or over 20 % of the words in 5-word windows
    that the text repeats. kept: not base_failed, and the text's log2 perplexity
    per symbol, leaned towards the median where the text is short, within the
    bands of its language (null: a language of its own), under a model of the
    half of that language's documents that the text is not in; see :func:`train`.
    A table may have any number of languages; one whose other half is empty has
    no perplexity to judge by (null), and the base rules decide. Null, empty and
    white-space texts have no words and fail. A very long text is worked on in
    pieces. Repeated rows fare alike; an empty table gives an empty table; other
    columns are ignored.
    """
    measured = written(measure(documents, train(documents)), "measured")
    out = measured.join(bands(measured, band), "lang", "left").withColumn("leaned", leaned())
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    inside = F.col("leaned").isNull() | F.col("leaned").between(F.col("lower"), F.col("upper"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & inside).alias("kept"), "lang", "log_ppl", "leaned", "lower", "upper"
    )


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
