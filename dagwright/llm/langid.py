"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import sliced, written

#: n-grams of one to three characters fall into so many buckets.
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Languages whose model is broadcast at once, 4 * BUCKETS bytes each (16 MB);
#: more are scored one such block after another.
TOGETHER = 64
#: Languages whose counts a task holds at once, 8 * BUCKETS bytes each (64 MB).
HELD = 128
#: Characters that are worked on at once.
BLOCK = 1 << 18
UNKNOWN = "und"

_alpha: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether a code point is a letter (Unicode L)."""
    if not _alpha:
        _alpha.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _alpha[0]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each n-gram, bucket of each n-gram, whether a document has a letter).

    Lower-cased; runs of anything but letters are one space; a space stands
    before and after each text; n-grams of spaces alone don't count.
    """
    low = [f" {x.lower()} " for x in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(low)), [len(x) for x in low])
    letter = _letters()[codes]
    # Of a run of others, the first; a text begins and ends with one.
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (of[1:] != of[:-1])
    keep[:1] = True
    c, of, letter = np.where(letter, codes, 32)[keep].astype(np.uint32), of[keep], letter[keep]
    docs, buckets = [], []
    for n in ORDERS:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        some = np.zeros(len(h), bool)
        for k in range(n):
            part = slice(k, len(c) - n + 1 + k)
            h = (h ^ c[part]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
            some |= letter[part]
        h *= np.uint32(0xC2B2AE35)
        some &= of[: len(h)] == of[n - 1 :]
        docs.append(of[: len(h)][some])
        buckets.append((h >> np.uint32(16))[some])
    has = np.zeros(len(texts), bool)
    has[of[letter]] = True
    return np.concatenate(docs) if docs else np.zeros(0, int), np.concatenate(buckets) if buckets else np.zeros(0, np.uint32), has


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Slices of texts of about BLOCK characters; a longer text is alone."""
    start = size = 0
    for i, x in enumerate(texts):
        if i > start and size + len(x) > BLOCK:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield start, len(texts)


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, log priors, and log probabilities (BUCKETS x languages)."""

    languages: list[str]
    prior: np.ndarray
    logp: np.ndarray

    @cached_property
    def usual(self) -> np.ndarray:
        """Mean log probability of a language's own n-grams."""
        return (np.exp(self.logp) * self.logp).sum(axis=0, dtype=np.float64)

    def weigh(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log prior and likelihood of each text under each language, and the number
        of its n-grams (-1 without a letter)."""
        texts = [x or "" for x in texts]
        whole, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for a, b in _blocks(texts):
            docs, buckets, has = _grams(texts[a:b])
            total = np.zeros((b - a, len(self.languages)))
            n[a:b] = np.where(has, np.bincount(docs, minlength=b - a), -1)
            order = np.argsort(docs, kind="stable")
            docs, buckets = docs[order], buckets[order]
            starts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]) if len(docs) else np.zeros(0, int)
            # Sparse: only the buckets that a text has are looked up, some documents at a time.
            for s in range(0, len(starts), 256):
                at = starts[s : s + 256]
                end = starts[s + 256] if s + 256 < len(starts) else len(docs)
                total[docs[at]] = np.add.reduceat(self.logp[buckets[at[0] : end]], at - at[0], axis=0, dtype=np.float64)
            whole[a:b] = total + self.prior
        return whole, n

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Predicted language and its posterior probability for each text."""
        best, name, rest, _, n = self.best(texts)
        ok = (n >= 0) & np.isfinite(best)
        p = np.exp(np.where(ok, best - rest, -np.inf))
        return [str(x) if o else UNKNOWN for x, o in zip(name, ok, strict=True)], p.tolist()

    def best(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """Of each text: the greatest weight, its language, ln of the sum of all
        weights' exponentials, the fit (see :func:`predict`), and the n-grams."""
        weight, n = self.weigh(texts)
        if not self.languages:
            none = np.full(len(texts), -np.inf)
            return none, np.full(len(texts), UNKNOWN, object), none, none, n
        at = weight.argmax(axis=1)
        top = weight[np.arange(len(at)), at]
        rest = top + np.log(np.exp(weight - top[:, None]).sum(axis=1))
        fit = (top - self.prior[at]) / np.maximum(n, 1) - self.usual[at]
        return top, np.array(self.languages, object)[at], rest, fit, n


def _counts(batches):
    """(lang, bucket, n) of a task's texts; bucket -1 counts the texts. A task holds
    HELD languages at most; beyond, it sends on what it counted and begins anew."""
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS + 1, np.int64))

    def sent():
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(np.where(at == BUCKETS, -1, at).astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])
        counts.clear()

    for batch in sliced(batches):
        by = defaultdict(list)
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by[lang].append(text or "")
        for lang, texts in by.items():
            if lang not in counts and len(counts) >= HELD:
                yield from sent()
            counts[lang][BUCKETS] += len(texts)
            for a, b in _blocks(texts):
                counts[lang][:BUCKETS] += np.bincount(_grams(texts[a:b])[1], minlength=BUCKETS)
    yield from sent()


@dataclass(frozen=True)
class Languages:
    """What training counted: n-grams by (lang, bucket), and of each language, in
    order, documents and n-grams."""

    counts: DataFrame
    names: list[str]
    docs: np.ndarray
    grams: np.ndarray
    smoothing: float

    def models(self) -> Iterator[LanguageModel]:
        """The model of TOGETHER languages after another."""
        prior = np.log(self.docs) - np.log(max(self.docs.sum(), 1))
        for a in range(0, max(len(self.names), 1), TOGETHER):
            names = self.names[a : a + TOGETHER]
            n = np.full((BUCKETS, len(names)), self.smoothing, np.float32)
            if names:
                # At most BUCKETS rows for a language, however large the corpus.
                rows = self.counts.filter(F.col("lang").between(names[0], names[-1]) & (F.col("bucket") >= 0))
                at = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("lang")).cast("int") - 1
                table = rows.select(at.alias("at"), "bucket", F.col("n").cast("float").alias("n")).toArrow()
                n[table.column("bucket").to_numpy(), table.column("at").to_numpy()] += table.column("n").to_numpy()
            whole = np.log(self.grams[a : a + TOGETHER] + self.smoothing * BUCKETS)
            yield LanguageModel(names, prior[a : a + TOGETHER], (np.log(n) - whole).astype(np.float32))


def train(labelled: DataFrame, smoothing: float = 0.1) -> Languages:
    """Fits the model on all rows of ``labelled`` (text, lang) with a non-null
    lang, of whatever number of languages; null texts count for the prior only.
    No rows: a model of no language."""
    rows = labelled.filter("lang is not null").select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(_counts, "lang string, bucket int, n long")
    counts = written(rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "ngrams")
    by = counts.groupBy("lang").agg(F.sum(F.when(F.col("bucket") < 0, F.col("n")).otherwise(0)).alias("docs"), F.sum(F.when(F.col("bucket") >= 0, F.col("n")).otherwise(0)).alias("grams"))
    # Languages are told apart, and sorted, by code point, as Spark's between() has it.
    found = sorted(by.collect(), key=lambda r: r[0].encode("utf-8", "surrogatepass"))
    return Languages(counts, [r[0] for r in found], np.array([r[1] for r in found], float), np.array([r[2] for r in found], float), smoothing)


_STATE = "_best", "_name", "_rest", "_fit", "_n"


def predict(documents: DataFrame, languages: Languages, fit: bool = False) -> DataFrame:
    """``documents`` with ``lang_pred`` (a learned language, ``und`` for a null
    text or one without a letter, or if nothing was learned) and ``score``, the
    prediction's posterior probability (0 for ``und``).

    With ``fit``, another column of that name: the mean log probability of the
    text's n-grams under its language, less the mean that the language's own have
    (null for ``und``): far under 0, the text is of no language that was learned,
    however sure the choice among these is. Ties go to the language that sorts
    first. Very long texts are worked on one by one. Repeated rows get equal
    predictions, an empty table stays empty. Other columns pass through; columns
    named lang_pred or score (or fit, if asked for) are replaced. Beyond TOGETHER
    languages a table is written between the blocks of them.
    """
    added = ["lang_pred", "score", *["fit"] * fit]
    kept = [F.col(f"`{c}`") for c in documents.columns if c not in added]
    # The state's columns have names that no column has.
    mark = "_" * max(map(len, documents.columns))
    state = [mark + c for c in _STATE]
    now = documents.select(*kept, F.lit(float("-inf")).alias(state[0]), F.lit(UNKNOWN).alias(state[1]), F.lit(float("-inf")).alias(state[2]), F.lit(None).cast("double").alias(state[3]), F.lit(0).cast("long").alias(state[4]))
    for k, model in enumerate(languages.models()):
        now = _judged(written(now, "judged") if k else now, model, state)
    best, name, rest, near, n = (F.col(c) for c in state)
    ok = (n > 0) & (best > float("-inf"))
    out = {"lang_pred": F.when(ok, name).otherwise(F.lit(UNKNOWN)), "score": F.when(ok, F.exp(best - rest)).otherwise(F.lit(0.0)), "fit": F.when(ok, near)}
    return now.select(*kept, *[out[c].alias(c) for c in added])


def _judged(now: DataFrame, model: LanguageModel, state: list[str]) -> DataFrame:
    """The state after one more model: the best language so far, and the sum."""
    shared = now.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for b in sliced(batches):
            best, name, rest, near, n = shared.value.best(b.column("text").to_pylist())
            old = [b.column(c).to_numpy(zero_copy_only=False) for c in state]
            more = best > old[0]
            cols = [np.where(more, best, old[0]), np.where(more, name, old[1]), np.logaddexp(rest, old[2]), np.where(more, near, old[3].astype(float)), n]
            others = [b.column(c) for c in b.schema.names if c not in state]
            yield pa.RecordBatch.from_arrays([*others, *[pa.array(c, t) for c, t in zip(cols, (pa.float64(), pa.string(), pa.float64(), pa.float64(), pa.int64()), strict=True)]], names=b.schema.names)

    return now.mapInArrow(rows, StructType([StructField(f.name, f.dataType) for f in now.schema]))


def held_out(doc_id: Column) -> Column:
    """Documents that a test keeps from training: a quarter, by CRC-32 of the id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(docs.filter("not held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
