"""Phrase collocations: frequent word sequences level by level, scored at their weakest cut."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, mix64, sliced, written

#: Words of a block, at most; memory, not results, depends on it.
BLOCK = 2_000_000
#: Bytes of different words in a block, at most.
WORD_BYTES = 1 << 25
#: Bytes of a text that are split together.
STRETCH = 1 << 18
#: The table that says which phrases of a level are frequent has 2^BITS bits, 8 MB, at any size of the corpus.
BITS = 26

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: Every separator becomes a line feed, a tab a space.
_PLAIN = bytes.maketrans(_SEPARATORS + b"\t", b"\n" * len(_SEPARATORS) + b" ")
_GAP, _SKIP = -1, -2


def _hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode() + b" " + word)


def _longer(phrases: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word each."""
    return mix64(phrases * np.uint64(0x9E3779B97F4A7C15) + words)


# --- Which phrases of a level are frequent: a table of bits ---


def frequent_bits(level: DataFrame):
    """Broadcast for the next level: a table of 2^``BITS`` bits with one set for
    each (lang, phrase) of ``level``.

    It may say yes to a phrase that isn't frequent, never no to one that is. The
    next level counts what it emits in full, so results don't depend on it: its
    size is fixed, and a corpus with more frequent phrases than it can tell apart
    emits more to count. What the driver gets is one row for each 64 bits with
    one set, at most 2^20 rows.
    """

    def bits(batches):
        for b in batches:
            at = np.empty(b.num_rows, np.uint64)
            for i, (lang, phrase) in enumerate(zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist(), strict=True)):
                h = None
                for w in phrase.encode().split(b" "):
                    x = np.array([_hash(lang, w)], np.uint64)
                    h = x if h is None else _longer(h, x)
                at[i] = h[0] >> np.uint64(64 - BITS)
            slot, bit = (at >> np.uint64(6)).astype(np.int32), (at & np.uint64(63)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(bit)], names=["slot", "bit"])

    rows = level.select("lang", "phrase").mapInArrow(bits, "slot int, bit int")
    table = rows.groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("word")).toArrow()
    slots, words = table.column("slot").to_numpy(), table.column("word").to_numpy().view(np.uint64)
    return level.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, slots, words))


_tables: dict[str, np.ndarray] = {}


def _table(spec, most: int) -> np.ndarray:
    """The table of a broadcast, one for each worker process."""
    name, slots, words = spec.value
    if name not in _tables:
        while len(_tables) >= most:
            _tables.pop(next(iter(_tables)))
        _tables[name] = np.zeros(1 << BITS - 6, np.uint64)
        _tables[name][slots] = words
    return _tables[name]


def _has(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - BITS)
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


# --- Texts as numbered words ---


class _Words(dict):
    """Numbers of the words of one language in a block."""

    def __init__(self, lang: str, block: Blocks):
        super().__init__({b"": _SKIP, b"\n": _GAP})
        self.lang, self.block = lang, block

    def __missing__(self, word: bytes) -> int:
        block = self.block
        n = self[word] = len(block.words)
        block.words.append(word)
        block.langs.append(block.lang_of[self.lang])
        block.bytes += len(word) + 100
        return n


class Blocks:
    """Turns a stream of texts into blocks of numbered words. A block inside a text
    ends with the ``overlap`` words that the next one begins with: phrases belong to
    the block that has their first word among its own."""

    def __init__(self, overlap: int):
        self.overlap = overlap
        self.rest: list[tuple[str, bytes] | None] = []
        self._new()

    def _new(self) -> None:
        self.words: list[bytes] = []
        self.langs: list[int] = []
        self.lang_of: dict[str, int] = {}
        self.by_lang: dict[str, _Words] = {}
        self.parts: list[np.ndarray] = []
        self.n = self.bytes = 0
        if self.rest:
            self.parts.append(np.array([_GAP if x is None else self._index(x[0])[x[1]] for x in self.rest], np.int32))
            self.rest = []

    def _index(self, lang: str) -> _Words:
        if lang not in self.by_lang:
            self.lang_of[lang] = len(self.lang_of)
            self.by_lang[lang] = _Words(lang, self)
            self.bytes += 1000
        return self.by_lang[lang]

    def add(self, lang: str, text: str) -> Iterator[pa.RecordBatch]:
        """Takes a text; yields blocks that are full."""
        raw = text.encode("utf-8", "surrogatepass").lower().translate(_PLAIN)
        at = 0
        while at < len(raw):
            end = at + STRETCH
            if end < len(raw):  # between two words
                ends = [x for x in (raw.find(b" ", end), raw.find(b"\n", end)) if x >= 0]
                end = min(ends, default=len(raw))
            tokens = raw[at:end].replace(b"\n", b" \n ").split(b" ")
            ids = np.fromiter(map(self._index(lang).__getitem__, tokens), np.int32, len(tokens))
            self.parts.append(ids[ids != _SKIP])
            self.n += len(self.parts[-1])
            at = end
            if self.n >= BLOCK or self.bytes >= WORD_BYTES:
                yield self.block(at >= len(raw))
        self.parts.append(np.array([_GAP], np.int32))

    def block(self, whole: bool = True) -> pa.RecordBatch:
        ids = np.concatenate([np.empty(0, np.int32), *self.parts])
        own = len(ids) if whole else max(len(ids) - self.overlap, 0)
        n = np.bincount(ids[:own][ids[:own] >= 0], minlength=len(self.words))
        names = list(self.lang_of)
        row = [pa.array([names], pa.list_(pa.string())), pa.array([self.langs], pa.list_(pa.int32())), pa.array([self.words], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array([n], pa.list_(pa.int64())), pa.array([ids.tobytes()]), pa.array([own], pa.int64())]
        self.rest = [] if whole else [(names[self.langs[i]], self.words[i]) if i >= 0 else None for i in ids[own:].tolist()]
        self._new()
        return pa.RecordBatch.from_arrays(row, names=["names", "langs", "words", "n", "ids", "own"])


def blocks_of(documents: DataFrame, longest: int) -> DataFrame:
    """The texts as blocks of up to ``BLOCK`` words: the names of their languages,
    their different words with language and count, and the words of the texts
    by number (int32, -1 between pieces and texts), ``own`` of them the block's."""

    def rows(batches):
        blocks = Blocks(longest - 1)
        for b in sliced(batches):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                yield from blocks.add(lang, text.as_py() or "")
        yield blocks.block()

    texts = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return texts.mapInArrow(rows, "names array<string>, langs array<int>, words array<string>, n array<long>, ids binary, own long")


# --- Levels ---


def phrases_of(ids: np.ndarray, own: int, hashes: np.ndarray, k: int, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, one row for each phrase of ``k`` words; counts) of a block."""
    frequent = _has(tables[0], hashes)
    # Level by level, ``now`` numbers the frequent phrase that begins at a word, or none.
    now = np.append(np.where(frequent, np.arange(len(hashes)), _GAP), _GAP)[ids]
    words, h = np.arange(len(hashes))[:, None], hashes
    for j in range(2, k + 1):
        # A phrase is looked at where both of its parts of one word less are frequent.
        at = np.flatnonzero((now[:-1] >= 0) & (now[1:] >= 0))
        if j == k:
            at = at[at < own]
        key = now[at] << 32 | ids[at + j - 1]
        kinds = np.sort(key)
        first = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1])) if len(kinds) else np.empty(0, np.int64)
        n, kinds = np.diff(np.append(first, len(kinds))), kinds[first]
        before, last = kinds >> 32, kinds & 0xFFFFFFFF
        if j == k:
            return np.column_stack([words[before], last]), n
        grown = _longer(h[before], hashes[last])
        frequent = _has(tables[j - 1], grown)
        kinds, h, words = kinds[frequent], grown[frequent], np.column_stack([words[before], last])[frequent]
        new = np.full(len(now), _GAP, np.int64)
        if len(kinds):
            place = np.minimum(np.searchsorted(kinds, key), len(kinds) - 1)
            hit = kinds[place] == key
            new[at[hit]] = place[hit]
        now = new
    raise ValueError("phrases have two words or more")


def count_level(blocks: DataFrame, k: int, tables: list) -> DataFrame:
    """``(lang, phrase, f)``: occurrences of the phrases of k words whose parts of
    one word less are both in the level before, by ``tables`` of all levels
    before; level 1 has all words and a null phrase for their sum."""
    if k == 1:
        each = blocks.select("names", F.explode(F.arrays_zip("langs", "words", "n")).alias("w")).filter("w.n > 0")
        words = each.select(F.element_at("names", F.col("w.langs") + 1).alias("lang"), F.col("w.words").alias("phrase"), F.col("w.n").alias("n"))
        counts = words.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        sums = words.groupBy("lang").agg(F.sum("n").alias("f")).select("lang", F.lit(None).cast("string").alias("phrase"), "f")
        return counts.unionByName(sums)

    def count(row, bits):
        column = lambda c: row.column(c)[0]
        words, langs, names = (column(c).values for c in ("words", "langs", "names"))
        of = names.to_pylist()
        hashes = np.array([_hash(of[i], w) for i, w in zip(langs.to_pylist(), words.cast(pa.binary()).to_pylist(), strict=True)], np.uint64)
        found, n = phrases_of(np.frombuffer(column("ids").as_buffer(), np.int32), column("own").as_py(), hashes, k, bits)
        for s in range(0, len(n), 1 << 15):
            part = found[s : s + (1 << 15)]
            phrases = pc.binary_join_element_wise(*[words.take(pa.array(part[:, i])) for i in range(k)], pa.scalar(" "))
            # One string of both is a smaller row to shuffle; no phrase has a line feed.
            keys = pc.binary_join_element_wise(phrases, names.take(langs.take(pa.array(part[:, 0]))), pa.scalar("\n"))
            yield pa.RecordBatch.from_arrays([keys, pa.array(n[s : s + (1 << 15)], pa.int64())], names=["key", "n"])

    def rows(batches):
        bits = [_table(t, len(tables)) for t in tables]
        for b in batches:
            for row in sliced([b], 1):
                yield from count(row, bits)
            pa.default_memory_pool().release_unused()

    counted = blocks.drop("n").mapInArrow(rows, "key string, n long").groupBy("key").agg(F.sum("n").alias("f"))
    phrase = F.substring_index("key", "\n", 1)
    return counted.select(F.expr("substring(key, locate('\n', key) + 1)").alias("lang"), phrase.alias("phrase"), "f")


def level_tables(documents: DataFrame, longest: int = 4, least: int = 30) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases of 1 to ``longest`` words, a table ``(lang, phrase, f)``
    for each length, and ``(lang, n)``, the number of all words.

    Apriori: the texts are read once and kept as blocks of numbered words; each
    level is one pass over the blocks, which emits only phrases whose two parts of
    one word less were frequent; those are broadcast as a table of bits of fixed
    size (:func:`frequent_bits`). A block adds up its phrases before Spark adds up
    all, in hash aggregates with partial sums: a word or phrase that a third of
    the texts have is one row a task.
    """
    # Few blocks to a row group and one to a page: the sizes that Parquet's writers
    # look at only every hundred rows would let a whole task's blocks be one page.
    small = {"compression": "zstd", "parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.row.count.limit": "1"}
    blocks = written(blocks_of(documents, longest), "blocks", **small)
    levels, tables = [], []
    first = written(count_level(blocks, 1, []).filter((F.col("f") >= least) | F.col("phrase").isNull()), "words")
    levels.append(first.filter("phrase IS NOT NULL"))
    for k in range(2, longest + 1):
        tables.append(frequent_bits(levels[-1]))
        levels.append(written(count_level(blocks, k, tables).filter(F.col("f") >= least), f"phrases{k}"))
    for t in tables:
        t.unpersist()
    dropped(blocks)
    return levels, first.filter("phrase IS NULL").select("lang", F.col("f").alias("n"))


# --- Scores from the level tables ---


def scored(levels: list[DataFrame], cover: tuple[int, int] = (80, 100), scale: int = 2_000_000) -> DataFrame:
    """``(lang, phrase, a, l, r, score)`` of the phrases of two words and more that
    no longer frequent phrase covers: score is the lowest floor(scale * a / (l +
    r)) of all cuts, of equal ones the first; l and r are the counts of the parts.

    A phrase is covered if its words lie contiguously in a longer one with
    cover[1] * f(longer) >= cover[0] * a. Both parts of a frequent phrase are
    frequent, so the level tables have them all. Products are decimals of 38
    digits. One join brings the counts of parts, one aggregate with partial
    maxima puts cuts and covers together; a part that many phrases share is a
    skewed join key, whose partition adaptive execution splits.
    """
    longest = len(levels)
    words = F.split("phrase", " ")
    phrases, every = None, levels[0].select("lang", F.col("phrase").alias("part"), "f")
    for k, level in enumerate(levels[1:], 2):
        now = level.select("lang", "phrase", F.col("f").alias("a"), words.alias("w"), F.lit(k).alias("k"))
        phrases = now if phrases is None else phrases.unionByName(now)
        if k < longest:
            every = every.unionByName(level.select("lang", F.col("phrase").alias("part"), "f"))
    join = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    sides = F.flatten(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda j: F.array(
        F.struct(j.alias("cut"), F.lit(True).alias("left"), join(F.lit(1), j).alias("part")),
        F.struct(j.alias("cut"), F.lit(False).alias("left"), join(j + 1, F.col("k") - j).alias("part")),
    )))
    parts = phrases.select("lang", "phrase", "a", F.explode(sides).alias("side")).select("lang", "phrase", "a", "side.*")
    parts = parts.join(every, ["lang", "part"]).select("lang", "phrase", "a", "cut", "left", "f", F.lit(None).cast("long").alias("cover"))
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: join(i, n))))
    covers = phrases.filter("k > 2").select("lang", F.explode(inside).alias("phrase"), F.col("a").alias("cover"))
    both = parts.unionByName(covers, allowMissingColumns=True)
    side = lambda j, left: F.max(F.when((F.col("cut") == j) & (F.col("left") == left), F.col("f")))
    cuts = range(1, longest)
    at = both.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("cover").alias("cover"), *[side(j, x).alias(f"{'rl'[x]}{j}") for j in cuts for x in (True, False)])
    big = lambda c: F.col(c).cast("decimal(20,0)")
    at = at.filter(F.col("a").isNotNull() & (F.col("cover").isNull() | (F.lit(cover[1]) * big("cover") < F.lit(cover[0]) * big("a"))))
    score = lambda j: F.expr(f"{scale} * CAST(a AS DECIMAL(20,0)) div (CAST(l{j} AS DECIMAL(20,0)) + CAST(r{j} AS DECIMAL(20,0)))")
    options = [F.when(F.col(f"l{j}").isNotNull(), F.struct(score(j).cast("long").alias("score"), F.lit(j).alias("cut"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r"))) for j in cuts]
    return at.withColumn("best", F.array_min(F.array(*options))).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def top_phrases(phrases: DataFrame, top: int = 2000) -> DataFrame:
    """The first ``top`` of each lang by score and a, descending, then phrase, with
    ``rank`` from 1. A language is ranked in parts first, by a hash of the phrase,
    then what is left of it in fewer ones, so no task gets a whole language."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    parts = int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for n in (parts, math.isqrt(parts)):
        if n > 1:
            part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(n))).orderBy(*order)
            phrases = phrases.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    return phrases.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def collocations(documents: DataFrame, longest: int = 4, least: int = 30, top: int = 2000, cover: tuple[int, int] = (80, 100), scale: int = 2_000_000) -> DataFrame:
    """Each language's best phrases: ``(lang, rank, phrase, a, l, r, n, score)``.

    Texts are lower-cased (A-Z) and split at ``. , ; : ! ?`` and line ends into
    pieces, those at spaces and tabs into words. Everything is per lang, a null
    one is "und"; n is the number of all words. A null or empty text has no
    words; a text of any length is read whole, some words at a time; repeated
    rows count each. An empty table, or one without frequent phrases, gives an
    empty table; other columns are ignored. Parameters as in
    :func:`level_tables`, :func:`scored` and :func:`top_phrases`.
    """
    levels, totals = level_tables(documents, longest, least)
    best = written(top_phrases(scored(levels, cover, scale), top), "phrases")
    out = written(best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    dropped(best, *levels)
    return out


def op11_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), words AS (
  SELECT id, lang, unnest(w) AS w, unnest(range(len(w))) AS i FROM lists
), runs AS (
  SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM words WINDOW o AS (PARTITION BY id ORDER BY i)
), grams AS (
  SELECT lang, 1 AS k, w1 AS phrase FROM runs
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM runs WHERE w4 IS NOT NULL
), counts AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING k = 1 OR count(*) >= 30
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1
), parts AS (
  -- one key, or the plan may join both sides by lang alone
  SELECT lang || '|' || phrase AS part, f FROM counts
), halves AS (
  SELECT lang, phrase, a, j, lang || '|' || array_to_string(w[1:j], ' ') AS before, lang || '|' || array_to_string(w[j + 1:], ' ') AS after
  FROM candidates, range(1, 4) t(j) WHERE j < k
), cuts AS (
  SELECT h.lang, h.phrase, a, j, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * a // (l.f::HUGEINT + r.f) AS BIGINT) AS score
  FROM halves h JOIN parts l ON l.part = h.before JOIN parts r ON r.part = h.after
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS cover
  FROM candidates, range(2, 4) t(m), range(1, 4) u(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN totals USING (lang) LEFT JOIN inside USING (lang, phrase)
WHERE cover IS NULL OR 100::HUGEINT * cover < 80::HUGEINT * a
QUALIFY rank <= 2000
"""
