"""LM scoring: cross-entropy difference of matched n-gram models."""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, sliced, words_of, written

#: Tokens that are worked on at once: memory, not results, depends on it.
BLOCK = 1 << 20
#: Counts are added up by ranges of keys: this many, and one for each PER_SHARD tokens if these are more.
SHARDS, PER_SHARD = 128, 1 << 22
#: Weight of the bigram estimate; the rest goes to the unigram one.
LAMBDA = 0.7
#: Stands before the first word.
START = np.uint64(0x5EED)
#: Rows of some MB: the writer looks at its buffers after each.
LARGE_ROWS = {"parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def _packed(x: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed, after the size in bytes: small ones take little."""
    planes = np.ascontiguousarray(x).reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(b: bytes, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _packed_keys(x: np.ndarray) -> bytes:
    """Ascending keys as the steps between them."""
    return _packed(np.diff(x, prepend=np.uint64(0)))


def _unpacked_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(b, np.uint64), dtype=np.uint64)


def blocks(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each block of documents: their doc_ids, whether ``targets`` names
    them, numbers of tokens, the hashes of the block's words, ascending, and the
    tokens as numbers of these words; written, for the passes to come."""
    kind = dict(documents.dtypes)["doc_id"]
    schema = f"block long, doc_ids array<{kind}>, target array<boolean>, n array<int>, words binary, ids binary, tokens array<long>, docs array<long>"
    names = ["block", "doc_ids", "target", "n", "words", "ids", "tokens", "docs"]

    def rows(batches):
        at = count(TaskContext.get().partitionId() << 32)
        docs, number, held, kind = [], defaultdict(count().__next__), 0, None

        def block():
            doc_ids, target, ids = zip(*docs, strict=True)
            target, n, ids = np.array(target), np.array(list(map(len, ids)), np.int32), np.concatenate(ids)
            words, where = np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number)), return_inverse=True)
            cols = [
                pa.array([next(at)], pa.int64()),
                pa.array([doc_ids], pa.list_(kind)),
                pa.array([target], pa.list_(pa.bool_())),
                pa.array([n], pa.list_(pa.int32())),
                pa.array([_packed_keys(words)], pa.binary()),
                pa.array([_packed(where[ids].astype(np.int32))], pa.binary()),
                pa.array([[n.sum(), n[target].sum()]], pa.list_(pa.int64())),
                pa.array([[(n > 0).sum(), (n[target] > 0).sum()]], pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for b in sliced(batches):
            kind = b.schema.field("doc_id").type
            for doc_id, target, text in zip(b.column("doc_id").to_pylist(), b.column("target").to_pylist(), b.column("text"), strict=True):
                words = words_of(text.as_py())
                docs.append((doc_id, target, np.fromiter(map(number.__getitem__, words), np.int64, len(words))))
                held += len(words) + 1
                if held >= BLOCK:
                    yield block()
                    docs, number, held = [], defaultdict(count().__next__), 0
        if docs:
            yield block()

    # Both sides grow with the corpus: a sort-merge join at any size.
    named = targets.select(F.col("doc_id").alias("t")).distinct().hint("merge")
    marked = documents.join(named, F.col("doc_id") == F.col("t"), "left").select("doc_id", "text", F.col("t").isNotNull().alias("target"))
    return written(marked.mapInArrow(rows, schema), "blocks", **LARGE_ROWS)


class Block:
    """Tokens of a block: number of the word, of the word before (0: none, else
    one more), of the pair and of the document; and the keys of words and pairs."""

    def __init__(self, row: dict):
        self.n, self.target = np.array(row["n"], np.int64), np.array(row["target"], bool)
        words, self.ids = _unpacked_keys(row["words"]), _unpacked(row["ids"], np.int32).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.before = np.r_[0, self.ids[:-1] + 1][: len(self.ids)]
        self.before[np.r_[True, self.doc[1:] != self.doc[:-1]][: len(self.ids)]] = 0
        size = max(len(words), 1)
        pairs, self.pair = np.unique(self.before * size + self.ids, return_inverse=True)
        context = mix64(np.r_[START, words])[pairs // size] * np.uint64(0x9E3779B97F4A7C15)
        self.keys = words, mix64(context + words[pairs % size])

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: tokens, target tokens, and both as a context; of each pair:
        tokens and target tokens."""
        some, (words, pairs) = self.target[self.doc], map(len, self.keys)
        by = lambda at, size: [np.bincount(at, minlength=size), np.bincount(at[some], minlength=size)]
        return np.stack(by(self.ids, words) + [x[1:] for x in by(self.before, words + 1)]), np.stack(by(self.pair, pairs))


def _counts(blocks: DataFrame, shards: int) -> DataFrame:
    """``(kind, shard, block, keys, counts)``: of each block the counts of its words
    (kind 0) and pairs (1), cut at fixed keys; full 64-bit keys, ascending."""

    def rows(batches):
        for b in batches:
            for row in b.to_pylist():
                block, out = Block(row), []
                for kind, (keys, n) in enumerate(zip(block.keys, block.counts(), strict=True)):
                    order = np.argsort(keys)
                    keys, n = keys[order], n[:, order]
                    shard = ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                    cuts = np.searchsorted(shard, np.arange(shards + 1))
                    for s in np.flatnonzero(np.diff(cuts)):
                        at = slice(cuts[s], cuts[s + 1])
                        out.append((kind, s, row["block"], _packed_keys(keys[at]), _packed(n[:, at])))
                if out:
                    types = pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["kind", "shard", "block", "keys", "counts"])

    return blocks.select("block", "target", "n", "words", "ids").mapInArrow(rows, "kind int, shard int, block long, keys binary, counts binary")


def _totals(counts: DataFrame) -> DataFrame:
    """``(kind, shard, block, counts, fresh)``: what each block counted, over all
    blocks; ``fresh`` adds up to the number of distinct keys. A key has one row for
    each block at most, however frequent it is."""

    def total(table: pa.Table) -> pa.Table:
        parts = [_unpacked_keys(x) for x in table.column("keys").to_pylist()]
        sizes = np.array(list(map(len, parts)))
        keys, where = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.concatenate([_unpacked(x).reshape(-1, size) for x, size in zip(table.column("counts").to_pylist(), sizes, strict=True)], axis=1)
        # Floats hold these sums exactly up to 2**53.
        n = np.stack([np.bincount(where, x, len(keys)) for x in n]).astype(np.int64)
        ends = np.cumsum(sizes)
        cols = table.column("kind"), table.column("shard"), table.column("block"), pa.array([_packed(n[:, where[b - s : b]]) for b, s in zip(ends, sizes, strict=True)], pa.binary())
        return pa.Table.from_arrays([*cols, pa.array([len(keys)] + [0] * (len(parts) - 1), pa.int64())], names=["kind", "shard", "block", "counts", "fresh"])

    return written(counts.groupBy("kind", "shard").applyInArrow(total, "kind int, shard int, block long, counts binary, fresh long"), "totals")


def _share(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often the token's document has what the token has."""
    _, where, n = np.unique(doc * (at.max(initial=0) + 1) + at, return_inverse=True, return_counts=True)
    return n[where]


def losses(block: Block, words: np.ndarray, pairs: np.ndarray, tokens, docs, size: int) -> list[np.ndarray]:
    """Bits of each token under the model of all documents and that of the target:
    interpolated bigrams, the same tokens and smoothing. A document's own counts
    are left out of the model if it was counted there: none tells its own score."""
    own = [_share(block.doc, x) for x in (block.ids, block.before, block.pair)]
    out = []
    for side in (0, 1):
        counted = np.ones(len(block.n), bool) if side == 0 else block.target
        mine = counted[block.doc]
        uni, both = words[side][block.ids] - own[0] * mine, pairs[side][block.pair] - own[2] * mine
        context = np.r_[docs[side], words[2 + side]][block.before] - own[1] * mine
        total = tokens[side] - (block.n * counted)[block.doc]
        uni = (uni + 1.0) / (total + size + 2)
        ratio = np.divide(both, context, out=np.zeros(len(uni)), where=context > 0)
        weight = np.where(context > 0, LAMBDA, 0.0)
        out.append(-np.log2(weight * np.clip(ratio, 0.0, 1.0) + (1 - weight) * uni))
    return out


def cross_entropy_difference(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Scores every row of ``documents`` (doc_id, text) by how much better a model
    of the target documents predicts it than a model of all documents.

    ``targets`` (doc_id) names the target rows; both models share the vocabulary
    of all words, all bigrams and the smoothing, and all are counted over all
    rows. Returns ``(doc_id, n_tokens, target_loss, background_loss, score)``:
    mean bits per token under either model, without the document's own share in
    it, and the difference target - background: the lower, the more like the
    target. Null and empty texts have no tokens and null losses. Without a target
    row the target model is uniform. Repeated doc_ids in ``targets`` count once,
    repeated documents are scored and counted each; a null doc_id is never a
    target. An empty table gives an empty table; other columns are ignored.
    """
    docs = documents.select("doc_id", "text")
    held = blocks(docs, targets)
    sums = held.agg(*[F.coalesce(F.sum(F.col(c)[i]), F.lit(0)) for c in ("tokens", "docs") for i in (0, 1)]).first()
    totals = _totals(_counts(held, max(SHARDS, sums[0] // PER_SHARD)))
    size = totals.filter("kind = 0").agg(F.coalesce(F.sum("fresh"), F.lit(0))).first()[0]
    tokens, starts = (sums[0], sums[1]), (sums[2], sums[3])
    names = ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        block, n = Block(row), []
        kinds, shards, counts = (right.column(c).to_pylist() for c in ("kind", "shard", "counts"))
        for kind, keys in enumerate(block.keys):
            parts = [_unpacked(c).reshape(2 * (2 - kind), -1) for _, c in sorted((s, c) for k, s, c in zip(kinds, shards, counts, strict=True) if k == kind)]
            table = np.zeros((2 * (2 - kind), len(keys)), np.int64)
            if parts:
                table[:, np.argsort(keys)] = np.concatenate(parts, axis=1)
            n.append(table)
        far, near = losses(block, *n, tokens, starts, size)
        none = block.n == 0
        mean = lambda x: pa.array(np.bincount(block.doc, x, len(none)) / np.maximum(block.n, 1), mask=none)
        return pa.Table.from_arrays([left.column("doc_ids").combine_chunks().flatten(), pa.array(block.n), mean(near), mean(far), mean(near - far)], names=names)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, target_loss double, background_loss double, score double"
    given = held.select("block", "doc_ids", "target", "n", "words", "ids").groupBy("block")
    return given.cogroup(totals.select("block", "kind", "shard", "counts").groupBy("block")).applyInArrow(rows, schema)


def op7_lm_score(spark, sf_dir: str) -> DataFrame:
    """Target: documents labelled good and not toxic."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 and toxic = 0")
    return cross_entropy_difference(spark.read.parquet(f"{sf_dir}/documents.parquet"), good)
