"""BPE encoding by per-prefix dynamic programming, and decoding."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import sliced

#: Fixed value: the split pattern of byte-level BPE vocabularies of this kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces and pairs that a worker remembers; memory, not results, depends on it.
PIECES, PAIRS = 250_000, 300_000
#: Longer pieces aren't remembered.
LONG_PIECE = 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the others, in order, for the code
    points from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one vocabulary file (its JSON text)."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        letters = byte_alphabet()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab, merges = j["model"]["vocab"], j["model"]["merges"]
        self.bytes_of = {i: raw(t) for t, i in vocab.items()}
        #: rank of the merge that makes a token; -1: a single byte
        self.rank = {i: -1 for i in self.bytes_of}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for r, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            whole = vocab[a + b]
            self.merged.setdefault((vocab[a], vocab[b]), r)
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (vocab[a], vocab[b]), r
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(SPLIT)
        # All tokens that end at a position, the longest first: the automaton's suffix links.
        self.suffixes = ahocorasick.Automaton()
        for t, i in vocab.items():
            if i in self.parts or len(self.bytes_of[i]) == 1:
                b = raw(t)
                self.suffixes.add_word(b.decode("latin-1"), (i, len(b)))
        self.suffixes.make_automaton()
        self.pairs: dict[int, bool] = {}
        #: what a piece becomes, by :meth:`packed` or :meth:`digested`
        self.pieces: dict[str, bytes | tuple[bytes, bytes]] = {}
        self.kept = None

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves token b after token a as they are.

        Merging goes by rank, leftmost first. Seen backwards in time, the two
        tokens at the boundary are taken apart, the later-made one first; at each
        step, the pair then at the boundary must not have merged before its
        tokens went into what was just taken apart.
        """
        before = len(self.merged) + 1  # a boundary merge of a rank under this came first
        while True:
            r = self.merged.get((a, b))
            if r is not None and r < before:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                # Of equal ranks, the merge inside a lies to the left and came first.
                before, a = ra, self.parts[a][1]
            else:
                # Of equal ranks, the boundary's merge lies to the left of the one inside b.
                before, b = rb + 1, self.parts[b][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: for every prefix the one token that can end it,
        then back from the whole."""
        last = [-1] * (len(piece) + 1)
        size = [0] * (len(piece) + 1)
        known = self.pairs
        for end, (token, n) in self.suffixes.iter(piece.decode("latin-1")):
            at = end + 1
            if size[at]:
                continue
            prev = last[at - n]
            if at > n:
                key = prev << 32 | token
                fits = known.get(key)
                if fits is None:
                    if len(known) >= PAIRS:
                        known.clear()
                    fits = known[key] = self.compatible(prev, token)
                if not fits:
                    continue
            last[at], size[at] = token, n
        ids, at = [], len(piece)
        while at:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def packed(self, ids: list[int]) -> bytes:
        """Ids as int32."""
        return np.array(ids, np.int32).tobytes()

    def digested(self, ids: list[int]) -> tuple[bytes, bytes]:
        """(ids in decimal with commas, what they decode to)"""
        return ",".join(map(str, ids)).encode(), b"".join(map(self.bytes_of.__getitem__, ids))

    def _spans(self, text: str) -> Iterator[tuple[bool, str]]:
        if not self.cut or not any(s in text for s in self.special):
            yield False, text
        else:
            for i, part in enumerate(self.cut.split(text)):
                if part:
                    yield bool(i % 2), part

    def parts_of(self, text: str, make) -> list:
        """What ``make`` (packed or digested) makes of the ids of each pre-token."""
        if self.kept != make.__name__:
            self.kept = make.__name__
            self.pieces.clear()
        out, known = [], self.pieces
        for special, span in self._spans(text):
            if special:
                out.append(make([self.special[span]]))
                continue
            for piece in self.split.findall(span):
                got = known.get(piece)
                if got is None:
                    got = make(self.encode_piece(piece.encode("utf-8")))
                    if len(piece) <= LONG_PIECE:
                        if len(known) >= PIECES:
                            known.clear()
                        known[piece] = got
                out.append(got)
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.parts_of(text, self.packed)), np.int32)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[int, Bpe] = {}


def _coder(spec) -> Bpe:
    """One coder for each worker process and vocabulary."""
    key = hash(spec.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(spec.value)
    return _loaded[key]


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file (about 2 MB, fixed) for all workers."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(documents: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids array<int>)`` of every whole text, as the vocabulary's own
    library encodes it without adding special tokens; a special token's string in
    a text is that token.

    A null text is empty and has no ids, as an empty one. Repeated rows are
    encoded each. An empty table gives an empty table; other columns are ignored.
    """
    spec = vocabulary(documents.sparkSession, path)

    def rows(batches):
        bpe = _coder(spec)
        for b in sliced(batches):
            ids = pa.array([bpe.encode(x.as_py() or "") for x in b.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(rows, _schema(documents, "ids array<int>"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; special tokens become their
    strings, invalid UTF-8 U+FFFD; null ids decode to an empty text."""
    spec = vocabulary(encoded.sparkSession, path)

    def rows(batches):
        bpe = _coder(spec)
        for b in sliced(batches):
            text = pa.array([bpe.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), text], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, _schema(encoded, "text string"))


def digests(documents: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every whole text: ``(doc_id, n_tokens, ids_sha256,
    decoded_sha256)``. Cases as in :func:`encode`."""
    spec = vocabulary(documents.sparkSession, path)

    def rows(batches):
        bpe = _coder(spec)
        for b in sliced(batches):
            n, ids, text = [], [], []
            for x in b.column("text"):
                parts = bpe.parts_of(x.as_py() or "", bpe.digested)
                decimal = b",".join([p[0] for p in parts])
                n.append(decimal.count(b",") + 1 if parts else 0)
                ids.append(hashlib.sha256(decimal).hexdigest())
                decoded = b"".join([p[1] for p in parts]).decode("utf-8", "replace")
                text.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", "text").mapInArrow(rows, _schema(documents, "n_tokens long, ids_sha256 string, decoded_sha256 string"))


def _schema(df: DataFrame, rest: str) -> str:
    return f"doc_id {dict(df.dtypes)['doc_id']}, {rest}"


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("byte_bpe_50k.json")))
