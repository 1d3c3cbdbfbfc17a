"""Byte-level BPE by rank files, run by a sentencepiece model made of the vocabulary."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from .bpe import byte_alphabet
from .common import sliced

#: Pre-tokens that a worker remembers, and the longest one; memory, not results, depends on them.
PIECES, LONG_PIECE = 300_000, 64
#: A longer text is taken so many pre-tokens at a time.
STRETCH = 1_000_000

_LETTERS = {b: c for c, b in byte_alphabet().items()}
_TO_LETTERS = {b: c for b, c in _LETTERS.items()}
_TO_BYTES = {ord(c): b for b, c in _LETTERS.items()}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    """A protobuf field that holds an integer; negative ones take ten bytes."""
    return _varint(field << 3) + _varint(n & (1 << 64) - 1)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def model_of(ranks: dict[bytes, int]) -> tuple[bytes, np.ndarray]:
    """A serialised sentencepiece BPE model of a rank vocabulary, and the rank of
    each of its pieces.

    Each token is a piece spelt in the printable stand-ins of its bytes, scored by
    its negative rank, so that the lowest rank merges first, the leftmost of equal
    ones; piece 0 is the unknown piece that the library asks for. Normalisation is
    the identity: no rule, no added prefix, white space as it stands. The field
    numbers are those of the library's public model format.
    """
    order = sorted(ranks, key=ranks.__getitem__)
    pieces = [_block(1, _block(1, b"<unk>") + b"\x15" + np.float32(0).tobytes() + _number(3, 2))]
    for token in order:
        spelt = "".join(map(_LETTERS.__getitem__, token)).encode()
        pieces.append(_block(1, _block(1, spelt) + b"\x15" + np.float32(-ranks[token]).tobytes()))
    # trainer: BPE, its size, unknown piece 0, no pieces for beginning, end and padding
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, 0) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    normaliser = _block(1, b"identity") + _block(2, b"") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _block(2, trainer) + _block(3, normaliser), np.array([-1, *(ranks[t] for t in order)], np.int32)


class PieceBpe:
    """Encoder and decoder of one rank vocabulary (the text of its file)."""

    def __init__(self, spec: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in spec.splitlines() if line.strip())}
        model, self.rank_of = model_of(self.ranks)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.letters_of = {r: self.model.id_to_piece(i) for i, r in enumerate(self.rank_of.tolist()) if i}
        self.bytes_of = {r: bytes(map(_TO_BYTES.__getitem__, map(ord, s))) for r, s in self.letters_of.items()}
        self.split = regex.compile(pattern)
        #: ids of a pre-token as decimals with commas, and what they decode to
        self.pieces: dict[str, tuple[bytes, bytes]] = {}

    def ids_of(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each pre-token: its own if it is a token as a whole, else by merges."""
        raw = [p.encode("utf-8") for p in pieces]
        out: list = [self.ranks.get(p) for p in raw]
        rest = [i for i, r in enumerate(out) if r is None]
        if rest:
            spelt = [raw[i].decode("latin-1").translate(_TO_LETTERS) for i in rest]
            rank_of = self.rank_of
            for i, found in zip(rest, self.model.encode(spelt, out_type=int, num_threads=1), strict=True):
                out[i] = rank_of[found].tolist()
        return [[r] if isinstance(r, int) else r for r in out]

    def stretches(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of a text, of a long one some at a time."""
        if len(text) <= STRETCH:
            yield self.split.findall(text)
            return
        now = []
        for m in self.split.finditer(text):
            now.append(m[0])
            if len(now) == STRETCH:
                yield now
                now = []
        yield now

    def encode(self, text: str) -> np.ndarray:
        out = []
        for part in self.stretches(text):
            kinds = list(dict.fromkeys(part))
            ids = dict(zip(kinds, (np.array(i, np.int32).tobytes() for i in self.ids_of(kinds)), strict=True))
            out += map(ids.__getitem__, part)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids as decimals with commas, SHA-256 of the decoded bytes)"""
        known, n = self.pieces, 0
        ids, decoded = hashlib.sha256(), hashlib.sha256()
        for part in filter(None, self.stretches(text)):
            new = list(set(part).difference(known))
            for p, i in zip(new, self.ids_of(new), strict=True):
                known[p] = ",".join(map(str, i)).encode(), self.decode(i)
            decimals, raw = zip(*map(known.__getitem__, part), strict=True)
            decimals = b",".join(decimals)
            ids.update(b"," + decimals if n else decimals)
            decoded.update(b"".join(raw))
            n += decimals.count(b",") + 1
            if len(known) > PIECES:
                known.clear()
            for p in new:
                if len(p) > LONG_PIECE:
                    known.pop(p, None)
        return n, ids.hexdigest(), decoded.hexdigest()


_loaded: dict[int, PieceBpe] = {}


def _coder(spec) -> PieceBpe:
    """One coder for each worker process and vocabulary."""
    key = hash(spec.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PieceBpe(*spec.value)
    return _loaded[key]


def vocabulary(spark: SparkSession, path: str, pattern: str):
    """The rank file (under 1 MB, fixed) and the pattern of pre-tokens for all workers."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((f.read(), pattern))


def _mapped(df: DataFrame, column: str, names: list[str], kinds: list, types: str, spec, make) -> DataFrame:
    """``doc_id`` and what ``make(coder, value)`` gives for each value of a column."""

    def rows(batches):
        coder = _coder(spec)
        for b in sliced(batches):
            # One value at a time becomes a Python object.
            out = [make(coder, x.as_py()) for x in b.column(1)]
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *names])

    return df.select("doc_id", column).mapInArrow(rows, f"doc_id {dict(df.dtypes)['doc_id']}, {types}")


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids array<int>)`` of every whole text: each match of ``pattern``
    is encoded by itself, without special tokens, as rank files of this kind are
    meant; a pre-token that is a token is that token.

    A null text is empty and has no ids, as an empty one. Texts of any length are
    encoded whole, some pre-tokens at a time; a long pre-token takes time in
    proportion to its length times its logarithm. Repeated rows are encoded each.
    An empty table gives an empty table; other columns are ignored.
    """
    spec = vocabulary(documents.sparkSession, path, pattern)
    return _mapped(documents, "text", ["ids"], [pa.list_(pa.int32())], "ids array<int>", spec, lambda c, x: (c.encode(x or ""),))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, bytes binary)`` from ``(doc_id, ids)``; null ids decode to
    nothing; an id that the vocabulary lacks is an error."""
    spec = vocabulary(encoded.sparkSession, path, pattern)
    return _mapped(encoded, "ids", ["bytes"], [pa.binary()], "bytes binary", spec, lambda c, x: (c.decode(x or []),))


def digests(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes every whole text: ``(doc_id, n_tokens, ids_sha256,
    decoded_sha256)``. Cases as in :func:`encode`."""
    spec = vocabulary(documents.sparkSession, path, pattern)
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return _mapped(documents, "text", names, [pa.int64(), pa.string(), pa.string()], "n_tokens long, ids_sha256 string, decoded_sha256 string", spec, lambda c, x: c.digest(x or ""))


def op13_piece_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
