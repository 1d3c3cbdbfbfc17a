"""Shared pieces of the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..storage import dropped
from ..storage import stored as written

__all__ = ["SPACES", "WORD", "dropped", "mix64", "n_words", "sliced", "uniform", "words_of", "written"]

#: A word is a maximal run of anything but these six ASCII white-space characters.
#: ``bytes.split()`` splits at exactly the same six.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

def n_words(text: Column) -> Column:
    """Number of words (``WORD``) of a text, null text 0: every run becomes one
    character, the white space goes, the length is left."""
    marked = F.regexp_replace(text, WORD, "x")
    return F.coalesce(F.length(F.translate(marked, SPACES, "")), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def sliced(batches, rows: int = 512):
    """Arrow batches in pieces of a few rows: what Python holds of them at once stays small."""
    for b in batches:
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by key and seed: 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"|{seed}"))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))
