"""Words and n-grams of Arrow text columns as 64-bit hashes, many documents at once.

All word rules used here separate words at ASCII characters, so the UTF-8 bytes can be scanned directly. A word's hash is
a polynomial over its bytes modulo 2**64 and is mixed afterwards; equal words have equal hashes, and unequal ones meet
with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from varloom.llm.store import cached

ODD = 0x9E3779B97F4A7C15  # base of the polynomials
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, at least ``n`` of each."""
    size = CHUNK + 64
    while size < n:
        size *= 2

    def build():
        out = []
        for base in (ODD, pow(ODD, -1, 2**64)):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            out.append(np.multiply.accumulate(row))
        return tuple(out)

    return cached(f"powers-{size}", build)


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each slice ``values[start:end]``."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def table(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(is the byte part of a word, value of the byte) of a word rule.

    ``space``: words are ``[^\\x20\\x09-\\x0D]+``; ``space_folded``: the same after A-Z became a-z;
    ``alnum_folded``: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became a-z.
    """

    def build():
        byte = np.arange(256)
        fold = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
        if kind == "alnum_folded":
            word = (byte >= 128) | ((fold >= 48) & (fold <= 57)) | ((fold >= 97) & (fold <= 122))
        else:
            word = ~((byte == 32) | ((byte >= 9) & (byte <= 13)))
        value = mix((fold if kind.endswith("folded") else byte).astype(np.uint64) * np.uint64(ODD) + np.uint64(ODD))
        return word, value

    return cached(f"table-{kind}", build)


@dataclass
class Words:
    """Words of several documents in text order. ``first[i]:first[i + 1]`` are those of document ``i``."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    data: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, i: int, j: int) -> bytes:
        """The bytes from word ``i`` to before word ``j``."""
        return self.data[self.starts[i] : self.ends[j - 1]].tobytes() if j > i else b""


def words(data: np.ndarray, offsets: np.ndarray, kind: str) -> Words:
    """Words of the documents ``data[offsets[i]:offsets[i + 1]]``."""
    is_word, value = table(kind)
    w = is_word[data]
    before, after = np.zeros(len(w), dtype=bool), np.zeros(len(w), dtype=bool)
    before[1:], after[:-1] = w[:-1], w[1:]
    edges = offsets[(offsets > 0) & (offsets < len(w))]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return Words(rolling(value[data], starts, ends), starts, ends, np.searchsorted(starts, offsets), data)


def ngrams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the first words, hashes) of all runs of ``k`` words within a document."""
    n = len(w.hashes)
    if n < k:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    doc = w.doc
    at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
    return at, rolling(w.hashes, at, at + k)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of successive runs of rows of about ``limit`` bytes; a longer text comes alone."""
    data, offsets = buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: row ``i`` has ``values[ends[i]:ends[i + 1]]``."""
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(values, kind)).cast(pa.list_(kind))
