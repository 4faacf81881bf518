"""Flat text kernels shared by the training-data operators.

A slice of documents is one byte buffer plus offsets; every kernel works on
the whole slice with numpy, so the cost of a call is spread over many
documents.  Slices hold about ``SLICE_BYTES`` of text (or one longer
document), which bounds the memory of a Python worker whatever the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_BASE))
#: Separators of words: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    while len(_powers[0]) < n:
        k = len(_powers[0])
        for i, b in enumerate((_BASE, _BASE_INV)):
            _powers[i] = np.concatenate([_powers[i], _powers[i] * U(pow(b, k, 1 << 64))])
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Flat:
    """Documents of one slice: bytes ``buf``, document i at ``off[i]:off[i + 1]``."""

    buf: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1

    @staticmethod
    def of(texts: list[str | None], lower: bool = False) -> Flat:
        return next(f for _, f in slices(pa.array(texts, pa.string()), lower=lower, most=1 << 62))

    @cached_property
    def _space(self) -> np.ndarray:
        return SPACE[self.buf]

    @cached_property
    def _sums(self) -> np.ndarray:
        s = np.zeros(len(self.buf) + 1, U)
        np.cumsum(_BYTE[self.buf] * powers(len(self.buf) + 1)[0][: len(self.buf)], out=s[1:])
        return s

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges; equal ranges have equal hashes."""
        inv = powers(len(self.buf) + 1)[1]
        return mix((self._sums[end] - self._sums[start]) * inv[start] + (end - start).astype(U) * U(_BASE))

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every word, in order."""
        word = ~self._space
        edge = np.zeros(len(self.buf) + 1, bool)
        edge[self.off] = True
        before = np.zeros(len(self.buf), bool)
        before[1:] = word[:-1]
        start = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.zeros(len(self.buf), bool)
        after[:-1] = word[1:]
        return start, np.flatnonzero(word & (~after | edge[1:])) + 1

    @cached_property
    def first(self) -> np.ndarray:
        """Number of the first word of each document, and at last of all words."""
        return np.searchsorted(self.words[0], self.off)

    @cached_property
    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    @cached_property
    def word_hash(self) -> np.ndarray:
        return self.hashes(*self.words)

    def count(self, of_byte: np.ndarray) -> np.ndarray:
        """Per document, how many bytes the boolean mask marks."""
        return per_doc(of_byte, self.off)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k-word sequences within documents, and the number of each one's first word."""
        h = self.word_hash
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return rolled(h, k)[at], at


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive elements (order matters)."""
    n = len(h) - k + 1
    g = h[:n].copy()
    for j in range(1, k):
        g *= U(_BASE)
        g += h[j : j + n]
    return mix(g)


def per_doc(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    s = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=s[1:])
    return s[off[1:]] - s[off[:-1]]


def in_groups(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (doc, key), and where in that order a new pair begins. Slices hold few documents: radix sort."""
    order = np.argsort(key)
    d = doc[order]
    order = order[np.argsort(d.astype(np.uint16) if len(d) and d.max() < 1 << 16 else d, kind="stable")]
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    return order, new


def folded(text: pa.Array) -> pa.Array:
    """Lower case of all scripts, one code point for each."""
    return pc.utf8_lower(text)


def slices(text: pa.Array, lower: bool = False, most: int = SLICE_BYTES) -> Iterator[tuple[slice, Flat]]:
    """Rows and flat text of successive slices; null counts as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text, "") if text.null_count else text  # texts, or bytes without nulls
    kind = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    if not len(text):
        return
    buffers = text.buffers()
    off = np.frombuffer(buffers[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, len(text), i + 60_000)
        buf = data[off[i] : off[j]]
        yield slice(i, j), Flat(_LOWER[buf] if lower else buf, off[i : j + 1] - off[i])
        i = j
