"""Word and n-gram hashes of whole Arrow batches of texts, in numpy.

Words are maximal runs of bytes other than 0x20 and 0x09 to 0x0D of the UTF-8 form. A word's hash is a multilinear sum over its bytes,
finished by a mixer; an n-gram's is a polynomial in its words' hashes, finished alike. All are 64 bits wide: two different n-grams
among m get one hash with a chance of about m^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_STEP = U(0x9E3779B97F4A7C15)
_GRAM = U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64, in place on a fresh array."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def series(n: int, seed: int, odd: bool = False) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    out = mix((np.arange(1, n + 1, dtype=U) + U(seed) * U(1 << 32)) * _STEP)
    return out | U(1) if odd else out


_BYTE = series(256, 1)


@dataclass
class Words:
    """Words of some documents: hashes in reading order, the document of each, and where each document's words begin (one more at the end)."""

    hashes: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on. Those that run into the next document are there too: see whole()."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, U)
        acc = self.hashes[:n].copy()
        for j in range(1, k):
            acc *= _GRAM
            acc += self.hashes[j : j + n]
        return mix(acc + U(k))

    def whole(self, k: int) -> np.ndarray:
        """For each of grams(k): does it lie in one document?"""
        n = len(self.hashes) - k + 1
        return self.doc[:n] == self.doc[k - 1 :] if n > 0 else np.zeros(0, bool)


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    """data: bytes of consecutive documents; offsets: where each begins, and the end."""
    n_docs = len(offsets) - 1
    at = np.flatnonzero(~_SPACE[data])
    if not len(at):
        return Words(np.zeros(0, U), np.zeros(0, np.int64), np.zeros(n_docs + 1, np.int64))
    opens = np.zeros(len(data) + 1, bool)
    opens[offsets] = True
    new = np.empty(len(at), bool)
    new[0] = True
    np.not_equal(np.diff(at), 1, out=new[1:])
    new[1:] |= opens[at[1:]]
    start = np.flatnonzero(new)
    length = np.diff(start, append=len(at))
    place = np.arange(len(at)) - np.repeat(start, length)
    byte = data[at]
    if lower:
        byte = _LOWER[byte]
    value = _BYTE[byte]
    value *= series(int(length.max()), 2, odd=True)[place]
    hashes = mix(np.add.reduceat(value, start) + length.astype(U) * _STEP)
    doc = np.searchsorted(offsets, at[start], "right") - 1
    return Words(hashes, doc, np.searchsorted(doc, np.arange(n_docs + 1)))


def slices(texts: pa.Array, lower: bool, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words of documents from..to) over runs of documents of about ``limit`` bytes; a longer document is a run of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, words_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower)
        a = b


def runs(mask: np.ndarray, *breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of True; a run also ends where one of ``breaks`` changes value."""
    at = np.flatnonzero(mask)
    if not len(at):
        return at, at
    new = np.empty(len(at), bool)
    new[0] = True
    np.not_equal(np.diff(at), 1, out=new[1:])
    for b in breaks:
        new[1:] |= b[at[1:]] != b[at[:-1]]
    start = np.flatnonzero(new)
    return at[start], np.diff(start, append=len(at))
