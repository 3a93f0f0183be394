"""Vectorised scanning of UTF-8 text in Arrow buffers: words, lines, hashes and shingles without per-word Python.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; as these are
ASCII, runs of bytes and runs of code points are the same.  Texts are handled
whole, in blocks of about a megabyte; windows bound the memory of one very long
text to a small multiple of its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Bytes of a block of documents, and of a hashing window.
BLOCK, WINDOW = 1 << 20, 1 << 17
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, and the bytes of terms in lower-cased text.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
IN_TERM = np.zeros(256, bool)
IN_TERM[0x30:0x3A] = IN_TERM[0x61:0x7B] = IN_TERM[0x80:] = True

#: An odd multiplier and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15 | 1
_Q = pow(_P, -1, 1 << 64)
_MASK = (1 << 64) - 1


def _table(base: int) -> np.ndarray:
    out = np.ones(WINDOW + 1, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_POWERS, _INVERSES = _table(_P), _table(_Q)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes of sorted spans that do not overlap; equal bytes give equal values anywhere."""
    out = np.zeros(len(starts), np.uint64)
    running, step, back = 0, 1, 1
    s_cuts = np.searchsorted(starts, np.arange(0, len(data) + WINDOW, WINDOW))
    e_cuts = np.searchsorted(ends, np.arange(0, len(data) + WINDOW, WINDOW) + 1)
    shift = np.ones(len(starts), np.uint64)
    for w, base in enumerate(range(0, max(len(data), 1), WINDOW)):
        piece = data[base : base + WINDOW]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(piece)], out=sums[1:])
        s = slice(s_cuts[w], s_cuts[w + 1] if w + 1 < len(s_cuts) else len(starts))
        e = slice(e_cuts[w] if w else 0, e_cuts[w + 1] if w + 1 < len(e_cuts) else len(ends))
        at = starts[s] - base
        inside = at <= len(piece)
        out[s][inside] -= (sums[at[inside]] * np.uint64(step)) + np.uint64(running)
        shift[s][inside] = _INVERSES[at[inside]] * np.uint64(back)
        out[e] += (sums[ends[e] - base] * np.uint64(step)) + np.uint64(running)
        running = (running + int(sums[-1]) * step) & _MASK
        step, back = (step * int(_POWERS[WINDOW])) & _MASK, (back * int(_INVERSES[WINDOW])) & _MASK
    return mix(out * shift + (ends - starts).astype(np.uint64))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string()).fill_null("")
    else:
        texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Block:
    """Some documents of a batch: rows ``lo`` to ``hi``."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, bounds: np.ndarray):
        self.lo, self.hi, self.data, self.bounds = lo, hi, data, bounds

    def __len__(self) -> int:
        return self.hi - self.lo

    @cached_property
    def in_word(self) -> np.ndarray:
        return ~SEPARATOR[self.data]

    @cached_property
    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        inside = self.in_word
        before = np.zeros(len(inside) + 1, bool)
        before[1:] = inside
        firsts = self.bounds[:-1][self.bounds[:-1] < len(inside)]
        starts = inside & ~before[:-1]
        starts[firsts] = inside[firsts]
        after = np.zeros(len(inside) + 1, bool)
        after[:-1] = inside
        ends = inside & ~after[1:]
        lasts = self.bounds[1:][self.bounds[1:] > self.bounds[:-1]] - 1
        ends[lasts] = inside[lasts]
        return np.flatnonzero(starts), np.flatnonzero(ends) + 1

    @property
    def starts(self) -> np.ndarray:
        return self._edges[0]

    @property
    def ends(self) -> np.ndarray:
        return self._edges[1]

    @cached_property
    def word_bounds(self) -> np.ndarray:
        """Index of each document's first word, and the number of words."""
        return np.searchsorted(self.starts, self.bounds)

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_bounds)

    @cached_property
    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.n_words)

    @cached_property
    def word_hash(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of k words within a document, and the index of each window's first word."""
        return word_windows(self.word_hash, self.word_bounds, k)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums over the bytes of each document."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]


class TermBlock(Block):
    """A block whose words are maximal runs of ASCII letters, digits and all of U+0080 and beyond, A-Z lower-cased.

    Bytes from 0x80 on only occur in code points from U+0080 on, so here too
    runs of bytes are runs of code points.
    """

    def __init__(self, lo: int, hi: int, data: np.ndarray, bounds: np.ndarray):
        super().__init__(lo, hi, LOWER[data], bounds)

    @cached_property
    def in_word(self) -> np.ndarray:
        return IN_TERM[self.data]


def word_windows(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = np.repeat(bounds[1:], np.diff(bounds))  # end of the word's document
    at = np.flatnonzero(np.arange(n) + k <= last)
    out = hashes[at]
    for i in range(1, k):
        out = out * np.uint64(_P) + hashes[at + i]
    return mix(out), at


def blocks(texts: pa.Array, most: int = BLOCK, kind: type[Block] = Block) -> Iterator[Block]:
    """The documents of an Arrow array in blocks of about ``most`` bytes; a longer text is a block of its own."""
    data, offsets = buffers(texts)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        hi = min(hi, lo + 4096)
        yield kind(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi
