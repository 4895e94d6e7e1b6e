"""Whole batches of texts as numpy vectors: word boundaries and 64-bit word hashes, without a Python loop over words.

A word is a maximal run of bytes other than blank and 0x09 to 0x0D, which for UTF-8 is the
same as a run of code points other than these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Lower case, and every ASCII mark a blank.
PLAIN = LOWER.copy()
PLAIN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32

#: Bytes that are hashed at once; larger texts go piece by piece, cut between words.
SEGMENT = 1 << 20
#: Bytes of text that are looked at together.
GROUP = 4 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads each input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base modulo 2^64 and of its inverse."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers = both[0], both[1]
    return _powers


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span (ascending, disjoint) by prefix sums of a polynomial modulo 2^64."""
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        at = int(starts[lo])
        hi = max(int(np.searchsorted(ends, at + SEGMENT, side="right")), lo + 1)
        piece = buf[at : int(ends[hi - 1])]
        power, inverse = _power_tables(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[piece] * power[: len(piece)], out=sums[1:])
        s, e = starts[lo:hi] - at, ends[lo:hi] - at
        out[lo:hi] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


class Texts:
    """Some texts end to end: bytes, offsets, and the words with the text each lies in."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, table: np.ndarray | None = None) -> None:
        self.offsets = offsets.astype(np.int64)
        self.raw = buf
        self.buf = buf if table is None else table[buf]
        self.n = len(offsets) - 1
        solid = np.zeros(len(buf) + 1, dtype=bool)
        solid[:-1] = ~SPACE[self.buf]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        # A word ends with its text, even if the next one begins with a word.
        inner = self.offsets[:-1]
        inner = inner[inner < len(buf)]
        begin[inner] = solid[inner]
        self.starts = np.flatnonzero(begin)
        stop = solid.copy()
        stop[:-1] &= ~solid[1:] | begin[1:]
        self.ends = np.flatnonzero(stop) + 1
        self.doc = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self.words = np.bincount(self.doc, minlength=self.n).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.words)])

    def hashes(self) -> np.ndarray:
        return hash_spans(self.buf, self.starts, self.ends)

    def per_text(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sums of values by the text that the byte positions lie in."""
        doc = np.searchsorted(self.offsets, at, side="right") - 1
        return np.bincount(doc, weights=values, minlength=self.n)


def texts_of(column: pa.Array, table: np.ndarray | None = None) -> Iterator[tuple[int, int, Texts]]:
    """Slices (from, to, texts) of a string column, each of about GROUP bytes; null is empty. table maps bytes first."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(int(np.searchsorted(offsets, offsets[lo] + GROUP, side="right")) - 1, lo + 1)
        yield lo, hi, Texts(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], table)
        lo = hi
