"""Word splitting and hashing over Arrow string buffers, whole batches at a time.

Words are maximal runs of word bytes. Both word classes used here treat every byte of a multi-byte UTF-8
character alike, so splitting bytes equals splitting characters. A-Z are lower-cased first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

PIECE = 1 << 19
HASHED_AT_ONCE = 1 << 16
U = np.uint64
_R = U(0x9E3779B97F4A7C15)

B = np.uint8


def NOT_SPACE(data: np.ndarray) -> np.ndarray:
    """Bytes of the words `[^\\x20\\x09-\\x0D]+`."""
    return (data != B(0x20)) & (data - B(9) > B(4))


def LETTERS(data: np.ndarray) -> np.ndarray:
    """Bytes of the words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` in lower-cased text."""
    return (data >= B(0x80)) | (data - B(0x30) < B(10)) | (data - B(0x61) < B(26))


def _lowered(data: np.ndarray) -> np.ndarray:
    return data + ((data - B(65) < B(26)).view(B) << B(5))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = U(pow(int(_R), -1, 1 << 64))
_UP, _DOWN = _powers(_R, HASHED_AT_ONCE + 1), _powers(_INVERSE, HASHED_AT_ONCE + 1)


def _weights(n: int) -> tuple[np.ndarray, np.ndarray]:
    return (_UP, _DOWN) if n <= len(_UP) else (_powers(_R, n), _powers(_INVERSE, n))


def segment_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order-sensitive 64-bit hash of values[starts[i]:ends[i]]; segments ascend and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        at = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, at + HASHED_AT_ONCE, "right")))
        part = values[at : int(ends[hi - 1])]
        up, down = _weights(len(part) + 1)
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(part * up[: len(part)], out=total[1:])
        s, e = starts[lo:hi] - at, ends[lo:hi] - at
        out[lo:hi] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * U(0xD6E8FEB86659FD93))
        lo = hi
    return out


_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
#: Longer stretches of bytes are hashed one by one.
LONG = 512


def byte_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start[i]:end[i]], eight bytes of all at a time."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left = end - start
    h = left.astype(np.uint64) * U(0x9E3779B97F4A7C15)
    which = None
    at = start
    while len(at):
        x = eight[at] & _MASK[np.minimum(left, 8)]
        x = ((h if which is None else h[which]) ^ x) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
        x ^= x >> U(32)
        if which is None:
            h = x
            which = np.flatnonzero((left > 8) & (left <= LONG))
            at, left = start[which] + 8, left[which] - 8
        else:
            h[which] = x
            more = left > 8
            which, at, left = which[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(end - start > LONG):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return h


def by_unit(unit: np.ndarray, value: np.ndarray, units: int) -> np.ndarray:
    """An order by unit and value."""
    shift = U(64 - max(1, units.bit_length()))
    top = (unit.astype(np.uint64) << shift) | (value >> (U(64) - shift))
    order = np.argsort(top)
    tied = top[order]
    if ((tied[1:] == tied[:-1]) & (value[order][1:] != value[order][:-1])).any():
        return np.lexsort((value, unit))
    return order


def pieces(col: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of consecutive rows with about `size` bytes; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    if len(col) == 0:
        return
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    raw = col.buffers()
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """Words of consecutive units (documents, or lines of documents): unit, start, end and hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: Callable[[np.ndarray], np.ndarray], lines: bool = False):
        data = _lowered(data)
        self.data = data
        if lines:
            breaks = np.flatnonzero(data == 10)
            cut = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
            cut = cut[cut < len(data)]
            #: the document of each line and the line's number in it; only lines without words may be missing
            self.row = np.searchsorted(offsets, cut, "right") - 1
            self.line = np.searchsorted(breaks, cut) - np.searchsorted(breaks, offsets[self.row])
            self.bounds = np.append(cut, len(data))
        else:
            self.bounds = offsets
            self.row = np.arange(len(offsets) - 1)
        n = len(data)
        if n == 0:
            self.start = self.end = self.unit = np.empty(0, np.int64)
            self.hash = np.empty(0, np.uint64)
            self.first = np.zeros(len(self.bounds), np.int64)
            return
        word = kind(data)
        # units are cut at every bound; lines end in a byte of no word anyhow
        inner = offsets if lines else self.bounds
        inner = inner[(inner > 0) & (inner < n)]
        edge = word.copy()
        edge[1:] &= ~word[:-1]
        edge[inner] = word[inner]
        self.start = np.flatnonzero(edge)
        edge[:] = word
        edge[:-1] &= ~word[1:]
        edge[inner - 1] = word[inner - 1]
        self.end = np.flatnonzero(edge) + 1
        self.hash = byte_hash(data, self.start, self.end)
        #: first[i]:first[i + 1] are the words of unit i
        self.first = np.searchsorted(self.start, self.bounds)
        self.unit = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.first))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def sequence_keys(self) -> np.ndarray:
        """A hash of each unit's word sequence."""
        return segment_hash(self.hash, self.first[:-1], self.first[1:])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, first word, hash) of each run of `size` words inside a unit."""
        n = len(self.hash)
        if n < size:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        h = self.hash[: n - size + 1].copy()
        for j in range(1, size):
            h = h * U(0x9FB21C651E98DF25) + self.hash[j : n - size + 1 + j]
        inside = self.unit[: n - size + 1] == self.unit[size - 1 :]
        at = np.flatnonzero(inside)
        return self.unit[at], at, mix(h[at] + U(size))

    def shingles(self, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """(unit, hash) of every shingle, with repeats; a unit of fewer words, but not none, is one shingle."""
        unit, _, h = self.windows(size)
        count = self.counts()
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):
            whole = segment_hash(self.hash, self.first[short], self.first[short + 1])
            unit, h = np.concatenate([unit, short]), np.concatenate([h, whole])
        return unit, h
