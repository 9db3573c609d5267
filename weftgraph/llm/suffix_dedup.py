"""Bytes of repeated passages: every string of `length` bytes that starts at more than one place, found by buckets of suffixes.

Suffixes only have to be told apart by their first `length` bytes, and any order in which equal strings are neighbours will
do, so they are ordered by hash, and a bucket is a range of it. Nothing but one bucket, or one block of texts, is in memory.

1. Blocks. Texts are cut into blocks of about BLOCK bytes, written once; a block is known by a number from then on.
2. Cover sample. The places whose distance from the start of their text is in a difference cover modulo v: whatever two
   places i and j are, some d < v takes both to sampled places. So equal strings at i and j hold equal sampled strings of
   length - v + 1 bytes. Each block sends these as sorted hashes; buckets are sorted one at a time and tell each block which
   come again. What lies further than v before such a place is never looked at again.
3. Long ties. A sampled string of length + v - 1 bytes that comes again proves v windows at once. These ranks of the cover
   settle all but the ends of long matches; one block for each such string, its leader, stands for them later.
4. Rest. Windows that aren't proven, and those of leaders, are sorted by bucket on their own 96-bit hashes.

A string that comes again inside one block is sent once, so a bucket gets at most one entry of it for each block. Hashes of
step 2 only choose; a window goes if 96-bit hashes of whole strings are equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .setjoin import pack, unpack
from .shared import block_count, forget, give_back, small_batches, staged

U = np.uint64
#: Bytes of text in a block; a longer text is a block of its own. Bytes of input for each bucket.
BLOCK, BUCKET = 12 << 20, 24 << 20
#: Bits of a sampled hash that are sent, besides those that name its bucket.
SAMPLED = 40
_LANES = ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))


def cover(length: int) -> tuple[int, np.ndarray]:
    """(v, places): a perfect difference cover modulo v, as large as a string of `length` bytes takes. The powers of 2 modulo
    73, 7 and 3 have every difference once."""
    v = next((v for v in (73, 7, 3) if 2 * v <= length), 1)
    return v, np.unique([pow(2, i, v) for i in range(9)])


def _hash(data: np.ndarray, at: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """64-bit hash of the n bytes at each place; eight bytes of all places at a time."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    seed, factor = (U(x) for x in _LANES[lane])
    h = np.full(len(at), int(seed) * n & (1 << 64) - 1, np.uint64)
    for j in [*range(0, n - 7, 8), *([n - 8] if n > 8 and n % 8 else [])]:
        h ^= eight[at + j]
        h *= factor
        h ^= h >> U(32)
    if n < 8:
        h = (h ^ (eight[at] & U((1 << (8 * n)) - 1))) * factor
        h ^= h >> U(32)
    h *= seed
    return h ^ (h >> U(29))


def _in_parts(f: Callable[[np.ndarray], np.ndarray], at: np.ndarray, size: int = 1 << 16) -> np.ndarray:
    return np.concatenate([f(at[i : i + size]) for i in range(0, max(1, len(at)), size)])


def _every(data: np.ndarray, n: int, lane: int, size: int = 1 << 15) -> np.ndarray:
    """64-bit hash of the n bytes at every place, n >= 8: hashes of stretches of 8 bytes, then of 16, 32 and so on from two halves."""
    factor, other = (U(x) for x in _LANES[lane])
    out = np.empty(max(0, len(data) - n + 1), np.uint64)

    def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a * factor
        x ^= x >> U(31)
        x += b
        x *= other
        x ^= x >> U(32)
        return x

    for lo in range(0, len(out), size):
        part = np.ascontiguousarray(data[lo : lo + size + n - 1])
        h, m = np.ndarray((len(part) - 7,), "<u8", part, strides=(1,)).copy(), 8
        while 2 * m <= n:
            h, m = both(h[:-m], h[m:]), 2 * m
        out[lo : lo + size] = both(h[: len(h) - (n - m)], h[n - m :])
    return out


@dataclass
class _Keys:
    """Keys of strings: hi, and lo for another 32 bits, or nothing."""

    hi: np.ndarray
    lo: np.ndarray | None

    def __len__(self) -> int:
        return len(self.hi)

    def __getitem__(self, at) -> _Keys:
        return _Keys(self.hi[at], None if self.lo is None else self.lo[at])

    def order(self) -> np.ndarray:
        order = np.argsort(self.hi)
        if self.lo is not None:
            hi, lo = self.hi[order], self.lo[order]
            if ((hi[1:] == hi[:-1]) & (lo[1:] != lo[:-1])).any():
                return np.lexsort((self.lo, self.hi))
        return order

    def new(self) -> np.ndarray:
        """Which differ from the one before; of keys in order."""
        out = np.ones(len(self), bool)
        out[1:] = self.hi[1:] != self.hi[:-1]
        if self.lo is not None:
            out[1:] |= self.lo[1:] != self.lo[:-1]
        return out

    def packed(self, more: np.ndarray | None = None) -> bytes:
        """Keys in order, not none, and a byte more for each: steps from key to key in as few bytes as the largest takes, and no
        compression, since hashes have none to gain."""
        used = int(np.bitwise_or.reduce(self.hi))
        shift = max(0, (used & -used).bit_length() - 1)
        step = np.diff(self.hi) >> U(shift)
        width = max(1, (int(step.max(initial=0)).bit_length() + 7) // 8)
        head = np.array([len(self), shift, width, self.lo is not None, more is not None], np.int64)
        body = [head.tobytes(), self.hi[:1].tobytes(), np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()]
        return b"".join([*body, b"" if self.lo is None else self.lo.tobytes(), b"" if more is None else more.astype(np.uint8).tobytes()])

    @classmethod
    def of(cls, blob: bytes) -> tuple[_Keys, np.ndarray | None]:
        n, shift, width, wide, more = np.frombuffer(blob, np.int64, 5).tolist()
        at = 48
        step = np.zeros((n, 8), np.uint8)
        step[1:, :width] = np.frombuffer(blob, np.uint8, (n - 1) * width, at).reshape(n - 1, width)
        at += (n - 1) * width
        hi = step.view(np.uint64).reshape(-1) << U(shift)
        hi[0] = np.frombuffer(blob, np.uint64, 1, 40)[0]
        lo = np.frombuffer(blob, np.uint32, n, at) if wide else None
        return cls(np.cumsum(hi, dtype=np.uint64), lo), np.frombuffer(blob, np.uint8, n, at + 4 * n * wide) if more else None

    @classmethod
    def together(cls, parts: list[_Keys]) -> _Keys:
        wide = any(p.lo is not None for p in parts)
        none = [np.empty(0, np.uint32)]
        return cls(np.concatenate([np.empty(0, np.uint64), *(p.hi for p in parts)]), np.concatenate([*none, *(p.lo for p in parts if p.lo is not None)]) if wide else None)


def _sample_keys(data: np.ndarray, at: np.ndarray, n: int, bits: int) -> _Keys:
    """Keys of the n bytes at each place: SAMPLED bits behind the `bits` of a bucket."""
    return _Keys(_in_parts(lambda x: _hash(data, x, n), at) & ~U((1 << max(0, 64 - SAMPLED - bits)) - 1), None)


def _wide_keys(data: np.ndarray, at: np.ndarray, n: int, dense: bool = False) -> _Keys:
    """96-bit keys of the n bytes at each place. dense: hash all places, as most are asked for; another key than otherwise."""
    if n < 8 or not dense:
        hi, lo = (_in_parts(lambda x, lane=lane: _hash(data, x, n, lane), at) for lane in (0, 1))
    else:
        hi, lo = (_every(data, n, lane)[at] for lane in (0, 1))
    return _Keys(hi, (lo >> U(32)).astype(np.uint32))


def _distinct(keys: _Keys) -> _Keys:
    keys = keys[keys.order()]
    return keys[keys.new()]


def _sent(block: int, keys: _Keys, bits: int) -> Iterator[pa.RecordBatch]:
    """A row for each bucket: (bucket, block, keys). keys ascend and are distinct."""
    if len(keys):
        first = np.searchsorted(keys.hi, np.arange(1 << bits, dtype=np.uint64) << U(64 - bits))
        last = np.append(first[1:], len(keys))
        bucket = np.flatnonzero(first < last)
        blobs = [keys[first[i] : last[i]].packed() for i in bucket]
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(blobs), block)), pa.array(blobs, pa.binary())], names=["bucket", "block", "keys"])


SENT = "bucket bigint, block bigint, keys binary"


def repeated(sent: DataFrame) -> DataFrame:
    """(block, found): for each block the keys that other blocks have too, and whether it is the first of them; one bucket at a
    time is sorted. A row of `sent` holds a key once."""

    def sort(key: tuple, table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy()
        parts = [_Keys.of(x.as_py())[0] for x in table.column("keys")]
        size = [len(p) for p in parts]
        keys, row = _Keys.together(parts), np.repeat(np.arange(len(parts), dtype=np.int32), size)
        del parts
        order = keys.order()
        new = keys[order].new()
        again = ~new | ~np.append(new[1:], True)
        order, first = order[again], np.flatnonzero(new[again])
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        least = np.minimum.reduceat(block[row[order]], first) if len(order) else np.empty(0, np.int64)
        leads = (block[row[order]] == least[group]).astype(np.uint8)
        # back to the rows, in each by key, as they came
        back = np.argsort(order)
        order, leads = order[back], leads[back]
        cut = np.searchsorted(row[order], np.arange(len(size) + 1))
        some = np.flatnonzero(np.diff(cut))
        blobs = [keys[order[cut[i] : cut[i + 1]]].packed(leads[cut[i] : cut[i + 1]]) for i in some]
        return pa.table({"block": pa.array(block[some], pa.int64()), "found": pa.array(blobs, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(sort, "block bigint, found binary")


def _told(table: pa.Table) -> tuple[_Keys, np.ndarray]:
    """(keys, leads) of what buckets said about a block, in order."""
    parts = [_Keys.of(x.as_py()) for x in table.column("found")]
    keys, leads = _Keys.together([p[0] for p in parts]), np.concatenate([np.empty(0, np.uint8), *(p[1] for p in parts)]).astype(bool)
    order = keys.order()
    return keys[order], leads[order]


def _find(keys: _Keys, told: _Keys) -> np.ndarray:
    """Where each key is in `told`, -1 if nowhere; both ascend."""
    out = np.full(len(keys), -1)
    if len(told):
        lo = np.searchsorted(told.hi, keys.hi)
        same = np.flatnonzero(told.hi[np.minimum(lo, len(told) - 1)] == keys.hi)
        if told.lo is None or keys.lo is None:
            out[same] = lo[same]
            return out
        at, left = lo[same], same
        while len(left):  # more than once only where 64 bits agree and 32 don't
            hit = told.lo[at] == keys.lo[left]
            out[left[hit]] = at[hit]
            at, left = at[~hit] + 1, left[~hit]
            more = (at < len(told)) & (told.hi[np.minimum(at, len(told) - 1)] == keys.hi[left])
            at, left = at[more], left[more]
    return out


def _repeats(at: np.ndarray, keys: _Keys, told: _Keys) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of these places: (which come again in this block or, as told, in others; the first place of each such string; where it
    is in `told`, or -1)."""
    order = keys.order()
    keys = keys[order]
    first = np.flatnonzero(keys.new())
    times = np.diff(np.append(first, len(order)))
    where = _find(keys[first], told)
    again = (times > 1) | (where >= 0)
    return at[order[np.repeat(again, times)]], at[order[first[again]]], where[again]


# blocks


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to blocks: (block, ids, body), body being compressed texts and where they end."""
    held, size, number = [], 0, TaskContext.get().partitionId() << 32

    def block() -> pa.RecordBatch:
        nonlocal held, size, number
        ids, texts = (pa.chunked_array([b.column(i) for b in held]).combine_chunks() for i in (0, 1))
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = texts.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if texts.buffers()[2] else b""
        row = [pa.array([x], t) for x, t in ((number, pa.int64()), (pack(ids.fill_null(0).to_numpy().view(np.uint64), np.asarray(ids.is_null()).view(np.uint8), np.diff(offsets).astype(np.uint64)), pa.binary()), (zstandard.ZstdCompressor(level=3).compress(body), pa.binary()))]
        held, size, number = [], 0, number + 1
        return pa.RecordBatch.from_arrays(row, names=["block", "head", "body"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(1).nbytes
        if size > BLOCK:
            yield block()
            give_back()
    if held:
        yield block()


def _opened(head: bytes, body: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(ids, offsets, bytes) of a block"""
    ids, null, size = unpack(head)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8) if size.sum() else np.empty(0, np.uint8)
    return pa.array(ids.view(np.int64), pa.int64(), mask=null.astype(bool)), np.append(0, np.cumsum(size)).astype(np.int64), data


def _sampled(offsets: np.ndarray, v: int, places: np.ndarray, n: int) -> np.ndarray:
    """The places of the cover in every text at which n bytes are left."""
    size = np.diff(offsets)
    periods = -(-size // v)
    base = np.repeat(offsets[:-1], periods) + v * (np.arange(int(periods.sum())) - np.repeat(np.cumsum(periods) - periods, periods))
    at = (base[:, None] + places[None, :]).reshape(-1)
    return at[at + n <= np.repeat(np.repeat(offsets[1:], periods), len(places))]


def _covered(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any [lo, hi)."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, lo, 1)
    np.add.at(change, hi, -1)
    return np.cumsum(change[:-1]) > 0


def _runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of True"""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


class _Thin:
    """What is left of a block after sampling: pieces of texts around sampled places that come again.

    data: the pieces' bytes, one after the other; end: where the piece of each ends. doc, start: whose piece it is, and from
    where. at: the sampled places. proven: places whose window surely comes again; led: windows that this block stands for.
    """

    def __init__(self, data, size, doc, start, at, proven=None, led=None):
        self.data, self.size, self.doc, self.start, self.at = data, size.astype(np.int64), doc, start, at.astype(np.int64)
        none = np.empty(0, np.int64)
        self.proven, self.led = (none if x is None else x.astype(np.int64) for x in (proven, led))
        self.cut = np.append(0, np.cumsum(self.size))

    def packed(self) -> bytes:
        ascending = [np.diff(x, prepend=0).astype(np.uint32) for x in (self.at, self.proven, self.led)]
        return pack(self.data, self.size.astype(np.uint64), self.doc.astype(np.uint32), self.start.astype(np.uint64), *ascending)

    @classmethod
    def of(cls, blob: bytes) -> _Thin:
        data, size, doc, start, *ascending = unpack(blob)
        return cls(data, size, doc, start, *[np.cumsum(x, dtype=np.int64) for x in ascending])

    def piece(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cut, at, "right") - 1

    def fitting(self, at: np.ndarray, n: int) -> np.ndarray:
        return at[at + n <= self.cut[self.piece(at) + 1]]


def _thinned(offsets: np.ndarray, data: np.ndarray, at: np.ndarray, v: int, length: int) -> _Thin:
    at = np.sort(at)
    text = np.searchsorted(offsets, at, "right") - 1
    lo, hi = np.maximum(at - v + 1, offsets[text]), np.minimum(at + length + v - 1, offsets[text + 1])
    new = np.append(True, (text[1:] != text[:-1]) | (lo[1:] > np.maximum.accumulate(hi)[:-1])) if len(at) else np.empty(0, bool)
    first = np.flatnonzero(new)
    a, b = lo[first], np.maximum.reduceat(hi, first) if len(at) else hi
    size = b - a
    keep = np.arange(int(size.sum())) + np.repeat(a - (np.cumsum(size) - size), size)
    piece = np.cumsum(new) - 1
    return _Thin(data[keep], size, text[first], a - offsets[text[first]], at - a[piece] + (np.cumsum(size) - size)[piece])


def _open_windows(thin: _Thin, v: int, length: int) -> np.ndarray:
    """Places whose window might come again: up to v before a sampled place, and not proven."""
    begin = thin.cut[thin.piece(thin.at)]
    on = _covered(np.maximum(thin.at - v + 1, begin), thin.at + 1, len(thin.data))
    on[thin.proven] = False
    return thin.fitting(np.flatnonzero(on), length)


def _joined(left: DataFrame, right: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(f, schema)


def _parts(block: int, blob: bytes | None) -> pa.Table:
    return pa.table({"block": pa.array([] if blob is None else [block], pa.int64()), "part": pa.array([] if blob is None else [blob], pa.binary())})


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) for every row of docs: spans are the maximal removed runs [start, end) of the
    text's UTF-8 bytes, kept the rest.

    A byte goes if some string of `length` bytes around it starts anywhere else too, in this text or another, judged on the
    input. Null texts are empty; texts below `length` bytes stay whole; repeated rows are copies of each other, so both lose
    what they share; null ids stay null, one row each. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    v, places = cover(length)
    short, long = length - v + 1, length + v - 1
    docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    bits = block_count(docs, BUCKET, 16).bit_length() - 1
    blocks = staged(docs.mapInArrow(_cut, "block bigint, head binary, body binary"), "blocks")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, head, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, offsets, data = _opened(head, body)
                yield from _sent(block, _distinct(_sample_keys(data, _sampled(offsets, v, places, short), short, bits)), bits)
                give_back()

    def thin_out(left: pa.Table, right: pa.Table) -> pa.Table:
        block, head, body = (left.column(i)[0].as_py() for i in range(3))
        _, offsets, data = _opened(head, body)
        at = _sampled(offsets, v, places, short)
        at = _repeats(at, _sample_keys(data, at, short, bits), _told(right)[0])[0]
        out = _parts(block, _thinned(offsets, data, at, v, length).packed() if len(at) else None)
        give_back()
        return out

    def rank_cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                thin = _Thin.of(part)
                yield from _sent(block, _distinct(_wide_keys(thin.data, thin.fitting(thin.at, long), long)), bits)

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        thin = _Thin.of(left.column(1)[0].as_py())
        at = thin.fitting(thin.at, long)
        told, leads = _told(right)
        proven, first, where = _repeats(at, _wide_keys(thin.data, at, long), told)
        led = first[(where < 0) | np.append(leads, False)[where]]
        thin.proven, thin.led = (np.flatnonzero(_covered(x, x + v, len(thin.data))) for x in (proven, led))
        return _parts(left.column(0)[0].as_py(), thin.packed())

    def wanted(thin: _Thin) -> np.ndarray:
        return np.union1d(_open_windows(thin, v, length), thin.led)

    def rank_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                thin = _Thin.of(part)
                yield from _sent(block, _distinct(_wide_keys(thin.data, wanted(thin), length, True)), bits)
                give_back()

    def spans(left: pa.Table, right: pa.Table) -> pa.Table:
        """For a block, the runs of bytes that go: text, start and end of each."""
        thin = _Thin.of(left.column(1)[0].as_py())
        at = wanted(thin)
        at = np.union1d(_repeats(at, _wide_keys(thin.data, at, length, True), _told(right)[0])[0], thin.proven)
        if not len(at):
            return _parts(0, None)
        edges = thin.cut[:-1]
        on = _covered(at, at + length, len(thin.data))
        lo, hi = _runs(on)
        # runs of two pieces may touch here though they don't in the text
        lo = np.union1d(lo, edges[on[edges]])
        hi = np.append(np.minimum(lo[1:], hi[np.searchsorted(hi, lo[:-1], "right")]), hi[-1])
        piece = thin.piece(lo)
        begin = thin.start[piece].astype(np.int64) + lo - thin.cut[piece]
        return _parts(left.column(0)[0].as_py(), pack(thin.doc[piece], begin.astype(np.uint64), (hi - lo).astype(np.uint64)))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, offsets, data = _opened(left.column(1)[0].as_py(), left.column(2)[0].as_py())
        doc, start, size = unpack(right.column(1)[0].as_py()) if right.num_rows else (np.empty(0, np.uint64),) * 3
        doc, start, size = (x.astype(np.int64) for x in (doc, start, size))
        # pieces of one text may touch or overlap; runs of the text itself count
        on = np.zeros(len(data), bool)
        for a, n in zip((offsets[doc] + start).tolist(), size.tolist(), strict=True):
            on[a : a + n] = True
        edge = on.copy()
        inner = offsets[1:-1][offsets[1:-1] < len(data)]
        edge[1:] &= ~on[:-1]
        edge[inner] = on[inner]
        lo = np.flatnonzero(edge)
        stop = on.copy()
        stop[:-1] &= ~on[1:]
        last = inner[inner > 0] - 1
        stop[last] = on[last]
        hi = np.flatnonzero(stop) + 1
        text = np.searchsorted(offsets, lo, "right") - 1
        runs = pa.StructArray.from_arrays([pa.array(lo - offsets[text]), pa.array(hi - offsets[text])], names=["start", "end"])
        gone = np.append(0, np.cumsum(on))[offsets]
        left_at = offsets - gone
        kept = data[~on].tobytes()
        counted = np.searchsorted(text, np.arange(len(ids) + 1))
        return pa.table(
            {
                "doc_id": ids,
                "n_bytes": pa.array(np.diff(offsets)),
                "n_removed": pa.array(np.diff(gone)),
                "spans": pa.ListArray.from_arrays(pa.array(counted, pa.int32()), runs),
                "kept": pa.array([kept[a:b] for a, b in zip(left_at[:-1], left_at[1:], strict=True)], pa.binary()),
            }
        )

    two = "block bigint, part binary"
    thin = staged(_joined(blocks, repeated(blocks.mapInArrow(sample, SENT)), thin_out, two), "thin")
    settled = staged(_joined(thin, repeated(thin.mapInArrow(rank_cover, SENT)), settle, two), "settled")
    forget(thin)
    gone = staged(_joined(settled, repeated(settled.mapInArrow(rank_rest, SENT)), spans, two), "spans")
    forget(settled)
    return _joined(blocks, gone, finish, "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
