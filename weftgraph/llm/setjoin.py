"""Exact Jaccard links between the shingle sets of many units (documents, or lines), without all-pairs work.

1. Rarity. One pass counts the tokens of all units in hashed counters, kept as logarithms in a byte each. The order
   (counter, hash) is a total order over tokens, rare ones first; any total order gives right results.
2. Prefixes. Units whose Jaccard similarity is T or more share a token among the first n - ceil(T n) + 1 of
   each, so only these are posted. Copies share one key and count once.
3. Candidates. Postings meet in one block for each range of tokens, as packed arrays: a sparse product of units by prefix
   tokens. Overlaps add up over the blocks; pairs whose sizes or positions exclude a link are dropped. Tokens whose
   counter is far above the mean stay rows that Spark can pre-aggregate and split, and so do tokens that turn out to have
   more than `cold` units where they meet: each of their units is first held against the token's leader only.
4. Blocked product. Candidates' rows of the incidence matrix are dealt to cells (row block, column block), units
   with common partners together; a cell multiplies its blocks where candidates are and adds up their overlaps.
5. Rest of hot tokens. Pairs that a leader already connected need no work; a pair whose distances from a common
   leader differ by more than 1 - T can't link, as the Jaccard distance is a metric. All others are counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import block_count, forget, give_back, input_bytes, merged, small_batches, staged
from .words import NOT_SPACE, Words, by_unit, mix, pieces

U = np.uint64
FLUSH = 1 << 19
#: A token with no more units than these has all its pairs looked at where its postings meet.
COLD = 64
#: Counters: one for so many bytes of input files, a power of two between these. A byte each in every Python worker.
BYTES_PER_COUNTER, LEAST_BITS, MOST_BITS = 32, 16, 26
#: Units of one block of the product; a cell has two blocks.
CELL = 128
RANGES = 64


@dataclass(frozen=True)
class Rule:
    """100 * intersection >= percent * union, over shingles of `size` words; lines=True takes lines as units."""

    percent: int = 75
    size: int = 5
    lines: bool = False
    cold: int = COLD

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - -(-n * self.percent // 100) + 1

    def needed(self, a, b):
        """The least overlap of linked sets of sizes a and b."""
        return -(-(a + b) * self.percent // (100 + self.percent))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed: sorted or small numbers take few bytes."""
    head = np.array([len(arrays)] + [x for a in arrays for x in (len(a), a.dtype.itemsize)], np.int64).tobytes()
    coder = zstandard.ZstdCompressor(level=1).compressobj(size=len(head) + sum(a.nbytes for a in arrays))
    out = [coder.compress(head)]
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize)
        out += [coder.compress(np.ascontiguousarray(planes[:, i])) for i in range(planes.shape[1] if len(a) else 0)]
    return b"".join([*out, coder.flush()])


def unpack(blob: bytes) -> list[np.ndarray]:
    """Unsigned arrays of the widths that were packed."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 1 + 2 * count)[1:].reshape(count, 2)
    at, out = 8 * (1 + 2 * count), []
    for n, width in head:
        part = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        out.append(np.ascontiguousarray(part).reshape(-1).view(f"u{width}") if n else np.empty(0, f"u{width}"))
        at += n * width
    return out


def _units(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray, Words]]:
    """(ids, hashes of the texts, words) of pieces of the batches' columns doc_id, text, row."""
    for batch in batches:
        ids, rows = (batch.column(c).cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False) for c in (0, 2))
        for lo, hi, data, offsets in pieces(batch.column(1)):
            yield ids[lo:hi], rows[lo:hi], Words(data, offsets, NOT_SPACE, rule.lines)
        give_back()


def _unique(unit: np.ndarray, value: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, unit, value): sorted by unit and value, without repeats; order tells where they were."""
    order = by_unit(unit, value, units)
    unit, value = unit[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (unit[1:] != unit[:-1])
    return order[new], unit[new], value[new]


def _first_of(keys: np.ndarray, asked: np.ndarray, seen: set) -> np.ndarray:
    """Which units are the first of their key, of those asked for; keys are remembered over calls, but no more than some 100,000."""
    out = np.zeros(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = True
    out &= asked
    at = np.flatnonzero(out)
    own = keys[at].tolist()
    out[at] = [x not in seen for x in own]
    if len(seen) > 1 << 17:
        seen.clear()
    seen.update(own)
    return out


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64), pa.int64())


def _table(schema: list[tuple[str, pa.DataType]], *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(cols, schema, strict=True)], names=[n for n, _ in schema])


def _some(schema: list[tuple[str, pa.DataType]], n: int, /, **cols) -> pa.RecordBatch:
    """n rows; columns that aren't given are null."""
    return _table(schema, *[cols[c] if c in cols else pa.nulls(n, t) for c, t in schema])


# 1. rarity


def _level(count):
    """A counter as eight steps for each doubling."""
    return np.minimum(np.ceil(8 * np.log2(np.asarray(count, np.float64) + 1)), 255).astype(np.uint8)


@dataclass
class Census:
    """What every worker gets: the level of each token counter, and for lines a bit for each slot that more than one line's
    key fell on. hot: the highest level at which a token's postings may all meet in one block."""

    bits: int
    levels: np.ndarray
    repeated: np.ndarray | None
    hot: int

    def of(self, token: np.ndarray) -> np.ndarray:
        return self.levels[(token >> U(64 - self.bits)).astype(np.int64)]

    def may_repeat(self, key: np.ndarray) -> np.ndarray:
        at = (key >> U(63 - self.bits)).astype(np.int64)
        return (self.repeated[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


class _Sparse:
    """Counts of slots below 2**bits, sent as (part, packed slots and counts); part numbers start from `base`."""

    def __init__(self, bits: int, base: int):
        self.width, self.base, self.held, self.n = bits - RANGES.bit_length() + 1, base, [], 0

    def add(self, slots: np.ndarray) -> None:
        self.held.append(slots.astype(np.uint32))
        self.n += len(slots)

    def sent(self) -> Iterator[tuple[int, bytes]]:
        slots = np.sort(np.concatenate(self.held)) if self.held else np.empty(0, np.uint32)
        self.held, self.n = [], 0
        if len(slots):
            first = np.flatnonzero(np.append(True, slots[1:] != slots[:-1]))
            count, slots = np.diff(np.append(first, len(slots))), slots[first]
            cut = np.append(0, np.searchsorted(slots, np.arange(1, RANGES + 1, dtype=np.uint64) << U(self.width)))
            for part, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if a < b:
                    yield self.base + part, _pack_counts(slots[a:b] & np.uint32((1 << self.width) - 1), count[a:b])


def _pack_counts(slots: np.ndarray, counts: np.ndarray) -> bytes:
    return pack(np.diff(slots.astype(np.uint32), prepend=np.uint32(0)), counts.astype(np.uint32))


def census(docs: DataFrame, rule: Rule) -> Census:
    """Counts of the tokens of all units; a line that comes again in one task counts once."""
    size = input_bytes(docs)
    bits = int(np.clip(np.ceil(np.log2(max(1, size) / BYTES_PER_COUNTER)), LEAST_BITS, MOST_BITS))
    schema = [("part", pa.int32()), ("blob", pa.binary())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, keys, seen = _Sparse(bits, 0), _Sparse(bits + 1, RANGES), set()
        for _, _, w in _units(batches, rule):
            unit, h = w.shingles(rule.size)
            if rule.lines:
                k, some = w.sequence_keys(), w.counts() > 0
                keys.add(k[some] >> U(63 - bits))
                h = h[_first_of(k, some, seen)[unit]]
            tokens.add(h >> U(64 - bits))
            if tokens.n + keys.n > 4 * FLUSH:
                yield from ([_table(schema, *map(list, zip(*rows, strict=True)))] if (rows := [*tokens.sent(), *keys.sent()]) else [])
        if rows := [*tokens.sent(), *keys.sent()]:
            yield _table(schema, *map(list, zip(*rows, strict=True)))

    def add(part: int, blobs: list[bytes], last: bool) -> bytes:
        total = np.zeros((1 << (bits + (part >= RANGES))) // RANGES, np.uint32)
        for blob in blobs:
            step, n = unpack(blob)
            at = np.cumsum(step, dtype=np.uint32)
            total[at] = np.minimum(total[at].astype(np.uint64) + n, U(0xFFFFFFFF))
        if not last:
            at = np.flatnonzero(total)
            return _pack_counts(at, total[at])
        return pack(np.packbits(total > 1)) if part >= RANGES else pack(_level(total), np.array([total.sum(dtype=np.uint64)]))

    levels, repeated, total = np.zeros(1 << bits, np.uint8), np.zeros(1 << (bits - 2), np.uint8) if rule.lines else None, 0
    for part, blob in merged(docs.mapInArrow(count, "part int, blob binary"), add, size >> 24):
        out, at = (levels, part) if part < RANGES else (repeated, part - RANGES)
        own = unpack(blob)
        step = len(out) // RANGES
        out[at * step : (at + 1) * step] = own[0]
        total += int(own[1][0]) if part < RANGES else 0
    # a counter of a rare token holds some others; only tokens well above that are hot
    return Census(bits, levels, repeated, int(_level(rule.cold + 2 * total / (1 << bits))) if rule.cold else 0)


# 2. prefixes


def _prefixes(w: Words, rule: Rule, known: Census, only: np.ndarray):
    """(unit, set size, position, token, is hot, number of hot tokens) of the prefixes of the units that `only` marks; sizes and numbers by unit."""
    unit, h = w.shingles(rule.size)
    if not only.all():
        unit, h = unit[only[unit]], h[only[unit]]
    level = known.of(h)
    # rare tokens first, then by hash: equal tokens have equal ranks
    order, unit, _ = _unique(unit, (level.astype(np.uint64) << U(56)) | (mix(h) >> U(8)), len(w.bounds))
    n_units = len(w.bounds) - 1
    size = np.bincount(unit, minlength=n_units)
    at = np.arange(len(unit)) - (np.cumsum(size) - size)[unit]
    keep = at < rule.prefix(size)[unit]
    unit, at, order = unit[keep], at[keep], order[keep]
    hot = level[order] > known.hot
    return unit, size, at, h[order], hot, np.bincount(unit[hot], minlength=n_units)


#: kind 0: packed postings of a block; 1: a posting of a hot token; 2: a unit.
POSTED = [("kind", pa.int8()), ("block", pa.int32()), ("postings", pa.binary()), ("token", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int64()), ("unit", pa.int64())]
POSTED_DDL = "kind byte, block int, postings binary, token bigint, key bigint, n int, pos int, doc_id bigint, row bigint, unit bigint"


def posted(docs: DataFrame, rule: Rule, known: Census, blocks: int) -> DataFrame:
    """Packed postings by block, a row for each posting of a hot token, and units: all documents, or the lines whose key may
    come again."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # 2**bits bytes, twice for lines; bits <= MOST_BITS
    top = blocks.bit_length() - 1

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Census = shared.value
        held: list[tuple[np.ndarray, ...]] = []
        n, seen = 0, set()

        def flush() -> pa.RecordBatch:
            nonlocal held, n
            h, key, size, hots, pos = (np.concatenate([x[i] for x in held]) for i in range(5))
            held, n = [], 0
            order = np.argsort(h)
            h, key, size, hots, pos = h[order], key[order], size[order], hots[order], pos[order]
            block = (h >> U(64 - top)).astype(np.int64) if top else np.zeros(len(h), np.int64)
            cut = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(h))
            blobs = []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                keys, one, back = np.unique(key[lo:hi], return_index=True, return_inverse=True)
                blobs.append(pack(h[lo:hi], back.astype(np.uint32), pos[lo:hi].astype(np.uint32), keys, size[lo:hi][one].astype(np.uint32), hots[lo:hi][one].astype(np.uint32)))
            return _some(POSTED, len(blobs), kind=[0] * len(blobs), block=block[cut[:-1]], postings=blobs)

        for ids, rows, w in _units(batches, rule):
            keys, some = w.sequence_keys(), w.counts() > 0
            fresh = _first_of(keys, some, seen)
            unit, size, pos, h, hot, hots = _prefixes(w, rule, known, fresh if rule.lines else some)
            listed = np.flatnonzero(some & known.may_repeat(keys)) if rule.lines else np.arange(len(keys))
            if len(listed):
                none = pa.array(ids[w.row[listed]], mask=ids[w.row[listed]] == -(1 << 63))
                own = _long(keys[listed]) if rule.lines else pa.array(keys.view(np.int64), mask=~some)
                line = w.line[listed] if rule.lines else np.zeros(len(listed), np.int64)
                yield _some(POSTED, len(listed), kind=[2] * len(listed), key=own, n=size[listed].astype(np.int32), doc_id=none, row=rows[w.row[listed]], unit=line)
            if not rule.lines:  # copies within this task are posted once
                keep = fresh[unit]
                unit, pos, h, hot = unit[keep], pos[keep], h[keep], hot[keep]
            if hot.any():
                u = unit[hot]
                yield _some(POSTED, len(u), kind=[1] * len(u), token=_long(h[hot]), key=_long(keys[u]), n=size[u].astype(np.int32), pos=pos[hot].astype(np.int32), doc_id=ids[w.row[u]])
            u = unit[~hot]
            held.append((h[~hot], keys[u], size[u], hots[u], pos[~hot]))
            n += len(u)
            if n > FLUSH:
                yield flush()
        if n:
            yield flush()

    return docs.mapInArrow(post, POSTED_DDL)


# 3. candidates


def _expand(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of all pairs inside consecutive groups of these lengths."""
    start = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum()))
    group = np.repeat(np.arange(len(lengths)), lengths)
    later = start[group] + lengths[group] - at - 1
    i = np.repeat(at, later)
    begin = np.cumsum(later) - later
    return i, i + 1 + np.arange(len(i)) - np.repeat(begin, later)


def _add_up(parts: list[np.ndarray]) -> np.ndarray:
    """Columns a, b, count, need, fits, a row for each pair: counts add up; one place that fits is enough."""
    rows = np.concatenate(parts, axis=1)
    order = np.lexsort((rows[1], rows[0]))
    rows = rows[:, order]
    first = np.flatnonzero(np.append(True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])))
    out = rows[:, first]
    out[2] = np.add.reduceat(rows[2], first)
    out[4] = np.maximum.reduceat(rows[4], first)
    return out


MET = [("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("need", pa.int64()), ("fits", pa.int64()), ("token", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())]
MET_DDL = "a bigint, b bigint, c bigint, need bigint, fits bigint, token bigint, key bigint, n int, pos int"


def met(packed: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of keys with the overlap c of their prefixes in this block, and postings of tokens with more than
    rule.cold units.

    Of two linked sets, the one whose prefix ends first in the order of tokens has all common tokens in both
    prefixes or behind its own. So the overlap is at most that of the prefixes plus the longer rest, and hot tokens,
    which aren't counted here, add the smaller of their numbers at most. The first common token of linked sets has
    enough tokens from there on in both (fits).
    """

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py()) for x in table.column("postings")]
        h = np.concatenate([p[0] for p in parts])
        k = np.concatenate([p[3][p[1]] for p in parts])
        pos = np.concatenate([p[2] for p in parts]).astype(np.int64)
        n = np.concatenate([p[4][p[1]] for p in parts]).astype(np.int64)
        hots = np.concatenate([p[5][p[1]] for p in parts]).astype(np.int64)
        del parts
        slot = (h >> U(36)).astype(np.int64) & 0xFFFFF
        many = np.bincount(slot, minlength=1 << 20)[slot] > 1
        h, k, n, hots, pos = h[many], k[many], n[many], hots[many], pos[many]
        found: list[np.ndarray] = []
        waiting = 0
        over = np.zeros(0, np.int64)
        if len(h):
            order = np.lexsort((k, h))
            h, k, n, hots, pos = h[order], k[order], n[order], hots[order], pos[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
            h, k, n, hots, pos = h[new], k[new], n[new], hots[new], pos[new]
            cut = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            lengths = np.diff(np.append(cut, len(h)))
            over = np.flatnonzero(np.repeat(lengths > rule.cold, lengths))
            cut, lengths = cut[lengths <= rule.cold], lengths[lengths <= rule.cold]
            # groups are dealt so that no step expands more than some hundred thousand pairs
            work = np.cumsum(lengths.astype(np.int64) ** 2)
            step = np.append(np.searchsorted(work, np.arange(0, int(work[-1]) + 1 if len(work) else 0, 400_000)), len(lengths))
            for lo, hi in zip(step[:-1], step[1:], strict=True):
                if hi <= lo:
                    continue
                at = np.repeat(cut[lo:hi] - (np.cumsum(lengths[lo:hi]) - lengths[lo:hi]), lengths[lo:hi]) + np.arange(int(lengths[lo:hi].sum()))
                i, j = _expand(lengths[lo:hi])
                i, j = at[i], at[j]
                small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                sized = small * 100 >= large * rule.percent
                i, j, large = i[sized], j[sized], large[sized]
                whole = rule.needed(n[i], n[j])
                need = whole - (large - rule.prefix(large)) - np.minimum(hots[i], hots[j])
                fits = np.minimum(n[i] - pos[i], n[j] - pos[j]) >= whole
                x, y = k[i].view(np.int64), k[j].view(np.int64)
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y), np.ones(len(i), np.int64), need, fits.astype(np.int64)]))
                waiting += len(i)
                if waiting > 1_000_000:
                    found, waiting = [_add_up(found)], 0
        pairs = _add_up(found) if sum(x.shape[1] for x in found) else np.empty((5, 0), np.int64)
        rows = [_some(MET, pairs.shape[1], **dict(zip(("a", "b", "c", "need", "fits"), map(pa.array, pairs), strict=True)))]
        if len(over):
            rows.append(_some(MET, len(over), token=_long(h[over]), key=_long(k[over]), n=n[over].astype(np.int32), pos=pos[over].astype(np.int32)))
        return pa.Table.from_batches(rows)

    return packed.groupBy("block").applyInArrow(meet, MET_DDL)


def cold_pairs(found: DataFrame, late_hot: DataFrame | None) -> DataFrame:
    """(a, b) of the pairs whose overlaps, added up over all blocks, are enough. late_hot: postings that blocks gave up."""
    pairs = found.where("a is not null").groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("need").alias("need"), F.max("fits").alias("fits")).where("fits > 0")
    if late_hot is not None:
        debt = late_hot.groupBy("key").agg(F.count("*").alias("debt"))
        pairs = pairs.join(debt.select(F.col("key").alias("a"), F.col("debt").alias("da")), "a", "left").join(debt.select(F.col("key").alias("b"), F.col("debt").alias("db")), "b", "left")
        pairs = pairs.withColumn("c", F.col("c") + F.least(F.coalesce("da", F.lit(0)), F.coalesce("db", F.lit(0))))
    return pairs.where("c >= need").select("a", "b")


# 4. blocked product


def _bloom_bits(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys.astype(np.uint64, copy=False) ^ U(0x5851F42D4C957F2D))
    return (h >> U(64 - bits)).astype(np.int64), ((h >> U(8)) & U((1 << bits) - 1)).astype(np.int64)


def key_sketch(keys: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter over the n values of the column key: 16 bits a key, 2**29 at most. Beyond, it only lets more through."""
    bits = int(np.clip((16 * max(1, n)).bit_length(), 16, 29))
    schema = [("part", pa.int32()), ("blob", pa.binary())]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sparse = _Sparse(bits, 0)
        for b in batches:
            for at in _bloom_bits(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits):
                sparse.add(at)
            if sparse.n > 4 * FLUSH:
                yield _table(schema, *map(list, zip(*sparse.sent(), strict=True)))
        if sparse.n:
            yield _table(schema, *map(list, zip(*sparse.sent(), strict=True)))

    def union(part: int, blobs: list[bytes], last: bool) -> bytes:
        out = np.zeros((1 << bits) // RANGES, bool)
        for x in blobs:
            out[np.cumsum(unpack(x)[0], dtype=np.uint32)] = True
        at = np.flatnonzero(out)
        return pack(np.packbits(out)) if last else _pack_counts(at, np.ones(len(at)))

    out, step = np.zeros((1 << bits) // 8, np.uint8), (1 << bits) // 8 // RANGES
    for part, blob in merged(keys.mapInArrow(mark, "part int, blob binary"), union, n >> 18):
        out[part * step : (part + 1) * step] = unpack(blob)[0]
    return out


def units_of(docs: DataFrame, rule: Rule, keys: DataFrame, n: int) -> DataFrame:
    """The units that may have one of the n keys: (key, tokens) once for each task, and for lines (key, doc_id, row, unit) of each."""
    sketch = docs.sparkSession.sparkContext.broadcast(key_sketch(keys, n))  # 64 MB at most
    schema = [("key", pa.int64()), ("tokens", pa.binary()), ("doc_id", pa.int64()), ("row", pa.int64()), ("unit", pa.int64())]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = sketch.value, set()
        for ids, rows, w in _units(batches, rule):
            k = w.sequence_keys()
            one, two = _bloom_bits(k, len(bits).bit_length() + 2)
            hit = ((bits[one >> 3] >> (7 - (one & 7))) & (bits[two >> 3] >> (7 - (two & 7))) & 1).astype(bool) & (w.counts() > 0)
            if not hit.any():
                continue
            if rule.lines:
                u = np.flatnonzero(hit)
                yield _some(schema, len(u), key=_long(k[u]), doc_id=ids[w.row[u]], row=rows[w.row[u]], unit=w.line[u])
            hit = _first_of(k, hit, seen)
            if not hit.any():
                continue
            unit, h = w.shingles(rule.size)
            _, unit, h = _unique(unit[hit[unit]], h[hit[unit]], len(w.bounds))
            lo, hi = np.searchsorted(unit, np.flatnonzero(hit)), np.searchsorted(unit, np.flatnonzero(hit), "right")
            yield _some(schema, int(hit.sum()), key=_long(k[hit]), tokens=[h[a:b].tobytes() for a, b in zip(lo, hi, strict=True)])

    return docs.mapInArrow(gather, "key bigint, tokens binary, doc_id bigint, row bigint, unit bigint")


def _product(held: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlaps of the rows a and b of an incidence matrix; held: the columns of each row. A masked sparse product: columns
    that only one row has are left out, and the entries at (a, b) add up over the columns of the shorter row."""
    size = np.array([len(x) for x in held], np.int64)
    row = np.repeat(np.arange(len(held)), size)
    token = np.concatenate(held) if held else np.empty(0, np.uint64)
    order = np.argsort(token, kind="stable")
    new = np.append(True, token[order][1:] != token[order][:-1]) if len(order) else np.empty(0, bool)
    column = np.empty(len(token), np.int64)
    column[order] = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1 if len(column) else np.empty(0, bool)
    entry = np.sort(row[shared] << 32 | column[shared])
    first = np.searchsorted(entry, np.arange(len(held) + 1) << 32)
    left = np.diff(first)
    swap = left[a] > left[b]
    short, long = np.where(swap, b, a), np.where(swap, a, b)
    out, work = np.zeros(len(a), np.int64), np.cumsum(left[short])
    cuts = np.unique(np.append(np.searchsorted(work, np.arange(0, int(work[-1]) if len(work) else 0, 1 << 20)), len(a)))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        many = left[short[lo:hi]]
        pair = np.repeat(np.arange(lo, hi), many)
        at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + first[short[pair]]
        wanted = (entry[at] & 0xFFFFFFFF) | long[pair] << 32
        where = np.minimum(np.searchsorted(entry, wanted), len(entry) - 1)
        out[lo:hi] = np.bincount(pair[entry[where] == wanted] - lo, minlength=hi - lo)
    return out


def overlaps(pairs: DataFrame, sets: DataFrame, rule: Rule, blocks: int) -> DataFrame:
    """(a, b, na, nb, common) of pairs, which hold each (a, b) once. A cell gets the sets of its own row and column block only."""
    sides = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    home = sides.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.min("a")).alias("home"))
    crowd = home.groupBy("home").agg(F.ceil(F.count("*") / CELL).alias("salts"))
    # units with a common partner share a block; a crowd of them is dealt to several
    salted = F.when(F.col("salts") > 1, F.xxhash64("home", F.pmod(F.xxhash64("key"), F.col("salts")))).otherwise(F.pmod(F.xxhash64("home"), F.lit(blocks)))
    block = staged(home.join(crowd, "home").select("key", salted.alias("block")), "blocks")
    placed = pairs.join(block.select(F.col("key").alias("a"), F.col("block").alias("i")), "a").join(block.select(F.col("key").alias("b"), F.col("block").alias("j")), "b").select("i", "j", "a", "b")
    wanted = placed.select("i", "j", F.explode(F.array("a", "b")).alias("key")).distinct()
    rows = wanted.join(sets, "key").select("i", "j", "key", F.lit(None).cast("bigint").alias("other"), "tokens")
    both = rows.unionByName(placed.select("i", "j", F.col("a").alias("key"), F.col("b").alias("other"), F.lit(None).cast("binary").alias("tokens")))

    def product(key: tuple, table: pa.Table) -> pa.Table:
        k = table.column("key").to_numpy()
        other, tokens = table.column("other"), table.column("tokens")
        is_pair = ~np.asarray(other.is_null())
        at = np.flatnonzero(~is_pair)
        at = at[np.argsort(k[at], kind="stable")]
        own = k[at]
        held = [np.frombuffer(tokens[int(x)].as_py(), np.uint64) for x in at]
        size = np.array([len(x) for x in held], np.int64)
        a, b = k[is_pair], other.filter(pa.array(is_pair)).to_numpy()
        x, y = np.searchsorted(own, a), np.searchsorted(own, b)
        na, nb = size[x], size[y]
        common = np.full(len(a), -1, np.int64)
        sized = np.minimum(na, nb) * 100 >= np.maximum(na, nb) * rule.percent
        common[sized] = _product(held, x[sized], y[sized])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "na": pa.array(na), "nb": pa.array(nb), "common": pa.array(common)})

    return both.groupBy("i", "j").applyInArrow(product, "a bigint, b bigint, na bigint, nb bigint, common bigint")


def linked(rule: Rule):
    """The condition on the columns na, nb, common. common is -1 where the sizes alone exclude a link."""
    return (F.col("common") >= 0) & (F.lit(100) * F.col("common") >= F.lit(rule.percent) * (F.col("na") + F.col("nb") - F.col("common")))


def ordered(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


@dataclass
class Links:
    """links: (a, b), keys of different word sequences that link. Every connection is kept: of pairs inside one hot group that
    a chain of returned links connects already, only that chain is certain to be there; for lines, every key that links with
    a key first seen earlier has such a link.

    units: (doc_id, row, unit, key, n) of all documents, key null without words; or of the lines whose key may come again.
    members: for lines, (key, doc_id, row, unit) of all that have a key of a link, and of some others.
    """

    links: DataFrame
    units: DataFrame
    members: DataFrame


def link(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> Links:
    """Rows without words have no key and no link; nulls count as empty; repeated rows and exact copies share a key.

    row is the xxhash64 of the text: rows of one id with different texts differ in it. unit is the line's number from 0.
    """
    small_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row"))
    everything = staged(posted(docs, rule, census(docs, rule), block_count(docs)), "postings")
    found = staged(met(everything.where("kind = 0").select("block", "postings"), rule), "met")
    hot = everything.where("kind = 1").select("token", "key", "n", "pos", "doc_id")
    given_up = found.where("token is not null").select("token", "key", "n", "pos")
    late_hot = None if given_up.isEmpty() else given_up
    if late_hot is not None:
        hot = hot.unionByName(late_hot.withColumn("doc_id", F.lit(None).cast("bigint")))
    # copies of one text, found by several tasks, are one posting
    hot = staged(hot.groupBy("token", "key").agg(F.min("n").alias("n"), F.min("pos").alias("pos"), F.min("doc_id").alias("doc_id")), "hot")
    leaders = hot.groupBy("token").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(0)), "key", "n", "pos")).alias("l"), F.count("*").alias("many")).where("many > 1").select("token", F.col("l.key").alias("leader"), F.col("l.n").alias("ln"), F.col("l.pos").alias("lpos"))
    leaders = staged(leaders, "leaders")
    led = hot.join(leaders, "token").where("key <> leader and least(n, ln) * 100 >= greatest(n, ln) * %d" % rule.percent)
    pairs = staged(cold_pairs(found, late_hot).unionByName(led.select(*ordered(F.col("key"), F.col("leader")))).distinct(), "pairs")
    forget(found)
    links, members = _counted(docs, rule, hot, leaders, pairs)
    units = everything.where("kind = 2").select("doc_id", "row", "unit", "key", F.col("n").cast("bigint").alias("n"))
    return Links(links, units, members)


def _counted(docs: DataFrame, rule: Rule, hot: DataFrame, leaders: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    # every key with a hot posting may come up again in the last step, so sets are gathered once for all
    hot = hot.join(leaders.select("token", "leader"), "token")
    keys = staged(pairs.select(F.explode(F.array("a", "b")).alias("key")).unionByName(hot.select("key")).distinct(), "keys")
    n = keys.count()
    cells = max(1, n // CELL)
    gathered = staged(units_of(docs, rule, keys, n), "units")
    members = gathered.where("tokens is null").select("key", "doc_id", "row", "unit")
    sets = staged(gathered.where("tokens is not null").groupBy("key").agg(F.first("tokens").alias("tokens")), "sets")
    known = staged(overlaps(pairs, sets, rule, cells), "overlaps")
    good = known.where(linked(rule)).select("a", "b")
    if leaders.isEmpty():
        return good, members
    # what makes a pair superfluous: two keys of one label are connected anyhow; a late key has a link with an earlier one
    both = good.unionByName(good.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not rule.lines:
        near = both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.min("a")).alias("label"))
        near = both.join(near.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("label"))
        rows = hot.join(near, "key", "left").withColumn("label", F.coalesce("label", "key"))
        open_tokens = rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
        kept = ["key", "n", "pos", "d", "label"]
    else:
        first = staged(members.groupBy("key").agg(F.min(F.struct("doc_id", "unit")).alias("at")), "first")
        own, other = first.select(F.col("key").alias("a"), F.col("at").alias("at_a")), first.select(F.col("key").alias("b"), F.col("at").alias("at_b"))
        late = both.join(own, "a").join(other, "b").where("at_b < at_a").select(F.col("a").alias("key"), F.lit(True).alias("late")).distinct()
        rows = hot.join(first, "key").join(late, "key", "left").withColumn("late", F.coalesce("late", F.lit(False)))
        open_tokens = rows.groupBy("token").agg(F.max(~F.col("late")).alias("open")).where("open").select("token")
        kept = ["key", "n", "pos", "d", "at", "late"]
    rows = staged(rows, "rows")
    rows = rows.join(open_tokens if not rows.isEmpty() else leaders.select("token"), "token", "left_semi").withColumns({"a": F.least("key", "leader"), "b": F.greatest("key", "leader")})
    distance = known.where("common >= 0").select("a", "b", (F.lit(1.0) - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("d"))
    rows = rows.join(distance, ["a", "b"], "left").withColumn("d", F.when(F.col("key") == F.col("leader"), 0.0).otherwise(F.col("d")))
    rows = staged(rows.select("token", *kept), "open")
    left, right = (rows.select("token", *[F.col(c).alias(f"{c}_{s}") for c in kept]) for s in "xy")
    if not rule.lines:
        worth = (F.col("key_x") < F.col("key_y")) & (F.col("label_x") != F.col("label_y"))
    else:
        left = left.where("not late_x")
        worth = (F.col("key_x") != F.col("key_y")) & (F.col("at_y") < F.col("at_x"))
    worth = worth & (F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) * (100 + rule.percent) >= (F.col("n_x") + F.col("n_y")) * rule.percent)
    worth = worth & F.coalesce(F.abs(F.col("d_x") - F.col("d_y")) <= 1 - rule.percent / 100 + 1e-9, F.lit(True))
    more = left.join(right, "token").where(worth).select(*ordered(F.col("key_x"), F.col("key_y"))).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")
    more = staged(more, "more")
    if more.isEmpty():
        return good, members
    return good.unionByName(overlaps(more, sets, rule, cells).where(linked(rule)).select("a", "b")), members


def components(edges: DataFrame) -> DataFrame:
    """(key, label): label is the least key of the component, by propagation with pointer jumping; keys without edges don't appear."""
    both = staged(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    table = labels
    while True:
        old = labels
        seen = both.join(old.select(F.col("key").alias("b"), "label"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("seen"))
        step = old.join(seen, "key").select("key", F.least("label", "seen").alias("label"), F.col("label").alias("was"))
        jump = old.select(F.col("key").alias("label"), F.col("label").alias("over"))
        new = staged(step.join(jump, "label").select("key", F.least("label", "over").alias("label"), (F.least("label", "over") != F.col("was")).alias("moved")), "labels")
        forget(table)
        labels, table = new.select("key", "label"), new
        if new.where("moved").isEmpty():
            forget(both)
            return labels
