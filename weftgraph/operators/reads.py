"""Reads to fragments, k-mers and counts.

A read is split at every character but A, C, G, T (or those become A, by `n_policy`); k-mers slide over the
fragments. Windows are rolled over pieces of Arrow batches, because a built-in substring at every position costs the square
of a read's length. Short k-mers are added up in the task, which sends one row for each distinct one: the combine before the
shuffle. Most long ones are met once, so these travel as stretches of reads instead, at 2 bits a base: neighbouring windows
whose least hash of a shorter string is the same go to the bucket of that hash together, and are counted there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .durable import keep
from .sizes import planned_bytes, small_batches

U = np.uint64
_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate(b"CATG"):
    _CODE[_b] = _i
#: Bases that are rolled at once, and rows that a task adds up before it sends them.
PIECE, HELD = 1 << 19, 1 << 20
#: From this k on, counts take stretches; bases of the strings whose least hash names the bucket.
STRETCHED, SEED = 12, 11
#: Bytes of input files for one bucket, buckets at most, and how many where the planner knows no size.
BUCKET, MOST_BUCKETS, BUCKETS = 2 << 20, 1 << 20, 1 << 12
#: Stretches that are held before they are sent, and windows of a bucket that are counted at once.
SENT, COUNTED = 1 << 20, 4 << 20


def fragments(reads: DataFrame, k: int = 1, id_col: str = "read_id", seq_col: str = "seq") -> DataFrame:
    """(read_id, frag, seq): maximal runs of A, C, G, T of at least k bases; frag counts the runs of a read from 0."""
    runs = F.filter(F.split(F.col(seq_col), "[^ACGT]+"), lambda x: x != "")
    return reads.select(F.col(id_col).alias("read_id"), F.posexplode(runs).alias("frag", "seq")).where(F.length("seq") >= k)


def _packs(k: int) -> None:
    """k-mers are packed into 64 bits, and nodes have a base at least."""
    if not 2 <= k <= 32:
        raise ValueError(f"k must be from 2 to 32, not {k}")


def reverse_complement_array(v: np.ndarray, k: int) -> np.ndarray:
    for m, s in ((0x3333333333333333, 2), (0x0F0F0F0F0F0F0F0F, 4), (0x00FF00FF00FF00FF, 8), (0x0000FFFF0000FFFF, 16), (0x00000000FFFFFFFF, 32)):
        v = ((v >> U(s)) & U(m)) | ((v & U(m)) << U(s))
    return ~v >> U(64 - 2 * k)


def canonical_array(v: np.ndarray, k: int) -> np.ndarray:
    return np.maximum(v, reverse_complement_array(v, k))


def _spans(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(letters, offsets, first row) of consecutive reads: PIECE bases at most, or one read that is longer."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if len(col) and col.buffers()[2] is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, "right")) - 1)
        yield data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo
        lo = hi


def _coded(letters: np.ndarray, n_policy: str) -> np.ndarray:
    code = _CODE[letters]
    return np.where(letters == ord("N"), np.uint8(1), code) if n_policy == "as_a" else code


def _joined(letters: np.ndarray, offsets: np.ndarray, n_policy: str) -> np.ndarray:
    """Codes of whole reads, a separator behind each; 4 splits."""
    out = np.full(len(letters) + len(offsets) - 1, 4, np.uint8)
    out[np.arange(len(letters)) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))] = _coded(letters, n_policy)
    return out


def _pieces(col: pa.Array, n_policy: str) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(codes, offsets, first row) of consecutive reads, a separator behind each; 4 splits."""
    for letters, offsets, lo in _spans(col):
        yield _joined(letters, offsets, n_policy), offsets + np.arange(len(offsets)), lo


def _cut(read: np.ndarray, n_policy: str, k: int) -> Iterator[tuple[np.ndarray, slice]]:
    """(codes, own) of consecutive pieces of one read. own are PIECE windows; the one before and the one behind come along."""
    n = len(read) - k + 1
    for lo in range(0, n, PIECE):
        hi, before = min(lo + PIECE, n), min(lo, 1)
        yield _coded(read[lo - before : hi + k], n_policy), slice(before, before + hi - lo)


def _cut_pieces(col: pa.Array, n_policy: str, k: int, hanging: bool = False) -> Iterator[tuple[np.ndarray, slice, tuple[bool, bool]]]:
    """(codes, own, beyond) of pieces that are bounded, however long a read: each window is among the own ones of one piece.
    beyond, if asked for with `hanging`: what _hanging_beyond says of a piece; a long read is rolled twice then."""
    for letters, offsets, _ in _spans(col):
        if len(letters) <= PIECE:
            code = _joined(letters, offsets, n_policy)
            yield code, slice(0, max(len(code) - k + 1, 0)), (False, False)
        else:
            beyond = iter(_hanging_beyond(_cut(letters, n_policy, k), k)) if hanging else None
            for code, own in _cut(letters, n_policy, k):
                yield code, own, next(beyond) if beyond else (False, False)


def _windows(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, valid) of the k-mer at every position."""
    n = len(code) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    value = np.zeros(n, np.uint64)
    for j in range(k):
        value = (value << U(2)) | (code[j : j + n] & 3)
    bad = np.concatenate([[0], np.cumsum(code > 3)])
    return value, bad[k:] == bad[:-k]


def _ends(value: np.ndarray, valid: np.ndarray, k: int, own: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, left, right, where): read ends on a side of a node, one entry each; where, one of the `own` windows, is a k-mer of its fragment.

    A fragment has two: where its first and its last k-mer stick out. A node that equals its reverse complement or is one
    repeated base loses the direction of reads that pass, so there both k-mers count as ends.
    """
    if not len(value):
        return (np.empty(0, np.uint64),) * 3 + (np.empty(0, np.int64),)
    before, after = np.append(False, valid[:-1]), np.append(valid[1:], False)
    mine = np.zeros(len(valid), bool)
    mine[own] = valid[own]
    first, last = np.flatnonzero(mine & ~before), np.flatnonzero(mine & ~after)
    inner = np.flatnonzero(mine & after)
    low = U((1 << (2 * (k - 1))) - 1)
    node = value[inner] & low
    units = np.array([sum(b << (2 * i) for i in range(k - 1)) for b in range(4)], np.uint64)
    inner = inner[(node == reverse_complement_array(node, k - 1)) | np.isin(node, units)]
    nodes = np.concatenate([value[first] >> U(2), value[last] & low, value[inner] & low, value[inner] & low])
    edges = np.concatenate([value[first], value[last], value[inner], value[inner + 1]])
    node, edge = canonical_array(nodes, k - 1), canonical_array(edges, k)
    back, head, tail = reverse_complement_array(node, k - 1), edge >> U(2), edge & low
    left, right = (tail == node) | (head == back), (head == node) | (tail == back)
    return node, left & ~right, right & ~left, np.concatenate([first, last, inner, inner])


def _fragment_of(valid: np.ndarray) -> np.ndarray:
    """The number of the fragment of each valid window."""
    return np.cumsum(valid & ~np.append(False, valid[:-1]))


def _hanging_beyond(pieces: Iterator[tuple[np.ndarray, slice]], k: int) -> list[tuple[bool, bool]]:
    """For each piece of one read, whether the fragment that runs over its left edge, and its right one, hangs by an end beyond."""
    near = []
    for code, own in pieces:
        value, valid = _windows(code, k)
        _, left, right, where = _ends(value, valid, k, own)
        run = _fragment_of(valid)
        hung = run[where[left | right]]
        near.append((bool(valid[0] and (hung == run[0]).any()), bool(valid[-1] and (hung == run[-1]).any()), bool(valid.all())))
    from_left, from_right = [False], [False]
    for _, last, through in near[:-1]:
        from_left.append(last or (through and from_left[-1]))
    for first, _, through in near[:0:-1]:
        from_right.append(first or (through and from_right[-1]))
    return list(zip(from_left, from_right[::-1], strict=True))


def _nodes_of_hanging_fragments(value: np.ndarray, valid: np.ndarray, where: np.ndarray, k: int, beyond: tuple[bool, bool]) -> np.ndarray:
    """Distinct canonical nodes of the fragments that have one of the k-mers `where`, at which a read ends, or hang by an end beyond
    the piece."""
    if not len(value):
        return value
    run = _fragment_of(valid)
    hangs = np.zeros(int(run.max(initial=0)) + 1, bool)
    hangs[run[where]] = True
    for edge, hung in zip((0, -1), beyond, strict=True):
        hangs[run[edge]] |= hung
    on = value[valid & hangs[run]]
    return np.unique(canonical_array(np.concatenate([on >> U(2), on & U((1 << (2 * (k - 1))) - 1)]), k - 1))


def _batch(**cols: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64), pa.int64())


def occurrences(reads: DataFrame, k: int, n_policy: str = "split", id_col: str = "read_id", seq_col: str = "seq") -> DataFrame:
    """(read_id, pos, kmer, edge): every window with its place in the read, packed as read and canonical."""
    _packs(k)

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for code, offsets, lo in _pieces(batch.column(1), n_policy):
                value, valid = _windows(code, k)
                at = np.flatnonzero(valid)
                row = np.searchsorted(offsets, at, "right") - 1
                yield _batch(read_id=ids.take(pa.array(lo + row)), pos=pa.array(at - offsets[row], pa.int64()), kmer=_long(value[at]), edge=_long(canonical_array(value[at], k)))

    return reads.select(F.col(id_col).cast("bigint").alias("read_id"), F.col(seq_col).alias("seq")).mapInArrow(roll, "read_id bigint, pos bigint, kmer bigint, edge bigint")


def _per_read(row: np.ndarray, edge: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, edge), distinct and in order."""
    if 2 * k + rows.bit_length() <= 64:
        both = np.unique(row.astype(np.uint64) << U(2 * k) | edge)
        return (both >> U(2 * k)).astype(np.int64), both & U((1 << (2 * k)) - 1)
    order = np.lexsort((edge, row))
    row, edge = row[order], edge[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (edge[1:] != edge[:-1])
    return row[new], edge[new]


def occurrence_counts(reads: DataFrame, k: int, n_policy: str = "split", id_col: str = "read_id", seq_col: str = "seq") -> DataFrame:
    """(read_id, n_kmers, n_edges, n_forward) of reads that have windows: all, their distinct canonical k-mers, and those read as
    the canonical form. Rows of one id, null too, are one read.

    A row is counted where it is read, and sends its three numbers. Only ids that came in several rows have their k-mers dealt
    out, each distinct one of a row once.
    """
    _packs(k)
    small_batches(reads.sparkSession)
    reads = reads.select(F.col(id_col).cast("bigint").alias("read_id"), F.col(seq_col).alias("seq"))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, ...]]:
        for batch in batches:
            for code, offsets, lo in _pieces(batch.column(1), n_policy):
                value, valid = _windows(code, k)
                at = np.flatnonzero(valid)
                row, edge = np.searchsorted(offsets, at, "right") - 1, canonical_array(value[at], k)
                yield batch.column(0).slice(lo, len(offsets) - 1), row, edge == value[at], *_per_read(row, edge, len(offsets), k)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, row, forward, distinct, _ in edges(batches):
            kmers, different, same = (np.bincount(x, minlength=len(ids)) for x in (row, distinct, row[forward]))
            some = np.flatnonzero(kmers)
            yield _batch(read_id=ids.take(pa.array(some)), **{n: pa.array(x[some], pa.int64()) for n, x in (("n_kmers", kmers), ("n_edges", different), ("n_forward", same))})

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, _, distinct, edge in edges(batches):
            yield _batch(read_id=ids.take(pa.array(distinct)), edge=_long(edge))

    numbers = ["n_kmers", "n_edges", "n_forward"]
    rows = reads.mapInArrow(count, "read_id bigint, n_kmers bigint, n_edges bigint, n_forward bigint")
    sums = rows.groupBy("read_id").agg(*[F.sum(n).alias(n) for n in numbers], (F.count("*") > 1).alias("again"))
    seen = Observation()
    sums = keep(sums.observe(seen, F.count_if("again").alias("again")), "occurrences", "again")
    once = sums.where("not again").select("read_id", *numbers)
    if not seen.get["again"]:
        return once
    again = sums.where("again").select(F.col("read_id").alias("id"), "n_kmers", "n_forward")
    theirs = reads.join(again.select("id"), F.col("read_id").eqNullSafe(F.col("id")), "left_semi")
    different = theirs.mapInArrow(spell, "read_id bigint, edge bigint").distinct().groupBy("read_id").agg(F.count("*").alias("n_edges"))
    return once.unionByName(different.join(again, F.col("read_id").eqNullSafe(F.col("id"))).select("read_id", *numbers))


class _Tally:
    """Sums a, b by key of arrays that come one after another; no more than HELD rows are held, and a piece's."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, *cols: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        self.held.append(cols)
        self.n += len(cols[0])
        if self.n > HELD:
            out = self.close()
            if len(out[0]) > HELD // 2:
                yield out
            else:
                self.held, self.n = [out], len(out[0])

    def close(self) -> tuple[np.ndarray, ...]:
        key, *sums = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        self.held, self.n = [], 0
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        return key[first], *[np.add.reduceat(x[order], first) if len(first) else x for x in sums]


def scan(reads: DataFrame, k: int, n_policy: str = "split", seq_col: str = "seq", nodes: bool = False, only: str | None = None) -> DataFrame:
    """(is_end, key, a, b), partly summed: counts a of canonical k-mers, and left and right ends a, b of canonical nodes.

    With `nodes`, the node rows are those of read_nodes, with 0 where no read ends: the same scan gives all three. only:
    "edges" or "ends" leaves the other rows out.
    """
    _packs(k)
    small_batches(reads.sparkSession)

    def rows(is_end: bool, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return _batch(is_end=pa.array(np.full(len(key), is_end)), key=_long(key), a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, at_nodes = _Tally(), _Tally()
        for batch in batches:
            for code, own, beyond in _cut_pieces(batch.column(0), n_policy, k, nodes and only != "edges"):
                value, valid = _windows(code, k)
                if only != "ends":
                    edge, count = np.unique(canonical_array(value[own][valid[own]], k), return_counts=True)
                    for sums in edges.add(edge, count, np.zeros(len(edge), np.int64)):
                        yield rows(False, *sums)
                if only != "edges":
                    node, left, right, where = _ends(value, valid, k, own)
                    if nodes:
                        node, left, right, where = (x[left | right] for x in (node, left, right, where))
                        more = _nodes_of_hanging_fragments(value, valid, where, k, beyond)
                        none = np.zeros(len(more), bool)
                        node, left, right = np.concatenate([node, more]), np.append(left, none), np.append(right, none)
                    for sums in at_nodes.add(node, left.astype(np.int64), right.astype(np.int64)):
                        yield rows(True, *sums)
        yield rows(False, *edges.close())
        yield rows(True, *at_nodes.close())

    return reads.select(F.col(seq_col).alias("seq")).mapInArrow(roll, "is_end boolean, key bigint, a bigint, b bigint")


def counted(reads: DataFrame, k: int, **options) -> DataFrame:
    """(is_end, key, a, b) of scan, one row for each key: one scan and one shuffle. edges_in, ends_in and nodes_in read it."""
    return scan(reads, k, **options).groupBy("is_end", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def edges_in(counts: DataFrame) -> DataFrame:
    """edges(edge, cnt) of a counted table"""
    return counts.where("not is_end").select(F.col("key").alias("edge"), F.col("a").alias("cnt"))


def ends_in(counts: DataFrame) -> DataFrame:
    """ends(node, left_ends, right_ends) of a counted table"""
    return counts.where("is_end and a + b > 0").select(F.col("key").alias("node"), F.col("a").alias("left_ends"), F.col("b").alias("right_ends"))


def nodes_in(counts: DataFrame) -> DataFrame:
    """(node) of read_nodes, of a table counted with nodes=True"""
    return counts.where("is_end").select(F.col("key").alias("node"))


def exact_counts(reads: DataFrame, k: int, n_policy: str = "split", seq_col: str = "seq") -> DataFrame:
    """edges(edge, cnt)"""
    _packs(k)
    if k >= STRETCHED:
        size = planned_bytes(reads)
        buckets = BUCKETS if size is None else int(np.clip(size // BUCKET + 1, 16, MOST_BUCKETS))
        return stretches(reads, k, buckets, n_policy, seq_col).groupBy("bucket").applyInArrow(_counter(k), "edge bigint, cnt bigint")
    found = scan(reads, k, n_policy, seq_col, only="edges")
    return found.groupBy(F.col("key").alias("edge")).agg(F.sum("a").alias("cnt"))


def _least_hashes(long: np.ndarray, k: int, m: int) -> np.ndarray:
    """Of the k-mer at every position, the least hash of the canonical m-mers in it. long: the 32 bases from each position on."""
    least = (canonical_array(long[: len(long) - m + 1] >> U(64 - 2 * m), m) * U(0x9E3779B97F4A7C15) >> U(32)).astype(np.uint32)
    size, w = 1, k - m + 1
    while 2 * size <= w:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    return np.minimum(least[: len(least) - (w - size)], least[w - size :]) if size < w else least


def _cut_stretches(code: np.ndarray, k: int, buckets: int) -> tuple[np.ndarray, ...]:
    """(bucket, n, w0, w1): the valid windows, in runs of n that share a bucket; w0 and w1 have a run's bases, 64 at most, zero
    behind. Both strands of a window are in the same bucket."""
    n = len(code) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint8), np.empty(0, np.uint64), np.empty(0, np.uint64)
    long = np.zeros(len(code) + 64, np.uint64)
    long[: len(code)] = code & 3
    for j in (1, 2, 4, 8, 16):
        long[:-j] = (long[:-j] << U(2 * j)) | long[j:]
    bad = np.concatenate([[0], np.cumsum(code > 3)])
    valid = bad[k:] == bad[:-k]
    least = _least_hashes(long[: len(code)], k, min(SEED, k - 4))
    edge = valid.copy()
    edge[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    start = np.flatnonzero(edge)
    edge[:] = valid
    edge[:-1] &= ~valid[1:] | (least[1:] != least[:-1])
    size = np.flatnonzero(edge) + 1 - start
    most = 65 - k
    many = -(-size // most)
    first = np.cumsum(many) - many
    part = np.arange(int(many.sum())) - np.repeat(first, many)
    start, size = np.repeat(start, many) + part * most, np.minimum(np.repeat(size, many) - part * most, most)
    bases = size + k - 1
    w0 = long[start] & (U(2**64 - 1) << (64 - 2 * np.minimum(bases, 32)).astype(np.uint64))
    over = np.maximum(bases - 32, 0)
    w1 = np.where(over > 0, long[start + 32] & (U(2**64 - 1) << (2 * (32 - np.maximum(over, 1))).astype(np.uint64)), U(0))
    x = least[start]
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return (x.astype(np.int64) * buckets) >> 32, size.astype(np.uint8), w0, w1


def _combined(bucket: np.ndarray, n: np.ndarray, cnt: np.ndarray, w0: np.ndarray, w1: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches by bucket and first bases, equal ones that come together as one; cnt says how often each is meant."""
    order = np.argsort((bucket.astype(np.uint64) << U(44)) | (w0 >> U(20)))
    bucket, n, cnt, w0, w1 = (x[order] for x in (bucket, n, cnt, w0, w1))
    new = np.ones(len(n), bool)
    new[1:] = (w0[1:] != w0[:-1]) | (w1[1:] != w1[:-1]) | (n[1:] != n[:-1]) | (bucket[1:] != bucket[:-1])
    first = np.flatnonzero(new)
    return bucket[first], n[first], np.add.reduceat(cnt, first) if len(first) else cnt, w0[first], w1[first]


def _binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def stretches(reads: DataFrame, k: int, buckets: int, n_policy: str = "split", seq_col: str = "seq") -> DataFrame:
    """(bucket, n, cnt, bases): runs of windows that share a bucket, a row for each bucket and SENT runs. n has a byte for each
    run, its windows; cnt 8 bytes, how often it was met; bases the runs, each from a new byte on."""
    _packs(k)
    small_batches(reads.sparkSession)

    def sent(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        bucket, n, w0, w1 = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket, n, cnt, w0, w1 = _combined(bucket, n, np.ones(len(n), np.int64), w0, w1)
        cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        used = (n.astype(np.int64) + k + 2) // 4
        whole = np.stack([w0, w1], axis=1).astype(">u8").view(np.uint8).reshape(-1, 16)
        flat = whole[np.arange(16) < used[:, None]]
        return _batch(bucket=pa.array(bucket[cut[:-1]].astype(np.int32)), n=_binary(n, cut), cnt=_binary(cnt.view(np.uint8), 8 * cut), bases=_binary(flat, np.append(0, np.cumsum(used))[cut]))

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for code, own, _ in _cut_pieces(batch.column(0), n_policy, k):
                held.append(_cut_stretches(code[own.start : own.stop + k - 1], k, buckets))
                total += len(held[-1][1])
                if total > SENT:
                    yield sent(held)
                    held, total = [], 0
        if total:
            yield sent(held)

    return reads.select(F.col(seq_col).alias("seq")).mapInArrow(roll, "bucket int, n binary, cnt binary, bases binary")


def _counter(k: int):
    """Counts of the canonical windows of one bucket's stretches. However large the bucket, COUNTED windows or so are counted at
    once: those of one range of hashes, then those of the next. They come as they are first met, as neighbours compress well."""

    def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        n, cnt, bases = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind) for c, kind in (("n", np.uint8), ("cnt", np.int64), ("bases", np.uint8)))
        whole = np.zeros((len(n), 16), np.uint8)
        whole[np.arange(16) < ((n.astype(np.int64) + k + 2) // 4)[:, None]] = bases
        words = whole.view(">u8").astype(np.uint64)
        return np.zeros(len(n), np.int64), n, cnt, words[:, 0].copy(), words[:, 1].copy()

    def windows(n: np.ndarray, w0: np.ndarray, w1: np.ndarray, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        values, places, which = [], [], np.arange(len(n))
        for j in range(int(n.max(initial=0))):
            which = which[n[which] > j]
            v = w0[which] << U(2 * j) | w1[which] >> U(64 - 2 * j) if 0 < j < 32 else w0[which] if j == 0 else w1[which] << U(2 * j - 64)
            v = canonical_array(v >> U(64 - 2 * k), k)
            at = which
            if parts > 1:
                mine = ((v * U(0xD6E8FEB86659FD93) >> U(32)) * U(parts) >> U(32)) == part
                v, at = v[mine], which[mine]
            values.append(v)
            places.append(at * 64 + j)
        return np.concatenate(values), np.concatenate(places)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, full = [], 0, SENT
        for batch in batches:
            held.append(unpacked(batch))
            total += len(held[-1][1])
            if total > full:
                held = [_combined(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                total = len(held[0][1])
                full = max(SENT, 2 * total)
        _, n, cnt, w0, w1 = (np.concatenate(x) for x in zip(*held, strict=True))
        parts = int(n.sum(dtype=np.int64)) // COUNTED + 1
        for part in range(parts):
            value, place = windows(n, w0, w1, part, parts)
            order = np.argsort(value)
            value, place = value[order], place[order]
            first = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.empty(0, np.int64)
            if len(first):
                met = np.argsort(np.minimum.reduceat(place, first))
                yield _batch(edge=_long(value[first][met]), cnt=pa.array(np.add.reduceat(cnt[place >> 6], first)[met], pa.int64()))

    # Spark reads the kind of function from these
    count.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return count


def end_counts(reads: DataFrame, k: int, **options) -> DataFrame:
    """ends(node, left_ends, right_ends), only nodes with any"""
    found = scan(reads, k, only="ends", **options).where("a + b > 0")
    return found.groupBy(F.col("key").alias("node")).agg(F.sum("a").alias("left_ends"), F.sum("b").alias("right_ends"))


def read_nodes(reads: DataFrame, k: int, n_policy: str = "split", seq_col: str = "seq") -> DataFrame:
    """(node): the nodes of all fragments that have an end on a side of a node. Such a fragment is a way from there, so a
    traversal from read ends reaches them all."""
    _packs(k)

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for code, own, beyond in _cut_pieces(batch.column(0), n_policy, k, hanging=True):
                value, valid = _windows(code, k)
                _, left, right, where = _ends(value, valid, k, own)
                yield _batch(node=_long(_nodes_of_hanging_fragments(value, valid, where[left | right], k, beyond)))

    return reads.select(F.col(seq_col).alias("seq")).mapInArrow(roll, "node bigint").distinct()


def sketch_counts(edges: DataFrame, hash_of, edge_col: str = "edge") -> DataFrame:
    """sketch(hash, cnt): the lossy table. hash_of maps the packed edge to its hash; counts are never too low."""
    return edges.groupBy(hash_of(F.col(edge_col)).alias("hash")).agg(F.sum("cnt").alias("cnt"))
