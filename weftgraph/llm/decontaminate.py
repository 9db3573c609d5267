"""Benchmark decontamination: a prefix-filtered containment join of item-sized windows with documents.

Sets are the word shingles of a window. Containment must be complete (threshold 1), so the necessary prefix of
a window is its one rarest shingle; rarity is counted over all documents. A document's shingle that is some window's
prefix token gives a candidate place: the token's offset in the window fixes where the window would have to start
(position bound), and it has to end inside the document (length bound). All words of the window are then compared.
Only windows travel to documents, in blocks of bounded size; documents are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .setjoin import pack, unpack
from .shared import give_back, input_bytes, merged, small_batches, staged
from .words import LETTERS, Words, pieces

U = np.uint64
SIZE = 5
#: Bytes of benchmark text that one broadcast block may hold.
BLOCK_BYTES = 8 << 20


class Windows:
    """Windows of one block of items as places in its words, and by prefix token where they would start.

    Made, it holds some 10 bytes for each byte of item text; while it is made, some 60.
    """

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.items = sorted({i for i, _ in items})
        number = {x: i for i, x in enumerate(self.items)}
        col = pa.array([t for _, t in items], pa.large_string())
        data = np.frombuffer(col.buffers()[2] or b"", np.uint8) if len(col) else np.empty(0, np.uint8)
        offsets = np.frombuffer(col.buffers()[1], np.int64)[: len(col) + 1] if len(col) else np.zeros(1, np.int64)
        w = Words(data[: offsets[-1]], offsets, LETTERS)
        #: words of all items in order; a window is `length` words from `place`
        self.words, count = w.hash, w.counts()
        many = np.where(count > 0, np.maximum(1, count - window + 1), 0)
        text = np.repeat(np.arange(len(count)), many)
        place = w.first[text] + np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        length = np.minimum(count[text], window)
        owner = np.array([number[i] for i, _ in items], np.int64)[text] if items else text
        # windows of equal words are one, with several owners
        whole = segment_hash_at(w, place, length)
        order = np.argsort(whole, kind="stable")
        new = np.append(True, np.diff(whole[order]) != 0) if len(order) else np.empty(0, bool)
        self.place, self.length = place[order[new]], length[order[new]]
        owned = np.unique((np.cumsum(new) - 1) << 32 | owner[order]) if len(order) else np.empty(0, np.int64)
        self.owner_of, self.owner_first = owned & 0xFFFFFFFF, np.searchsorted(owned >> 32, np.arange(len(self.place) + 1))
        # the shingle at each place, of SIZE words or as many as a shorter window has
        self.size = np.minimum(self.length, SIZE)
        self.at_place = {size: np.zeros(len(w.hash) + 1, np.uint64) for size in self.sizes()}
        for size, at in self.at_place.items():
            _, first, h = w.windows(size)
            at[first] = h
        self.tokens = np.unique(np.concatenate([np.empty(0, np.uint64), *[x for _, _, x in self._shingles()]]))

    def _shingles(self) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(windows, offset, their shingles there)"""
        for size in self.sizes():
            own = np.flatnonzero(self.size == size)
            for offset in range(int(self.length[own].max(initial=0)) - size + 1):
                fit = own[self.length[own] >= offset + size]
                yield fit, offset, self.at_place[size][self.place[fit] + offset]

    def choose(self, seen: np.ndarray) -> None:
        """Each window's rarest token; seen: the documents' counts of self.tokens."""
        n = len(self.place)
        best, self.token, self.offset = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.uint64), np.zeros(n, np.int64)
        for fit, offset, token in self._shingles():
            rank = seen[np.searchsorted(self.tokens, token)]
            less = (rank < best[fit]) | ((rank == best[fit]) & (token < self.token[fit]))
            best[fit[less]], self.token[fit[less]], self.offset[fit[less]] = rank[less], token[less], offset
        self.at = np.argsort(self.token, kind="stable")
        lead = self.token[self.at]
        self.tokens = np.unique(lead)
        self.low, self.high = np.searchsorted(lead, self.tokens), np.searchsorted(lead, self.tokens, "right")
        del self.at_place, self.token

    def sizes(self) -> list[int]:
        return sorted({int(x) for x in self.size})

    def sieve(self) -> np.ndarray:
        return _sieve(self.tokens)

    def found(self, w: Words, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every place in w where a window occurs."""
        begin, which = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for size in self.sizes():
            unit, first, h = w.windows(size)
            hit, token = _found(h, self.tokens, sieve)
            many = self.high[token] - self.low[token]
            window = self.at[np.repeat(self.low[token], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)]
            unit, first = np.repeat(unit[hit], many), np.repeat(first[hit], many)
            start = first - self.offset[window]
            ok = (self.size[window] == size) & (start >= w.first[unit]) & (start + self.length[window] <= w.first[unit + 1])
            start, window = start[ok], window[ok]
            for j in range(int(self.length[window].max(initial=0))):
                within = j < self.length[window]
                same = ~within | (w.hash[np.minimum(start + j, len(w.hash) - 1)] == self.words[np.minimum(self.place[window] + j, len(self.words) - 1)])
                start, window = start[same], window[same]
            begin.append(start)
            which.append(window)
        return np.concatenate(begin), np.concatenate(which)

    def owners(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index in window, item) of the items that each has."""
        many = self.owner_first[window + 1] - self.owner_first[window]
        return np.repeat(np.arange(len(window)), many), self.owner_of[np.repeat(self.owner_first[window], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)]


def segment_hash_at(w: Words, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of the words from each place on."""
    out = np.zeros(len(place), np.uint64)
    for size in np.unique(length).tolist():
        _, first, h = w.windows(size)
        by_place = np.zeros(len(w.hash) + 1, np.uint64)
        by_place[first] = h
        out[length == size] = by_place[place[length == size]]
    return out


def _sieve(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 20, bool)
    bits[(tokens >> U(44)).astype(np.int64)] = True
    return bits


def _found(h: np.ndarray, tokens: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index in h, index in tokens) of equal values."""
    maybe = np.flatnonzero(sieve[(h >> U(44)).astype(np.int64)])
    if not len(maybe) or not len(tokens):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(tokens, h[maybe]), len(tokens) - 1)
    same = tokens[at] == h[maybe]
    return maybe[same], at[same]


def _count_tokens(texts: DataFrame, windows: Windows) -> np.ndarray:
    """Occurrences in all documents of the windows' shingles; what comes back is as long as the block's token list."""
    tokens, sizes = windows.tokens, windows.sizes()
    shared = texts.sparkSession.sparkContext.broadcast((tokens, sizes))  # 8 bytes a word of the block

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sizes = shared.value
        sieve, total, n = _sieve(tokens), np.zeros(len(tokens), np.uint32), 0

        def sent() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([pack(at.astype(np.uint32), total[at])], pa.binary())], names=["part", "blob"])

        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)):
                w = Words(data, offsets, LETTERS)
                for size in sizes:
                    which = _found(w.windows(size)[2], tokens, sieve)[1]
                    total += np.bincount(which, minlength=len(tokens)).astype(np.uint32) if len(which) else np.uint32(0)
                    n += len(which)
                if n > 1 << 31:
                    yield sent()
                    total[:], n = 0, 0
            give_back()
        if total.any():
            yield sent()

    def add(part: int, blobs: list[bytes], last: bool) -> bytes:
        total = np.zeros(len(shared.value[0]), np.uint64)
        for x in blobs:
            at, n = unpack(x)
            total[at] += n
        at = np.flatnonzero(total)
        return pack(at.astype(np.uint32), total[at])

    out = np.zeros(len(tokens), np.int64)
    for _, blob in merged(texts.mapInArrow(count, "part int, blob binary"), add, input_bytes(texts) >> 24):
        at, n = unpack(blob)
        out[at] += n.astype(np.int64)
    return out


def _marks(text: pa.Array, win: Windows, sieve: np.ndarray) -> tuple[np.ndarray, dict[int, list[list[int]]], dict[int, set[str]]]:
    """Words of each row; by row with a window, the spans of words hit, and the items found."""
    n_words = np.zeros(len(text), np.int64)
    spans: dict[int, list[list[int]]] = {}
    items: dict[int, set[str]] = {}
    for lo, _, data, offsets in pieces(text):
        w = Words(data, offsets, LETTERS)
        n_words[lo : lo + len(offsets) - 1] = w.counts()
        start, window = win.found(w, sieve)
        if not len(start):
            continue
        unit = w.unit[start]
        at, owner = win.owners(window)
        for pair in np.unique(unit[at] << 32 | owner).tolist():
            items.setdefault(lo + (pair >> 32), set()).add(win.items[pair & 0xFFFFFFFF])
        cover = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + win.length[window], -1)
        covered = np.cumsum(cover)[:-1] > 0
        for u in np.unique(unit).tolist():
            edge = np.diff(np.concatenate([[0], covered[w.first[u] : w.first[u + 1]].astype(np.int8), [0]]))
            spans[lo + u] = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).tolist()
    return n_words, spans, items


SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
KIND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("items", pa.list_(pa.string())), ("spans", SPAN), ("contaminated", pa.bool_())])
RESULT = "struct<n_words: bigint, n_hit: bigint, n_items: bigint, items_sha256: string, items: array<string>, spans: array<struct<first: bigint, last: bigint>>, contaminated: boolean>"


def _verdict(n: int, found: list[list[int]], items: set[str], share: int) -> dict:
    merged_: list[list[int]] = []
    for a, b in sorted(found):
        if merged_ and a <= merged_[-1][1]:
            merged_[-1][1] = max(b, merged_[-1][1])
        else:
            merged_.append([a, b])
    hit, names = sum(b - a for a, b in merged_), sorted(items)
    return {"n_words": n, "n_hit": hit, "n_items": len(names), "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest(), "items": names, "spans": [{"first": a, "last": b - 1} for a, b in merged_], "contaminated": hit > 0 and share * hit >= n}


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int | None = None) -> DataFrame:
    """(row, result) for every row of docs: row is the whole row, result what was found in it.

    Null and empty texts have no words and aren't contaminated. Items without words have no window; a null item id
    counts as the empty string; items with one id are one item, and repeated items are taken once. Repeated rows each come back. A text of any length is
    judged as a whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{item_text}`").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-int(total) // (block_bytes or BLOCK_BYTES)) or 1
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    column = docs.columns.index(text_col)
    rows = docs.select(F.struct("*").alias("row"))

    def windows_of(block: int) -> Windows:
        # rows of one item may be in several blocks: what is found is joined by the item's id
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        windows = Windows([(r["id"], r["text"]) for r in own.collect()], window)  # about block_bytes, or one text
        windows.choose(_count_tokens(texts, windows))
        return windows

    if blocks == 1:
        shared = spark.sparkContext.broadcast(windows_of(0))

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            win: Windows = shared.value
            sieve = win.sieve()
            for batch in batches:
                n_words, spans, found = _marks(pc.struct_field(batch.column(0), [column]), win, sieve)
                out = [_verdict(n, spans.get(i, []), found.get(i, set()), share) for i, n in enumerate(n_words.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, KIND)], names=["row", "result"])
                give_back()

        return rows.mapInArrow(judge, T.StructType([rows.schema["row"], T.StructField("result", T.DataType.fromDDL(RESULT))]))

    # more items than one block: every block is looked for in all texts, and gives only the texts with a window, by their hash
    hashed = texts.select("text", F.xxhash64("text").alias("hash"))
    hits = None
    for block in range(blocks):
        shared = spark.sparkContext.broadcast(windows_of(block))

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            win: Windows = shared.value
            sieve = win.sieve()
            for batch in batches:
                _, spans, found = _marks(batch.column(0), win, sieve)
                at = sorted(spans)
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(at, pa.int64())), pa.array([[{"first": a, "last": b} for a, b in spans[i]] for i in at], SPAN), pa.array([sorted(found[i]) for i in at], pa.list_(pa.string()))], names=["hash", "spans", "items"])
                give_back()

        own = staged(hashed.mapInArrow(look, "hash bigint, spans array<struct<first: bigint, last: bigint>>, items array<string>").dropDuplicates(["hash"]), "contamination")
        shared.destroy()
        hits = own if hits is None else hits.unionByName(own)
    hits = staged(hits.groupBy("hash").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")), "contamination")
    joined = rows.withColumn("hash", F.xxhash64(F.col(f"row.`{text_col}`"))).join(hits, "hash", "left").select("row", "spans", "items")

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = np.concatenate([np.empty(0, np.int64), *[Words(data, offsets, LETTERS).counts() for _, _, data, offsets in pieces(pc.struct_field(batch.column(0), [column]))]])
            out = [_verdict(n, [[x["first"], x["last"]] for x in spans or []], set(found or []), share) for n, spans, found in zip(n_words.tolist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, KIND)], names=["row", "result"])

    return joined.mapInArrow(sum_up, T.StructType([rows.schema["row"], T.StructField("result", T.DataType.fromDDL(RESULT))]))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that aren't contaminated, unchanged."""
    return contamination(docs, benchmark, **options).where("not result.contaminated").select("row.*")
