"""Byte-level BPE: every distinct pre-token of the corpus is encoded once.

Documents are taken in blocks of many texts, and one scan gives both sides of a block: its distinct pre-tokens, packed by
hash range, and its positions (each document as numbers of the block's pre-tokens). A range holds the pre-tokens of all
blocks, encodes each distinct one once and sends the ids back to the blocks, where they meet the positions. Decoding joins
ids with the token-byte table, which every worker holds whole: a vocabulary has a fixed size (some 50,000 short entries).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretoken import PATTERN, distinct, gather, split
from .setjoin import pack, unpack
from .shared import block_count, give_back, small_batches
from .words import PIECE, pieces

#: Bytes of text, or rows, after which a block ends. Only numbers and the distinct pre-tokens of a block are held.
BLOCK_BYTES, BLOCK_ROWS = 20 << 20, 1 << 16
#: Spellings of a block's pieces that are held before they are told apart, and tokens that are spelt at once.
FRESH, SPELT = 1 << 17, 1 << 14


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    """encode(bytes of one pre-token) -> ids"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})._core_bpe.encode_single_piece


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> dict[int, bytes]:
    return {i: b for b, i in _ranks(path).items()}


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, length) of all parts"""
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(length) - length, length


@lru_cache(maxsize=2)
def _spellings(path: str) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Of every id, its digits with a comma behind and the bytes it stands for, as _flat gives them."""
    table = _token_bytes(path)
    ids = range(max(table) + 1)
    return _flat([b"%d," % i for i in ids]), _flat([table.get(i, b"") for i in ids])


def _stretches(text: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about PIECE bytes that cover the rows; a long row is cut where a space follows something else.

    PATTERN has no pre-token with a space behind another character, and looks ahead from white space only, so its
    pre-tokens are the same on both sides of such a cut.
    """
    at, n = 0, len(text)
    ends = offsets[1:]
    while at < n:
        end = int(ends[min(np.searchsorted(ends, at + 1), len(ends) - 1)])
        if end - at > 2 * PIECE:
            cuts = np.flatnonzero((text[at + PIECE : end] == 32) & (text[at + PIECE - 1 : end - 1] > 32) & (text[at + PIECE - 1 : end - 1] < 127))
            end = at + PIECE + int(cuts[0]) if len(cuts) else end
        else:
            more = int(np.searchsorted(ends, at + PIECE, "right"))
            end = max(end, int(ends[more - 1]) if more else end)
        yield at, end
        at = end


class _Block:
    """Consecutive rows: their ids, distinct pre-tokens, and each row as numbers of those."""

    def __init__(self, pattern: str):
        self.pattern, self.size, self.rows, self.fresh = pattern, 0, 0, 0
        # the spellings told apart so far, and after them those of each piece since
        self.held: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.uint8))]
        self.codes: list[np.ndarray] = []
        self.rows_of: list[np.ndarray] = []
        self.all_ids: list[pa.Array] = []

    def add(self, ids: pa.Array, text: np.ndarray, offsets: np.ndarray) -> None:
        counts = np.zeros(len(offsets) - 1, np.int64)
        whole = self.pattern == PATTERN
        for lo, hi in _stretches(text, offsets) if whole else [(0, len(text))]:
            a, b = (int(np.searchsorted(offsets, x, "right")) - 1 for x in (lo, max(lo, hi - 1)))
            cut = np.clip(offsets[a : b + 2], lo, hi) - lo
            start, end, first = split(text[lo:hi], cut, self.pattern)
            word, length, _, code = distinct(text[lo:hi], start, end)
            self.held.append((length, gather(text[lo:hi], word, length)))
            self.codes.append(code)
            counts[a : b + 1] += np.diff(first)
            self.fresh += len(length)
            if self.fresh > FRESH:
                self._tell_apart()
        self.all_ids.append(ids)
        self.rows_of.append(counts)
        self.size, self.rows = self.size + len(text), self.rows + len(ids)

    def _tell_apart(self) -> None:
        """One spelling for each pre-token: those told apart before keep their numbers, as numbers go by first appearance."""
        at = np.cumsum([0] + [len(x[0]) for x in self.held])
        length, text = (np.concatenate(x) for x in zip(*self.held, strict=True))
        new = len(self.held) - 1
        self.held, self.fresh = [], 0
        end = np.cumsum(length)
        word, length, self.hash, number = distinct(text, end - length, end)
        for i in range(new):
            x = self.codes[i - new]
            self.codes[i - new] = number[at[i + 1] : at[i + 2]][x] if len(x) else x
        self.held.append((length, gather(text, word, length)))
        del text, end, word, number
        give_back()

    def close(self) -> _Block:
        self._tell_apart()
        ((length, self.text),) = self.held
        often = np.zeros(len(length), np.int64)
        for x in self.codes:
            often += np.bincount(x, minlength=len(length))
        # frequent pre-tokens get small numbers, which pack well
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        self.word, self.length, self.hash = (np.cumsum(length) - length)[order], length[order], self.hash[order]
        self.counts, self.code = np.concatenate(self.rows_of).astype(np.uint32), np.empty(sum(map(len, self.codes)), np.uint32)
        to = 0
        for i, x in enumerate(self.codes):
            self.code[to : to + len(x)] = rank[x]
            self.codes[i] = None
            to += len(x)
        self.ids = pa.chunked_array(self.all_ids).combine_chunks()
        return self

    def spelt(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.length[which].astype(np.uint32), gather(self.text, self.word[which], self.length[which])


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, most: int | None = None) -> Iterator[_Block]:
    block = _Block(pattern)
    for batch in batches:
        for lo, hi, text, offsets in pieces(batch.column(1)):
            block.add(batch.column(0).slice(lo, hi - lo).cast(pa.int64()), text, offsets)
            if block.size >= (most or BLOCK_BYTES) or block.rows >= BLOCK_ROWS:
                yield block.close()
                block = _Block(pattern)
                give_back()
    if block.rows:
        yield block.close()


def _cut(lengths: np.ndarray, data: np.ndarray) -> list[bytes]:
    whole, at = data.tobytes(), np.concatenate([[0], np.cumsum(lengths.astype(np.int64))]).tolist()
    return [whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _batch(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.binary())])


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) for every row; ids: little-endian 32-bit numbers.

    decoded_sha256 is of the bytes that the ids decode to. Null texts count as empty: no ids. Repeated rows and rows with
    null ids each come back. A text of any length is one document; no text is cut.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    parts = block_count(docs)

    def part_of(h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)

    def both_sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, block in enumerate(_blocks(batches, pattern)):
            part = part_of(block.hash)
            order = np.argsort(part, kind="stable")
            cut = np.flatnonzero(np.diff(part[order].astype(np.int64), prepend=-1))
            groups = np.split(order, cut[1:]) if len(order) else []
            # numbered by task: both sides of a block come from one task
            name = TaskContext.get().partitionId() << 32 | n
            ranges = [int(part[g[0]]) for g in groups]
            yield _batch(
                key=pa.array([*ranges, -1 - name], pa.int64()),
                block=pa.array([name] * (len(groups) + 1), pa.int64()),
                part=pa.array([*ranges, None], pa.int32()),
                words=pa.array([*[pack(*block.spelt(g)) for g in groups], None], pa.binary()),
                docs=pa.array([*[None] * len(groups), pack(part.astype(np.uint32), block.counts, block.code)], pa.binary()),
                doc_ids=pa.array([*[None] * len(groups), block.ids.to_pylist()], pa.list_(pa.int64())),
            )

    def encode_words(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return pa.table({"block": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "ids": pa.array([], pa.binary())})
        one, known, out = _encoder(rank_path, pattern), {}, []
        for blob in table.column("words"):
            found = []
            for x in _cut(*unpack(blob.as_py())):
                if (y := known.get(x)) is None:
                    y = known[x] = one(x)
                found.append(y)
            out.append(pack(np.array([len(x) for x in found], np.uint32), np.array([y for x in found for y in x], np.uint32)))
        return pa.table({"block": table.column("block"), "part": table.column("part"), "ids": pa.array(out, pa.binary())})

    def assemble(key: tuple, block: pa.Table, coded: pa.Table) -> pa.Table:
        if key[0].as_py() >= 0:  # pre-tokens on their way to encode_words
            return pa.Table.from_batches([], schema=SCHEMA if keep_ids else SCHEMA.remove(4))
        said, spelt = _spellings(rank_path)
        part, lengths, positions = unpack(block.column("docs")[0].as_py())
        doc_ids = block.column("doc_ids")[0].as_py()
        flat, start, count, held = [], np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), 0
        for p, blob in zip(coded.column("part").to_pylist(), coded.column("ids"), strict=True):
            counts, ids = unpack(blob.as_py())
            mine = np.flatnonzero(part == p)
            count[mine], start[mine] = counts, held + np.cumsum(counts, dtype=np.int64) - counts
            flat.append(ids)
            held += len(ids)
        flat = np.concatenate(flat) if flat else np.empty(0, np.uint32)
        row_end = np.cumsum(lengths, dtype=np.int64)
        n_tokens, known = np.zeros(len(lengths), np.int64), 0
        tokens = np.empty(sum(int(count[positions[lo : lo + SPELT]].sum()) for lo in range(0, len(positions), SPELT)) if keep_ids else 0, "<u4")
        of_ids, of_bytes = [hashlib.sha256() for _ in lengths], [hashlib.sha256() for _ in lengths]
        for lo in range(0, len(positions), SPELT):
            own = positions[lo : lo + SPELT]
            ids, upto = gather(flat, start[own], count[own]), np.append(0, np.cumsum(count[own]))
            first = int(np.searchsorted(row_end, lo, "right"))
            last = int(np.searchsorted(row_end, lo + len(own) - 1, "right"))
            cut = np.append(upto[np.clip(row_end[first : last + 1] - lengths[first : last + 1] - lo, 0, None)], len(ids))
            n_tokens[first : last + 1] += np.diff(cut)
            for (data, at, size), hashes in ((said, of_ids), (spelt, of_bytes)):
                text = gather(data, at[ids], size[ids])
                ends = np.append(0, np.cumsum(size[ids]))[cut]
                for i, a, b, over in zip(range(first, last + 1), ends[:-1].tolist(), ends[1:].tolist(), row_end[first : last + 1].tolist(), strict=True):
                    # no comma behind the last id of a row
                    hashes[i].update(text[a : b - 1 if hashes is of_ids and b > a and over <= lo + len(own) else b])
            if keep_ids:
                tokens[known : known + len(ids)] = ids
                known += len(ids)
        cols = {"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(n_tokens), "ids_sha256": pa.array([h.hexdigest() for h in of_ids]), "decoded_sha256": pa.array([h.hexdigest() for h in of_bytes])}
        if keep_ids:
            ends = 4 * np.append(0, np.cumsum(n_tokens))
            cols["ids"] = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(tokens)]).cast(pa.binary())
        del positions, flat, tokens
        give_back()
        return pa.table(cols)

    sides = docs.mapInArrow(both_sides, "key bigint, block bigint, part int, words binary, docs binary, doc_ids array<bigint>")
    # one exchange holds both sides of all blocks; Spark reuses it, because both of its readers take it as it is
    dealt = sides.repartition(parts, "key")
    coded = dealt.groupBy("key").applyInArrow(encode_words, "block bigint, part int, ids binary").select((-1 - F.col("block")).alias("key"), "part", "ids")
    return dealt.groupBy("key").cogroup(coded.groupBy("key")).applyInArrow(assemble, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)


def decode(encoded: DataFrame, rank_path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """encoded with a binary column of the bytes that its ids stand for; null ids give null."""
    schema = encoded.select("*", F.lit(None).cast("binary").alias(into)).schema

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(rank_path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            out = [None if x is None else b"".join([table[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, into])

    return encoded.mapInArrow(spell, schema)
