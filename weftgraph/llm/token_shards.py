"""Token-ID output in training order.

Texts become sequences of at most `stride` token ids, padded to it. Every sequence gets a dense number, in the order of ids
and text hashes, however the input is split, and a keyed Feistel permutation with cycle-walking turns the number into its global slot in training order. Partitions are ranges of
slots; each writes one shard of fixed-stride rows, so slot s is at byte (s % slots_per_shard) * stride * width of its
shard, and a reader resumes at any slot.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .setjoin import pack, unpack
from .shared import small_batches, staged
from .words import mix

U = np.uint64
ROUNDS = 6
#: Documents of one range of the numbering, about, and ranges at most (a number for each comes to the driver).
RANGE, MOST_RANGES = 1 << 17, 1 << 16
#: Tokens of one row of the table of tokens, about; texts stay whole.
ROW_TOKENS = 1 << 19
#: Pre-tokens that a task remembers.
REMEMBERED = 1 << 18


def permute(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A permutation of 0..n-1 chosen by key, or its inverse: balanced Feistel rounds on the least even number of bits that
    holds n, walked on while outside."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low = U((1 << half) - 1)
    keys = mix((np.arange(1, ROUNDS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) ^ U(key & (2**64 - 1)))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> U(half), v & low
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (mix(left + k) & low), left
            else:
                left, right = right, left ^ (mix(right + k) & low)
        return (left << U(half)) | right

    out = once(x.astype(np.uint64))
    while (outside := out >= U(n)).any():
        out[outside] = once(out[outside])
    return out


def sequences(docs: DataFrame, rank_path: str, pattern: str, stride: int = 256, key: int = 1, pad: int = 50256, slots_per_shard: int = 1 << 14, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(slot, shard, offset, doc_id, seq, n_tokens, tokens): one row for each sequence, a partition for each run of shards,
    ordered by slot. tokens has stride little-endian ids of 2 bytes, or 4 if the pad id needs them.

    Null and empty texts have no tokens and no sequence. Repeated rows and null ids each give sequences. No text is cut
    off: a text of n tokens has ceil(n / stride) sequences.
    """
    spark = docs.sparkSession
    small_batches(spark)
    width = "<u2" if pad < 1 << 16 else "<u4"
    text = F.col(f"`{text_col}`")
    docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, hashes, number = bpe._encoder(rank_path, pattern), [], 0

        class Known(dict):
            def __missing__(self, x: bytes) -> list[int]:
                y = one(x)
                if len(self) < REMEMBERED:
                    self[x] = y
                return y

        known = Known()

        def read() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hashes.extend(batch.column(2).to_pylist())
                yield batch

        # pre-tokens are told apart over a large block, so that fewer come again; what leaves it are rows of few texts
        for block in bpe._blocks(read(), pattern):
            found = list(map(known.__getitem__, bpe._cut(*block.spelt(np.arange(len(block.length))))))
            size = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
            del found
            start = np.cumsum(size) - size
            first = np.concatenate([[0], np.cumsum(block.counts.astype(np.int64))])
            upto = np.concatenate([[0], np.cumsum(size[block.code])])[first]
            n, ids = np.diff(upto), block.ids.to_pylist()
            lo = 0
            while lo < block.rows:
                hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + ROW_TOKENS, "right")) - 1)
                code = block.code[first[lo] : first[hi]]
                tokens = bpe.gather(flat, start[code], size[code]) if len(code) else np.empty(0, np.uint32)
                name, part = TaskContext.get().partitionId() << 32 | number, n[lo:hi]
                cols = {"block": pa.array([name], pa.int64()), "ids": pa.array([ids[lo:hi]], pa.list_(pa.int64())), "hashes": pa.array([hashes[lo:hi]], pa.list_(pa.int64())), "many": pa.array([-(-part // stride)], pa.list_(pa.int64())), "tokens": pa.array([pack(part.astype(np.uint32), tokens)], pa.binary())}
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
                lo, number = hi, number + 1
            hashes[: block.rows] = []

    blocks = docs.mapInArrow(tokenize, "block bigint, ids array<bigint>, hashes array<bigint>, many array<bigint>, tokens binary")
    blocks = staged(blocks, "tokens")  # from here on a block's number is fixed
    # every document with tokens, sorted by id and hash in ranges; rows that are equal in both are equal in all that follows
    each = blocks.select("block", F.posexplode(F.arrays_zip("ids", "hashes", "many")).alias("pos", "d")).select("block", "pos", "d.*").where("many > 0")
    order = ["ids", "hashes", "block", "pos"]
    ranges = int(np.clip(each.count() // RANGE + 1, 1, MOST_RANGES))
    each = staged(each.repartitionByRange(ranges, *order).withColumn("run", F.spark_partition_id()), "order")
    total, before = 0, []
    for run, n in sorted((r["run"], r["n"]) for r in each.groupBy("run").agg(F.sum("many").alias("n")).collect()):
        before.append((run, total))
        total += n
    base = spark.createDataFrame(before, "run int, before bigint")
    inside = Window.partitionBy("run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = each.join(F.broadcast(base), "run").select("block", "pos", (F.col("before") + F.coalesce(F.sum("many").over(inside), F.lit(0))).alias("base"))
    numbered = numbered.groupBy("block").agg(F.collect_list(F.struct("pos", "base")).alias("bases"))  # a block has BLOCK_ROWS documents at most
    shards = -(-total // slots_per_shard) or 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, blob, bases in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                n, tokens = unpack(blob.as_py())
                n = n.astype(np.int64)
                many = -(-n // stride)
                doc = np.repeat(np.arange(len(n)), many)
                seq = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start = np.zeros(len(n), np.int64)
                start[[x["pos"] for x in bases]] = [x["base"] for x in bases]
                slot = permute(start[doc] + seq, total, key).astype(np.int64)
                size = np.minimum(stride, n[doc] - seq * stride)
                at = (np.cumsum(n) - n)[doc] + seq * stride
                for lo in range(0, len(doc), 4096):
                    cut = slice(lo, lo + 4096)
                    rows = np.full((len(doc[cut]), stride), pad, width)
                    inside = np.arange(stride)[None, :] < size[cut, None]
                    rows[inside] = tokens[(at[cut, None] + np.arange(stride)[None, :])[inside]]
                    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(stride * rows.itemsize), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(slot[cut]), pa.array([ids[d] for d in doc[cut]], pa.int64()), pa.array(seq[cut]), pa.array(size[cut]), flat], names=["slot", "doc_id", "seq", "n_tokens", "tokens"])

    rows = blocks.join(numbered, "block").select("ids", "tokens", "bases").mapInArrow(place, "slot bigint, doc_id bigint, seq bigint, n_tokens bigint, tokens binary")
    shard = F.floor(F.col("slot") / slots_per_shard).cast("int")
    rows = rows.select("slot", shard.alias("shard"), (F.pmod("slot", F.lit(slots_per_shard)) * stride * np.dtype(width).itemsize).alias("offset"), "doc_id", "seq", "n_tokens", "tokens")
    return rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")


def write_shards(rows: DataFrame, path: str, stride: int = 256, slots_per_shard: int = 1 << 14) -> list[dict]:
    """Writes the shards of sequences() and manifest.json under path, any that pyarrow's file systems open; gives the manifest.

    A shard is written under a name of its own task attempt and then moved, so a repeated task leaves one whole file.
    """
    schema = "shard int, first_slot bigint, n bigint, bytes bigint, sha256 string"
    where, root = fs.FileSystem.from_uri(path)
    where.create_dir(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(path)
        attempt = TaskContext.get().taskAttemptId()
        current, out, seen, start, digest, size = None, None, 0, 0, hashlib.sha256(), 0
        done = []

        def close() -> None:
            if out is not None:
                out.close()
                where.move(f"{root}/.{current}-{attempt}", f"{root}/shard-{current:08d}.bin")
                done.append((current, start, seen, size, digest.hexdigest()))

        for batch in batches:
            for shard, slot, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if shard != current:
                    close()
                    current, seen, start, digest, size = shard, 0, slot, hashlib.sha256(), 0
                    out = where.open_output_stream(f"{root}/.{current}-{attempt}")
                if slot != start + seen:
                    raise ValueError(f"slot {slot} follows {start + seen - 1}")
                raw = tokens.as_py()
                out.write(raw)
                digest.update(raw)
                seen, size = seen + 1, size + len(raw)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["shard", "first_slot", "n", "bytes", "sha256"])

    manifest = [r.asDict() for r in rows.select("shard", "slot", "tokens").mapInArrow(write, schema).orderBy("shard").collect()]
    with where.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"stride": stride, "slots_per_shard": slots_per_shard, "shards": manifest}).encode())
    return manifest


def read_slots(path: str, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, padded ids) from slot `start` on: seeks to it in its shard, then reads on."""
    where, root = fs.FileSystem.from_uri(path)
    with where.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    for shard in manifest["shards"]:
        first, n = shard["first_slot"], shard["n"]
        if first + n <= start or (stop is not None and first >= stop):
            continue
        row = shard["bytes"] // n
        with where.open_input_file(f"{root}/shard-{shard['shard']:08d}.bin") as f:
            at = max(start, first)
            f.seek((at - first) * row)
            while at < first + n and (stop is None or at < stop):
                yield at, np.frombuffer(f.read(row), "<u2" if row == 2 * manifest["stride"] else "<u4")
                at += 1

