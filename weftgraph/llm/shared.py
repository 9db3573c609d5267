"""Shared plumbing: durable intermediate tables, sizes, sums over many tasks and Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.durable import forget, keep
from weftgraph.operators.sizes import planned_bytes, small_batches

__all__ = ["block_count", "columns", "forget", "give_back", "input_bytes", "merged", "small_batches", "staged"]

#: Parts that one task merges at most.
FAN_IN = 256


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage and survives lost executors."""
    return keep(df, name)


def input_bytes(df: DataFrame) -> int:
    """Size of the tables under df as the planner knows it, without running a job. Where a leaf has no statistics, one job adds
    up the texts of df."""
    size = planned_bytes(df)
    if size is not None:
        return size
    texts = [F.coalesce(F.octet_length(f"`{n}`"), F.lit(0)).cast("bigint") for n, kind in df.dtypes if kind in ("string", "binary")]
    return int(df.agg(F.coalesce(F.sum(sum(texts, F.lit(8 * len(df.columns)).cast("bigint"))), F.lit(0))).first()[0])


def block_count(df: DataFrame, each: int = 4 << 20, least: int = 16) -> int:
    """How many blocks an input needs at `each` bytes a block; a power of two, with no upper bound."""
    n, size = least, input_bytes(df)
    while n * each < size:
        n *= 2
    return n


def merged(parts: DataFrame, merge: Callable[[int, list[bytes], bool], bytes], tasks: int) -> list[tuple[int, bytes]]:
    """(part, blob) for each value of parts.part: merge(part, blobs, last) joins the column blob, FAN_IN of them at a time.

    parts: part int, blob binary. tasks: about how many blobs a part has; levels are added until one is left.
    """
    levels = 1
    while FAN_IN**levels < tasks:
        levels += 1

    def adder(last: bool):
        def add(key: tuple, table: pa.Table) -> pa.Table:
            blob = merge(key[0].as_py(), [x.as_py() for x in table.column("blob")], last)
            return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([key[1].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary())})

        return add

    rows = parts.select("part", F.spark_partition_id().alias("salt"), "blob")
    for level in range(levels, 0, -1):
        dealt = F.lit(0) if level == 1 else F.pmod(F.xxhash64("salt"), F.lit(FAN_IN ** (level - 1))).cast("int")
        rows = rows.select("part", dealt.alias("salt"), "blob").groupBy("part", "salt").applyInArrow(adder(level == 1), "part int, salt int, blob binary")
    return sorted((r["part"], bytes(r["blob"])) for r in rows.select("part", "blob").collect())


def give_back() -> None:
    """Returns freed memory of this Python worker to the system, where its allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; extra columns and their names never matter."""
    return df.select(*[F.col(f"`{n}`") for n in names])
