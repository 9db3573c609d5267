"""Incremental inserts: a stream of reads keeps exact counts up to date."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.operators.durable import delete_path, list_path
from weftgraph.operators.reads import scan

#: Parts of one size that become a part of the next size.
FAN = 8


def insert_reads(counts: DataFrame, new_reads: DataFrame, k: int) -> DataFrame:
    """counts(is_end, key, a, b) with the k-mers and ends of more reads added."""
    return counts.unionByName(scan(new_reads, k)).groupBy("is_end", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def count_stream(reads: DataFrame, k: int) -> DataFrame:
    """The same over a streaming DataFrame; its state is one row for each distinct key."""
    return scan(reads, k).groupBy("is_end", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def start(reads: DataFrame, k: int, name: str, checkpoint: str) -> StreamingQuery:
    """Counts in a memory table, whole after each batch: for graphs that the driver can hold. start_into has no such limit."""
    return count_stream(reads, k).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def start_into(reads: DataFrame, k: int, path: str, checkpoint: str, fan: int = FAN) -> StreamingQuery:
    """Each batch's counts as a part of their own under path. Parts are added up as batches come: every `fan` parts of one size
    become one of the next, so n batches are at most fan parts of each of log n sizes, and a key is rewritten log n times."""

    def add(batch: DataFrame, number: int) -> None:
        add_batch(batch, number, k, path, fan)

    return reads.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()


def add_batch(batch: DataFrame, number: int, k: int, path: str, fan: int = FAN) -> None:
    """Adds batch `number`, counted from 0, to the parts under path. A batch that comes again changes nothing.

    A part span=a_b holds the batches a to b. It counts once it was written whole; until then its predecessors do, so that a
    batch may fail at any point and be repeated. Predecessors are deleted a batch later: who reads while a batch is added still
    finds the files of the table it opened.
    """
    spark = batch.sparkSession
    live = live_parts(spark, path)
    for a, b in _parts(spark, path):
        if (a, b) not in live:
            delete_path(spark, _part(path, a, b))
    if not any(a <= number <= b for a, b in live):
        _write(count_stream(batch, k), _part(path, number, number))
    size = 1
    while (number + 1) % (size * fan) == 0:
        first, size = number + 1 - size * fan, size * fan
        live = live_parts(spark, path)
        if any(a <= first and number <= b for a, b in live):
            continue
        inside = [(a, b) for a, b in live if first <= a and b <= number]
        if sum(b - a + 1 for a, b in inside) < size:  # earlier batches were written with another fan, or by something else
            return
        _write(_summed(spark, path, inside), _part(path, first, number))


def _write(counts: DataFrame, path: str) -> None:
    counts.sortWithinPartitions("is_end", "key").write.mode("overwrite").parquet(path)


def _part(path: str, a: int, b: int) -> str:
    return f"{path}/span={a}_{b}"


def _parts(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(first, last) batch of every folder, whole or not. As many as there are parts: some for each size."""
    found = (re.fullmatch(r"span=(\d+)_(\d+)", name) for name in list_path(spark, path))
    return sorted((int(m[1]), int(m[2])) for m in found if m)


def live_parts(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """The parts that make up the table: whole ones that no larger whole one holds."""
    whole = [(a, b) for a, b in _parts(spark, path) if "_SUCCESS" in list_path(spark, _part(path, a, b))]
    return [(a, b) for a, b in whole if not any((c, d) != (a, b) and c <= a and b <= d for c, d in whole)]


def _summed(spark: SparkSession, path: str, parts: list[tuple[int, int]]) -> DataFrame:
    rows = spark.read.schema("is_end boolean, key bigint, a bigint, b bigint").parquet(*[_part(path, a, b) for a, b in parts])
    return rows.groupBy("is_end", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def stored_counts(spark: SparkSession, path: str) -> DataFrame:
    """counts(is_end, key, a, b) of all batches that were added; graph.balance and reads.edges_in, ends_in take it."""
    parts = live_parts(spark, path)
    if not parts:
        return spark.createDataFrame([], "is_end boolean, key bigint, a bigint, b bigint")
    return _summed(spark, path, parts)
