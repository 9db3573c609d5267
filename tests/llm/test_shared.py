"""Sizes of inputs and what follows them."""

from __future__ import annotations

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import shared


def test_input_bytes_is_the_size_of_what_lies_below(spark, tmp_path):
    texts = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    texts.coalesce(1).write.parquet(f"{tmp_path}/a")
    on_disk = sum(os.path.getsize(f"{tmp_path}/a/{f}") for f in os.listdir(f"{tmp_path}/a") if f.endswith(".parquet"))
    a = spark.read.parquet(f"{tmp_path}/a")
    assert shared.input_bytes(a) == shared.input_bytes(a.select("text").where("id > 5")) == on_disk
    assert shared.input_bytes(a.join(a.select("id"), "id")) == 2 * on_disk
    # without statistics, texts are counted
    loose = spark.createDataFrame(spark.sparkContext.parallelize([("abc", 1), (None, 2)]), "text string, n int")
    assert shared.input_bytes(loose) == 3 + 2 * 16 and shared.input_bytes(loose.where("n > 5")) == 0


@pytest.mark.parametrize(("size", "blocks"), [(0, 16), (64 << 20, 16), (65 << 20, 32), (1 << 40, 1 << 18), (100 << 40, 1 << 25)])
def test_blocks_grow_with_the_input(monkeypatch, size, blocks):
    monkeypatch.setattr(shared, "input_bytes", lambda df: size)
    assert shared.block_count(None) == blocks


def test_merged_adds_levels(spark, monkeypatch):
    monkeypatch.setattr(shared, "FAN_IN", 3)
    met = []

    def add(part, blobs, last):
        met.append(len(blobs))
        return bytes([sum(x[0] for x in blobs)])

    def ones(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([b"\1", b"\2"], pa.binary())], names=["part", "blob"])

    parts = spark.range(0, 20, numPartitions=20).mapInArrow(ones, "part int, blob binary")
    assert shared.merged(parts, add, 20) == [(0, b"\x14"), (1, b"\x28")]
