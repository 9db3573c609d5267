"""Scores of a lossy or corrected table (edge, cnt) against the exact one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.hashes import mix_array

from .reads import canonical_array


def false_positives(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Edges that have a count but aren't in the exact table."""
    return found.where("cnt > 0").join(exact.select("edge"), "edge", "left_anti")


def abundance_errors(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(edge, cnt, exact) where they differ, over the found edges."""
    both = found.select("edge", "cnt").join(exact.select("edge", F.col("cnt").alias("exact")), "edge", "left")
    return both.withColumn("exact", F.coalesce("exact", F.lit(0))).where("cnt <> exact")


def false_negatives(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Exact edges without a count."""
    return exact.join(found.where("cnt > 0").select("edge"), "edge", "left_anti")


def errors(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: over-counts, under-counts, false positives and false negatives."""
    both = found.select("edge", "cnt").join(exact.select("edge", F.col("cnt").alias("exact")), "edge", "full").na.fill(0, ["cnt", "exact"])
    return both.agg(F.count_if(F.col("cnt") > F.col("exact")).alias("over"), F.count_if(F.col("cnt") < F.col("exact")).alias("under"), F.count_if((F.col("cnt") > 0) & (F.col("exact") == 0)).alias("false_positives"), F.count_if((F.col("cnt") == 0) & (F.col("exact") > 0)).alias("false_negatives"))


def random_probes(spark, n: int, k: int, seed: int = 1) -> DataFrame:
    """(edge): n packed k-mers drawn evenly, made canonical; k is 31 at most. Row i is a mix of i and the seed, however
    the rows are dealt to tasks."""
    bits = 40 if 2 * k <= 40 else 62

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = mix_array(batch.column(0).to_numpy().astype(np.uint64) + np.uint64(seed << (bits - 10)), bits) >> np.uint64(bits - 2 * k)
            yield pa.RecordBatch.from_arrays([pa.array(canonical_array(value, k).view(np.int64))], names=["edge"])

    return spark.range(n).mapInArrow(draw, "edge bigint")
