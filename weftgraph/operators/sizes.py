"""Sizes of inputs, and Arrow batches of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: From this size on, the planner's figure says only that it has none.
UNKNOWN = 1 << 60


def planned_bytes(df: DataFrame) -> int | None:
    """Size of the tables under df as the planner knows it, without running a job; None where one has no statistics. Only the
    leaves are added up: above a join, the planner multiplies."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(sizes) if max(sizes, default=0) < UNKNOWN else None


def small_batches(spark: SparkSession, size: int = 2 << 20) -> None:
    """Documents vary from empty to megabytes; Python workers get batches of about `size` bytes, so their memory is bounded.

    Sets spark.sql.execution.arrow.maxBytesPerBatch of the session, which is read when a query runs, unless it is lower.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name, "64m").lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(old[-1:], 0)
    now = int(old.rstrip("kmg")) << unit
    if now <= 0 or now > size:
        spark.conf.set(name, str(size))
