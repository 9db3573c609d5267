"""What the steps of a job took: rows and seconds, seen in the pass that writes each step."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .durable import keep


class Steps:
    """Keeps tables one after another and notes the rows and seconds of each.

    The rows are counted by the pass that writes the table, not by another one; the seconds are those of that pass, so a step
    takes in everything since the tables it was made from were kept.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.taken: list[tuple[str, int, float]] = []

    def keep(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        seen, began = Observation(), time.monotonic()
        out = keep(df.observe(seen, F.count(F.lit(1)).alias("n")), name, *by)
        self.taken.append((name, seen.get["n"], time.monotonic() - began))
        return out

    def table(self) -> DataFrame:
        """(step, name, n_rows, seconds, rows_per_second), a row for each step from 1."""
        rows = [(i, name, n, took) for i, (name, n, took) in enumerate(self.taken, 1)]
        return self.spark.createDataFrame(rows, "step int, name string, n_rows long, seconds double").withColumn("rows_per_second", F.try_divide("n_rows", "seconds"))
