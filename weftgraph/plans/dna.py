"""Reads out of the test tables: letters of any text, a to y as the four bases in turn and z as N."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS, AS_BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAN"
#: (table, id column) of the tables with texts.
TABLES = {"documents": "doc_id", "benchmark": "item_id", "conversations": "conv_id"}


def reads(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """reads(read_id, seq) of whole texts"""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    seq = F.translate(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z]+", ""), LETTERS, AS_BASES)
    return rows.select(F.col(TABLES[table]).alias("read_id"), seq.alias("seq"))
