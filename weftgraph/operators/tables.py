"""Algebra of count tables (key, cnt): multisets with positive counts; an absent key counts 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge(*tables: DataFrame, key: str = "key") -> DataFrame:
    """Sum of any number of tables; none but the first need the same column order."""
    both = reduce(lambda a, b: a.unionByName(b), [t.select(key, "cnt") for t in tables])
    return both.groupBy(key).agg(F.sum("cnt").alias("cnt"))


def increment(table: DataFrame, changes: DataFrame, key: str = "key") -> DataFrame:
    return merge(table, changes, key=key)


def decrement(table: DataFrame, changes: DataFrame, key: str = "key") -> DataFrame:
    """Takes changes.cnt off, down to 0; keys at 0 are gone."""
    less = changes.groupBy(key).agg(F.sum("cnt").alias("less"))
    left = F.col("cnt") - F.coalesce("less", F.lit(0))
    return table.join(less, key, "left").select(key, left.alias("cnt")).where("cnt > 0")


def delete_keys(table: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def replace_keys(table: DataFrame, new_key: Column, key: str = "key") -> DataFrame:
    """Counts under new keys; keys that meet add up."""
    return table.groupBy(new_key.alias(key)).agg(F.sum("cnt").alias("cnt"))


def lookup(probes: DataFrame, table: DataFrame, key: str = "key") -> DataFrame:
    """probes with the count of each key, 0 if absent."""
    return probes.join(table.select(key, "cnt"), key, "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))


def inner_product(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """One row: the sum of count products over common keys."""
    both = a.select(key, F.col("cnt").alias("x")).join(b.select(key, F.col("cnt").alias("y")), key)
    return both.agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("inner_product"))


def magnitude(table: DataFrame) -> DataFrame:
    """One row: the whole part of the root of the self product."""
    return table.agg(F.floor(F.sqrt(F.coalesce(F.sum(F.col("cnt") * F.col("cnt")), F.lit(0)))).cast("bigint").alias("magnitude"))


def cosine(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    x, y = (t.agg(F.sqrt(F.sum(F.col("cnt") * F.col("cnt"))).alias(n)) for t, n in ((a, "x"), (b, "y")))
    return inner_product(a, b, key).join(F.broadcast(x)).join(F.broadcast(y)).select((F.col("inner_product") / (F.col("x") * F.col("y"))).alias("cosine"))


def statistics(table: DataFrame) -> DataFrame:
    """One row: distinct keys, total, greatest count, keys counted more than once."""
    zero = F.lit(0)
    return table.agg(F.count("*").alias("n_distinct"), F.coalesce(F.sum("cnt"), zero).alias("total"), F.coalesce(F.max("cnt"), zero).alias("max_count"), F.count_if(F.col("cnt") > 1).alias("n_repeated"))


def histogram(table: DataFrame) -> DataFrame:
    """(cnt, n_keys)"""
    return table.groupBy("cnt").agg(F.count("*").alias("n_keys"))


def count_distinct(rows: DataFrame, key: str = "key") -> DataFrame:
    return rows.agg(F.count_distinct(key).alias("n_distinct"))
