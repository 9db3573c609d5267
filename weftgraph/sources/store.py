"""Count tables on disk: Parquet for each, and the parameters they were made with.

Clustered tables are for lookups and merges: rows are dealt to buckets by key, one sorted file each, with statistics and Bloom
filters for every row group. Spark knows the buckets, so a join or a sum by key doesn't shuffle the stored side.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import tables as T

#: Distinct keys that a lookup sends to the scan as a filter; more are joined. Keys that Spark pushes down in one list.
FEW, PUSHED = 1000, 10


def save(tables: dict[str, DataFrame], path: str, **parameters) -> None:
    """tables: any of exact, sketch, ends, corrections. Replaces what is there."""
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    _write_text(spark, f"{path}/parameters", json.dumps({"tables": sorted(tables), **parameters}))


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    parameters = json.loads(spark.read.text(f"{path}/parameters").first()[0])
    return {n: spark.read.parquet(f"{path}/{n}") for n in parameters.pop("tables")}, parameters


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _table_name(path: str) -> str:
    return f"weft_{hashlib.md5(path.encode()).hexdigest()}"


def save_clustered(table: DataFrame, path: str, key: str = "key", buckets: int = 64, rows_per_group: int = 1 << 20) -> None:
    """Writes a table with distinct whole-number keys as `buckets` sorted files, and what open_clustered needs. Replaces what is there.

    Tables that are merged or joined without a shuffle need equal numbers of buckets. A null key is an error. rows_per_group:
    about how many rows a row group has, the least that a lookup reads.
    """
    spark, name = table.sparkSession, _table_name(path)
    width = 16 * max(1, len(table.columns))
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    checked = table.withColumn(key, F.coalesce(F.col(key), F.raise_error("a clustered table has no null keys").cast(table.schema[key].dataType)))
    writer = checked.repartition(buckets, key).write.format("parquet").mode("overwrite").option("path", f"{path}/rows")
    writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(rows_per_group)).option("parquet.block.size", str(width * rows_per_group))
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    _write_text(spark, f"{path}/clustering", json.dumps({"key": key, "buckets": buckets, "schema": schema}))


def open_clustered(spark: SparkSession, path: str) -> DataFrame:
    """A table of save_clustered, in this session or another.

    A union of bucketed tables counts as dealt by bucket in Spark 4.1, but isn't where the scan of a bucket is switched off or
    its column batches are put together: then sums by key are wrong. So this switches off
    spark.sql.sources.bucketing.autoBucketedScan.enabled in the session, and the table comes with a filter that every row passes,
    which takes rows, not batches.
    """
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        c = json.loads(spark.read.text(f"{path}/clustering").first()[0])
        where = f"{path}/rows".replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({c['schema']}) USING parquet CLUSTERED BY (`{c['key']}`) SORTED BY (`{c['key']}`) INTO {c['buckets']} BUCKETS LOCATION '{where}'")
    key = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Bucket Columns'").first()["data_type"]
    return spark.table(name).where(F.col(key.strip("[]")).isNotNull())


def lookup(probes: DataFrame, stored: DataFrame, key: str = "key") -> DataFrame:
    """probes with the count of each key in a clustered table, 0 if absent. Null keys count 0; a probe that comes again does so.

    The distinct keys are counted up to FEW. So many are filters of the scan, which opens only the buckets and reads only the
    row groups that can hold them; more are dealt to the buckets, and the stored side stays where it is.
    """
    some = [r[0] for r in probes.select(key).where(F.col(key).isNotNull()).distinct().limit(FEW + 1).collect()]
    if len(some) <= FEW:
        parts = [F.col(key).isin(some[i : i + PUSHED]) for i in range(0, len(some), PUSHED)]
        stored = stored.where(reduce(lambda a, b: a | b, parts, F.lit(False)) if parts else F.lit(False))
        return T.lookup(probes, stored, key)
    return T.lookup(probes, stored.hint("merge"), key)


def merge(*stored: DataFrame, key: str = "key") -> DataFrame:
    """Sum of clustered tables with equal numbers of buckets and distinct keys, without a shuffle.

    A key's sum stands beside it in the first table that has it: each table, less the keys of those before, joined to those
    behind. All joins are of bucket with bucket; the parts have no key in common and aren't summed again.
    """
    parts = []
    for i, table in enumerate(stored):
        own, total = table.select(key, "cnt"), F.col("cnt")
        for earlier in stored[:i]:
            own = own.join(earlier.select(key).hint("merge"), key, "left_anti")
        for j, later in enumerate(stored[i + 1 :]):
            own, total = own.join(later.select(key, F.col("cnt").alias(f"__{j}")).hint("merge"), key, "left"), total + F.coalesce(f"__{j}", F.lit(0))
        parts.append(own.select(key, total.alias("cnt")))
    return reduce(lambda a, b: a.unionByName(b), parts)
