"""Intermediate tables of iterations: Parquet in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder on a local master; an error on a cluster, whose
    executors would not see it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="weft-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jvm is not None and spark.sparkContext._jsc is not None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def list_path(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it isn't there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(where)) if files.exists(where) else []


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        delete_path(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone by then; the folder is scratch space
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the interpreter ends."""
    path = f"{folder(spark)}/weft-{name}-{uuid.uuid4().hex}"
    atexit.register(_at_exit, spark, path)
    return path


def keep(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Writes df and reads it again: the lineage ends, and lost executors cost nothing that was kept. by: columns of few values,
    a folder for each, so that what reads one value reads no other's files."""
    spark = df.sparkSession
    path = scratch(spark, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Deletes kept tables that nothing will read again: rounds of an iteration, sides of a join that was written."""
    for df in tables:
        path = getattr(df, "_weft_path", None)
        if path:
            delete_path(df.sparkSession, path)
