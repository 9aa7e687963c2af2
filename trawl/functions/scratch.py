"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_scratch: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package when it is run from a checkout."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def spread_small(df: DataFrame, core_bytes: int = 16_000_000) -> DataFrame:
    """A table that is estimated at less than ``core_bytes`` a core, dealt to all cores: it may be a single split, or a single row
    group, where much work a row waits. Larger tables have splits enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < cores * core_bytes else df


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temp folder only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _local_scratch:
        _local_scratch[key] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_scratch[key]


def materialise(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage, survives
    lost executors, and fixes the values of non-deterministic columns. Files hold ``file_rows`` rows at most, if given: a reader holds up to
    4,096 rows of a file at once, which is much where a row is megabytes."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/trawl-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the scratch tables behind ``materialise``'s results, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
