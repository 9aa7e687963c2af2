"""Bucketed Parquet tables that live in a folder, for joins that do not shuffle them and filters that pick buckets."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession


def bucketed_table(spark: SparkSession, path: str, columns: str, column: str, buckets: int) -> str:
    """The name under which this session knows the table of ``columns`` in the folder ``path``, bucketed and sorted by ``column``. It
    reads what is there and takes inserts; a folder is given the same columns and number of buckets each time."""
    name = f"trawl_{hashlib.md5(path.encode()).hexdigest()}"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({column}) SORTED BY ({column}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name
