"""Numbers for rows and for ids of any type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.scratch import materialise


def assign_ids(rows: DataFrame, high_water: int, column: str = "data_id", order: str = "pos") -> DataFrame:
    """Numbers rows from high_water + 1 without gaps, in the order of ``order``.

    Rows are range-partitioned and written with their partition's number once, so that the counts of the partitions, which
    give the offsets, and the numbers inside them are taken from the same rows. ``order`` must tell rows apart for the numbers to
    be repeatable."""
    placed = materialise(rows.repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id()))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    offsets = F.broadcast(sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__offset")))
    turn = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    numbered = placed.withColumn("__turn", turn).join(offsets, "__part")
    others = [c for c in rows.columns if c != column]  # a column of that name is numbered anew
    return numbered.select(*others, (F.lit(high_water) + F.col("__offset") + F.col("__turn")).alias(column))


def is_long(df: DataFrame, column: str) -> bool:
    return dict(df.dtypes)[column] in ("bigint", "int", "smallint", "tinyint")


def id_numbers(df: DataFrame, column: str) -> DataFrame:
    """(id, number) of the distinct ids of a column that is no integer, in their order, so that ties go by id as they do for integers."""
    distinct = df.select(F.col(column).alias("id")).where(F.col(column).isNotNull()).distinct()
    return materialise(assign_ids(distinct, -1, "number", "id"))
