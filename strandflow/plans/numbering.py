"""Consecutive numbers for rows of a sorted table, without gathering the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.session import materialize


def number_rows(rows: DataFrame, *order, name: str = "row_number") -> DataFrame:
    """`rows` with a long column `name`: 0, 1, ... in the given order (ties in any).

    Rows are dealt to ranges, numbered in each, and written once, so that numbers and the sizes of
    ranges come from the same evaluation; only a row for each range is broadcast.
    """
    spread = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    numbered = materialize(spread.withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1), "numbered")
    sizes = numbered.groupBy("_range").agg(F.count("*").alias("_n"))
    first = sizes.withColumn("_first", F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    return numbered.join(F.broadcast(first.drop("_n")), "_range").withColumn(name, F.col("_first") + F.col("_place")).drop("_range", "_first", "_place")


def number_within(rows: DataFrame, key: str, *order, name: str = "pos") -> DataFrame:
    """`rows` with a long column `name`: 0, 1, ... among the rows of each key in the given order (ties in any).

    A key of any size is dealt to ranges like all rows, so no task numbers a whole key. A range goes on with at most
    one key of the ranges before it: what is broadcast is a row for each range.
    """
    spread = rows.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id())
    numbered = materialize(spread.withColumn("_place", F.row_number().over(Window.partitionBy("_range", key).orderBy(*order)) - 1), "numbered")
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = numbered.groupBy("_range", key).agg(F.count("*").alias("_n"))
    goes_on = counts.withColumn("_first", before).where("_first > 0").select(F.col("_range").alias("_r"), F.col(key).alias("_k"), "_first")
    joined = numbered.join(F.broadcast(goes_on), (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    return joined.withColumn(name, F.col("_place") + F.coalesce("_first", F.lit(0).cast("long"))).drop("_range", "_place", "_r", "_k", "_first")
