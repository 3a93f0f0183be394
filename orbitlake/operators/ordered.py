"""Places in the order of a group, without a group's rows in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialised


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """``df`` plus ``name``: the place of each row, from 0, in the ``order`` of its group; rows equal in all of it come in any order.

    Rows are dealt by ranges of key and order and stored, so that a task that
    runs again has the same; a group of any size spans as many ranges as it
    needs.  Rows are numbered within their range and moved up by what the
    group's earlier ranges hold.  Only the first group of a range has any, so one
    row a range is broadcast.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialised(df.repartitionByRange(ranges, *keys, *order).withColumn("__range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    moved = counts.withColumn("__before", before).filter("__before IS NOT NULL")
    moved = moved.select(F.col("__range").alias("__r"), "__before", *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    local = F.row_number().over(Window.partitionBy("__range", *keys).orderBy(*order)) - 1
    test = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col("__range") == F.col("__r"))
    joined = ranged.withColumn("__local", local).join(F.broadcast(moved), test, "left")
    return joined.select(*df.columns, (F.col("__local") + F.coalesce("__before", F.lit(0))).alias(name))
