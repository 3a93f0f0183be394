"""Global running sums without a global window: range partitions, per-partition totals, local windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import free_name
from .storage import partitions, stored


def running_sums(df: DataFrame, order: list[str | Column], sums: dict[str, str]) -> DataFrame:
    """``df`` plus, for each ``out: value`` of ``sums``, the sum of ``value`` over all rows before this one.

    Rows are ordered by ``order`` over the whole table; rows equal in all of it
    come in any order.  The table is range-partitioned and stored, so partition
    numbers stay what they are if a task is run again; one row of totals per
    partition (at most the number of shuffle partitions) is broadcast.
    """
    spark = df.sparkSession
    part = free_name(df, "__part")
    total, local_sum, offset = ({o: free_name(df, f"__{kind}_{i}") for i, o in enumerate(sums)} for kind in ("total", "local", "offset"))
    ranged = stored(df.repartitionByRange(partitions(spark), *order).withColumn(part, F.spark_partition_id()), "ranged")
    totals = ranged.groupBy(part).agg(*[F.sum(v).alias(total[o]) for o, v in sums.items()])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(part, *[F.coalesce(F.sum(total[o]).over(before), F.lit(0)).alias(offset[o]) for o in sums])
    local = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.select("*", *[F.coalesce(F.sum(v).over(local), F.lit(0)).alias(local_sum[o]) for o, v in sums.items()])
    joined = within.join(F.broadcast(offsets), part)
    return joined.select(*df.columns, *[(F.col(local_sum[o]) + F.col(offset[o])).alias(o) for o in sums])
