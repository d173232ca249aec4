"""Running sums within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import materialize


def running_sums(df: DataFrame, group: list[str], order: list[Column | str], value: str, out: str = "sum", label: str = "sums") -> DataFrame:
    """``df`` with the running sum of ``value`` (BIGINT, the row itself included) in the order ``order`` within ``group``.

    A range shuffle cuts the order into even parts; sums within a part and offsets of the earlier parts of the group give
    the result. The table of offsets has at most one row per part and group met there, not one per row.
    """
    spark = df.sparkSession
    keys = [*(F.col(g) for g in group), *(F.col(c) if isinstance(c, str) else c for c in order)]
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = materialize(df.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id()), label)
    totals = parts.groupBy(*group, "__part").agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy("__part", *group).orderBy(*keys[len(group) :]).rowsBetween(Window.unboundedPreceding, 0)
    summed = parts.withColumn("__run", F.sum(value).over(within)).join(offsets, ["__part", *group])
    return summed.select(*df.columns, (F.col("__run") + F.col("__offset")).cast("bigint").alias(out))
