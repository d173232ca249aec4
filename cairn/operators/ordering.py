"""Positions and joins that never put a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import materialize

#: Keys that own more than one row in HOT_PARTS are joined by broadcast; fewer than HOT_PARTS keys can do so.
HOT_PARTS = 2000


def _partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def number_rows(df: DataFrame, order: list[Column | str], out: str = "pos", label: str = "numbered") -> DataFrame:
    """``df`` with its 0-based position in the total order ``order`` (BIGINT column ``out``).

    A range shuffle splits even one dominating key over many tasks; positions are partition offset plus place within the
    partition. Only one count per partition goes to the driver. The result is a written table. Empty input gives no rows.
    """
    spark = df.sparkSession
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = (
        df.repartitionByRange(_partitions(df), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("__pid", F.spark_partition_id())
        .withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    placed = materialize(placed, label)
    counts = {r["__pid"]: r["count"] for r in placed.groupBy("__pid").count().collect()}
    total, offsets = 0, []
    for pid in sorted(counts):
        offsets.append((pid, total))
        total += counts[pid]
    if not offsets:
        return placed.select(*df.columns, F.lit(0).cast("bigint").alias(out))
    table = spark.createDataFrame(offsets, "__pid int, __off bigint")  # one row per partition
    return placed.join(F.broadcast(table), "__pid").select(*df.columns, (F.col("__off") + F.col("__at")).alias(out))


def join_counted(facts: DataFrame, sizes: DataFrame, key: str | list[str], count: str, total: int) -> DataFrame:
    """Inner equi-join of ``facts`` with ``sizes`` (unique ``key``; ``count`` = rows of that key in ``facts``).

    Keys holding more than ``total / HOT_PARTS`` rows are joined by broadcast - there are fewer than ``HOT_PARTS`` of them by
    counting - and all others by shuffle, where no key holds more than that share of the rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    limit = max(1, total // HOT_PARTS)
    hot = sizes.where(F.col(count) > limit)
    cold = sizes.where(F.col(count) <= limit)
    there = F.broadcast(hot.select(*keys))
    return facts.join(F.broadcast(hot), keys).unionByName(facts.join(there, keys, "left_anti").join(cold, keys))
