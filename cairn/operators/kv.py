"""Key-value table over a change feed in apply order (sequence number, not time): the engine's own store semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.changelog import DELETE, PUT


def replay(log: DataFrame) -> DataFrame:
    """The records before the first torn one (operation null or unknown): what a log replay accepts."""
    torn = log.where(F.col("op").isNull() | ~F.col("op").isin(1, 2, 3)).agg(F.min("seq")).first()[0]
    return log if torn is None else log.where(F.col("seq") < torn)


def versions(log: DataFrame) -> DataFrame:
    """Last change of every key, tombstones included. Combines before the shuffle."""
    changed = log.where(F.col("op").isin(PUT, DELETE) & F.col("key").isNotNull())
    best = F.max(F.struct("seq", "op", "ts", "value")).alias("m")
    return changed.groupBy("key").agg(best).select("key", "m.seq", "m.op", "m.ts", "m.value")


def live(log: DataFrame) -> DataFrame:
    """Latest-wins state without deleted keys."""
    return versions(log).where(F.col("op") == PUT).drop("op")


def get(log: DataFrame, key: str) -> DataFrame:
    """Point lookup: the key filter is pushed below the aggregate, into the scan."""
    return live(log).where(F.col("key") == key)


def scan(log: DataFrame, prefix: str) -> DataFrame:
    """Live keys of one family, in order; the prefix is pushed into the scan."""
    return live(log).where(F.col("key").startswith(prefix)).orderBy("key")


def compact(log: DataFrame) -> DataFrame:
    """What a compaction writes: the live versions, sorted by key within files; all tombstones are dropped."""
    return live(log).sortWithinPartitions("key")


def stats(log: DataFrame) -> DataFrame:
    """Counters of the store: puts, deletes, commit marks, torn rows, bytes written."""
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    return log.agg(
        n(F.col("op") == PUT).alias("puts"),
        n(F.col("op") == DELETE).alias("deletes"),
        n(F.col("op") == 3).alias("commits"),
        n(F.col("op").isNull() | ~F.col("op").isin(1, 2, 3)).alias("torn"),
        F.coalesce(F.sum(F.when(F.col("op") == PUT, F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)))), F.lit(0)).cast("bigint").alias("bytes_put"),
    )
