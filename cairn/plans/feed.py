"""Queries over the change feed ``kv_log`` (problem 3) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import changelog
from cairn.session import scratch_path
from cairn.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Live keys with the time of the put that gave them their value."""
    return changelog.apply_changes(table(spark, d, "kv_log")).select("key", "ts")


def p3_state(spark: SparkSession, d: str) -> DataFrame:
    """Current table with values (as digest), by key family."""
    state = changelog.apply_changes(table(spark, d, "kv_log"), with_value=True)
    return state.select("key", "ts", "seq", F.sha2("value", 256).alias("value_sha256"))


def p3_compacted(spark: SparkSession, d: str) -> DataFrame:
    """The same state from more runs than a store keeps apart: they are compacted, and the one run left is read."""
    state = changelog.apply_changes(table(spark, d, "kv_log"), slices=12, with_value=True)
    return state.select("key", "ts", "seq", F.sha2("value", 256).alias("value_sha256"))


def p3_late(spark: SparkSession, d: str) -> DataFrame:
    """The same state when the feed comes in three mixed batches, and the first of them once more at the end,
    into a store that compacts beyond two runs."""
    log = table(spark, d, "kv_log")
    store = changelog.ChangeStore(spark, scratch_path(spark, "late"), fanout=2, with_value=False)
    part = F.pmod(F.xxhash64("seq"), F.lit(3))
    for k in (2, 0, 1, 2):
        store.append(log.where(F.coalesce(part, F.lit(0)) == k))
    return store.read().select("key", "ts", "seq")


_LIVE = """
WITH c AS (SELECT seq, op, key, value, CASE WHEN abs(ts) < 100000000000 THEN ts * 1000000000
    WHEN abs(ts) < 100000000000000 THEN ts * 1000000 WHEN abs(ts) < 100000000000000000 THEN ts * 1000 ELSE ts END AS ts
  FROM kv_log WHERE op IN (1, 2) AND key IS NOT NULL AND ts IS NOT NULL),
w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM c)
"""

QUERIES = {"p3_found": p3_found, "p3_state": p3_state, "p3_compacted": p3_compacted, "p3_late": p3_late}
ORACLES = {
    "p3_found": _LIVE + "SELECT key, ts FROM w WHERE rn = 1 AND op = 1",
    "p3_late": _LIVE + "SELECT key, ts, seq FROM w WHERE rn = 1 AND op = 1",
    "p3_state": _LIVE + "SELECT key, ts, seq, sha256(value) AS value_sha256 FROM w WHERE rn = 1 AND op = 1",
}
ORACLES["p3_compacted"] = ORACLES["p3_state"]
