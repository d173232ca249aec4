"""Change feed application: a log-structured merge of sorted runs.

``ChangeStore`` keeps a table as immutable runs. ``append`` turns a slice of the feed into one run that is sorted by key and
holds, per key, only the newest change of that slice (a tombstone if that is a delete); every run is cut into the same buckets
by the hash of the key. ``read`` merges the runs bucket by bucket without a shuffle - the newest change of any run wins,
tombstones hide the key. ``compact`` rewrites the runs as one, and ``append`` calls it whenever more than ``fanout`` runs have
gathered; tombstones stay, for a put older than the delete may still come late or again. Only the caller can know from which
time on changes may still come, and drop those before it. A change is newer if its time is later, or at equal times its
sequence number is higher, so late, repeated and out-of-order arrivals end in the same state whatever slice they come in.

Defined results: rows whose operation is neither put (1) nor delete (2), or null, change nothing; neither do rows without
a key or without a time, or whose time in nanoseconds has no place in a BIGINT (beyond the year 2262); a null sequence number
counts as the lowest; a put with a null value is a live key with a null
value; repeated rows change nothing; an empty feed gives an empty table; columns other than seq, op, ts, key, value are
ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.session import scratch_path

PUT, DELETE = 1, 2
RUNS, _TRACKED = "runs", "spark.sql.hive.manageFilesourcePartitions"


def to_nanoseconds(ts: Column) -> Column:
    """Unix time in s, ms, us or ns brought to ns; the unit follows from the magnitude (dates from 1973 on, in any unit). Null
    where nanoseconds overflow."""
    least = F.lit(-(2**63))  # has no positive counterpart
    size = F.abs(F.when(ts != least, ts))
    return (
        F.when(size < F.lit(10**11), F.try_multiply(ts, F.lit(10**9)))
        .when(size < F.lit(10**14), F.try_multiply(ts, F.lit(10**6)))
        .when(size < F.lit(10**17), F.try_multiply(ts, F.lit(10**3)))
        .otherwise(ts)
    )


def changes(log: DataFrame, with_value: bool = True) -> DataFrame:
    """The rows of ``log`` that change something: (key, ts in ns, seq, op[, value])."""
    value = [F.col("value")] if with_value else []
    valid = log.where(F.col("op").isin(PUT, DELETE) & F.col("key").isNotNull() & F.col("ts").isNotNull())
    return valid.select("key", to_nanoseconds(F.col("ts")).alias("ts"), "seq", F.col("op").cast("tinyint").alias("op"), *value).where("ts IS NOT NULL")


def newest(changed: DataFrame, *keys: str) -> DataFrame:
    """The newest change of every key. The aggregate combines before the shuffle, so a hot key sends one row per task."""
    rest = [c for c in changed.columns if c not in (*keys, "ts", "seq")]
    best = F.max(F.struct("ts", "seq", *rest)).alias("best")
    return changed.groupBy(*keys).agg(best).select(*keys, "best.ts", "best.seq", *(f"best.{c}" for c in rest))


class ChangeStore:
    """Runs of one table below ``path``; the newest ``MANIFEST-n.json`` names the live ones and the number of buckets."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 8, with_value: bool = True, buckets: int | None = None):
        self.spark, self.path, self.fanout, self.with_value = spark, path, fanout, with_value
        self.fields = "key string, ts bigint, seq bigint, op tinyint" + ", value binary" * with_value
        self.schema = T._parse_datatype_string(self.fields)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
        self._path = jvm.org.apache.hadoop.fs.Path
        # the number of a store's buckets is that of its first run; with as many shuffle partitions a run is one file a bucket
        self.buckets = self._manifest()["buckets"] or buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def _at(self, *names: str):  # noqa: ANN202
        return self._path(os.path.join(self.path, *names))

    def _manifests(self) -> list[str]:
        found = self._fs.globStatus(self._at("MANIFEST-*.json")) or []
        return sorted(str(f.getPath().getName()) for f in found)

    def _manifest(self) -> dict:
        names = self._manifests()
        if not names:
            return {"version": 0, "buckets": 0, "runs": [], "retired": []}
        stream = self._fs.open(self._at(names[-1]))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _save(self, manifest: dict, runs: list[str]) -> None:
        """A new version appears by a rename; the one before stays until it has, so a crash leaves the old state or the new.
        Runs that it no longer names are kept for the readers of the version before and deleted with the next version."""
        gone = manifest["retired"]
        manifest |= {"version": manifest["version"] + 1, "buckets": self.buckets, "runs": runs, "retired": [r for r in manifest["runs"] if r not in runs]}
        new, at = self._at(f"_manifest-{uuid.uuid4().hex}.tmp"), self._at(f"MANIFEST-{manifest['version']:012d}.json")
        stream = self._fs.create(new, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if not self._fs.rename(new, at):
            raise RuntimeError(f"another writer has changed {self.path}")
        for name in self._manifests()[:-1]:
            self._fs.delete(self._at(name), False)
        for r in gone:
            self._fs.delete(self._at(RUNS, f"run={r}"), True)

    @property
    def runs(self) -> list[str]:
        return self._manifest()["runs"]

    def append(self, log: DataFrame) -> None:
        """One more sorted run from a slice of the feed."""
        name, manifest = self._write(newest(changes(log, self.with_value), "key")), self._manifest()
        run = f"{name}-0"
        if self._fs.exists(self._at(RUNS, f"run={run}")):  # a slice that changes nothing leaves no run
            self._save(manifest, [*manifest["runs"], run])
        if len(self.runs) > self.fanout:
            self.compact()

    def append_slices(self, log: DataFrame, slices: int) -> None:
        """A backlog as ``slices`` runs in one job and one shuffle by key: arrival order (``seq``) is cut into equal ranges,
        and a key's newest change of every range is found side by side."""
        feed = changes(log, self.with_value)
        low, high = feed.agg(F.min("seq"), F.max("seq")).first()
        if low is None:
            return self.append(log)
        width = (high - low) // slices + 1
        run = F.coalesce(F.expr(f"(seq - {low}) div {width}"), F.lit(0)).cast("int")
        rest = [c for c in feed.columns if c != "key"]
        change = F.struct(*rest)
        best = feed.withColumn("run", run).groupBy("key").agg(*(F.max(F.when(F.col("run") == k, change)).alias(f"run{k}") for k in range(slices)))
        each = F.array(*(F.struct(F.lit(k).alias("run"), F.col(f"run{k}").alias("c")) for k in range(slices)))
        cut = best.select("key", F.explode(F.filter(each, lambda x: x["c"].isNotNull())).alias("x")).select("key", *(f"x.c.{c}" for c in rest), "x.run")
        name, manifest = self._write(cut), self._manifest()
        there = [r for r in (f"{name}-{k}" for k in range(slices)) if self._fs.exists(self._at(RUNS, f"run={r}"))]
        self._save(manifest, [*manifest["runs"], *there])
        if len(self.runs) > self.fanout:
            self.compact()

    @contextmanager
    def _files(self) -> Iterator[str]:
        """The folder of all runs as a bucketed table, while it is named in a statement; its entry in the catalogue goes at
        once, its files stay. Which runs there are is read from the folder, not from the catalogue."""
        at, place, conf = f"cairn_{uuid.uuid4().hex}", os.path.join(self.path, RUNS).replace("'", "\\'"), self.spark.conf
        kept = conf.get(_TRACKED)
        conf.set(_TRACKED, "false")
        try:
            self.spark.sql(f"CREATE TABLE {at} ({self.fields}, run string) USING parquet PARTITIONED BY (run) CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{place}'")
            yield at
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {at}")
            conf.set(_TRACKED, kept)

    def _write(self, rows: DataFrame) -> str:
        """``rows`` as one run or, with a number ``run``, several, of files sorted by key, one for each bucket of the key's
        hash. The new name they begin with: names are never used twice, so nothing that a failed attempt left is in the way
        of the next."""
        name, fields = uuid.uuid4().hex, [f.name for f in self.schema]
        run = F.concat(F.lit(f"{name}-"), F.col("run").cast("string")) if "run" in rows.columns else F.lit(f"{name}-0")
        with self._files() as at:
            rows.select(*fields, run.alias("run")).write.insertInto(at)
        return name

    def merged(self) -> DataFrame:
        """Newest change of every key over all runs, tombstones included.

        All runs are cut into the same buckets, so equal buckets are read by one task and nothing is shuffled. There they
        stand one after the other, each in the order of its keys; the sort finds and merges these ascending stretches (it is
        a natural merge sort), and the changes of a key then pass by together, of which the newest is kept.
        """
        runs = self.runs
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        with self._files() as at:
            rows = self.spark.table(at).where(F.col("run").isin(runs)).drop("run")
        return newest(rows, "key")

    def read(self) -> DataFrame:
        """Current state: one row per live key, with the change that gave it its value."""
        return self.merged().where(F.col("op") == PUT).drop("op")

    def get(self, key: str) -> DataFrame:
        """Point lookup: one bucket of every run is read, and the key filter reaches the scan of its sorted file."""
        return self.read().where(F.col("key") == key)

    def scan(self, prefix: str) -> DataFrame:
        return self.read().where(F.col("key").startswith(prefix)).orderBy("key")

    def compact(self, low_water: int | None = None) -> None:
        """All runs become one. Tombstones stay but for those before ``low_water`` (ns): the caller's word that no change of
        an earlier time comes any more, neither late nor again."""
        if not self.runs:
            return
        rows = self.merged()
        if low_water is not None:
            rows = rows.where((F.col("op") == PUT) | (F.col("ts") >= F.lit(low_water)))
        name = self._write(rows)
        run = f"{name}-0"
        self._save(self._manifest(), [run] if self._fs.exists(self._at(RUNS, f"run={run}")) else [])

    def vacuum(self) -> list[str]:
        """Delete what killed writes left behind: folders and files that the manifest does not name. For the one writer of the
        store, between its writes."""
        manifest = self._manifest()
        named = {f"run={r}" for r in (*manifest["runs"], *manifest["retired"])}
        name_of = lambda pattern: [str(f.getPath().getName()) for f in self._fs.globStatus(self._at(*pattern)) or []]
        left = [(RUNS, n) for n in name_of((RUNS, "run=*")) if n not in named] + [(n,) for n in name_of(("_manifest-*",))]
        for at in left:
            self._fs.delete(self._at(*at), True)
        return sorted(at[-1] for at in left)


def apply_changes(log: DataFrame, slices: int = 4, with_value: bool = False, fanout: int = 8) -> DataFrame:
    """State of the table after the whole feed, rebuilt through a ``ChangeStore`` in the shared folder."""
    store = ChangeStore(log.sparkSession, scratch_path(log.sparkSession, "changes"), fanout, with_value=with_value)
    store.append_slices(log, slices)
    return store.read()
