"""Session defaults and durable intermediate tables.

Intermediate results that several jobs read are written as Parquet below the shared folder named by
``spark.checkpoint.dir``; that cuts lineage like ``checkpoint()`` and survives the loss of an executor. The folder is
read from the session and only set here where it is unset (local runs and tests).
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def build_session(name: str = "cairn", cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested under; on a cluster the caller brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A machine-local folder is used only by a local master without the setting."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="cairn-")
        spark.sparkContext.setCheckpointDir(_LOCAL_DIRS[app])
        atexit.register(_remove, _LOCAL_DIRS[app])
    return _LOCAL_DIRS[app]


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder; ``release`` deletes it."""
    path = os.path.join(shared_dir(spark), f"cairn-{label}-{uuid.uuid4().hex}")
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete all intermediate tables of this application; results that were not written or collected yet need them."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        fs, at = file_system(spark, p)
        fs.delete(at(p), True)
    return len(paths)


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """(file system of ``path``, maker of its path objects)."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return bool(fs.exists(at(path)))


def spread(df: DataFrame, below: int = 16 << 20) -> DataFrame:
    """``df`` over all cores if the optimiser takes it for smaller than ``below`` bytes; unchanged otherwise.

    A file of a few megabytes is one task, however much work its rows are; larger inputs come in enough tasks by themselves
    and are never shuffled for this.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism)) if size < below else df


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the intermediate tables that were written within it. What is read from them must be written or
    collected by then."""
    app = spark.sparkContext.applicationId
    kept = _WRITTEN.pop(app, [])
    try:
        yield
    finally:
        release(spark)
        _WRITTEN.setdefault(app, [])[:0] = kept


def tidy(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``query`` (spark, ...) such that only those of its intermediate tables stay that its result still reads; the others are
    deleted before it returns. ``release`` deletes the rest when the results are written or collected."""

    @wraps(query)
    def run(spark: SparkSession, *rest, **how) -> DataFrame:  # noqa: ANN002, ANN003
        app = spark.sparkContext.applicationId
        before = _WRITTEN.pop(app, [])
        try:
            result = query(spark, *rest, **how)
            read = {unquote(f).removeprefix("file://") for f in result.inputFiles()}
            mine = _WRITTEN.get(app, [])
            needed = [p for p in mine if any(f.startswith(p.removeprefix("file://") + "/") for f in read)]
            for p in set(mine) - set(needed):
                fs, at = file_system(spark, p)
                fs.delete(at(p), True)
            _WRITTEN[app] = needed
            return result
        finally:
            _WRITTEN[app] = [*before, *_WRITTEN.get(app, [])]

    return run


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs start from the files, not from the lineage."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
