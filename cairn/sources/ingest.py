"""Documents from files: recursive scan, guards, content ids and an ingest report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import extension_of, is_blank, title_of

# The file types that are read as text.
EXTENSIONS = [".txt", ".md", ".markdown", ".text", ".rst", ".log", ".csv", ".json", ".xml", ".html", ".htm", ".yaml", ".yml", ".toml", ".cfg", ".ini", ".conf", ".tex", ".org", ".wiki", ".adoc"]
MAX_BYTES = 50 * 1024 * 1024


def status_of(valid: Column, text: Column, size: Column) -> Column:
    """error (too large or not UTF-8), skipped (blank) or ok; duplicates are found against the store."""
    return F.when(size > MAX_BYTES, "error").when(~valid, "error").when(is_blank(text), "skipped").otherwise("ok")


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, path, title, content, size, status) of all supported files below ``root``.

    The size limit reaches the file listing; a file over it is reported without being read. Unreadable files are left out
    instead of failing the job; ``unread`` names them. Spark's file listing leaves out names that begin with a dot or an
    underscore.
    """
    return read_files(_listed(spark, root))


def _listed(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(root)


def unread(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, status = error) of the supported files that are listed, small enough, and could not be read."""
    files = _listed(spark, root).where(extension_of(F.col("path")).isin(EXTENSIONS) & (F.col("length") <= MAX_BYTES))
    got = files.where(F.col("content").isNotNull()).select("path")
    return files.select("path", F.col("length").alias("size"), F.lit("error").alias("status")).join(got, "path", "left_anti")


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, path, title, content, size, status) of files (path, length, content) of a supported type."""
    files = files.where(extension_of(F.col("path")).isin(EXTENSIONS))
    small = files.where(F.col("length") <= MAX_BYTES)
    # invalid bytes fail a plain cast under ANSI rules, so validity is asked of the bytes first
    valid = F.coalesce(F.is_valid_utf8(F.col("content").cast("string")), F.lit(False))
    text = F.when(valid, F.col("content").cast("string"))
    read = small.select(F.when(valid, F.sha2("content", 256)).alias("doc_id"), "path", title_of(F.col("path")).alias("title"), text.alias("content"), F.col("length").alias("size"), status_of(valid, text, F.col("length")).alias("status"))
    large = files.where(F.col("length") > MAX_BYTES).select(F.lit(None).cast("string").alias("doc_id"), "path", title_of(F.col("path")).alias("title"), F.lit(None).cast("string").alias("content"), F.col("length").alias("size"), F.lit("error").alias("status"))
    return read.unionByName(large)


def from_table(texts: DataFrame, text_col: str = "text", path_col: str = "path") -> DataFrame:
    """The same columns from a table of texts; a null text is an error."""
    t = F.col(text_col)
    size = F.octet_length(t).cast("bigint")
    return texts.select(F.sha2(t, 256).alias("doc_id"), F.col(path_col).alias("path"), title_of(F.col(path_col)).alias("title"), t.alias("content"), size.alias("size"), F.when(t.isNull(), "error").otherwise(status_of(F.lit(True), t, size)).alias("status"))


def against_known(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """Status ``duplicate`` for contents whose id is known already (column doc_id), and for repeats within the run but the
    first path."""
    ids = known.select("doc_id").distinct().withColumn("seen", F.lit(True))
    ok = scanned.where("status = 'ok'")
    first = ok.groupBy("doc_id").agg(F.min("path").alias("first_path"))
    joined = scanned.join(ids, "doc_id", "left").join(first, "doc_id", "left")
    repeated = F.col("seen").isNotNull() | (F.col("path") != F.col("first_path"))
    return joined.withColumn("status", F.when((F.col("status") == "ok") & F.coalesce(repeated, F.lit(False)), "duplicate").otherwise(F.col("status"))).drop("seen", "first_path")


def accepted(tagged: DataFrame) -> DataFrame:
    """The documents to store, each content once."""
    return tagged.where("status = 'ok'").drop("status").dropDuplicates(["doc_id"])


def report(tagged: DataFrame) -> DataFrame:
    """One row: files by outcome and bytes ingested."""
    n = lambda s: F.count_if(F.col("status") == s)
    return tagged.agg(F.count("*").alias("total"), n("ok").alias("ingested"), n("skipped").alias("skipped"), n("duplicate").alias("duplicates"), n("error").alias("errors"), F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("size"))), F.lit(0)).cast("bigint").alias("bytes"))
