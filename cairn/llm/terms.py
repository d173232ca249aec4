"""How distinctive each term is of its record (problem 1).

Probabilistic relevance weighting: ``idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))`` with
``idf = ln(1 + (N - df + 0.5) / (df + 0.5))``, where N, df, dl and avgdl are counted over all records.

Defined results: rows with a null term, a null record or a count that is null or below 1 have no part; repeated rows count
once, and of several counts for one term of one record the largest holds; postings of records that are not in the
collection have no part; equal weights are ordered by term in byte order; an empty collection gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.ordering import join_counted
from cairn.session import materialize

K1, B = 1.5, 0.75


def records(documents: DataFrame, doc_id: str = "doc_id", content: str = "content") -> DataFrame:
    """Distinct ids with content."""
    return documents.where(F.col(content).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id")).distinct()


def clean_postings(postings: DataFrame, of: DataFrame) -> DataFrame:
    """(token, doc_id, tf): one row per term and record of the collection ``of``."""
    valid = F.col("token").isNotNull() & F.col("doc_id").isNotNull() & (F.col("tf") >= 1)
    one = postings.where(valid).groupBy("doc_id", "token").agg(F.max("tf").cast("bigint").alias("tf"))
    return one.join(of.select("doc_id"), "doc_id", "left_semi").select("token", "doc_id", "tf")


def term_weights(postings: DataFrame, of: DataFrame, only: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, token, tf, df, idf, weight) for every term of every record; ``only`` (doc_id) restricts which records are
    scored, never what is counted."""
    p = materialize(clean_postings(postings, of), "postings")
    lengths = p.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    n, avgdl, total = of.count(), *p.groupBy("doc_id").agg(F.sum("tf").alias("dl"), F.count("*").alias("c")).agg(F.avg("dl"), F.sum("c")).first()
    df = p.groupBy("token").agg(F.count("*").alias("df"))
    scored = p.join(only.select("doc_id").distinct(), "doc_id", "left_semi") if only is not None else p
    joined = join_counted(scored.join(lengths, "doc_id"), df, "token", "df", total or 0)
    idf = F.log(F.lit(1.0) + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(float(avgdl or 1.0))))
    return joined.withColumn("idf", idf).withColumn("weight", F.col("idf") * part).select("doc_id", "token", "tf", "df", "idf", "weight")


def keywords(weights: DataFrame, min_uses: int = 3, min_records: int = 2) -> DataFrame:
    """(doc_id, token): the term of each record that sets it apart most among those used ``min_uses`` times in it and
    shared by ``min_records`` records: highest idf, then highest weight, then first in byte order."""
    fit = weights.where((F.col("tf") >= min_uses) & (F.col("df") >= min_records))
    best = F.min_by("token", F.struct(F.col("df"), -F.col("weight"), F.col("token")))
    return fit.groupBy("doc_id").agg(best.alias("token"))


def top_terms(weights: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, place, token, weight): the ``k`` terms of highest weight of each record."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "token")
    return weights.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("doc_id", "place", "token", "weight")
