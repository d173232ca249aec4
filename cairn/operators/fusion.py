"""Fusion of two ranked lists into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60.0


def _outer(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """Full outer join of lists (doc_id, score, rank): a missing score counts 0, a missing rank stays null."""
    a = lexical.select("doc_id", F.col("score").alias("b"), F.col("rank").alias("rb"))
    s = semantic.select("doc_id", F.col("score").alias("e"), F.col("rank").alias("re"))
    part = lambda r: F.coalesce(F.lit(1.0) / (F.lit(RRF_K) + F.col(r)), F.lit(0.0))
    return a.join(s, "doc_id", "full_outer").select(
        "doc_id", F.coalesce("b", F.lit(0.0)).alias("bm25_score"), F.coalesce("e", F.lit(0.0)).alias("embed_score"), (part("rb") + part("re")).alias("rrf")
    )


def _ranked(rows: DataFrame, score: Column, k: int) -> DataFrame:
    best = rows.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "doc_id").limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("bigint")
    return best.withColumn("rank", rank).select("doc_id", "score", "bm25_score", "embed_score", "rank")


def rrf(lexical: DataFrame, semantic: DataFrame, k: int) -> DataFrame:
    """Reciprocal-rank fusion: the sum of 1 / (60 + rank) over the lists that have the document."""
    return _ranked(_outer(lexical, semantic), F.col("rrf"), k)


def mlp_forward(features: list[Column], weights: dict) -> Column:
    """A 3-4-1 network (rectified, then logistic) as one expression; the weights are literals of the plan."""
    hidden = []
    for j in range(len(weights["b1"])):
        x = F.lit(float(weights["b1"][j]))
        for i, f in enumerate(features):
            x = x + f * float(weights["w1"][i][j])
        hidden.append(F.greatest(F.lit(0.0), x))
    out = F.lit(float(weights["b2"][0]))
    for j, h in enumerate(hidden):
        out = out + h * float(weights["w2"][j][0])
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-out))


def mlp(lexical: DataFrame, semantic: DataFrame, weights: dict, k: int) -> DataFrame:
    """Fusion by the trained ranker over (lexical score, semantic score, reciprocal-rank score)."""
    return _ranked(_outer(lexical, semantic), mlp_forward([F.col("bm25_score"), F.col("embed_score"), F.col("rrf")], weights), k)
