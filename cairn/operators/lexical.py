"""Lexical index and BM25 ranking."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import pre_tokens
from cairn.session import materialize, spread

K1, B = 1.5, 0.75


def tokenized(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens) of the documents with a text."""
    texts = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return spread(texts).select("doc_id", pre_tokens(F.col("text")).alias("tokens"))


def term_frequencies(tokens: DataFrame) -> DataFrame:
    """(token, doc_id, tf)."""
    return tokens.select("doc_id", F.explode("tokens").alias("token")).groupBy("token", "doc_id").agg(F.count("*").alias("tf"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    """(token, df)."""
    return postings.groupBy("token").agg(F.count("*").alias("df"))


def document_lengths(tokens: DataFrame) -> DataFrame:
    """(doc_id, dl)."""
    return tokens.select("doc_id", F.size("tokens").cast("bigint").alias("dl"))


def idf(n: Column | float, df: Column) -> Column:
    """ln(N - df + 0.5) - ln(df + 0.5), never below 0: a token in half of the documents or more counts nothing."""
    n = F.lit(n) if not isinstance(n, Column) else n
    return F.greatest(F.lit(0.0), F.log(n - df + 0.5) - F.log(df + 0.5))


def part(tf: Column, dl: Column, avgdl: Column | float, k1: float = K1, b: float = B) -> Column:
    avgdl = F.lit(float(avgdl)) if not isinstance(avgdl, Column) else avgdl
    return tf * (k1 + 1) / (tf + k1 * (F.lit(1 - b) + b * dl / avgdl))


def scan_scores(tokens: DataFrame, query: list[str]) -> DataFrame:
    """(doc_id, score) of all documents with a positive score, by one pass over the texts and no index.

    Only the counts of the query's tokens leave the scan; tokens that stand in the query twice count twice.
    """
    terms = sorted(Counter(query).items())
    if not terms:
        return tokens.select("doc_id", F.lit(0.0).alias("score")).where("false")
    count = lambda word: F.size(F.filter("tokens", lambda t: t == word))
    tf = F.array(*(count(F.lit(q)) for q, _ in terms))
    return _scored(materialize(tokens.select("doc_id", F.size("tokens").alias("dl"), tf.alias("tf")), "query-terms"), terms)


def _scored(counted: DataFrame, terms: list[tuple[str, int]]) -> DataFrame:
    sums = [F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms)))]
    s = counted.agg(*sums).first()
    score = F.lit(0.0)
    for i, (_, times) in enumerate(terms):
        tf = F.col("tf")[i]
        score = score + F.when(tf > 0, times * idf(float(s["n"]), F.lit(float(s[f"df{i}"]))) * part(tf, F.col("dl"), s["avgdl"] or 1.0)).otherwise(F.lit(0.0))
    return counted.select("doc_id", score.alias("score")).where("score > 0")


def top(scores: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The ``k`` best (doc_id, score, rank): rounded score, then id; a heap per task, not a full sort."""
    from pyspark.sql import Window

    best = scores.withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), "doc_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("bigint"))


class LexicalIndex:
    """Written tables ``postings`` (sorted by token, so row groups can be skipped), ``lengths`` and two totals."""

    def __init__(self, postings: DataFrame, lengths: DataFrame):
        self.postings, self.lengths = postings, lengths
        self.n, self.avgdl = lengths.agg(F.count("*"), F.avg("dl")).first()

    @classmethod
    def build(cls, tokens: DataFrame) -> LexicalIndex:
        postings = term_frequencies(tokens).repartitionByRange("token", "doc_id").sortWithinPartitions("token", "doc_id")
        return cls(materialize(postings, "index"), materialize(document_lengths(tokens), "lengths"))

    def scores(self, query: list[str]) -> DataFrame:
        """(doc_id, score) from the postings of the query's tokens only."""
        spark = self.postings.sparkSession
        terms = sorted(Counter(query).items())
        if not terms:
            return self.lengths.select("doc_id", F.lit(0.0).alias("score")).where("false")
        hit = self.postings.where(F.col("token").isin([t for t, _ in terms]))
        df = hit.groupBy("token").agg(F.count("*").alias("df"))
        times = spark.createDataFrame(terms, "token string, times int")
        weights = df.join(F.broadcast(times), "token").select("token", (F.col("times") * idf(float(self.n), F.col("df"))).alias("w"))
        scored = hit.join(F.broadcast(weights), "token").join(self.lengths, "doc_id")  # one row per token of the query
        return scored.groupBy("doc_id").agg(F.sum(F.col("w") * part(F.col("tf"), F.col("dl"), self.avgdl or 1.0)).alias("score")).where("score > 0")
