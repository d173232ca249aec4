"""Hybrid search: build all models of a collection once, store them as tables, answer queries from them."""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import pre_tokens
from cairn.functions.vectors import gaussian_planes, quantize
from cairn.operators import ann, embed, fusion, lexical, ranker, subwords, summarize
from cairn.session import file_system, materialize

RESULT = ["doc_id", "title", "path", "snippet", "score", "bm25_score", "embed_score", "rank", "x", "y"]


@dataclass
class Engine:
    """Models over one collection; every table carries the same ``version``, so models of two builds never mix."""

    spark: SparkSession
    documents: DataFrame  # doc_id, title, path, content
    merges: subwords.Merges
    index: lexical.LexicalIndex
    vectors: DataFrame  # token, vec
    buckets: ann.BucketIndex
    weights: dict | None
    version: str

    @classmethod
    def build(cls, documents: DataFrame, config: embed.Config | None = None, merges: subwords.Merges | None = None, train_ranker: bool = True) -> Engine:
        """All models from (doc_id, title, path, content): subword tokens, lexical index, token and document vectors,
        bucket index, ranker."""
        spark = documents.sparkSession
        merges = merges if merges is not None else subwords.read_merges()
        docs = materialize(documents.where(F.col("content").isNotNull()).select("doc_id", "title", "path", "content"), "documents")
        tokens = materialize(subwords.encode(lexical.tokenized(docs, text_col="content"), merges), "tokens")
        vectors = materialize(embed.token_vectors(tokens, config), "token-vectors")
        quantised = embed.document_vectors(tokens, vectors).select("doc_id", quantize(F.col("vec")).alias("q"))
        dims = vectors.select(F.size("vec")).first()
        planes = gaussian_planes(128, dims[0] if dims else 1)
        weights = ranker.trained(spark)[0] if train_ranker else None
        return cls(spark, docs, merges, lexical.LexicalIndex.build(tokens), vectors, ann.BucketIndex(quantised, planes), weights, str(int(time.time() * 1000)))

    def encode(self, query: str) -> list[str]:
        """Tokens of a query: subwords, or whole words where the store has no merge rules."""
        row = self.spark.range(1).select(pre_tokens(F.lit(query)).alias("t")).first()
        if not self.merges:
            return row["t"]
        ranks = subwords.rank_of(self.merges)
        return [t for w in row["t"] for t in subwords.encode_word(w, ranks)]

    def query_vector(self, tokens: list[str]) -> list[int]:
        """INT8 vector of a query; zeros if no token is known."""
        known = {r["token"]: r["vec"] for r in self.vectors.where(F.col("token").isin(sorted(set(tokens)))).collect()} if tokens else {}
        s = np.sum([known[t] for t in tokens if t in known] or [np.zeros(self.buckets.planes.shape[1])], axis=0)
        n = np.linalg.norm(s)
        x = np.clip(s / n if n >= 1e-10 else s, -1, 1) * 127
        return (np.sign(x) * np.floor(np.abs(x) + 0.5)).astype(int).tolist()

    def search(self, query: str, k: int = 10, mode: str = "mlp") -> DataFrame:
        """The ``k`` best documents with both scores, snippet and plot point. Each ranker is asked for 2k; the limit stands
        before documents are read and snippets made. A query without a known token still returns documents, by id."""
        tokens = self.encode(query)
        words = lexical.top(self.index.scores(tokens), 2 * k)
        vector = self.spark.createDataFrame([(0, self.query_vector(tokens))], "query_id int, q array<tinyint>")
        near = self.buckets.query(vector, 2 * k).select("doc_id", "score", "rank")
        fused = fusion.mlp(words, near, self.weights, k) if mode == "mlp" and self.weights else fusion.rrf(words, near, k)
        fused = self.spark.createDataFrame(fused.collect(), fused.schema)  # k rows; a search writes nothing
        winners = hydrated(fused, self.documents)
        shown = summarize.snippet_strings(winners.select("doc_id", "content"), text_col="content")
        point = self.points().join(F.broadcast(fused.select("doc_id")), "doc_id")
        return winners.join(shown, "doc_id").join(point, "doc_id", "left").select(*RESULT)

    def query_point(self, query: str) -> tuple[float, float]:
        """The plot point of a query: the first two components of its vector."""
        q = [*self.query_vector(self.encode(query)), 0, 0]
        return q[0] / 127.0, q[1] / 127.0

    def points(self) -> DataFrame:
        """(doc_id, x, y): the first two components of every document vector."""
        return self.buckets.rows.select("doc_id", (F.get("q", F.lit(0)) / F.lit(127.0)).alias("x"), (F.get("q", F.lit(1)) / F.lit(127.0)).alias("y"))

    def stats(self) -> DataFrame:
        """One row of counters."""
        return self.documents.agg(F.count("*").alias("documents")).select("documents", F.lit(self.buckets.size()).alias("vectors"), F.lit(self.vectors.count()).alias("token_vectors"), F.lit(len(subwords.vocabulary(self.merges))).alias("vocabulary"))

    def save(self, path: str) -> None:
        """All tables below a new folder. The pointer that names it appears last, by a rename, and older pointers go after that,
        so a reader finds the old store or the new one at any time."""
        at = os.path.join(path, f"v{self.version}")
        tables = {"documents": self.documents, "postings": self.index.postings, "lengths": self.index.lengths, "vectors": self.vectors, "buckets": self.buckets.rows.drop("sig", "sig_high", "bucket"), "merges": subwords.merges_table(self.spark, self.merges)}
        if self.weights:
            tables["ranker"] = ranker.weights_table(self.spark, self.weights)
        for name, t in tables.items():
            t.write.mode("overwrite").parquet(os.path.join(at, name))
        planes = [(i, p.tolist()) for i, p in enumerate(self.buckets.planes)]
        self.spark.createDataFrame(planes, "i int, plane array<double>").write.mode("overwrite").parquet(os.path.join(at, "planes"))
        fs, name = file_system(self.spark, path)
        new, pointer = name(os.path.join(path, f"_pointer-{uuid.uuid4().hex}")), name(os.path.join(path, f"CURRENT-{int(self.version):020d}.json"))
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps({"version": self.version}).encode()))
        stream.close()
        if not fs.rename(new, pointer) and not fs.exists(pointer):
            raise RuntimeError(f"could not write to {path}")
        for f in fs.globStatus(name(os.path.join(path, "CURRENT-*.json"))):
            if str(f.getPath().getName()) < str(pointer.getName()):
                fs.delete(f.getPath(), False)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Engine:
        fs, name = file_system(spark, path)
        pointers = sorted(str(f.getPath().getName()) for f in fs.globStatus(name(os.path.join(path, "CURRENT-*.json"))) or [])
        if not pointers:
            raise FileNotFoundError(f"no store in {path}")
        version = str(int(pointers[-1][8:-5]))
        read = lambda n: spark.read.parquet(os.path.join(path, f"v{version}", n))
        merges = [(r["left"], r["right"]) for r in read("merges").orderBy("rank").collect()]
        planes = np.array([r["plane"] for r in read("planes").orderBy("i").collect()])
        # a store without a ranker fuses by reciprocal rank
        weights = read("ranker").first().asDict() if fs.exists(name(os.path.join(path, f"v{version}", "ranker"))) else None
        return cls(spark, read("documents"), merges, lexical.LexicalIndex(read("postings"), read("lengths")), read("vectors"), ann.BucketIndex(read("buckets"), planes), weights, version)


def hydrated(fused: DataFrame, documents: DataFrame) -> DataFrame:
    """The documents of ``fused``, at most k rows; what is no longer in the collection is left out."""
    return documents.join(F.broadcast(fused), "doc_id")


def as_json(results: DataFrame, query: str, latency_ms: int) -> DataFrame:
    """The result of a query as one JSON value: query, results, count, latency_ms. ``results`` are the k winners."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("rank").alias("rank"), F.struct(*RESULT).alias("r"))))
    return results.agg(rows.alias("a")).select(F.to_json(F.struct(F.lit(query).alias("query"), F.col("a.r").alias("results"), F.size("a").alias("count"), F.lit(latency_ms).alias("latency_ms"))).alias("value"))
