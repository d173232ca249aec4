"""Approximate search of quantised vectors by SimHash buckets, with exact search beside it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.vectors import cosine_int8, with_signatures
from cairn.session import materialize


#: Rows of a bucket that meet a query in one task; blocks of queries that one pass over the rows answers.
PART, BLOCKS = 8192, 16


class BucketIndex:
    """(doc_id, q, sig, sig_high, bucket), a written table, and the number of rows per bucket."""

    def __init__(self, vectors: DataFrame, planes: np.ndarray, prefix_bits: int = 8):
        self.planes, self.bits = planes, prefix_bits
        self.rows = materialize(with_signatures(vectors.select("doc_id", "q"), "q", planes, prefix_bits).repartition("bucket"), "buckets")

    def histogram(self) -> DataFrame:
        """(bucket, n): at most 2 ** prefix_bits rows."""
        return self.rows.groupBy("bucket").agg(F.count("*").alias("n"))

    def size(self) -> int:
        return self.rows.count()

    def query(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, doc_id, score, rank) for rows (query_id, q).

        A query reads its own bucket; with fewer than 2k rows there, also the buckets one bit away; with fewer than k rows
        then, all. The choice is made from the histogram before any vector is read, and the probed buckets are joined by
        equality, in parts of about ``PART`` rows, so a bucket that holds a third of all vectors is many tasks; each keeps its
        ``k`` best before they are shuffled. There is no score threshold.
        """
        sizes = {r["bucket"]: r["n"] for r in self.histogram().collect()}
        asked = with_signatures(queries.select("query_id", "q"), "q", self.planes, self.bits).select("query_id", F.col("q").alias("qq"), F.col("bucket").alias("own"))
        n = F.create_map(*(F.lit(x) for b in sorted(sizes) for x in (b, sizes[b]))) if sizes else F.create_map().cast("map<int,bigint>")
        near = F.transform(F.sequence(F.lit(0), F.lit(self.bits - 1)), lambda i: F.col("own").bitwiseXOR(F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2), i).cast("int")))
        with_near = F.concat(F.array("own"), near)
        total = lambda bs: F.aggregate(bs, F.lit(0).cast("bigint"), lambda s, b: s + F.coalesce(F.try_element_at(n, b), F.lit(0)))
        every = F.array(*(F.lit(b) for b in sorted(sizes))) if sizes else F.array().cast("array<int>")
        first = F.when(total(F.array("own")) >= 2 * k, F.array("own")).otherwise(with_near)
        probed = asked.withColumn("first", first).withColumn("probe", F.when(total(F.col("first")) >= k, F.col("first")).otherwise(every))
        parts = F.create_map(*(F.lit(x) for b in sorted(sizes) for x in (b, -(-sizes[b] // PART)))) if sizes else F.create_map().cast("map<int,int>")
        last = F.coalesce(F.try_element_at(parts, F.col("bucket")), F.lit(1)) - 1
        there = self.rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), last + 1).cast("int"))
        wanted = probed.select("query_id", "qq", F.explode("probe").alias("bucket")).withColumn("part", F.explode(F.sequence(F.lit(0), last)))
        pairs = wanted.join(there, ["bucket", "part"])
        scored = pairs.select("query_id", "doc_id", F.round(cosine_int8(F.col("qq"), F.col("q")), 6).alias("score"))
        return best(scored, k)


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, ties by id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of every query with every row; 0 where a vector is (nearly) zero."""
    q, x = q.astype(np.float64), x.astype(np.float64)
    nq, nx = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    n = nq[:, None] * nx[None, :]
    return np.divide(q @ x.T, n, out=np.zeros((len(q), len(x))), where=n >= 1e-20)


def agreements(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Minus the number of differing bits of 64-bit signatures (one per row)."""
    return -np.bitwise_count(q.astype(np.int64).view(np.uint64) ^ x.astype(np.int64).view(np.uint64)[:, 0][None, :]).astype(np.float64)


def exact(vectors: DataFrame, queries: DataFrame, k: int, score: Callable = cosines, block: int = 1024) -> DataFrame:
    """Exact search: a stated set of queries (query_id, q) against all rows (doc_id, q) of the same length.

    Queries travel to the rows in blocks of bounded size, ``BLOCKS`` of them for each pass over the rows; each task keeps only
    its best ``k`` per query, and these alone are shuffled. Rows and queries without a vector, or with a null in it, take no part.
    """
    kinds = dict(vectors.dtypes)["doc_id"], dict(queries.dtypes)["query_id"]
    schema = f"query_id {kinds[1]}, doc_id {kinds[0]}, score double"
    array = lambda c: F.array(c) if not dict(queries.dtypes)["q"].startswith("array") else F.col(c)
    good = F.col("q").isNotNull() & (F.size("q") > 0) & F.forall("q", lambda x: x.isNotNull())
    asked = queries.where("q IS NOT NULL").select("query_id", array("q").alias("q")).where(good)
    rows = vectors.where("q IS NOT NULL").select("doc_id", array("q").alias("q")).where(good)
    found = None
    for part in _blocks(asked, block * BLOCKS):
        blocks = [(np.stack(p["q"].to_numpy()), p["query_id"].to_numpy()) for p in (part.iloc[i : i + block] for i in range(0, len(part), block))]

        def search(batches: Iterator[pd.DataFrame], blocks: list = blocks) -> Iterator[pd.DataFrame]:
            held: list = [None] * len(blocks)
            for pdf in batches:
                pdf = pdf[pdf["q"].map(len) == blocks[0][0].shape[1]]
                for at in range(0, len(pdf), 2048):
                    x = pdf.iloc[at : at + 2048]
                    rows, doc = np.stack(x["q"].to_numpy()), x["doc_id"].to_numpy()
                    order = np.argsort(doc, kind="stable")
                    for b, (m, _) in enumerate(blocks):
                        s = np.round(score(m, rows), 6) + 0.0
                        top = order[np.argsort(-s[:, order], axis=1, kind="stable")[:, :k]]
                        held[b] = _better(held[b], (np.take_along_axis(s, top, axis=1), doc[top]), k)
            for (_, ids), best_of in zip(blocks, held):
                if best_of is not None:
                    yield pd.DataFrame({"query_id": np.repeat(ids, best_of[0].shape[1]), "doc_id": best_of[1].ravel(), "score": best_of[0].ravel()})

        one = rows.mapInPandas(search, schema)
        found = one if found is None else found.unionByName(one)
    return best(found if found is not None else vectors.sparkSession.createDataFrame([], schema), k)


def _better(a: tuple | None, b: tuple, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best per row of two lists (scores, ids), by score, then id."""
    if a is None:
        return b
    s, d = np.concatenate([a[0], b[0]], axis=1), np.concatenate([a[1], b[1]], axis=1)
    by_id = np.argsort(d, axis=1, kind="stable")
    s, d = np.take_along_axis(s, by_id, axis=1), np.take_along_axis(d, by_id, axis=1)
    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(s, top, axis=1), np.take_along_axis(d, top, axis=1)


def _blocks(asked: DataFrame, block: int) -> Iterator[pd.DataFrame]:
    """The stated queries, ``block`` at a time."""
    held: list = []
    for r in asked.toLocalIterator():
        held.append((r["query_id"], r["q"]))
        if len(held) == block:
            yield pd.DataFrame(held, columns=["query_id", "q"])
            held = []
    if held:
        yield pd.DataFrame(held, columns=["query_id", "q"])


def recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, recall): part of the exact neighbours that were found."""
    hit = wanted.select("query_id", "doc_id").join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return hit.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))
