"""Most similar vectors for every vector (problem 7): an inverted file with product-quantised residuals.

Training (driver, bounded): k-means on ``SAMPLE_PER_LIST`` vectors per coarse list, ``SAMPLE`` in all at most, gives the
centroids, k-means per sub-space on at most ``PQ_SAMPLE`` of their residuals the codebooks. There are as many lists as the root
of the number of vectors, however many that is; beyond ``TWO_LEVEL`` of them k-means is made in two levels. Indexing (every row): nearest centroid and residual
codes. Search: each query probes its nearest lists; within a list, codes are scored from the query's asymmetric distance
tables, and the best ``rerank`` are scored exactly by their cosine in double precision. How many lists are probed is measured,
not fixed: the fewest that hold a share ``FOUND`` of the exact neighbours of ``TRIALS`` vectors of the table, which are
compared with all its vectors. Vectors without clusters so get nearly all lists, clustered ones few, at any size.

The sample is the bound of the training alone; all vectors are indexed, and all are searched. Lists are cut into blocks of
about ``BLOCK`` rows and the queries of a list into blocks too, so neither a list that holds a third of all vectors nor one
that a third of the queries probe comes into one task.

Defined results: vectors that are null, of another length, with a null or non-finite component, or of zero norm take no part,
nor do rows with a null id (any finite length counts, however large or small); of several vectors of one id the first in array order holds; a vector is no neighbour of its own
id; equal similarities are ordered by id; fewer than k other vectors give fewer rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import materialize

SAMPLE_PER_LIST, SAMPLE, PQ_SAMPLE, BLOCK, QUERY_BLOCK = 48, 500_000, 8192, 8192, 4096
TRIALS, FOUND, TWO_LEVEL, SUB_SPACES = 512, 0.999, 2048, 16


@dataclass
class Model:
    """Coarse centroids (lists x dims) and residual codebooks: of each sub-space its first component and codes x components.
    Sub-spaces differ by one component at most, so no component of a vector is left out."""

    centroids: np.ndarray
    books: list[tuple[int, np.ndarray]]

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = np.concatenate([(v[i : i + 4096] @ self.centroids.T - 0.5 * (self.centroids**2).sum(1)).argmax(1) for i in range(0, len(v), 4096)])
        rest = v - self.centroids[lists]
        codes = np.empty((len(v), len(self.books)), dtype=np.uint8)
        for s, (at, b) in enumerate(self.books):
            x = rest[:, at : at + b.shape[1]]
            for i in range(0, len(v), 4096):
                codes[i : i + 4096, s] = (x[i : i + 4096] @ b.T - 0.5 * (b**2).sum(1)).argmax(1)
        return lists.astype(np.int32), codes


def _kmeans(x: np.ndarray, k: int, steps: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        if (n == 0).any():  # an empty cell restarts at a vector of the sample
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c**2).sum(1)
    step = max(1, 8_000_000 // len(c))
    return np.concatenate([(x[i : i + step] @ c.T - half).argmax(1) for i in range(0, len(x), step)])


def _coarse(x: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Centroids of the lists; of many lists first their root in groups, then each group's share within it."""
    if lists <= TWO_LEVEL:
        return _kmeans(x, lists, 8, seed)
    groups = _kmeans(x, int(lists**0.5), 8, seed)
    at = _nearest(x, groups)
    n = np.bincount(at, minlength=len(groups))
    share = np.maximum(n > 0, np.floor(n * lists / len(x))).astype(int)
    return np.concatenate([_kmeans(x[at == g], int(k), 8, seed + g) for g, k in enumerate(share) if k])


def train(sample: np.ndarray, lists: int, sub_spaces: int = SUB_SPACES, seed: int = 42) -> Model:
    centroids = _coarse(sample, lists, seed)
    x = sample[:PQ_SAMPLE]
    rest = x - centroids[_nearest(x, centroids)]
    parts = np.array_split(np.arange(sample.shape[1]), min(sub_spaces, sample.shape[1]))
    books = [(int(p[0]), _kmeans(rest[:, p], 256, 5, seed + s).astype(np.float32)) for s, p in enumerate(parts)]
    return Model(centroids.astype(np.float32), books)


def usable(vectors: DataFrame, id_col: str, vec_col: str, dims: int) -> DataFrame:
    """(id, vec array<double>): the vectors that take part, one per id."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    good = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), v.alias("vec")).where(good).groupBy("id").agg(F.min("vec").alias("vec"))


def _unit(col: pd.Series, dims: int) -> np.ndarray:
    v = np.stack(col.to_numpy()).astype(np.float64) if len(col) else np.zeros((0, dims))
    exponent = np.frexp(np.abs(v).max(axis=1, initial=0.0))[1]
    v = np.ldexp(v, -exponent[:, None])  # an exact scaling, so that no square is too large or too small
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class VectorIndex:
    """Index of one table of vectors. ``rows``: (list, block, id, vec, code), a written table."""

    def __init__(self, vectors: DataFrame, id_col: str, vec_col: str, dims: int = 64, nlists: int | None = None):
        self.dims = dims
        self.vectors = materialize(usable(vectors, id_col, vec_col, dims), "vectors")
        self.n = self.vectors.count()
        self.kind = dict(self.vectors.dtypes)["id"]
        self.rows = None
        if not self.n:
            return
        self.nlists = min(nlists or max(1, int(round(self.n**0.5))), self.n)
        size = min(self.n, max(self.nlists, min(SAMPLE, SAMPLE_PER_LIST * self.nlists)))
        # a bounded sample for training, chosen by hash of the id
        picked = self.vectors.orderBy(F.xxhash64("id"), "id").limit(size).toPandas()
        self.model = train(_unit(picked["vec"], dims), self.nlists)
        self.trials = picked[:TRIALS]
        self._probes: dict[int, int] = {}
        model = self.model

        def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    lists, codes = model.encode(_unit(pdf["vec"], dims).astype(np.float32))
                    yield pdf.assign(list=lists, code=[c.tobytes() for c in codes])

        coded = materialize(self.vectors.mapInPandas(encode, f"id {self.kind}, vec array<double>, list int, code binary"), "codes")
        self.sizes = {r["list"]: r["count"] for r in coded.groupBy("list").count().collect()}  # one row per list
        self.blocks = [-(-self.sizes.get(i, 0) // BLOCK) for i in range(len(model.centroids))]
        self.rows = coded.join(self._of_list(self.blocks), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")

    def _of_list(self, parts: list[int]) -> DataFrame:
        """(list, parts) of the lists with any part, to be broadcast: one row per list."""
        rows = [(i, int(n)) for i, n in enumerate(parts) if n]
        return F.broadcast(self.vectors.sparkSession.createDataFrame(rows, "list int, parts int"))

    def probes_for(self, k: int = 5) -> int:
        """The fewest nearest lists that hold ``FOUND`` of the exact ``k`` neighbours of the trial vectors. Each task keeps the
        ``k`` best of its batch for every trial, so TRIALS * k rows a batch are shuffled."""
        if k in self._probes:
            return self._probes[k]
        model, dims, at = self.model, self.dims, {x: t for t, x in enumerate(self.trials["id"])}
        q = _unit(self.trials["vec"], dims)

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                cos = q @ _unit(pdf["vec"], dims).T
                own = [(at[x], i) for i, x in enumerate(pdf["id"]) if x in at]
                if own:
                    cos[tuple(np.array(own).T)] = -np.inf
                take = min(k, len(pdf))
                top = np.argpartition(-cos, take - 1, axis=1)[:, :take]
                out = pd.DataFrame({"trial": np.repeat(np.arange(len(q)), take), "list": pdf["list"].to_numpy()[top].ravel(), "cos": np.take_along_axis(cos, top, axis=1).ravel()})
                yield out[np.isfinite(out["cos"])]

        near = self.rows.select("id", "vec", "list").mapInPandas(best, "trial int, list int, cos double")
        first = Window.partitionBy("trial").orderBy(F.desc("cos"), "list")
        held = near.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k).select("trial", "list").toPandas()  # at most TRIALS * k rows
        # the place of every list in each trial's order, counted over the lists that hold vectors as in the search
        lists_of = np.flatnonzero(self.blocks)
        place = np.full((len(q), len(self.blocks)), len(lists_of))
        order = np.argsort(-(q.astype(np.float32) @ model.centroids[lists_of].T), axis=1)
        np.put_along_axis(place, lists_of[order], np.arange(len(lists_of))[None, :].repeat(len(q), 0), axis=1)
        places = np.sort(place[held["trial"].to_numpy(), held["list"].to_numpy()])
        self._probes[k] = int(places[max(0, int(np.ceil(FOUND * len(places))) - 1)]) + 1 if len(places) else 1
        return self._probes[k]

    def search(self, queries: DataFrame, k: int = 5, nprobe: int | None = None, rerank: int = 48) -> DataFrame:
        """(id, neighbour, similarity): the ``k`` best of all indexed vectors for each row (id, vec) of ``queries``, from the
        ``nprobe`` nearest lists of each (None: as many as ``probes_for`` measures)."""
        spark = queries.sparkSession
        out = f"id {self.kind}, neighbour {self.kind}, similarity double"
        if self.rows is None:
            return spark.createDataFrame([], out)
        nprobe = nprobe or self.probes_for(k)
        model, dims, blocks, sizes = self.model, self.dims, np.array(self.blocks), self.sizes
        lists_of = np.flatnonzero(blocks)

        def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                q = _unit(pdf["vec"], dims).astype(np.float32)
                near = q @ model.centroids[lists_of].T
                take = min(nprobe, len(lists_of))
                order = np.argpartition(-near, take - 1, axis=1)[:, :take]
                who = np.repeat(np.arange(len(pdf)), take)
                yield pd.DataFrame({"qid": pdf["id"].to_numpy()[who], "qvec": pdf["vec"].to_numpy()[who], "list": lists_of[order].ravel().astype(np.int32)})

        wanted = materialize(queries.mapInPandas(probes, f"qid {self.kind}, qvec array<double>, list int"), "probes")
        asked = {r["list"]: -(-r["count"] // QUERY_BLOCK) for r in wanted.groupBy("list").count().collect()}
        if not asked:
            return spark.createDataFrame([], out)
        q_blocks = [asked.get(i, 0) for i in range(len(blocks))]
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        wanted = wanted.join(self._of_list(q_blocks), "list").withColumn("qb", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int")).drop("parts")
        wanted = wanted.join(self._of_list(self.blocks), "list").withColumn("block", every).drop("parts")
        there = self.rows.join(self._of_list(q_blocks), "list").withColumn("qb", every).drop("parts")

        def cell(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(x):
                return pd.DataFrame({"id": [], "neighbour": [], "similarity": []})
            exact_q, exact_x = _unit(q["qvec"], dims), _unit(x["vec"], dims)
            codes = np.frombuffer(b"".join(x["code"]), dtype=np.uint8).reshape(len(x), -1)
            ids, found = x["id"].to_numpy(), []
            for i in range(0, len(q), 256):
                part = exact_q[i : i + 256].astype(np.float32)
                score = np.zeros((len(part), len(x)), dtype=np.float32)
                for s, (at, book) in enumerate(model.books):  # the list's centroid adds the same to every code of the list
                    score += (part[:, at : at + book.shape[1]] @ book.T)[:, codes[:, s]]
                take = min(rerank, len(x))
                best = np.argpartition(-score, take - 1, axis=1)[:, :take]
                cos = np.einsum("qd,qrd->qr", exact_q[i : i + 256], exact_x[best])
                qid = q["qid"].to_numpy()[i : i + 256]
                cos[ids[best] == qid[:, None]] = -np.inf
                for row in range(len(part)):
                    top = sorted(zip(-np.round(cos[row], 12), ids[best[row]]))[: k]
                    found += [(qid[row], n, -c) for c, n in top if c < np.inf]
            return pd.DataFrame(found, columns=["id", "neighbour", "similarity"])

        cells = wanted.groupBy("list", "block", "qb").cogroup(there.groupBy("list", "block", "qb")).applyInPandas(cell, out)
        first = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
        return cells.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k).drop("rn")

    def neighbours_of_all(self, k: int = 5, **how: int) -> DataFrame:
        return self.search(self.vectors, k, **how) if self.rows is not None else self.search(self.vectors)


SMALL = 100_000


def exact_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Brute force over (id, vec) tables: the measure of recall, for small tables. At most ``SMALL`` vectors; of larger tables
    ``operators.ann.exact`` takes a stated set of queries block by block."""
    if vectors.limit(SMALL + 1).count() > SMALL:
        raise ValueError("exact_neighbours is for small tables")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    q, v = queries.select(F.col("id").alias("q"), F.col("vec").alias("qv")), vectors.select("id", "vec")
    cos = dot(F.col("qv"), F.col("vec")) / F.sqrt(dot(F.col("qv"), F.col("qv")) * dot(F.col("vec"), F.col("vec")))
    pairs = q.join(F.broadcast(v), q["q"] != v["id"]).select("q", "id", F.round(cos, 12).alias("similarity"))
    w = Window.partitionBy("q").orderBy(F.desc("similarity"), "id")
    return pairs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select(F.col("q").alias("id"), F.col("id").alias("neighbour"), "similarity")
