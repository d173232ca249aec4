"""Token vectors from co-occurrence (PPMI, truncated SVD) and document vectors from token vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import materialize

#: Weights are sums of 1 / distance; kept as whole multiples of 1 / 60 they are exact for distances up to 5.
UNIT = 60
#: A matrix of more entries than this is multiplied in its files, by the tasks.
ON_DRIVER = 500_000
#: A model of more token vectors than this is never in one place: the basis is a table as well.
MODEL_ROWS = 200_000
#: Rows and columns of the blocks in which a matrix meets such a basis.
SIDE = 16_384
PAIRS_AT_ONCE = 500_000


@dataclass
class Config:
    dimensions: int = 100
    window: int = 5
    max_iterations: int = 50
    tolerance: float = 1e-6
    min_frequency: int = 2
    max_vocab: int = 10_000


def vocabulary(tokens: DataFrame, min_frequency: int = 2, max_vocab: int = 10_000) -> DataFrame:
    """(token, freq, i): tokens used at least ``min_frequency`` times, the ``max_vocab`` most used (0: all), numbered in
    byte order."""
    counts = tokens.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("freq")).where(F.col("freq") >= min_frequency)
    if max_vocab > 0:
        counts = counts.orderBy(F.desc("freq"), "token").limit(max_vocab)
        return counts.withColumn("i", (F.row_number().over(Window.orderBy("token")) - 1).cast("int"))  # at most max_vocab rows
    from cairn.operators.ordering import number_rows

    return number_rows(counts, ["token"], out="i").withColumn("i", F.col("i").cast("int"))


def cooccurrence(tokens: DataFrame, vocab: DataFrame, window: int = 5) -> DataFrame:
    """(w1, w2, weight): symmetric sums of 1 / distance over positions at most ``window`` apart, both tokens known.

    Positions are those of the whole text: unknown tokens are blanked but keep their place. Pairs are made inside the batch by
    shifted arrays and added up before the shuffle; there is no self-join. A vocabulary of up to ``MODEL_ROWS`` tokens travels
    with the tasks; a larger one is joined.
    """
    unit = UNIT if UNIT % max(1, window) == 0 and window <= 6 else int(np.lcm.reduce(range(1, window + 1)))
    known = vocab.select("token", "i")
    if bounded(known):
        rows = known.orderBy("i").collect()
        partial = tokens.select("tokens").mapInArrow(_pairs([r["token"] for r in rows], np.array([r["i"] for r in rows], dtype=np.int64), window, unit), "a int, b int, w bigint")
        return _both_ways(partial.groupBy("a", "b").agg(F.sum("w").alias("w")), unit)
    placed = tokens.select("doc_id", F.posexplode("tokens").alias("pos", "token")).join(known, "token")
    rows = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "i"))).alias("ts"))
    a = rows.select(F.posexplode("ts").alias("k", "x"), "ts")
    near = a.select("x", F.explode(F.slice("ts", F.col("k") + 2, window)).alias("y")).where(F.col("y.pos") - F.col("x.pos") <= window)
    weight = (F.lit(unit) / (F.col("y.pos") - F.col("x.pos"))).cast("bigint")
    one = near.groupBy(F.least("x.i", "y.i").alias("a"), F.greatest("x.i", "y.i").alias("b")).agg(F.sum(weight).alias("w"))
    return _both_ways(one, unit)


def _pairs(words: list[str], ids: np.ndarray, window: int, unit: int) -> Callable:
    """Sums of the weights of pairs (a <= b) in each stretch of about PAIRS_AT_ONCE tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = pa.array(words, pa.string()), int(ids.max(initial=0)) + 1
        for b in batches:
            col = b.column(0)
            ends, at = col.offsets.to_numpy(), 0
            while at < len(col):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + PAIRS_AT_ONCE, side="right")) - 1)
                part = col.slice(at, to - at)
                sizes, at = np.diff(ends[at : to + 1]), to
                where = pc.index_in(part.flatten().cast(pa.string()), value_set=known).fill_null(-1).to_numpy()
                i = np.where(where >= 0, ids[np.maximum(where, 0)], -1) if len(ids) else np.full(len(where), -1)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                keys, weights = [], []
                for d in range(1, window + 1):
                    x, y = i[:-d], i[d:]
                    both = np.flatnonzero((x >= 0) & (y >= 0) & (doc[:-d] == doc[d:]))
                    keys.append(np.minimum(x[both], y[both]) * n + np.maximum(x[both], y[both]))
                    weights.append(np.full(len(both), unit // d, dtype=np.int64))
                key = np.concatenate(keys)
                if len(key):
                    order = np.argsort(key, kind="stable")
                    key, w = key[order], np.concatenate(weights)[order]
                    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                    yield pa.RecordBatch.from_arrays([pa.array((key[start] // n).astype(np.int32)), pa.array((key[start] % n).astype(np.int32)), pa.array(np.add.reduceat(w, start))], names=["a", "b", "w"])

    return run


def _both_ways(one: DataFrame, unit: int) -> DataFrame:
    # a pair of one token with itself is met once and counts for both directions
    both = one.select(F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", (F.col("w") * 2).alias("w")))).otherwise(F.array(F.struct("a", "b", "w"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "w")))).alias("p"))
    return both.select(F.col("p.a").alias("w1"), F.col("p.b").alias("w2"), (F.col("p.w") / F.lit(float(unit))).alias("weight"))


def bounded(vocab: DataFrame, rows: int | None = None) -> bool:
    rows = MODEL_ROWS if rows is None else rows
    return vocab.limit(rows + 1).count() <= rows


def ppmi(cooc: DataFrame) -> DataFrame:
    """(i, j, v): log2(weight * total / (row sum * column sum)) where positive."""
    sums = materialize(cooc.groupBy("w1").agg(F.sum("weight").alias("s")), "sums")
    total = sums.agg(F.sum("s")).first()[0] or 0.0
    left, right = sums.toDF("w1", "rs"), sums.toDF("w2", "cs")
    v = F.log2(F.col("weight") * F.lit(total) / (F.col("rs") * F.col("cs") + 1e-10))
    return cooc.join(left, "w1").join(right, "w2").select(F.col("w1").alias("i"), F.col("w2").alias("j"), v.alias("v")).where("v > 0")


def _times(r: np.ndarray, c: np.ndarray, v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a sparse matrix that have entries, in order, and their products with ``x``. Entries are sorted by row."""
    rows, start = np.unique(r, return_index=True)
    ends, n = np.append(start[1:], len(r)), len(x)
    out = np.empty((len(rows), x.shape[1]))
    at = 0
    while at < len(rows):  # bounded memory: about four million products at a time
        to = max(at + 1, int(np.searchsorted(ends, start[at] + max(1, 4_000_000 // x.shape[1]), side="right")))
        own, count = slice(start[at], ends[to - 1]), ends[to - 1] - start[at]
        if count * 30 >= (to - at) * n:  # well filled rows are faster as a dense block
            cell = np.repeat(np.arange(to - at), ends[at:to] - start[at:to]) * n + c[own]
            out[at:to] = np.bincount(cell, v[own], (to - at) * n).reshape(to - at, n) @ x
        else:
            out[at:to] = np.add.reduceat(v[own, None] * x[c[own]], start[at:to] - start[at], axis=0)
        at = to
    return rows, out


def _power(times: Callable, back: Callable, n: int, k: int, steps: int, tolerance: float, seed: int) -> np.ndarray:
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, min(n, k + 8))))[0]
    past = None
    for _ in range(steps):
        y = back(times(q))
        q, r = np.linalg.qr(y)
        values = np.sqrt(np.abs(np.diag(r)))
        if past is not None and np.abs(values - past).max() <= tolerance * max(values.max(), 1e-12):
            break
        past = values
    small = times(q)
    _, s, vt = np.linalg.svd(small, full_matrices=False)
    basis = q @ vt.T
    keep = min(k, int((s > 1e-10 * max(s.max(initial=0), 1e-300)).sum()))
    basis = basis[:, :keep]
    return basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(keep)] < 0, -1, 1) if keep else basis


def truncated_svd(i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int, k: int, steps: int = 50, tolerance: float = 1e-6, seed: int = 42) -> np.ndarray:
    """Right singular vectors (n x k, unscaled, by falling singular value) of a sparse matrix by block power iteration.

    The numerical rank limits k. Signs are fixed: the component of largest size of each vector is positive.
    """

    def side(r: np.ndarray, c: np.ndarray) -> Callable:
        order = np.lexsort((c, r))
        r, c, w = r[order], c[order], v[order]

        def times(x: np.ndarray) -> np.ndarray:
            out = np.zeros((n, x.shape[1]))
            rows, y = _times(r, c, w, x)
            out[rows] = y
            return out

        return times

    return _power(side(i, j), side(j, i), n, k, steps, tolerance, seed)


def symmetric_svd(entries: DataFrame, n: int, k: int, steps: int = 50, tolerance: float = 1e-6, seed: int = 42) -> np.ndarray:
    """``truncated_svd`` of a symmetric matrix (i, j, v) that stays in its files: each product with the basis (n x k, on the
    driver) is a job over the entries."""
    stored = stored_matrix(entries)
    times = lambda x: product(stored, x)
    return _power(times, times, n, k, steps, tolerance, seed)


def stored_matrix(entries: DataFrame) -> DataFrame:
    """The entries (i, j, v) of a sparse matrix, written in the order of their rows."""
    return materialize(entries.repartition("i").sortWithinPartitions("i", "j"), "matrix")


def product(stored: DataFrame, x: np.ndarray) -> np.ndarray:
    """A stored n x n matrix times ``x`` (n x k, on the driver): one job over the entries, to which ``x`` travels."""
    spark = stored.sparkSession
    shared = spark.sparkContext.broadcast(x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                if not pdf["i"].is_monotonic_increasing:  # the end of one file and the start of another
                    pdf = pdf.sort_values("i", kind="stable")
                rows, y = _times(pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf["v"].to_numpy(), shared.value)
                yield pd.DataFrame({"i": rows, "y": [p.tobytes() for p in y]})

    got = stored.mapInPandas(run, "i int, y binary").toPandas()  # a row of the product may come in parts
    out = np.zeros(x.shape)
    if len(got):
        np.add.at(out, got["i"].to_numpy(), np.frombuffer(b"".join(got["y"])).reshape(-1, x.shape[1]))
    shared.destroy()
    return out


class _Table:
    """A dense matrix of ``width`` columns as a table (i, c0, c1, ...), for bases that are too long for one machine."""

    def __init__(self, rows: DataFrame, width: int):
        self.rows, self.width = rows, width
        self.cols = [f"c{k}" for k in range(width)]
        self.schema = "i int, " + ", ".join(f"{c} double" for c in self.cols)

    def times(self, m: np.ndarray) -> _Table:
        """The table times a small matrix."""
        out, cols = _Table(self.rows, m.shape[1]), self.cols
        to = out.cols

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                y = pd.DataFrame(pdf[cols].to_numpy() @ m, columns=to)
                y.insert(0, "i", pdf["i"].to_numpy())
                yield y

        return _Table(materialize(self.rows.mapInPandas(run, out.schema), "basis"), m.shape[1])

    def gram(self) -> np.ndarray:
        """Its transpose times itself: width x width sums."""
        cols = self.cols

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g = np.zeros((len(cols), len(cols)))
            for pdf in batches:
                x = pdf[cols].to_numpy()
                g += x.T @ x
            yield pd.DataFrame({"g": [g.ravel().tolist()]})

        parts = self.rows.mapInPandas(run, "g array<double>").select(F.posexplode("g").alias("at", "g")).groupBy("at").agg(F.sum("g").alias("g"))
        out = np.zeros(len(cols) ** 2)
        for r in parts.collect():
            out[r["at"]] = r["g"]
        return out.reshape(len(cols), -1)

    def orthonormal(self) -> tuple[_Table, np.ndarray]:
        """(an orthonormal basis of its columns, the triangular factor), by shifted Cholesky factors of its gram matrix."""
        q, r = self, np.eye(self.width)
        for step in range(3):
            g = q.gram()
            shift = 1e-13 * max(np.trace(g), 1e-300) if step == 0 else 1e-16 * np.trace(g)
            f = np.linalg.cholesky(g + shift * np.eye(len(g))).T
            q, r = q.times(np.linalg.inv(f)), f @ r
        return q, r


def _blocked(entries: DataFrame) -> DataFrame:
    side = F.lit(SIDE)
    at = lambda c: (F.col(c) / side).cast("int")
    return materialize(entries.select("i", "j", "v", at("i").alias("ib"), at("j").alias("jb")).repartition("ib", "jb"), "blocks")


def _multiply(blocked: DataFrame, x: _Table) -> _Table:
    """A matrix in blocks times a table: a block meets the stretch of the table that its columns ask for, so a task holds at
    most SIDE rows of it; the partial products of a row are added up."""
    cols = x.cols
    stretches = x.rows.withColumn("of", (F.col("i") / F.lit(SIDE)).cast("int"))
    there = blocked.select(F.col("ib").alias("to"), F.col("jb").alias("of")).distinct().join(stretches, "of").select("to", "of", "i", *cols)

    def cell(e: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(e):
            return pd.DataFrame({"i": [], **{c: [] for c in cols}})
        e = e.sort_values(["i", "j"], kind="stable")
        dense = np.zeros((SIDE, len(cols)))
        dense[q["i"].to_numpy() % SIDE] = q[cols].to_numpy()
        rows, y = _times(e["i"].to_numpy(), e["j"].to_numpy() % SIDE, e["v"].to_numpy(), dense)
        out = pd.DataFrame(y, columns=cols)
        out.insert(0, "i", rows)
        return out

    parts = blocked.groupBy("ib", "jb").cogroup(there.groupBy("to", "of")).applyInPandas(cell, x.schema)
    return _Table(materialize(parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in cols)), "product"), x.width)


def distributed_svd(entries: DataFrame, n: int, k: int, steps: int = 50, tolerance: float = 1e-6, seed: int = 42) -> tuple[DataFrame, int]:
    """((i, vec), number of components): what ``symmetric_svd`` gives, with the basis as a table all the way. Rows without
    entries, whose components are zero, are not there."""
    spark, width = entries.sparkSession, min(n, k + 8)
    blocked = _blocked(entries)
    start = [F.randn(seed + c).alias(f"c{c}") for c in range(width)]
    q, _ = _Table(materialize(spark.range(n).select(F.col("id").cast("int").alias("i"), *start), "start"), width).orthonormal()
    past = None
    for _ in range(steps):
        q, r = _multiply(blocked, _multiply(blocked, q)).orthonormal()
        values = np.sqrt(np.abs(np.diag(r)))
        if past is not None and np.abs(values - past).max() <= tolerance * max(values.max(), 1e-12):
            break
        past = values
    squares, turn = np.linalg.eigh(_multiply(blocked, q).gram())
    s = np.sqrt(np.maximum(squares[::-1], 0))
    keep = min(k, int((s > 1e-10 * max(s.max(initial=0), 1e-300)).sum()))
    basis = q.times(turn[:, ::-1][:, :keep])
    if not keep:
        return basis.rows.select("i", F.array().cast("array<double>").alias("vec")), 0
    largest = basis.rows.agg(*(F.max_by(c, F.struct(F.abs(F.col(c)), -F.col("i"))).alias(c) for c in basis.cols)).first()
    return basis.rows.select("i", F.array(*(F.col(c) * (-1.0 if largest[c] < 0 else 1.0) for c in basis.cols)).alias("vec")), keep


def token_vectors(tokens: DataFrame, config: Config | None = None) -> DataFrame:
    """(token, vec) of the ``max_vocab`` most used tokens (0: all). The matrix goes to the driver if it has at most
    ``ON_DRIVER`` entries and stays in its files otherwise; beyond ``MODEL_ROWS`` tokens the vectors are a table as well."""
    config = config or Config()
    spark = tokens.sparkSession
    vocab = materialize(vocabulary(tokens, config.min_frequency, config.max_vocab), "vocabulary")
    entries = materialize(ppmi(materialize(cooccurrence(tokens, vocab, config.window), "cooccurrence")), "ppmi")
    size = entries.count()
    if not bounded(vocab):
        n = vocab.count()
        basis, kept = distributed_svd(entries, n, min(config.dimensions, n), config.max_iterations, config.tolerance)
        return vocab.join(basis, "i", "left").select("token", F.coalesce("vec", F.array_repeat(F.lit(0.0), kept)).alias("vec"))
    words = [r["token"] for r in vocab.orderBy("i").collect()]
    if not words or not size:
        return spark.createDataFrame([], "token string, vec array<double>")
    how = (len(words), min(config.dimensions, len(words)), config.max_iterations, config.tolerance)
    if size <= ON_DRIVER:
        m = entries.toPandas()
        basis = truncated_svd(m["i"].to_numpy(), m["j"].to_numpy(), m["v"].to_numpy(), *how)
    else:
        basis = symmetric_svd(entries, *how)
    return spark.createDataFrame(pd.DataFrame({"token": words, "vec": basis.tolist()}), "token string, vec array<double>")


def document_vectors(tokens: DataFrame, vectors: DataFrame) -> DataFrame:
    """(doc_id, vec): unit vector of the sum of the token vectors; the zero vector if no token is known.

    Up to ``MODEL_ROWS`` token vectors travel with the tasks, and texts stay where they are. More of them meet the words of the
    texts by a join, in which words of many texts are joined by broadcast.
    """
    if not bounded(vectors):
        return _joined_vectors(tokens, vectors)
    model = vectors.toPandas()
    at = {t: k for k, t in enumerate(model["token"])}
    m = np.stack(model["vec"].to_numpy()).astype(np.float64) if len(model) else np.zeros((0, 0))
    kind = dict(tokens.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for ts in pdf["tokens"]:
                hit = [at[t] for t in ts if t in at]
                s = m[hit].sum(axis=0) if hit else np.zeros(m.shape[1])
                n = np.linalg.norm(s)
                out.append((s / n if n >= 1e-10 else s).tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "vec": out})

    return tokens.select("doc_id", "tokens").mapInPandas(run, f"doc_id {kind}, vec array<double>")


def _joined_vectors(tokens: DataFrame, vectors: DataFrame) -> DataFrame:
    from cairn.functions.vectors import normalize
    from cairn.operators.ordering import join_counted

    uses = materialize(tokens.select("doc_id", F.explode("tokens").alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n")), "uses")
    counts = uses.groupBy("token").agg(F.count("*").alias("texts"))
    dims = vectors.select(F.size("vec")).first()[0]
    weighed = join_counted(uses, counts.join(vectors, "token"), "token", "texts", uses.count())
    sums = weighed.groupBy("doc_id").agg(*(F.sum(F.col("n") * F.col("vec")[k]).alias(f"c{k}") for k in range(dims)))
    vec = F.array(*(F.coalesce(f"c{k}", F.lit(0.0)) for k in range(dims)))
    return tokens.select("doc_id").join(sums, "doc_id", "left").select("doc_id", normalize(vec).alias("vec"))
