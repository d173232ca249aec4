"""Extractive snippets: sentence graph, PageRank, top sentences in reading order within a byte budget."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import bag_words, sentences
from cairn.session import spread

TOP, BUDGET, DAMPING, MAX_STEPS, TOLERANCE = 3, 500, 0.85, 50, 1e-6
DENSE = 256  # sentences of a text whose similarities are worked on as a matrix


def similarity_matrix(bags: list[list[str]]) -> np.ndarray:
    """Cosine of the word counts of every two sentences; 0 on the diagonal."""
    words = {w: i for i, w in enumerate(sorted({w for b in bags for w in b}))}
    m = np.zeros((len(bags), max(1, len(words))))
    for i, b in enumerate(bags):
        for w in b:
            m[i, words[w]] += 1
    n = np.linalg.norm(m, axis=1)
    m = m / np.where(n > 0, n, 1)[:, None]
    s = m @ m.T
    np.fill_diagonal(s, 0)
    return s


def pagerank(adjacency: np.ndarray, damping: float = DAMPING, steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Power iteration; a row without edges passes nothing on, so its rank is lost."""
    n = len(adjacency)
    out = adjacency.sum(axis=1)
    share = np.divide(adjacency, out[:, None], out=np.zeros_like(adjacency), where=out[:, None] >= 1e-10)
    rank = np.full(n, 1.0 / max(1, n))
    for _ in range(steps):
        following = (1 - damping) / n + damping * (rank @ share)
        done = np.linalg.norm(following - rank) < tolerance
        rank = following
        if done:
            break
    return rank


def ranks(bags: list[list[str]]) -> np.ndarray:
    """``pagerank`` of the similarity matrix. For long texts neither that matrix nor the table of words is made: with the words'
    normed counts N a step is N (N' x) without each sentence's part in itself, which takes time and room in proportion to the words."""
    if len(bags) <= DENSE:
        return pagerank(similarity_matrix(bags))
    words: dict[str, int] = {}
    cells = Counter((i, words.setdefault(w, len(words))) for i, b in enumerate(bags) for w in b)
    at = np.array(list(cells), dtype=np.int64).reshape(-1, 2)
    v, n = np.array(list(cells.values()), dtype=float), len(bags)
    norm = np.sqrt(np.bincount(at[:, 0], v * v, n))
    v = v / norm[at[:, 0]]
    own = (norm > 0).astype(float)  # similarity of a sentence with itself

    def spread_of(x: np.ndarray) -> np.ndarray:
        return np.bincount(at[:, 0], v * np.bincount(at[:, 1], v * x[at[:, 0]], len(words))[at[:, 1]], n) - own * x

    out = spread_of(np.ones(n))
    rank = np.full(n, 1.0 / n)
    for _ in range(MAX_STEPS):
        following = (1 - DAMPING) / n + DAMPING * spread_of(np.divide(rank, out, out=np.zeros(n), where=out >= 1e-10))
        done = np.linalg.norm(following - rank) < TOLERANCE
        rank = following
        if done:
            break
    return rank


def pick(parts: list[str], bags: list[list[str]]) -> list[tuple[int, float]]:
    """(position, score) of the sentences of the snippet. Up to three sentences are all taken, whatever their length."""
    if len(parts) <= TOP:
        return [(i, 1.0) for i in range(len(parts))]
    scores = np.round(ranks(bags), 12)
    chosen = sorted(sorted(range(len(parts)), key=lambda i: (-scores[i], i))[:TOP])
    out, size = [], 0
    for i in chosen:
        size += len(parts[i].encode())
        if out and size > BUDGET:
            break
        out.append((i, float(scores[i])))
    return out


def snippets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, sentence, score): the sentences of each document's snippet, in order.

    Sentences and bags are JVM expressions; only the small graph of one document at a time is worked on in Python. Apply it
    to the documents to show, after any limit.
    """
    parts = sentences(F.col(text_col))
    texts = spread(documents.where(F.col(text_col).isNotNull()).select(id_col, text_col))
    rows = texts.select(F.col(id_col).alias("doc_id"), parts.alias("parts"))
    rows = rows.select("doc_id", "parts", F.transform("parts", lambda s: F.array_join(bag_words(s), " ")).alias("bags"))
    kind = dict(rows.dtypes)["doc_id"]

    def summarize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(d, i, p[i], s) for d, p, b in zip(pdf["doc_id"], pdf["parts"], pdf["bags"]) for i, s in pick(list(p), [x.split() for x in b])]
            yield pd.DataFrame(out, columns=["doc_id", "pos", "sentence", "score"])

    return rows.mapInPandas(summarize, f"doc_id {kind}, pos int, sentence string, score double")


def snippet_strings(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = 500) -> DataFrame:
    """(doc_id, snippet): sentences joined by a space; the beginning of the text where it has no sentence."""
    joined = snippets(documents, id_col, text_col).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("s"))
    joined = joined.select("doc_id", F.array_join("s.sentence", " ").alias("snippet"))
    from cairn.functions.text import shorten

    base = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), shorten(F.col(text_col), chars).alias("head"))
    return base.join(joined, "doc_id", "left").select("doc_id", F.coalesce("snippet", "head").alias("snippet"))
