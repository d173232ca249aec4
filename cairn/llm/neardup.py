"""Near-duplicate texts (problem 6): deletion-variant signatures.

A text is the set of its ``words_per_shingle`` consecutive words. Its signature is a row of min-hash symbols, cut into fewer
segments than an exact-match index would need: two texts at the threshold are expected to have, in at least one segment, at
most one differing symbol. Every segment is indexed once for each position with that position as a wildcard, so such
segments meet in an equality join; candidates are then verified by the exact Jaccard similarity of the sets.

Plain bits (as in a SimHash) are the special case of one-bit symbols. At a Jaccard similarity of 0.6 a fifth of those bits
differ and segments short enough for the pigeonhole guarantee would match almost any two texts; symbols of 32 bits keep
segments selective. Segment length and number follow from the threshold by ``plan``: the chance to miss a pair at exactly the
threshold is at most ``miss``, and falls steeply above it.

Texts with the same set form a class; only its first id enters the index, so a class of copies costs one row per copy. Groups
are the connected components of the links.

Defined results: a null text or one with fewer words than a shingle has no set and no partner; case and anything but letters
and digits are ignored; rows with a null id are left out; of several texts under one id the first in byte order holds; an
empty table gives no rows; texts of any length are used whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.ordering import join_counted
from cairn.session import materialize

WORDS, THRESHOLD = 5, 0.8
#: Texts of one index key that meet in one task; the blocks of keys with more are spread.
HOT = 1024


def shingles(text: Column, words: int = WORDS) -> Column:
    """Sorted array of the 64-bit hashes of all distinct runs of ``words`` words."""
    found = lambda t: F.regexp_extract_all(t, F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    # the whole text is lowered at once, but for the letters whose lower case depends on the word or is no letter alone
    w = F.when(text.rlike("[\u0130\u03a3]"), F.transform(found(text), F.lower)).otherwise(found(F.lower(text)))

    def runs(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(words))))

    # every word is hashed once; the one-element array names the hashes, so that they are made once
    each = F.transform(F.array(F.transform(w, lambda x: F.xxhash64(x))), lambda h: F.when(F.size(h) >= words, F.sort_array(F.array_distinct(runs(h)))))
    return F.element_at(each, 1)


def plan(threshold: float, miss: float = 1e-5, symbols: int = 160) -> tuple[int, int]:
    """(segments, symbols per segment): the longest segments whose number still fits into ``symbols``."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a similarity above 0, at most 1")

    def segments(r: int) -> int:
        p = threshold**r + r * threshold ** (r - 1) * (1 - threshold)
        return max(1, math.ceil(math.log(miss) / math.log1p(-p))) if p < 1 else 1

    # segments of two symbols, of which one may differ, are the shortest; low thresholds need more of them than ``symbols``
    fit = [(segments(r), r) for r in range(2, 33) if segments(r) * r <= symbols]
    return fit[-1] if fit else (segments(2), 2)


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def _symbols(sets: pd.Series, n: int) -> np.ndarray:
    a, b = _constants(n)
    out = np.zeros((len(sets), n), dtype=np.uint64)
    for row, s in enumerate(sets):
        h = np.asarray(s, dtype=np.int64).view(np.uint64)
        low = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(h), 4096):  # bounded memory for very long texts
            x = h[at : at + 4096, None] * a + b
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            np.minimum(low, (x >> np.uint64(32)).min(axis=0), out=low)
        out[row] = low
    return out


def _variants(sym: np.ndarray, m: int, r: int) -> np.ndarray:
    """One key per segment and wildcard position: the sum of mixed symbols without that position's, tagged by both."""
    rng = np.random.default_rng(7)
    tag = rng.integers(0, 2**63, m * r, dtype=np.uint64)
    x = (sym + np.uint64(0x9E3779B97F4A7C15)) * (rng.integers(0, 2**63, m * r, dtype=np.uint64) | np.uint64(1))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    seg = x.reshape(-1, m, r)
    keys = (seg.sum(axis=2, keepdims=True, dtype=np.uint64) - seg).reshape(-1, m * r) + tag
    keys *= np.uint64(0xD6E8FEB86659FD93)
    return (keys ^ (keys >> np.uint64(32))).view(np.int64)


def classes(texts: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(members(id, rep), sets(rep, sh)): ids with the same set share the representative, their least id."""
    one = texts.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(text_col).alias("text"))
    sets = one.select("id", shingles(F.col("text"), words).alias("sh")).where(F.col("sh").isNotNull())
    # 128 bits and the size name a set
    sets = materialize(sets.withColumns({"k1": F.xxhash64("sh"), "k2": F.xxhash64(F.lit(1), F.reverse("sh")), "k3": F.size("sh")}), "shingles")
    keys = ["k1", "k2", "k3"]
    reps = materialize(sets.groupBy(*keys).agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    members = join_counted(sets.select("id", *keys), reps, keys, "copies", sets.count()).select("id", "rep")
    return materialize(members, "members"), sets.join(reps.select(F.col("rep").alias("id")), "id", "left_semi").select(F.col("id").alias("rep"), "sh")


def links(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of representatives at or above the threshold."""
    m, r = plan(threshold)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                keys = _variants(_symbols(part["sh"], m * r), m, r)
                size = part["sh"].map(len).to_numpy(dtype=np.int32)
                yield pd.DataFrame({"v": keys.ravel(), "h": np.repeat(part["h"].to_numpy(), m * r), "n": np.repeat(size, m * r)})

    # representatives travel as 64-bit hashes; should two share one, all of them are verified below
    rows = sets.select(F.xxhash64("rep").alias("h"), "sh").mapInPandas(index, "v bigint, h bigint, n int")
    at = Window.partitionBy("v").orderBy("n", "h")
    met = rows.repartition("v").withColumns({"at": F.row_number().over(at), "following": F.lead("h").over(at)})
    met = met.where((F.col("at") > 1) | F.col("following").isNotNull()).select("v", "h", "n", ((F.col("at") - 1) / F.lit(HOT)).cast("int").alias("block"))
    pairs = candidates(materialize(met, "met"), threshold)
    side = lambda x: sets.select(F.xxhash64("rep").alias(x), F.col("rep").alias(f"r{x}"), F.col("sh").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "sa", "sb")
    common = F.size(F.array_intersect("sa", "sb")).cast("double")
    measured = both.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("similarity"))
    return measured.where(F.col("similarity") >= threshold)


def candidates(met: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: the hashes of all texts that share a key and may reach the threshold by their sizes.

    The texts of a key stand in blocks of ``HOT`` in the order of their sizes. Texts of one block meet in one task; the blocks
    of a key that many texts share meet pair by pair in other tasks, and pairs of blocks too unlike in size never do.
    """
    left, right = met.toDF("v", "a", "na", "block"), met.toDF("v", "b", "nb", "block")
    size = lambda: F.least("na", "nb") >= F.lit(threshold - 1e-9) * F.greatest("na", "nb")
    pairs = left.join(right, ["v", "block"]).where(size() & (F.col("a") < F.col("b"))).select("a", "b")
    hot = materialize(met.where("block > 0").select("v").distinct(), "hot")
    if not hot.isEmpty():
        of_hot = materialize(met.join(hot, "v", "left_semi"), "hot-rows")
        blocks = of_hot.groupBy("v", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
        i, j = blocks.toDF("v", "i", "li", "mi"), blocks.toDF("v", "j", "lj", "mj")
        meet = i.join(j, "v").where((F.col("i") < F.col("j")) & (F.col("mi") >= F.lit(threshold - 1e-9) * F.col("lj"))).select("v", "i", "j")
        first = of_hot.toDF("v", "a", "na", "i").join(meet, ["v", "i"])
        second = of_hot.toDF("v", "b", "nb", "j").join(meet, ["v", "j"])
        across = first.join(second, ["v", "i", "j"]).where(size() & (F.col("a") != F.col("b")))
        pairs = pairs.unionByName(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return pairs.distinct()


def near_duplicates(texts: DataFrame, id_col: str = "doc_id", text_col: str = "content", words: int = WORDS, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members(id, rep), links(a, b, similarity) between representatives)."""
    members, sets = classes(texts, id_col, text_col, words)
    return members, materialize(links(sets, threshold), "links")


def all_pairs(members: DataFrame, linked: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the links written out for every member, and the pairs within each class."""
    within = members.select("rep", F.col("id").alias("x")).join(members.select("rep", F.col("id").alias("y")), "rep").where("x < y").select("x", "y")
    across = linked.join(members.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a").join(members.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b")
    return within.unionByName(across.select("x", "y")).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def link_counts(members: DataFrame, linked: DataFrame) -> DataFrame:
    """(id, rep, class_size, n_links): one row per document with a set; links count classes, not copies."""
    ends = linked.select(F.col("a").alias("rep")).unionByName(linked.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    sizes = members.groupBy("rep").agg(F.count("*").alias("class_size")).join(ends, "rep", "left")
    return members.join(sizes, "rep").select("id", "rep", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def groups(members: DataFrame, linked: DataFrame) -> DataFrame:
    """(id, rep, group_id, group_size): texts that are connected by links, with the least representative as the group's id."""
    of = components(linked.select("a", "b"))
    counts = members.groupBy("rep").agg(F.count("*").alias("copies")).join(of.toDF("rep", "group_id"), "rep", "left")
    named = materialize(counts.withColumn("group_id", F.coalesce("group_id", "rep")), "named")
    sizes = named.groupBy("group_id").agg(F.sum("copies").alias("group_size"), F.count("*").alias("classes"))
    named = join_counted(named, sizes, "group_id", "classes", named.count())
    return join_counted(members, named.select("rep", "copies", "group_id", "group_size"), "rep", "copies", members.count()).select("id", "rep", "group_id", "group_size")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every end of an edge (a, b): the least id of its connected component.

    Alternating stars: every id is tied to the least id near it, first by its greater, then by its smaller neighbours, until
    every edge leads to a root. A long chain takes a number of rounds that grows with its logarithm. Neither links nor components
    come to the driver, one count and one sum per round do.
    """
    tied = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), "ties")
    before = None
    while True:
        both = tied.unionByName(tied.select(F.col("y").alias("x"), F.col("x").alias("y")))
        tied = _star(materialize(both, "both"), "y > x")
        tied = _star(tied, "true")
        tied = materialize(tied, "ties")
        now = tuple(tied.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("x", "y").cast("decimal(20,0)")), F.lit(0))).first())
        if now == before:
            return tied.select(F.col("x").alias("id"), F.col("y").alias("root")).unionByName(tied.select(F.col("y").alias("id"), F.col("y").alias("root"))).distinct()
        before = now


def _star(near: DataFrame, which: str) -> DataFrame:
    """Ties (x, y), y < x: the neighbours y of each x (those that ``which`` selects, and x itself) to the least id among x and
    all its neighbours."""
    least = near.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n"))
    least = materialize(least.withColumn("m", F.least("m", "x")), "least")
    total = least.agg(F.sum("n")).first()[0] or 0
    moved = join_counted(near, least, "x", "n", total).where(which).select(F.col("y").alias("x"), F.col("m").alias("y"))
    own = least.select("x", F.col("m").alias("y"))
    return moved.unionByName(own).where("x <> y").distinct()
