"""One ranking from several scores on unlike scales (problem 2): median rank aggregation.

Within a group (query) every score gives each item the place 1 + number of better items (equal scores share a place). Items
are ordered by the weighted median of their places, then the weighted mean, then the item's id in byte order.

Defined results: of several scorings of one item the latest holds (null times are oldest; at equal times the larger scores);
a null or NaN score gives the item no place, it then stands behind all placed items of that score; a score with fewer than
two different values in a group does not count there; if none counts, all places are equal and the id decides; rows with a
null item or group are left out; repeated rows count once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.ordering import join_counted, number_rows
from cairn.session import materialize


def latest_scoring(results: DataFrame, scores: list[str], group: str = "query_id", item: str = "doc_id", at: str = "scored_at") -> DataFrame:
    """One row per group and item: (g, item, vals) with the scores as an array; NaN becomes null."""
    vals = F.array(*(F.when(~F.isnan(F.col(s)), F.col(s).cast("double")) for s in scores))
    rows = results.where(F.col(group).isNotNull() & F.col(item).isNotNull())
    newest = F.max(F.struct(F.col(at).alias("at"), vals.alias("vals"))).alias("m")
    return rows.groupBy(F.col(group).alias("g"), F.col(item).alias("item")).agg(newest).select("g", "item", "m.vals")


def places(scored: DataFrame, n_scores: int) -> DataFrame:
    """(g, item, ranks): place per score; null where the score does not count in the group.

    One range sort over (group, score number, value) numbers all lists at once, so a group that holds a third of all rows
    is still spread over the tasks; so is a score that a third of the items share, for all joins know how many rows a key has.
    """
    long = scored.select("g", "item", F.posexplode("vals").alias("s", "v"))
    numbered = number_rows(long.where(F.col("v").isNotNull()), ["g", "s", F.desc("v"), "item"], out="pos", label="places")  # the item splits ties over the tasks
    first = materialize(numbered.groupBy("g", "s", "v").agg(F.min("pos").alias("at"), F.count("*").alias("n")), "values")
    lists = first.groupBy("g", "s").agg(F.min("at").alias("start"), F.sum("n").alias("n"), F.count("*").alias("values"))
    lists = materialize(lists, "lists")
    total = lists.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("values"), F.lit(0))).first()
    counted = lists.where(F.col("values") >= 2)
    at = join_counted(first.withColumnRenamed("n", "rows"), counted, ["g", "s"], "values", total[1])
    at = at.select("g", "s", "v", "rows", (F.col("at") - F.col("start") + 1).alias("place"))
    placed = join_counted(numbered, at, ["g", "s", "v"], "rows", total[0]).groupBy("g", "item").agg(F.map_from_entries(F.collect_list(F.struct("s", "place"))).alias("at"))
    counts = counted.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("s", "n"))).alias("n"))
    sizes = scored.groupBy("g").agg(F.count("*").alias("rows")).join(counts, "g", "left")
    full = join_counted(scored.select("g", "item"), sizes, "g", "rows", scored.count()).join(placed, ["g", "item"], "left")
    rank = lambda s: F.when(F.try_element_at("n", F.lit(s)).isNotNull(), F.coalesce(F.try_element_at("at", F.lit(s)), F.try_element_at("n", F.lit(s)) + 1))
    return full.select("g", "item", F.array(*(rank(s) for s in range(n_scores))).alias("ranks"))


def weighted_median(ranks: Column, weights: list[float]) -> Column:
    """The middle of the lower and the upper weighted median of the non-null ranks; null if there is none."""
    pairs = F.array_sort(F.filter(F.arrays_zip(ranks.alias("r"), F.array(*map(F.lit, weights)).alias("w")), lambda p: p["r"].isNotNull() & (p["w"] > 0)))
    total = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["w"])

    def at(p: Column, beyond: bool) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("bigint").alias("m"))
        half = total / 2
        hit = (lambda s: s > half + 1e-12) if beyond else (lambda s: s >= half - 1e-12)
        step = lambda a, x: F.struct((a["sum"] + x["w"]).alias("sum"), F.when(a["m"].isNull() & hit(a["sum"] + x["w"]), x["r"]).otherwise(a["m"]).alias("m"))
        return F.aggregate(p, start, step)["m"]

    return (at(pairs, False) + at(pairs, True)) / 2.0


def median_rank(results: DataFrame, scores: list[str], weights: list[float] | None = None, group: str = "query_id", item: str = "doc_id", at: str = "scored_at") -> DataFrame:
    """(group, item, median_rank, mean_rank) for every item."""
    weights = [float(w) for w in weights or [1.0] * len(scores)]
    scored = materialize(latest_scoring(results, scores, group, item, at), "scorings")
    ranked = places(scored, len(scores))
    mean = lambda r: F.aggregate(F.arrays_zip(r.alias("r"), F.array(*map(F.lit, weights)).alias("w")), F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda s, p: F.when(p["r"].isNull(), s).otherwise(F.struct((s["a"] + p["r"] * p["w"]).alias("a"), (s["b"] + p["w"]).alias("b"))), lambda s: F.when(s["b"] > 0, s["a"] / s["b"]))
    out = ranked.select("g", "item", weighted_median(F.col("ranks"), weights).alias("median_rank"), mean(F.col("ranks")).alias("mean_rank"))
    return out.select(F.col("g").alias(group), F.col("item").alias(item), "median_rank", "mean_rank")


_ORDER = ["median_rank", "mean_rank"]


def first_items(ranked: DataFrame, group: str = "query_id", item: str = "doc_id") -> DataFrame:
    """(group, item): the item that belongs first; combines before the shuffle."""
    key = F.struct(*(F.coalesce(F.col(c), F.lit(float("inf"))) for c in _ORDER), F.col(item).alias("id"))
    return ranked.groupBy(group).agg(F.min(key)["id"].alias(item))


def fused(ranked: DataFrame, group: str = "query_id", item: str = "doc_id") -> DataFrame:
    """(group, item, place, median_rank, mean_rank): the whole ranking, places from 1 per group."""
    key = [F.coalesce(F.col(c), F.lit(float("inf"))) for c in _ORDER]
    pos = number_rows(ranked, [F.col(group), *key, F.col(item)], out="pos", label="fused")
    start = pos.groupBy(group).agg(F.min("pos").alias("start"), F.count("*").alias("rows"))
    return join_counted(pos, start, group, "rows", pos.count()).select(group, item, (F.col("pos") - F.col("start") + 1).alias("place"), *_ORDER)
