"""Mixing sources to target weights (problem 9): weighted fair queueing.

Each source's texts are shuffled by hash and queued; a text's virtual finish time is the running number of tokens of its
source divided by the source's target share. All queues merge in the order of finish times and are truncated at the token
budget, so at any length the mixture holds the sources in their shares. Where a long text passes the end, its source is short of
its share by less than that text; with ``fill`` rounds (0 unless asked for) the room goes to the next texts of the source that
fit, after all others. A source may run through its texts ``max_repeats`` times,
each time in another shuffle. Without a budget the mixture is as large as it can be with every source
in its share: the least of repeats times tokens over share.

Source names match by their letters and digits in lower case. Shares of a mixture are brought to a sum of one over the sources
that have texts.

Defined results: texts of null or unmatched source, null id or size below 1 are left out; null, zero and negative shares take
no part, nor do sources without tokens or with ``max_repeats`` below 1 (a null means once) - the report lists them with what
they reached; repeated target rows count once, different rows of one source add their shares and keep the least repeats; a
budget beyond what the repeats allow ends where the first source is used up; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.prefix import running_sums
from cairn.session import materialize


def source_key(source: Column) -> Column:
    key = F.lower(F.regexp_replace(source, r"[^\p{L}\p{Nd}]", ""))
    return F.when(key != "", key)


def targets(mix: DataFrame) -> DataFrame:
    """(mix_id, key, source, wanted, repeats): one row per mixture and source."""
    rows = mix.where("mix_id IS NOT NULL").select("mix_id", source_key(F.col("source")).alias("key"), "source", "target_share", "max_repeats").where("key IS NOT NULL").distinct()
    good = F.when((F.col("target_share") > 0) & ~F.isnan("target_share"), F.col("target_share"))
    return rows.groupBy("mix_id", "key").agg(F.min("source").alias("source"), F.sum(good.cast("decimal(28,12)")).cast("double").alias("wanted"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("repeats"))


def shares(sized: DataFrame, mix: DataFrame, budget: int | None = None) -> DataFrame:
    """(mix_id, key, source, share, repeats, have, budget, binding): shares of the sources that take part, the token budget, and
    whether it is this source that ends with it."""
    have = sized.groupBy("key").agg(F.sum("tokens").alias("have"))
    rows = targets(mix).join(have, "key").where((F.col("wanted") > 0) & (F.col("repeats") >= 1))
    # exact sums: the same shares, to the last bit, whatever the order of the rows
    total = rows.groupBy("mix_id").agg(F.sum(F.col("wanted").cast("decimal(28,12)")).cast("double").alias("__all"))
    rows = rows.join(total, "mix_id").withColumn("share", F.col("wanted") / F.col("__all"))
    rows = rows.withColumn("lasts", F.floor(F.col("repeats") * F.col("have") / F.col("share")))
    most = rows.groupBy("mix_id").agg(F.min("lasts").alias("budget"))
    if budget is not None:
        most = most.withColumn("budget", F.least("budget", F.lit(budget)))
    binds = (F.col("lasts") <= F.col("budget")).alias("binding")
    return rows.join(most, "mix_id").select("mix_id", "key", "source", "share", "repeats", "have", "budget", binds)


def usable(texts: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "tokens") -> DataFrame:
    """(id, key, tokens) of the texts that can be mixed."""
    rows = texts.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("key"), F.col(size_col).cast("bigint").alias("tokens"))
    return rows.where(F.col("id").isNotNull() & F.col("key").isNotNull() & (F.col("tokens") >= 1))


def mixture(sized: DataFrame, mix: DataFrame, budget: int | None = None, fill: int = 0) -> DataFrame:
    """(mix_id, place, source, id, copy, tokens): the mixtures in reading order. ``sized`` is the result of ``usable``."""
    plan = materialize(shares(sized, mix, budget), "shares")
    # a copy is made only of texts whose queue is read so often before the budget is reached
    rounds = F.least(F.col("repeats").cast("bigint"), F.ceil(F.col("budget") * F.col("share") / F.col("have")) + 1)
    queued = sized.join(F.broadcast(plan.select("mix_id", "key", "source", "share", rounds.alias("rounds"))), "key") if _bounded(plan) else sized.join(plan.select("mix_id", "key", "source", "share", rounds.alias("rounds")), "key")
    queued = queued.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rounds").cast("int"))))
    queued = queued.withColumn("turn", F.xxhash64("mix_id", "copy", "id"))
    served = running_sums(queued, ["mix_id", "key"], ["copy", "turn", "id"], "tokens", out="served", label="queues")
    ends = plan.select("mix_id", "key", (F.col("share") * F.col("budget")).alias("end"))
    small = _bounded(plan)
    with_ends = served.join(F.broadcast(ends) if small else ends, ["mix_id", "key"])
    timed = with_ends.withColumn("finish", F.col("served") / F.col("share"))
    timed = materialize(timed, "timed") if fill else timed
    kept, rest = timed.where("served <= end").drop("end"), timed.where("served > end")
    for k in range(fill):
        used = kept.groupBy("mix_id", "key").agg(F.sum("tokens").alias("used"))
        room = ends.join(used, ["mix_id", "key"], "left").select("mix_id", "key", (F.col("end") - F.coalesce("used", F.lit(0))).alias("room"))
        fit = rest.join(F.broadcast(room) if small else room, ["mix_id", "key"]).where("tokens <= room")
        filled = running_sums(fit, ["mix_id", "key"], ["copy", "turn", "id"], "tokens", out="filled", label="room").where("filled <= room")
        filled = filled.withColumn("finish", F.col("end") / F.col("share") + k + F.col("filled") / (F.col("room") + 1.0))
        kept = materialize(kept.unionByName(filled.select(*kept.columns)), "kept")
        rest = rest.join(kept.select("mix_id", "key", "id", "copy"), ["mix_id", "key", "id", "copy"], "left_anti")
    placed = running_sums(kept, ["mix_id"], ["finish", "key", "id", "copy"], "tokens", out="place", label="mixture")
    return placed.select("mix_id", "place", "source", "id", "copy", "tokens")


def _bounded(plan: DataFrame, rows: int = 10_000) -> bool:
    """Whether the plan, of one row per mixture and source, is small enough to broadcast."""
    return plan.limit(rows + 1).count() <= rows


def reached(mixed: DataFrame, mix: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """(mix_id, source, wanted_share, share, tokens, texts, most_copies) for every source of the targets; with the ``plan`` that
    ``shares`` makes also (target, have, budget, binding): the share among the sources that have texts, the tokens of the source,
    the tokens the mixture may have, and whether this source sets that bound. These are null for sources that take no part."""
    got = mixed.groupBy("mix_id", source_key(F.col("source")).alias("key"), "id").agg(F.sum("tokens").alias("t"), F.count("*").alias("c"))
    got = got.groupBy("mix_id", "key").agg(F.sum("t").alias("tokens"), F.count("*").alias("texts"), F.max("c").alias("most_copies"))
    rows = targets(mix).join(got, ["mix_id", "key"], "left")
    all_of = rows.groupBy("mix_id").agg(F.sum("wanted").alias("w"), F.sum("tokens").alias("t"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = rows.join(all_of, "mix_id").select(
        "mix_id", "key", "source", (zero("wanted") / F.when(F.col("w") > 0, F.col("w"))).alias("wanted_share"), (zero("tokens") / F.when(F.col("t") > 0, F.col("t"))).alias("share"),
        zero("tokens").alias("tokens"), zero("texts").alias("texts"), zero("most_copies").alias("most_copies"),
    )
    if plan is not None:
        out = out.join(plan.select("mix_id", "key", F.col("share").alias("target"), "have", "budget", "binding"), ["mix_id", "key"], "left")
    return out.drop("key")


def broken(sized: DataFrame, mix: DataFrame, mixed: DataFrame) -> DataFrame:
    """(mix_id, overused, doubled, gaps, unwanted, over_budget, off_share): how often a mixture breaks each of its rules."""
    plan = materialize(shares(sized, mix), "plan")
    key = source_key(F.col("source")).alias("key")
    uses = mixed.groupBy("mix_id", key, "id").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("copies"), F.max("tokens").alias("longest"), F.sum("tokens").alias("t"))
    ruled = uses.join(plan, ["mix_id", "key"], "left")
    each = ruled.groupBy("mix_id").agg(F.count_if(F.col("n") > F.col("repeats")).alias("overused"), F.count_if(F.col("n") != F.col("copies")).alias("doubled"), F.count_if(F.col("repeats").isNull()).alias("unwanted"))
    total = mixed.groupBy("mix_id").agg(F.sum("tokens").alias("t"), F.max("place").alias("last"), F.countDistinct("place").alias("places"), F.count("*").alias("rows"))
    end = plan.groupBy("mix_id").agg(F.max("budget").alias("budget"))
    sums = total.join(end, "mix_id").select("mix_id", ((F.col("last") != F.col("t")) | (F.col("places") != F.col("rows"))).cast("bigint").alias("gaps"), (F.col("t") > F.col("budget")).cast("bigint").alias("over_budget"))
    # a queue ends within one text of its share of the budget
    longest = sized.groupBy("key").agg(F.max("tokens").alias("longest"))
    got = uses.groupBy("mix_id", "key").agg(F.sum("t").alias("t"))
    want = plan.join(got, ["mix_id", "key"], "left").join(longest, "key")
    off = want.groupBy("mix_id").agg(F.count_if(F.abs(F.col("share") * F.col("budget") - F.coalesce("t", F.lit(0))) > F.col("longest") + 1).alias("off_share"))
    return each.join(sums, "mix_id").join(off, "mix_id").select("mix_id", "overused", "doubled", "gaps", "unwanted", "over_budget", "off_share")
