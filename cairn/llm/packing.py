"""Filling containers of fixed capacity with items (problem 8): variable-capacity best fit.

The plan is made on the histogram of item sizes, which has at most as many entries as the largest capacity, so it is the
plan of one best-fit-decreasing run over all items, whatever their number: sizes go down, each item goes to the open
container with the least sufficient room, and when there is none a container of the least-cost permitted size is opened -
the size that, filled up greedily with what is left, wastes the smallest part. At the end every container is downsized to
the smallest permitted size that holds its contents. Items of equal size are interchangeable; the plan says which stretch
of each size goes to which containers, and the items look their place up by their number within the size.

Defined results: an item larger than the largest capacity is split into full pieces and a rest; other items stay whole;
items of size null or below 1 take no room and are left out; rows are items, repeated rows too; null or non-positive
capacities are ignored, and without any capacity, or any item, there are no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.ordering import number_rows
from cairn.session import materialize


def _lookahead(capacity: int, size: int, sizes: list[int], left: dict[int, int]) -> float:
    """Part of a container of ``capacity`` that stays empty if it is opened for ``size`` and filled with the rest."""
    room = capacity - size
    used: dict[int, int] = {size: 1}
    while room > 0:
        at = bisect_left(sizes, room + 1) - 1
        while at >= 0 and left[sizes[at]] - used.get(sizes[at], 0) <= 0:
            at -= 1
        if at < 0:
            break
        s = sizes[at]
        k = min(room // s, left[s] - used.get(s, 0))
        used[s] = used.get(s, 0) + k
        room -= k * s
    return room / capacity


def plan(histogram: dict[int, int], capacities: list[int]) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int, int]]]:
    """(stretches, containers) for sizes up to the largest capacity.

    A stretch (size, start, end, first, per) puts the items ``start`` <= number < ``end`` of ``size`` into containers
    ``first``, ``first`` + 1, ..., ``per`` into each. Containers are runs (first, end, capacity, contents).
    """
    capacities = sorted(set(capacities))
    open_at: dict[int, list[tuple[int, int, int]]] = {}  # room -> runs (first, end, opened capacity)
    rooms: list[int] = []
    stretches: list[tuple[int, int, int, int, int]] = []
    sizes = sorted(histogram)
    left = dict(histogram)
    following = 0

    def put(room: int, run: tuple[int, int, int]) -> None:
        if room not in open_at:
            open_at[room] = []
            insort(rooms, room)
        open_at[room].append(run)

    while sizes:
        size = sizes[-1]
        number, total = 0, left[size]
        while number < total:
            rest = total - number
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                first, end, cap = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room], rooms[at]
            else:
                fit = [c for c in capacities if c >= size]
                left[size] = rest
                cap = min(fit, key=lambda c: (_lookahead(c, size, sizes, left), -c)) if len(fit) > 1 else fit[0]
                per = min(cap // size, rest)
                first, end, room = following, following + max(1, rest // per), cap
                following = end
            per = min(room // size, rest)
            used = min(end - first, rest // per)
            stretches.append((size, number, number + used * per, first, per))
            put(room - per * size, (first, first + used, cap))
            if first + used < end:
                put(room, (first + used, end, cap))
            number += used * per
        sizes.pop()
        del left[size]
    bins = []
    for room, runs in open_at.items():
        for first, end, cap in runs:
            contents = cap - room
            bins.append((first, end, capacities[bisect_left(capacities, contents)], contents))
    return stretches, sorted(bins)


def pack(items: DataFrame, capacities: list[int], id_col: str = "doc_id", size_col: str = "tokens") -> DataFrame:
    """(container, capacity_tokens, filled, id, piece, start, tokens) for every item or piece of an item."""
    spark = items.sparkSession
    kind = dict(items.dtypes)[id_col]
    out = f"container bigint, capacity_tokens int, filled int, {id_col} {kind}, piece int, start bigint, tokens int"
    caps = sorted({int(c) for c in capacities if c is not None and c > 0})
    if not caps:
        return spark.createDataFrame([], out)
    top = F.lit(caps[-1])
    cut = items.where(F.col(size_col) >= 1).select(F.col(id_col), F.col(size_col).alias("__size"))
    cut = cut.withColumn("piece", F.explode(F.expr(f"sequence(0, cast((__size - 1) div {caps[-1]} as int))")))
    start = F.col("piece").cast("bigint") * top
    pieces = cut.select(id_col, "piece", start.alias("start"), F.least(F.col("__size") - start, top).cast("int").alias("tokens"))
    numbered = number_rows(pieces, ["tokens", id_col, "piece"], out="__pos", label="pieces")
    sizes = numbered.groupBy("tokens").agg(F.count("*").alias("n"), F.min("__pos").alias("at")).collect()  # <= largest capacity
    stretches, bins = plan({r["tokens"]: r["n"] for r in sizes}, caps)
    origin = {r["tokens"]: r["at"] for r in sizes}
    grouped: dict[int, list] = {}
    for x in stretches:
        grouped.setdefault(x[0], []).append(x[1:])
    by = {s: np.array(v, dtype=np.int64) for s, v in grouped.items()}
    heads = np.array(bins, dtype=np.int64).reshape(-1, 4)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            box = np.empty(len(pdf), dtype=np.int64)
            size, pos = pdf["tokens"].to_numpy(), pdf["__pos"].to_numpy()
            for s in np.unique(size):
                mask, runs = size == s, by[int(s)]
                p = pos[mask] - origin[int(s)]
                run = runs[np.searchsorted(runs[:, 0], p, side="right") - 1]
                box[mask] = run[:, 2] + (p - run[:, 0]) // run[:, 3]
            head = heads[np.searchsorted(heads[:, 0], box, side="right") - 1]
            yield pdf.assign(container=box, capacity_tokens=head[:, 2], filled=head[:, 3])[["container", "capacity_tokens", "filled", id_col, "piece", "start", "tokens"]]

    return numbered.mapInPandas(place, out)


def report(packed: DataFrame, *keys: str) -> DataFrame:
    """Per key: containers, tokens, room, and the share of room filled."""
    each = packed.groupBy(*keys, "container").agg(F.first("capacity_tokens").alias("c"), F.sum("tokens").alias("t"))
    return each.groupBy(*keys).agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.sum("c").alias("room"), (F.sum("t") / F.sum("c")).alias("fill"))


def broken(items: DataFrame, packed: DataFrame, packs: list[tuple[int, int]], id_col: str = "doc_id", size_col: str = "tokens") -> DataFrame:
    """(pack_id, items, bad_containers, cut_texts, bad_texts): what was packed for each (pack_id, capacity) and jointly
    (null), and how many containers and texts break a rule."""
    spark = items.sparkSession
    if not packs:
        return spark.createDataFrame([], "pack_id bigint, items bigint, bad_containers bigint, cut_texts bigint, bad_texts bigint")
    limits = {**{p: [c] for p, c in packs}, None: sorted({c for _, c in packs})}
    sizes = spark.createDataFrame([(p, cs, cs[-1]) for p, cs in limits.items()], "pack_id bigint, sizes array<int>, top int")  # the parameter table
    same = lambda a, b: a["pack_id"].eqNullSafe(b["pack_id"])
    boxes = packed.groupBy("pack_id", "container").agg(F.sum("tokens").alias("t"), F.max("capacity_tokens").alias("c"), F.min("capacity_tokens").alias("c0"), F.max("filled").alias("f"))
    wrong = (F.col("t") > F.col("c")) | (F.col("c") != F.col("c0")) | (F.col("f") != F.col("t")) | ~F.array_contains("sizes", F.col("c"))
    boxes = boxes.join(F.broadcast(sizes), same(boxes, sizes)).groupBy(boxes["pack_id"]).agg(F.count_if(wrong).alias("bad_containers"))
    size = items.where(F.col(size_col) >= 1).groupBy(id_col).agg(F.sum(size_col).alias("__size"), F.count("*").alias("__rows"))
    of = packed.groupBy("pack_id", id_col).agg(F.sum("tokens").alias("t"), F.count("*").alias("pieces"), F.max(F.col("start") + F.col("tokens")).alias("end"), F.countDistinct("start").alias("starts"))
    asked = F.array(*(F.struct(F.lit(p).cast("bigint").alias("pack_id"), F.lit(cs[-1]).alias("top")) for p, cs in limits.items()))
    every = size.select("*", F.inline(asked))
    joined = every.join(of, (every[id_col] == of[id_col]) & same(every, of), "left")
    # texts whose id stands once; of repeated rows only the sum is known
    need = F.ceil(F.col("__size") / F.col("top"))
    bad = F.col("t").isNull() | (F.col("t") != F.col("__size")) | ((F.col("__rows") == 1) & ((F.col("end") != F.col("__size")) | (F.col("starts") != F.col("pieces"))))
    texts = joined.groupBy(every["pack_id"]).agg(F.count("*").alias("items"), F.count_if((F.col("__rows") == 1) & (F.col("pieces") > need)).alias("cut_texts"), F.count_if(bad).alias("bad_texts"))
    return texts.join(boxes, texts["pack_id"].eqNullSafe(boxes["pack_id"])).select(texts["pack_id"], "items", "bad_containers", "cut_texts", "bad_texts")


def sized(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: str) -> DataFrame:
    """(id, tokens) of every text, as a written table."""
    from cairn.llm.tokens import token_counts

    return materialize(token_counts(texts.select(id_col, text_col), text_col, **how), "sizes")
