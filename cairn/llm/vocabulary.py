"""Frequency of every distinct term (problem 4): vertical layout.

Records get dense numbers. A term's records are kept as containers of 65,536 numbers each: a sorted array of 16-bit offsets
up to 4,095 of them, a bitmap beyond, and beside it the occurrence counters in the same order. Every task builds partial
containers of its own rows before the shuffle; partial containers of one (term, container number) are merged by union.
Document frequency is the sum of the cardinalities, use count the sum of the counters. No task ever holds more of a term
than one container, however common the term is.

Defined results: rows with a null term, a null record or a count that is null or below 1 have no part, nor do records that
are not in the collection; repeated rows count once, and of several counts for one term of one record the largest holds;
equal use counts are ordered by term in byte order; an empty collection gives no rows; repeated configurations count once;
a null ``min_frequency`` marks nothing rare, a null or zero ``max_vocab`` cuts nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.ordering import number_rows
from cairn.session import materialize

CHUNK, ARRAY_MAX = 1 << 16, 4095
CONTAINER = "token string, chunk bigint, ids binary, counts binary"
_ARROW = pa.schema([("token", pa.string()), ("chunk", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])


def pack(offsets: np.ndarray) -> bytes:
    """Sorted distinct offsets as a container: 2 bytes each, or a bitmap of 8 KiB if that is smaller."""
    if len(offsets) <= ARRAY_MAX:
        return offsets.astype("<u2").tobytes()
    bits = np.zeros(CHUNK, dtype=np.uint8)
    bits[offsets] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(ids: bytes) -> np.ndarray:
    if len(ids) < CHUNK // 8:
        return np.frombuffer(ids, dtype="<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(ids, dtype=np.uint8), bitorder="little"))


def cardinality(ids: bytes) -> int:
    """Number of offsets in a container: those of the array, or the bits set in the bitmap."""
    return len(ids) // 2 if len(ids) < CHUNK // 8 else int(np.bitwise_count(np.frombuffer(ids, dtype=np.uint64)).sum())


def union(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets with counters from several containers: each offset once, with its largest counter."""
    order = np.lexsort((counts, ids))
    ids, counts = ids[order], counts[order]
    last = np.append(ids[1:] != ids[:-1], True)
    return ids[last], counts[last]


def _counters(counts: np.ndarray) -> bytes:
    wide = 1 if counts.max(initial=0) < 1 << 8 else 2 if counts.max() < 1 << 16 else 4 if counts.max() < 1 << 32 else 8
    return bytes([wide]) + counts.astype(f"<u{wide}").tobytes()


def _uncount(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype=f"<u{b[0]}", offset=1).astype(np.int64)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole (token, chunk) groups from batches sorted by both."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None and held.num_rows else t
        if not t.num_rows:
            continue
        token, chunk = t["token"].combine_chunks(), t["chunk"].to_numpy()
        last, end, at = token[-1], chunk[-1], t.num_rows
        while at > 0 and chunk[at - 1] == end and token[at - 1] == last:
            at -= 1
        yield t.slice(0, at)
        held = t.slice(at)
    if held is not None and held.num_rows:
        yield held


def _edges(t: pa.Table) -> np.ndarray:
    token = t["token"].combine_chunks().dictionary_encode().indices.to_numpy()
    chunk = t["chunk"].to_numpy()
    return np.append(0, np.flatnonzero((token[1:] != token[:-1]) | (chunk[1:] != chunk[:-1])) + 1)


def _emit(t: pa.Table, starts: np.ndarray, ids: list[bytes], counts: list[bytes]) -> pa.RecordBatch:
    heads = t.take(pa.array(starts))
    return pa.RecordBatch.from_arrays([heads["token"].combine_chunks().cast(pa.string()), heads["chunk"].combine_chunks(), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], schema=_ARROW)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _runs(batches):
        if t.num_rows:
            starts = _edges(t)
            off, tf = t["off"].to_numpy().astype(np.int64), t["tf"].to_numpy().astype(np.int64)
            parts = [union(off[a:b], tf[a:b]) for a, b in zip(starts, np.append(starts[1:], t.num_rows))]
            yield _emit(t, starts, [pack(i) for i, _ in parts], [_counters(c) for _, c in parts])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _runs(batches):
        if t.num_rows:
            starts = _edges(t)
            ids, counts = t["ids"].to_pylist(), t["counts"].to_pylist()
            out_i, out_c = [], []
            for a, b in zip(starts, np.append(starts[1:], t.num_rows)):
                if b - a == 1:
                    out_i.append(ids[a]), out_c.append(counts[a])
                else:
                    i, c = union(np.concatenate([unpack(x) for x in ids[a:b]]), np.concatenate([_uncount(x) for x in counts[a:b]]))
                    out_i.append(pack(i)), out_c.append(_counters(c))
            yield _emit(t, starts, out_i, out_c)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        df = pa.array([cardinality(x) for x in b["ids"].to_pylist()], pa.int64())
        uses = pa.array([int(_uncount(x).sum()) for x in b["counts"].to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b["token"].cast(pa.string()), df, uses], names=["token", "df", "uses"])


def numbered_records(records: DataFrame) -> DataFrame:
    """(doc_id, n): dense numbers of the distinct record ids."""
    return number_rows(records.select("doc_id").distinct(), ["doc_id"], out="n", label="records")


def containers(postings: DataFrame, numbered: DataFrame) -> DataFrame:
    """(token, chunk, ids, counts): the merged containers of all terms."""
    valid = F.col("token").isNotNull() & F.col("doc_id").isNotNull() & (F.col("tf") >= 1)
    rows = postings.where(valid).select("token", "doc_id", F.col("tf").cast("bigint").alias("tf")).join(numbered, "doc_id")
    rows = rows.select("token", F.expr(f"n div {CHUNK}").alias("chunk"), (F.col("n") % CHUNK).cast("int").alias("off"), "tf")
    partial = rows.sortWithinPartitions("token", "chunk").mapInArrow(_build, CONTAINER)
    return merged(partial)


def merged(partial: DataFrame) -> DataFrame:
    """Union of containers that hold the same term and numbers, such as those of two table parts."""
    return partial.repartition("token", "chunk").sortWithinPartitions("token", "chunk").mapInArrow(_merge, CONTAINER)


def frequencies(held: DataFrame) -> DataFrame:
    """(token, uses, df) from the containers."""
    each = held.select("token", "ids", "counts").mapInArrow(_measure, "token string, df bigint, uses bigint")
    return each.groupBy("token").agg(F.sum("uses").alias("uses"), F.sum("df").alias("df"))


def vocabulary(postings: DataFrame, records: DataFrame) -> tuple[DataFrame, int]:
    """(token, uses, df, place) with the 1-based place by uses; and the number of records."""
    numbered = materialize(numbered_records(records), "numbers")
    counted = frequencies(containers(postings, numbered))
    placed = number_rows(counted, [F.desc("uses"), F.col("token")], out="place", label="vocabulary")
    return placed.withColumn("place", F.col("place") + 1), numbered.count()


def marks(vocab: DataFrame, n_records: int, configs: DataFrame) -> DataFrame:
    """(config_id, token, mark) under each distinct configuration (config_id, min_frequency, max_vocab).

    In the order by uses the terms that are not rare come first, so one numbering serves all configurations: such a term is
    cut if its place is beyond ``max_vocab``. Configurations are parameters: they are taken as literals, 256 at a time.
    """
    rows = configs.where("config_id IS NOT NULL").select("config_id", "min_frequency", "max_vocab").distinct().orderBy("config_id", "min_frequency", "max_vocab").collect()
    schema = f"array<struct<config_id:{dict(configs.dtypes)['config_id']},min_frequency:bigint,max_vocab:bigint>>"
    out = vocab.sparkSession.createDataFrame([], f"config_id {dict(configs.dtypes)['config_id']}, token string, mark string")
    for at in range(0, len(rows), 256):
        lit = F.array(*(F.struct(F.lit(r[0]).alias("config_id"), F.lit(r[1]).alias("min_frequency"), F.lit(r[2]).alias("max_vocab")) for r in rows[at : at + 256])).cast(schema)
        each = vocab.withColumn("c", F.explode(lit))
        rare = F.coalesce(F.col("uses") < F.col("c.min_frequency"), F.lit(False))
        cut = ~rare & (F.coalesce("c.max_vocab", F.lit(0)) > 0) & (F.col("place") > F.col("c.max_vocab"))
        common = F.col("df") * 2 >= F.lit(n_records)
        found = F.filter(F.array(F.when(rare, "rare"), F.when(common, "common"), F.when(cut, "cut")), lambda m: m.isNotNull())
        out = out.unionByName(each.select("c.config_id", "token", F.explode(found).alias("mark")))
    return out
