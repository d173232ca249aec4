"""Change feed: brute force over random feeds, and the cases the docstring defines."""

import random

import pytest

from cairn.operators import changelog as C
from cairn.operators import kv

SCHEMA = "seq bigint, op tinyint, ts bigint, key string, value binary"


def feed(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def nano(ts):
    return ts * 10**9 if abs(ts) < 10**11 else ts * 10**6 if abs(ts) < 10**14 else ts * 1000 if abs(ts) < 10**17 else ts


def brute(rows):
    best = {}
    for seq, op, ts, key, value in rows:
        if op in (1, 2) and key is not None and ts is not None:
            at = (nano(ts), -1 if seq is None else seq)
            if key not in best or at >= best[key][0]:
                best[key] = (at, op, value)
    return {k: (v[0][0], v[2]) for k, v in best.items() if v[1] == 1}


def random_rows(seed, n=600):
    r = random.Random(seed)
    base, rows = 1_704_000_000_000_000_000, []
    for seq in range(n):
        ts = base + r.randrange(50) * 10**9
        rows.append((seq, r.choice([1, 1, 1, 2, 3, 0, None]), r.choice([ts, ts, ts // 1000, ts // 10**6]), r.choice(["hot"] * 20 + [f"k{i}" for i in range(40)] + [None]), bytes([r.randrange(256)])))
    rows += r.sample(rows, 50)
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = random_rows(seed)
    got = {r["key"]: (r["ts"], bytes(r["value"])) for r in C.apply_changes(feed(spark, rows), slices=3, with_value=True).collect()}
    assert got == brute(rows)


def test_runs_in_any_order_and_compaction(spark, tmp_path):
    rows = random_rows(3)
    store = C.ChangeStore(spark, str(tmp_path / "t"), fanout=2)
    for at in (400, 0, 200):
        store.append(feed(spark, rows[at : at + 200] + (rows[600:] if at == 0 else [])))
    assert len(store.runs) <= 2  # the third append compacted
    want = brute(rows)
    assert {r["key"] for r in store.read().collect()} == set(want)
    store.compact()
    assert len(store.runs) == 1 and {r["key"]: r["ts"] for r in store.read().collect()} == {k: v[0] for k, v in want.items()}
    some = next(iter(want))
    assert store.get(some).count() == 1 and store.scan("k").count() == sum(k.startswith("k") for k in want)


def test_late_and_repeated_puts_after_compaction(spark, tmp_path):
    t = 1_704_000_000_000_000_000
    store = C.ChangeStore(spark, str(tmp_path / "t"), fanout=1)
    puts = [(1, 1, t, "a", b"1"), (2, 1, t, "live", b"2")]
    store.append(feed(spark, puts))
    store.append(feed(spark, [(3, 2, t + 5, "a", None), (4, 2, t + 5, "b", None)]))
    assert len(store.runs) == 1  # compacted
    store.append(feed(spark, puts))  # again
    store.append(feed(spark, [(5, 1, t + 4, "b", b"3")]))  # late
    assert {r["key"] for r in store.read().collect()} == {"live"}
    store.append(feed(spark, [(6, 1, t + 6, "b", b"4")]))
    store.compact(low_water=t + 5)
    assert {r["key"] for r in store.merged().collect()} == {"a", "b", "live"}  # a delete at the mark itself stays
    store.compact(low_water=t + 6)
    assert {(r["key"], r["ts"]) for r in store.merged().collect()} == {("b", t + 6), ("live", t)}


def test_killed_write_and_repeated_batch(spark, tmp_path):
    t, path = 1_704_000_000_000_000_000, tmp_path / "t"
    store = C.ChangeStore(spark, str(path))
    first = feed(spark, [(1, 1, t, "a", b"1"), (2, 1, t, "b", b"2")])
    store.append(first)
    for leftover in ("runs/run=killed/part-0_00000.parquet", "_manifest-killed.tmp"):  # what a write that died leaves behind
        (path / leftover).parent.mkdir(exist_ok=True)
        (path / leftover).write_bytes(b"torn")
    again = C.ChangeStore(spark, str(path))
    again.append(first)
    again.append(feed(spark, [(3, 2, t + 1, "a", None)]))
    assert {r["key"] for r in again.read().collect()} == {"b"} and len(again.runs) == 3
    assert again.vacuum() == ["_manifest-killed.tmp", "run=killed"] and {r["key"] for r in again.read().collect()} == {"b"}


def test_reader_of_the_version_before(spark, tmp_path):
    t, store = 1_704_000_000_000_000_000, C.ChangeStore(spark, str(tmp_path / "t"))
    for k in range(3):
        store.append(feed(spark, [(k, 1, t + k, f"k{k}", b"1")]))
    opened = store.read()
    store.compact()
    assert opened.count() == 3 and store.read().count() == 3
    store.append(feed(spark, [(9, 1, t + 9, "k9", b"1")]))
    assert len(list((tmp_path / "t").glob("runs/run=*"))) == 2  # the runs before the compaction are gone


def test_merge_on_read_without_shuffle(spark, tmp_path):
    t, store = 1_704_000_000_000_000_000, C.ChangeStore(spark, str(tmp_path / "t"), buckets=4)
    for k in range(3):
        store.append(feed(spark, [(k * 100 + i, 1, t + i, f"k{i * (k + 1)}", b"1") for i in range(100)]))
    plan = store.read()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert C.ChangeStore(spark, str(tmp_path / "t"), buckets=9).buckets == 4  # as its first run has it


def test_odd_times(spark):
    odd = [(i, 1, ts, f"k{i}", b"1") for i, ts in enumerate((5 * 10**10, 9 * 10**13, -(2**63), 2**63 - 1, 0, -1, 9 * 10**16))]
    got = {r["key"]: r["ts"] for r in C.apply_changes(feed(spark, odd)).collect()}
    assert got == {"k2": -(2**63), "k3": 2**63 - 1, "k4": 0, "k5": -(10**9)}


def test_edges(spark, tmp_path):
    assert C.apply_changes(feed(spark, [])).count() == 0
    t = 1_704_000_000
    rows = [(1, 1, t * 10**9, "a", None), (None, 2, t * 10**9, "a", None), (3, 1, None, "b", b"x"), (4, 1, t, "c", b""), (5, 2, t * 10**6, "c", None), (6, 1, t * 10**3, "d", b"1")]
    extra = feed(spark, rows).selectExpr("*", "1 AS run", "'x' AS best", "0 AS `__pid`")
    got = {r["key"]: r["ts"] for r in C.apply_changes(extra).collect()}
    assert got == {"a": t * 10**9, "d": t * 10**9}


def test_key_value_views(spark):
    rows = [(1, 1, 9, "a", b"1"), (2, 2, 1, "a", None), (3, 1, 5, "b", b"2"), (4, 1, 1, "b", b"3"), (5, None, 1, "b", b"4"), (6, 1, 1, "c", b"5"), (7, 2, 0, "zz", None)]
    log = feed(spark, rows)
    assert {(r["key"], bytes(r["value"])) for r in kv.live(log).collect()} == {("b", b"3"), ("c", b"5")}
    assert kv.replay(log).count() == 4 and kv.get(log, "a").count() == 0
    assert [r["key"] for r in kv.scan(log, "").collect()] == ["b", "c"]
    s = kv.stats(log).first()
    assert (s["puts"], s["deletes"], s["torn"]) == (4, 2, 1)
    assert kv.stats(feed(spark, [])).first()["bytes_put"] == 0
