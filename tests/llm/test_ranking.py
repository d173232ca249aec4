"""Terms, fused rankings and vocabulary against brute force, and the cases their docstrings define."""

import math
import random
import statistics

import pytest

from cairn.llm import rankfuse, terms, vocabulary

P = "token string, doc_id string, tf int"


def postings(spark, seed=1):
    r = random.Random(seed)
    rows = [(f"t{min(int(r.expovariate(0.15)), 60):02}", f"d{r.randrange(40):02}", 0) for _ in range(900)]
    rows = [(t, d, 1 + (hash((t, d)) % 5)) for t, d in {(t, d) for t, d, _ in rows}]
    rows += [(f"é{i}", "d00", 3) for i in range(3)] + r.sample(rows, 60)
    return rows + [(None, "d01", 4), ("t01", None, 4), ("t01", "gone", 9), ("t02", "d01", None), ("t03", "d01", 0)]


def documents(spark):
    rows = [(f"d{i:02}", "x") for i in range(40)] + [("d01", "x"), ("empty", ""), ("null", None), (None, "x")]
    return spark.createDataFrame(rows, "doc_id string, content string")


def counted(rows, ids):
    tf = {}
    for t, d, n in rows:
        if t is not None and d in ids and n is not None and n >= 1:
            tf[t, d] = max(tf.get((t, d), 0), n)
    return tf


IDS = {f"d{i:02}" for i in range(40)} | {"empty"}


def test_weights(spark):
    rows = postings(spark)
    df = spark.createDataFrame(rows, P).selectExpr("*", "1 AS df", "2 AS dl", "'x' AS idf")
    of = terms.records(documents(spark))
    assert of.count() == 41
    tf = counted(rows, IDS)
    docs = {d for _, d in tf}
    dl = {d: sum(n for (_, x), n in tf.items() if x == d) for d in docs}
    avg = sum(dl.values()) / len(dl)
    got = {(r["token"], r["doc_id"]): r for r in terms.term_weights(df, of).collect()}
    assert got.keys() == tf.keys()
    for (t, d), n in tf.items():
        k = sum(x == t for x, _ in tf)
        w = math.log(1 + (41 - k + 0.5) / (k + 0.5)) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * dl[d] / avg))
        assert got[t, d]["df"] == k and abs(got[t, d]["weight"] - w) < 1e-9
    best = {r["doc_id"]: r["token"] for r in terms.keywords(terms.term_weights(df, of)).collect()}
    for d in docs:
        fit = [(sum(x == t for x, _ in tf), -got[t, d]["weight"], t) for (t, x), n in tf.items() if x == d and n >= 3 and sum(y == t for y, _ in tf) >= 2]
        assert best.get(d) == (min(fit)[2] if fit else None)
    only = terms.term_weights(df, of, only=spark.createDataFrame([("d03",), ("nobody",)], "doc_id string"))
    assert {(r["token"], r["weight"]) for r in only.collect()} == {(t, got[t, d]["weight"]) for t, d in tf if d == "d03"}
    assert terms.term_weights(df.where("false"), of).count() == 0 and terms.term_weights(df, of.where("false")).count() == 0
    assert terms.top_terms(only, 2).count() == 2


def test_vocabulary(spark):
    rows = postings(spark, 2)
    tf = counted(rows, IDS)
    want = {}
    for (t, _), n in tf.items():
        u, d = want.get(t, (0, 0))
        want[t] = (u + n, d + 1)
    vocab, n = vocabulary.vocabulary(spark.createDataFrame(rows, P).repartition(5), terms.records(documents(spark)))
    got = {r["token"]: r for r in vocab.collect()}
    assert n == 41 and {t: (r["uses"], r["df"]) for t, r in got.items()} == want
    order = sorted(want, key=lambda t: (-want[t][0], t.encode()))
    assert [t for t in sorted(got, key=lambda t: got[t]["place"])] == order
    configs = spark.createDataFrame([(1, 5, 10), (1, 5, 10), (2, None, 0), (3, 10**6, 1), (4, 0, None), (None, 1, 1)], "config_id bigint, min_frequency int, max_vocab int")
    marks = sorted((r["config_id"], r["token"], r["mark"]) for r in vocabulary.marks(vocab, n, configs).collect())
    expect = []
    for c, low, cap in {(1, 5, 10), (2, None, 0), (3, 10**6, 1), (4, 0, None)}:
        kept = [t for t in order if low is None or want[t][0] >= low]
        expect += [(c, t, "rare") for t in want if t not in kept] + [(c, t, "common") for t in want if want[t][1] * 2 >= n] + [(c, t, "cut") for t in (kept[cap:] if cap else [])]
    assert marks == sorted(expect)
    nothing, none = vocabulary.vocabulary(spark.createDataFrame([], P), terms.records(documents(spark).where("false")))
    assert nothing.count() == 0 and none == 0


def test_containers_are_exact(spark):
    import numpy as np

    for ids in ([], [0], [65535], list(range(4095)), list(range(4096)), list(range(0, 65536, 2)), list(range(65536))):
        a = np.array(ids, dtype=np.int64)
        assert (vocabulary.unpack(vocabulary.pack(a)) == a).all() and len(vocabulary.pack(a)) <= 8192
    i, c = vocabulary.union(np.array([3, 1, 3, 2]), np.array([1, 5, 9, 2]))
    assert i.tolist() == [1, 2, 3] and c.tolist() == [5, 2, 9]
    # a term in more records than a container of arrays holds, over two containers and several tasks
    many = spark.range(70_000).selectExpr("'all' AS token", "format_string('%06d', id) AS doc_id", "cast(1 + id % 300 as int) AS tf").repartition(6)
    numbered = vocabulary.numbered_records(many)
    held = vocabulary.containers(many.union(many), numbered)
    assert held.count() == 2 and held.selectExpr("max(length(ids))").first()[0] == 8192
    r = vocabulary.frequencies(held).first()
    assert r["df"] == 70_000 and r["uses"] == sum(1 + i % 300 for i in range(70_000))


R = "query_id bigint, doc_id string, a double, b double, c double, scored_at timestamp, s int, v double"


def brute_ranks(rows):
    import datetime

    old = datetime.datetime.min
    last = {}
    for q, d, *vals, at, _, _ in rows:
        if q is not None and d is not None:
            key = (at or old, [(-math.inf if v is None or v != v else v) for v in vals])
            if (q, d) not in last or key > last[q, d][0]:
                last[q, d] = (key, [None if v is None or v != v else v for v in vals])
    out = {}
    for q in {q for q, _ in last}:
        items = {d: v for (x, d), (_, v) in last.items() if x == q}
        for d in items:
            places = []
            for s in range(3):
                have = [v[s] for v in items.values() if v[s] is not None]
                if len(set(have)) >= 2:
                    places.append(1 + sum(x > items[d][s] for x in have) if items[d][s] is not None else len(have) + 1)
            out[q, d] = (statistics.median(places), statistics.mean(places)) if places else (None, None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_median_rank(spark, seed):
    import datetime

    r = random.Random(seed)
    t = datetime.datetime(2024, 1, 1)
    val = lambda scale: r.choice([None, float("nan"), round(r.random() * scale, 1), round(r.random() * scale, 1), round(r.random() * scale, 1), 1e12])
    rows = [(q, f"d{r.randrange(12)}", val(3), val(1e6), 5.0 if q == 1 else val(1), r.choice([t, t + datetime.timedelta(days=i)]), 0, 0.0) for q in (1, 2, 2, 2, 3) for i in range(12)]
    # several scorings at one time are ordered by their values; leave those to the tie test below
    rows = list({(x[0], x[1], x[5]): x for x in rows}.values())
    rows += rows[:5] + [(None, "d1", 1.0, 1.0, 1.0, t, 0, 0.0), (1, None, 1.0, 1.0, 1.0, t, 0, 0.0), (9, "only", None, None, None, None, 0, 0.0), (8, "b", 1.0, 1.0, 1.0, t, 0, 0.0), (8, "a", 1.0, 1.0, 1.0, t, 0, 0.0)]
    df = spark.createDataFrame(rows, R)
    ranked = rankfuse.median_rank(df, ["a", "b", "c"])
    got = {(x["query_id"], x["doc_id"]): (x["median_rank"], x["mean_rank"]) for x in ranked.collect()}
    want = brute_ranks(rows)
    assert got.keys() == want.keys()
    for k, (m, a) in want.items():
        assert got[k] == (None, None) if m is None else abs(got[k][0] - m) < 1e-9 and abs(got[k][1] - a) < 1e-9
    order = lambda q: sorted((d for x, d in want if x == q), key=lambda d: (*(math.inf if v is None else v for v in want[q, d]), d))
    firsts = {x["query_id"]: x["doc_id"] for x in rankfuse.first_items(ranked).collect()}
    assert firsts == {q: order(q)[0] for q in {q for q, _ in want}} and firsts[8] == "a" and firsts[9] == "only"
    full = {}
    for x in rankfuse.fused(ranked).collect():
        full.setdefault(x["query_id"], {})[x["place"]] = x["doc_id"]
    assert all([full[q][i + 1] for i in range(len(full[q]))] == order(q) for q in full)


def test_weighted_median(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        rankfuse.weighted_median(F.array(*(F.lit(x).cast("bigint") for x in (1, 5, 9))), [1.0, 1.0, 3.0]).alias("heavy"),
        rankfuse.weighted_median(F.array(*(F.lit(x).cast("bigint") for x in (1, None, 9))), [1.0, 1.0, 1.0]).alias("two"),
        rankfuse.weighted_median(F.array(*(F.lit(x).cast("bigint") for x in (None, None))), [1.0, 1.0]).alias("none"),
    ).first()
    assert (row["heavy"], row["two"], row["none"]) == (9.0, 5.0, None)
    assert rankfuse.first_items(rankfuse.median_rank(spark.createDataFrame([], R), ["a", "b", "c"])).count() == 0


def test_one_query_holds_most_rows(spark):
    big = spark.range(4000).selectExpr("7L AS query_id", "concat('d', id) AS doc_id", "cast(id as double) AS a", "cast(-id as double) AS b", "cast(id % 10 as double) AS c", "timestamp'2024-01-01' AS scored_at")
    ranked = rankfuse.median_rank(big, ["a", "b", "c"])
    assert ranked.count() == 4000
    assert ranked.where("doc_id = 'd3999'").first()["median_rank"] == 1.0


def test_a_tie_over_a_third_of_all_rows(spark):
    from cairn.llm import rankfuse

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(1, f"d{i:04}", 1.0 if i % 3 else float(i), float(-i), 0.5) for i in range(2000)] + [(q, f"d{i}", float(i), float(i), 1.0) for q in range(2, 60) for i in range(20)]
        df = spark.createDataFrame(rows, "query_id int, doc_id string, a double, b double, c double").selectExpr("*", "TIMESTAMP '2024-01-01' AS scored_at", "1 AS rows")
        ranked = rankfuse.median_rank(df, ["a", "b", "c"])
        got = {(r["query_id"], r["doc_id"]): r for r in ranked.collect()}
        better = sum(1 for i in range(2000) if i % 3 == 0 and i > 1)
        assert len(got) == len(rows) and got[1, "d0001"]["median_rank"] == (1 + better + 2) / 2  # places in a and b; c does not count
        assert got[2, "d19"]["median_rank"] == 1.0 and got[2, "d0"]["mean_rank"] == 20.0
        out = {(r["query_id"], r["doc_id"]): r["place"] for r in rankfuse.fused(ranked).collect()}
        assert out[3, "d19"] == 1 and sorted(v for (q, _), v in out.items() if q == 1) == list(range(1, 2001))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_cardinality_of_containers():
    import numpy as np

    from cairn.llm import vocabulary

    for n in (0, 1, 4095, 4096, 65536):
        at = np.arange(n)
        assert vocabulary.cardinality(vocabulary.pack(at)) == n == len(vocabulary.unpack(vocabulary.pack(at)))
