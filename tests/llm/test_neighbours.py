"""Near-duplicates and nearest vectors against brute force."""

import random
import re

import numpy as np
import pytest

from cairn.llm import neardup, neighbours, queries


def sets_of(text, k):
    w = [x.lower() for x in re.findall(r"[^\W_]+", text or "")]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    shared = " ".join(r.choice(words) for _ in range(40))
    rows = []
    for i in range(40):
        base = [r.choice(words) for _ in range(r.choice([5, 30, 80, 200]))]
        if i % 4 == 0:
            base += shared.split()
        for j in range(r.randrange(1, 5)):
            x = list(base)
            for _ in range(r.randrange(0, 1 + len(x) // 12)):
                at = r.randrange(len(x))
                x[at : at + r.randrange(2)] = [r.choice(words)] * r.randrange(2)
            text = " ".join(x)
            rows.append((f"{i:02}-{j}", text.upper() if r.random() < 0.2 else text.replace(" ", ", ")))
    return rows + [("copy", rows[0][1]), ("copy", rows[0][1]), ("null", None), ("empty", ""), ("short", "one two"), ("short2", "one two"), (None, rows[0][1]), ("long", "x y z " * 20000), ("long2", "x y z " * 20000)]


@pytest.mark.parametrize("words,threshold", [(3, 0.6), (5, 0.8)])
def test_all_links_are_found(spark, words, threshold):
    rows = corpus(words)
    s = {i: sets_of(t, words) for i, t in rows if i is not None}
    ids = sorted(i for i in s if s[i])
    want = {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(s[a] & s[b]) / len(s[a] | s[b]) >= threshold}
    df = spark.createDataFrame(rows, "doc_id string, content string").selectExpr("*", "1 AS rep", "2 AS v", "3 AS id")
    members, linked = neardup.near_duplicates(df, words=words, threshold=threshold)
    got = {(r["id_a"], r["id_b"]) for r in neardup.all_pairs(members, linked).collect()}
    assert got == want and len(want) > 20
    counts = {r["id"]: r for r in neardup.link_counts(members, linked).collect()}
    assert counts.keys() == set(ids) and counts["long"]["class_size"] == 2 and counts["long"]["n_links"] == 0


def test_plan_bounds_the_misses():
    for t in (0.5, 0.6, 0.8, 0.9):
        m, r = neardup.plan(t)
        p = t**r + r * t ** (r - 1) * (1 - t)
        assert m * r <= 160 and (1 - p) ** m <= 1e-5


def test_no_rows(spark):
    members, linked = neardup.near_duplicates(spark.createDataFrame([], "doc_id string, content string"))
    assert neardup.all_pairs(members, linked).count() == 0 and neardup.link_counts(members, linked).count() == 0


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((30, dims))
    return centres[rng.integers(0, 30, n)] + 0.5 * rng.standard_normal((n, dims))


def test_recall(spark):
    x = clustered(3000, 64, 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vec array<double>")
    got = {}
    for r in neighbours.VectorIndex(df, "id", "vec").neighbours_of_all().collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for i in range(3000):
        c = u @ u[i]
        c[i] = -9
        hit += len(set(got[i]) & set(np.argsort(-c)[:5].tolist()))
        assert len(got[i]) == 5 and i not in got[i]
    assert hit / 15000 >= 0.97


def test_recall_without_clusters(spark):
    x = np.random.default_rng(4).standard_normal((1500, 64))
    df = spark.createDataFrame([(f"t{i}", v.tolist()) for i, v in enumerate(x)], "id string, vec array<double>")
    index = neighbours.VectorIndex(df, "id", "vec")
    got = {}
    for r in index.neighbours_of_all().collect():
        got.setdefault(int(r["id"][1:]), set()).add(int(r["neighbour"][1:]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    np.fill_diagonal(cos, -9)
    want = np.argsort(-cos, axis=1)[:, :5]
    assert sum(len(got[i] & set(w.tolist())) for i, w in enumerate(want)) / want.size >= 0.99
    assert index.probes_for(5) <= index.nlists


def test_hot_list_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 50)
    x = np.concatenate([np.ones((400, 8)) + 1e-3 * np.random.default_rng(2).standard_normal((400, 8)), clustered(300, 8, 3)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vec array<double>")
    index = neighbours.VectorIndex(df, "id", "vec", dims=8, nlists=4)
    assert max(index.blocks) > 3
    got = {}
    for r in index.search(index.vectors, 3, nprobe=4, rerank=64).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for i in range(len(x)):
        c = np.round(u @ u[i], 12)
        c[i] = -9
        hit += len(got[i] & set(sorted(range(len(x)), key=lambda j: (-c[j], j))[:3]))
    assert hit / (3 * len(x)) > 0.97


def test_neighbours_of_both_tables(spark, tmp_path):
    x = [[float(v) for v in row] for row in np.random.default_rng(6).integers(-9, 9, (20, 64))]
    spark.createDataFrame([(f"d{i}", [int(v) for v in row]) for i, row in enumerate(x)], "doc_id string, q array<tinyint>").write.parquet(str(tmp_path / "doc_vec.parquet"))
    spark.createDataFrame([(f"t{i}", row) for i, row in enumerate(x)], "token string, vec array<double>").write.parquet(str(tmp_path / "token_vec.parquet"))
    got = queries.p7_neighbours(spark, str(tmp_path)).collect()
    for name, letter in (("doc_vec", "d"), ("token_vec", "t")):
        own = [r for r in got if r["vectors"] == name]
        assert len(own) == 100 and {r["id"] for r in own} == {f"{letter}{i}" for i in range(20)} and all(r["neighbour"][0] == letter for r in own)


def test_vector_edges(spark):
    rows = [("a", [1, 0]), ("b", [2, 0]), ("c", [0, 5]), ("a", [1, 0]), ("zero", [0, 0]), ("short", [1]), ("null", None), ("part", [None, 1]), (None, [1, 1]), ("empty", [])]
    df = spark.createDataFrame(rows, "k string, q array<tinyint>").selectExpr("*", "1 AS id", "2 AS list", "3 AS vec")
    index = neighbours.VectorIndex(df, "k", "q", dims=2)
    got = sorted((r["id"], r["neighbour"], round(r["similarity"], 9)) for r in index.neighbours_of_all().collect())
    assert got == [("a", "b", 1.0), ("a", "c", 0.0), ("b", "a", 1.0), ("b", "c", 0.0), ("c", "a", 0.0), ("c", "b", 0.0)]
    exact = neighbours.exact_neighbours(index.vectors, index.vectors, 1)
    assert {(r["id"], r["neighbour"]) for r in exact.collect()} == {("a", "b"), ("b", "a"), ("c", "a")}
    assert neighbours.VectorIndex(df.where("false"), "k", "q", dims=2).neighbours_of_all().count() == 0
    assert index.search(index.vectors.where("false")).count() == 0


@pytest.mark.parametrize("threshold", [0.2, 0.6])
def test_blocks_of_hot_keys_lose_nothing(spark, monkeypatch, threshold):
    rows = [(f"v{i:03}", " ".join(["same words in every one of these many texts here"] * 1 + [f"a{i} b{i}"] + [f"c{j}" for j in range(i % 7)])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id string, content string")
    s = {i: sets_of(t, 3) for i, t in rows}
    want = {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) / len(s[a] | s[b]) >= threshold}
    for hot in (4, 1024):
        monkeypatch.setattr(neardup, "HOT", hot)
        got = {(r["a"], r["b"]) for r in neardup.near_duplicates(df, words=3, threshold=threshold)[1].collect()}
        assert got == want and len(want) > 100


def test_low_thresholds_have_a_plan():
    for t in (0.01, 0.2, 0.25):
        m, r = neardup.plan(t)
        assert (1 - t**r - r * t ** (r - 1) * (1 - t)) ** m <= 1.001e-5
    with pytest.raises(ValueError):
        neardup.plan(0)


def test_components(spark):
    r = random.Random(4)
    chain, hub = [(i, i + 1) for i in range(70)], [(100, i) for i in range(101, 160)]
    loose = [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    edges = chain + hub + [(b, a) for a, b in loose] + chain[:5]
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {x["id"]: x["root"] for x in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}
    assert neardup.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_words_are_lowered_as_single_words(spark):
    texts = ["ΑΣ'Α İstanbul one two", "ΑΣ Α İstanbul one two", "plain words one two"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(neardup.shingles(df["t"], 2)).collect()]
    assert got[0] == got[1] and len(got[2]) == 3


def test_every_component_counts(spark):
    rng = np.random.default_rng(3)
    for dims in (5, 19):  # fewer components than sub-spaces, and a number they don't divide
        x = rng.standard_normal((300, dims))
        x[:, :-1] *= 0.01  # the last component tells the most
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vec array<double>")
        index = neighbours.VectorIndex(df, "id", "vec", dims=dims)
        assert sum(b.shape[1] for _, b in index.model.books) == dims and len(index.model.books) == min(dims, 16)
        found = {(r["id"], r["neighbour"]) for r in index.neighbours_of_all().collect()}
        want = {(r["id"], r["neighbour"]) for r in neighbours.exact_neighbours(index.vectors, index.vectors).collect()}
        assert len(found & want) >= 0.9 * len(want)


def test_lists_beyond_one_level(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(neighbours, "TWO_LEVEL", 50)
    model = neighbours.train(x, 200)
    assert 150 <= len(model.centroids) <= 200 and np.isfinite(model.centroids).all()
    lists, _ = model.encode(x.astype(np.float32))
    assert len(np.unique(lists)) > 100


def test_very_large_and_small_components(spark):
    rows = [(0, [1e300, 0.0]), (1, [1.0, 0.01]), (2, [1e-300, 0.0]), (3, [0.0, 1e-310]), (4, [0.0, 2.0]), (5, [float("inf"), 1.0])]
    index = neighbours.VectorIndex(spark.createDataFrame(rows, "id int, vec array<double>"), "id", "vec", dims=2)
    got = {}
    for r in index.neighbours_of_all(1).collect():
        got[r["id"]] = r["neighbour"]
    assert got == {0: 2, 1: 0, 2: 0, 3: 4, 4: 3}
