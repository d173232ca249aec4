"""Lexical index, fusion, ranker, snippets, subwords, embeddings, ingest and the whole engine on small collections."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import embed, fusion, lexical, ranker, subwords, summarize
from cairn.plans.search import RESULT, Engine, as_json
from cairn.sources import ingest

DOCS = [(1, "the cat sat on the mat."), (2, "a dog and a cat"), (3, "birds fly over the sea"), (4, None), (5, ""), (6, "the the the sea sea"), (7, "quiet night")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id int, text string")


def bm25(query):
    toks = {i: t.replace(".", " .").split() for i, t in DOCS if t is not None}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    out = {}
    for i, ts in toks.items():
        s = 0.0
        for w in query:
            df, tf = sum(w in x for x in toks.values()), ts.count(w)
            if tf:
                s += max(0, math.log(n - df + 0.5) - math.log(df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / avg))
        if s > 0:
            out[i] = round(s, 6)
    return out


@pytest.mark.parametrize("query", [["cat"], ["cat", "cat", "sea"], ["the"], ["unknown"], []])
def test_bm25(docs, query):
    tokens = lexical.tokenized(docs)
    want = bm25(query)
    for scores in (lexical.scan_scores(tokens, query), lexical.LexicalIndex.build(tokens).scores(query)):
        assert {r["doc_id"]: round(r["score"], 6) for r in scores.collect()} == want
    order = [r["doc_id"] for r in lexical.top(lexical.scan_scores(tokens, query), 2).orderBy("rank").collect()]
    assert order == sorted(want, key=lambda i: (-want[i], i))[:2]


def test_fusion(spark):
    a = spark.createDataFrame([(1, 9.0, 1), (2, 8.0, 2)], "doc_id int, score double, rank int")
    b = spark.createDataFrame([(2, 0.9, 1), (3, 0.8, 2)], "doc_id int, score double, rank int")
    got = {r["doc_id"]: r for r in fusion.rrf(a, b, 10).collect()}
    assert got[2]["score"] == round(1 / 62 + 1 / 61, 6) and got[1]["embed_score"] == 0 and got[3]["bm25_score"] == 0
    assert [r["rank"] for r in sorted(got.values(), key=lambda r: (-r["score"], r["doc_id"]))] == [1, 2, 3]
    w = ranker.initial(3)
    x = [[9.0, 0.0, 1 / 61], [8.0, 0.9, 1 / 62 + 1 / 61], [0.0, 0.8, 1 / 62]]
    want = dict(zip((1, 2, 3), ranker.forward(w, np.array(x)).round(6)))
    assert all(abs(r["score"] - want[r["doc_id"]]) < 2e-6 for r in fusion.mlp(a, b, w, 10).collect())
    assert fusion.rrf(a.where("false"), b.where("false"), 3).count() == 0


def test_ranker_learns(spark):
    _, losses = ranker.trained(spark, epochs=20)
    assert losses[-1] < losses[0] and list(ranker.forward(ranker.initial(), np.zeros((2, 5)))) == [0, 0]


def test_snippets(spark):
    long = "An apple tree grows in the garden of apples. The apple garden has a tall tree with apples. Nobody came to the party yesterday evening. Apples from the tree fill the garden basket. Trees need water and light."
    few = "x" * 700 + " is one very long sentence. And this is a second sentence."
    df = spark.createDataFrame([(1, long), (2, few), (3, ""), (4, None), (5, "word " * 30000)], "doc_id int, text string")
    got = {}
    for r in summarize.snippets(df).collect():
        got.setdefault(r["doc_id"], []).append((r["pos"], r["score"]))
    assert len(got[2]) == 2 and all(s == 1.0 for _, s in got[2])
    assert len(got[1]) == 3 and [p for p, _ in got[1]] == sorted(p for p, _ in got[1]) and 2 not in [p for p, _ in got[1]]
    assert 3 not in got and 4 not in got
    shown = {r["doc_id"]: r["snippet"] for r in summarize.snippet_strings(df).collect()}
    assert shown[3] == "" and 4 not in shown and shown[1].startswith("An apple")
    lonely = np.zeros((3, 3))
    assert np.allclose(summarize.pagerank(lonely), 0.05)  # rank of sentences without edges is lost, as defined


def test_budget_stops_at_first_overflow():
    parts = ["a" * 300 + "b", "c" * 300, "d", "e" * 20]
    bags = [["w"], ["w"], ["w"], ["z"]]
    assert [i for i, _ in summarize.pick(parts, bags)] == [0]


def test_subwords(spark):
    merges = [("a", "b"), ("ab", "c"), ("b", "c"), ("a", "b")]
    ranks = subwords.rank_of(merges)
    for word in ["abc", "bc", "ababc", "cab", "", "x", "abcabc", "bcb"]:
        slow = list(word)
        for a, b in merges:
            slow = subwords.apply_merge(slow, a, b)
        assert subwords.encode_word(word, ranks) == slow
    assert subwords.apply_merge(list("aaa"), "a", "a") == ["aa", "a"]
    tokens = spark.createDataFrame([(1, ["abc", "?"]), (2, [])], "doc_id int, tokens array<string>")
    encoded = subwords.encode(tokens, merges)
    ids = subwords.encode_ids(encoded, merges)
    assert {r["doc_id"]: r["text"] for r in subwords.decode(ids, merges).collect()} == {1: "abc", 2: ""}
    odd = spark.createDataFrame([(1, [99, 0])], "doc_id int, ids array<int>")
    assert subwords.decode(odd, merges).first()["text"] == " a"
    pairs = subwords.pair_frequencies(spark.createDataFrame([(1, ["ab", "ab", "bc"])], "doc_id int, tokens array<string>"))
    assert tuple(subwords.best_pair(pairs).first()) == ("a", "b", 2) and subwords.best_pair(pairs, 3).count() == 0


def test_subwords_beyond_ascii(spark, tmp_path):
    file = tmp_path / "t.json"  # byte-level: e acute is the bytes C3 A9, which stand as two characters
    rules = ["a b", "\u00c3 \u00a9", "\u00c3\u00a9 t", "\u0120 a", "t \u00c3"]
    file.write_text(json.dumps({"model": {"merges": rules}}), encoding="utf-8")
    merges = subwords.read_merges(str(file))
    assert merges == [("a", "b"), ("\u00e9", "t")]
    words = ["\u00e9tab", "stra\u00dfe", "\u4e2d"]
    tokens = spark.createDataFrame([(1, words)], "doc_id int, tokens array<string>")
    chars, encoded = subwords.characters(tokens), subwords.encode(tokens, merges)
    assert set(chars) == set("".join(words))
    ids = subwords.encode_ids(encoded, merges, chars)
    assert encoded.first()["tokens"][:2] == ["\u00e9t", "ab"]
    assert subwords.decode(ids, merges, chars).first()["text"].split(" ") == encoded.first()["tokens"]
    assert any(not (a + b).isascii() for a, b in subwords.read_merges())


def test_cooccurrence_and_vectors(spark):
    texts = {1: "a b c a b".split(), 2: "a a z".split(), 3: ["q"]}
    tokens = spark.createDataFrame(list(texts.items()), "doc_id int, tokens array<string>")
    vocab = embed.vocabulary(tokens, 2, 10)
    names = {r["i"]: r["token"] for r in vocab.collect()}
    assert sorted(names.values()) == ["a", "b"]
    want = {}
    for ts in texts.values():
        for i, x in enumerate(ts):
            for j, y in enumerate(ts):
                if i != j and abs(i - j) <= 5 and x in "ab" and y in "ab":
                    want[x, y] = want.get((x, y), 0) + 1 / abs(i - j)
    cooc = embed.cooccurrence(tokens, vocab, 5)
    got = {(names[r["w1"]], names[r["w2"]]): r["weight"] for r in cooc.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    unknown = embed.document_vectors(tokens, spark.createDataFrame([("a", [3.0, 4.0])], "token string, vec array<double>"))
    vec = {r["doc_id"]: r["vec"] for r in unknown.collect()}
    assert np.allclose(vec[1], [0.6, 0.8]) and vec[3] == [0, 0]


def test_vectors_of_the_whole_vocabulary(spark, monkeypatch):
    rng = np.random.default_rng(1)
    words = [f"w{i:04}" for i in range(2100)]
    rows = [(i, [words[int(x)] for x in rng.permutation(2100)[:1050]]) for i in range(3)] + [(9, words), (10, words[::-1])]
    tokens = spark.createDataFrame(rows, "doc_id int, tokens array<string>")
    from cairn.plans import retrieval

    config = retrieval._WHOLE
    assert config.dimensions == 100 and embed.vocabulary(tokens, config.min_frequency, config.max_vocab).count() == 2100
    few = embed.Config(dimensions=4, max_iterations=3, max_vocab=0)
    driver = {r["token"]: r["vec"] for r in embed.token_vectors(tokens, few).collect()}
    assert driver.keys() == set(words) and len(driver["w0000"]) == 4
    monkeypatch.setattr(embed, "ON_DRIVER", 0)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")  # several files in one task
    tasks = {r["token"]: r["vec"] for r in embed.token_vectors(tokens, few).collect()}
    spark.conf.unset("spark.sql.files.minPartitionNum")
    assert driver.keys() == tasks.keys() and all(np.allclose(driver[t], tasks[t], atol=1e-6) for t in driver)


def test_models_beyond_one_machine(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    m = v @ np.diag([50, 20, 9, 4, *[0.1] * 56]) @ v.T
    i, j = np.nonzero(np.ones_like(m))
    entries = spark.createDataFrame(list(zip(i.tolist(), j.tolist(), m[i, j].tolist())), "i int, j int, v double")
    want = embed.truncated_svd(i, j, m[i, j], 60, 4, tolerance=1e-9)
    monkeypatch.setattr(embed, "SIDE", 16)
    rows, kept = embed.distributed_svd(entries, 60, 4, tolerance=1e-9)
    got = np.array([r["vec"] for r in rows.orderBy("i").collect()])
    assert kept == 4 and np.allclose(got, want, atol=1e-5) and np.allclose(got.T @ got, np.eye(4), atol=1e-8)
    low, kept = embed.distributed_svd(spark.createDataFrame([(0, 0, 2.0), (7, 7, 1.0)], "i int, j int, v double"), 9, 4)
    assert kept == 2 and {r["i"]: np.round(r["vec"], 6).tolist() for r in low.collect()} == {0: [1, 0], 7: [0, 1]}

    tokens = spark.createDataFrame([(k, [f"{t}{n}" for n in range(5)] * 3 + ["lone"] * (k < 2)) for k, t in enumerate("aabbbcccc")] + [(99, [])], "doc_id int, tokens array<string>")
    config = embed.Config(dimensions=3, max_vocab=0, max_iterations=6)
    here = {r["token"]: r["vec"] for r in embed.token_vectors(tokens, config).collect()}
    near = {r["doc_id"]: r["vec"] for r in embed.document_vectors(tokens, embed.token_vectors(tokens, config)).collect()}
    monkeypatch.setattr(embed, "MODEL_ROWS", 5)
    vectors = embed.token_vectors(tokens, config)
    far = {r["token"]: r["vec"] for r in vectors.collect()}
    cos = lambda x, a, b: float(np.dot(x[a], x[b]) / max(1e-12, np.linalg.norm(x[a]) * np.linalg.norm(x[b])))
    assert far.keys() == here.keys() and all(abs(cos(far, f"{a}0", f"{b}1") - cos(here, f"{a}0", f"{b}1")) < 1e-4 for a in "abc" for b in "abc")
    docs = {r["doc_id"]: r["vec"] for r in embed.document_vectors(tokens, vectors).collect()}
    assert docs.keys() == near.keys() and docs[99] == [0, 0, 0] and all(abs(cos(docs, 0, d) - cos(near, 0, d)) < 1e-4 for d in docs)


def test_svd_against_numpy():
    rng = np.random.default_rng(0)
    u, v = (np.linalg.qr(rng.standard_normal((60, 60)))[0] for _ in range(2))
    m = u @ np.diag([50, 20, 9, 4, *[0.1] * 56]) @ v.T
    i, j = np.nonzero(np.ones_like(m))
    got = embed.truncated_svd(i, j, m[i, j], 60, 4, steps=200, tolerance=1e-12)
    assert np.allclose(got.T @ got, np.eye(4), atol=1e-8) and np.allclose(np.abs(got.T @ v[:, :4]), np.eye(4), atol=1e-4)
    assert (got[np.abs(got).argmax(axis=0), range(4)] > 0).all()
    low = embed.truncated_svd(np.array([0, 1]), np.array([0, 1]), np.array([2.0, 1.0]), 5, 4)
    assert low.shape == (5, 2)  # never more vectors than the rank has


def test_ingest(spark, tmp_path):
    files = {"a.txt": b"hello", "sub/b.MD": b"hello", "c.pdf": b"no", "blank.txt": "  \n".encode(), "bad.log": b"\xff\xfe", "_draft.md": b"Spark lists no hidden files"}
    for name, data in files.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data)
    scanned = ingest.scan_files(spark, str(tmp_path))
    tagged = ingest.against_known(scanned, spark.createDataFrame([], "doc_id string"))
    r = ingest.report(tagged).first()
    assert (r["total"], r["ingested"], r["skipped"], r["duplicates"], r["errors"], r["bytes"]) == (4, 1, 1, 1, 1, 5)
    stored = ingest.accepted(tagged)
    assert {x["title"] for x in stored.collect()} == {"a"}
    again = ingest.report(ingest.against_known(scanned, stored)).first()
    assert again["ingested"] == 0 and again["duplicates"] == 2


@pytest.fixture(scope="module")
def engine(spark):
    words = "comet orbit planet telescope star glacier flood storm river rain verdict jury court law trial".split()
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        group = words[(i % 3) * 5 : (i % 3) * 5 + 5]
        rows.append((f"d{i:02}", f"t{i}", f"/x/t{i}.txt", ". ".join(" ".join(rng.choice(group, 6)) for _ in range(5)) + "."))
    docs = spark.createDataFrame(rows, "doc_id string, title string, path string, content string")
    return Engine.build(docs, embed.Config(dimensions=6, max_vocab=200), merges=[("c", "o"), ("co", "m")])


def test_hybrid_search(spark, engine, tmp_path):
    got = engine.search("comet telescope", 5).orderBy("rank").collect()
    assert len(got) == 5 and [r["rank"] for r in got] == [1, 2, 3, 4, 5] and got[0].asDict().keys() == set(RESULT)
    assert all("comet" in r["snippet"] or "orbit" in r["snippet"] or "star" in r["snippet"] or "planet" in r["snippet"] for r in got)
    value = json.loads(as_json(engine.search("comet", 3, mode="rrf"), "comet", 7).first()["value"])
    assert value["count"] == 3 and value["query"] == "comet" and [x["rank"] for x in value["results"]] == [1, 2, 3]
    nothing = engine.search("zzzz", 4).collect()
    assert len(nothing) == 4  # a query without a known token still has neighbours of the zero vector
    engine.save(str(tmp_path / "store"))
    again = Engine.load(spark, str(tmp_path / "store")).search("comet telescope", 5).orderBy("rank").collect()
    assert [r["doc_id"] for r in again] == [r["doc_id"] for r in got]
    assert engine.stats().first()["documents"] == 60 and engine.points().where(F.abs("x") > 1).count() == 0


def test_stores_change_by_a_rename(spark, engine, tmp_path):
    from dataclasses import replace

    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        Engine.load(spark, path)
    engine.save(path)
    replace(engine, version=str(int(engine.version) + 1), weights=None).save(path)
    pointers = [p.name for p in (tmp_path / "store").glob("CURRENT-*.json")]
    loaded = Engine.load(spark, path)
    assert len(pointers) == 1 and loaded.version == str(int(engine.version) + 1) and loaded.weights is None
    assert len(loaded.query_point("nothing known here")) == 2


def test_unread_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "ok.md").write_text("words")
    (tmp_path / "a" / "bad.txt").write_bytes(b"\xff\xfe")
    assert ingest.unread(spark, str(tmp_path)).count() == 0  # both can be read, one is no text
    assert {r["path"].rsplit("/", 1)[1]: r["status"] for r in ingest.scan_files(spark, str(tmp_path)).collect()} == {"ok.md": "ok", "bad.txt": "error"}


def test_checksums(spark):
    from cairn.functions.checksum import crc32c, crc32c_of

    assert crc32c_of([b"123456789", b"", b"a"]).tolist() == [0xE3069283, 0, 0xC1D04330]
    df = spark.createDataFrame([(b"123456789",), (None,), (b"",), (b"x" * 100_000,)], "v binary")
    got = [r[0] for r in df.select(crc32c(df["v"])).collect()]
    assert got[:3] == [0xE3069283, None, 0] and got[3] == crc32c_of([b"x" * 100_000])[0]


def test_intermediate_tables_are_released(spark):
    import os

    from cairn import session

    before = session.materialize(spark.range(3), "kept")
    with session.released(spark):
        path = session.materialize(spark.range(5), "gone").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path) and before.count() == 3
    paths = {}

    def query(spark, n):
        for name in ("read", "other"):
            table = session.materialize(spark.range(n), name)
            paths[name] = table.inputFiles()[0].removeprefix("file://")
            if name == "read":
                out = table.groupBy("id").count()
        return out

    result = session.tidy(query)(spark, 4)
    assert os.path.exists(paths["read"]) and not os.path.exists(paths["other"]) and result.count() == 4 and before.count() == 3


def test_long_texts_are_ranked_without_a_matrix(monkeypatch):
    import random

    from cairn.operators import summarize

    r = random.Random(3)
    bags = [[f"w{r.randrange(60)}" for _ in range(r.randrange(0, 9))] for _ in range(200)] + [["alone"], []]
    dense = summarize.ranks(bags)
    monkeypatch.setattr(summarize, "DENSE", 5)
    assert np.allclose(summarize.ranks(bags), dense, atol=1e-12)
    long = [[f"w{r.randrange(5000)}" for _ in range(8)] for _ in range(60_000)]  # 3.6e9 similarities
    assert len(summarize.ranks(long)) == 60_000


def test_pairs_of_a_joined_vocabulary(spark, monkeypatch):
    import random

    r = random.Random(5)
    rows = [(i, [f"t{r.randrange(30)}" for _ in range(r.randrange(0, 60))]) for i in range(50)]
    tokens = spark.createDataFrame(rows, "doc_id int, tokens array<string>")
    vocab = embed.vocabulary(tokens, 2, 25)
    key = lambda df: sorted(map(tuple, df.collect()))
    whole = key(embed.cooccurrence(tokens, vocab, 5))
    monkeypatch.setattr(embed, "PAIRS_AT_ONCE", 50)
    assert key(embed.cooccurrence(tokens, vocab, 5)) == whole
    monkeypatch.setattr(embed, "MODEL_ROWS", 3)
    assert key(embed.cooccurrence(tokens, vocab, 5)) == whole and len(whole) > 300
    assert embed.cooccurrence(tokens.where("false"), vocab, 5).count() == 0 and embed.cooccurrence(tokens, vocab.where("false"), 5).count() == 0
