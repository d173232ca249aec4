"""Packing, mixing and subjects."""

import os
import random

import numpy as np
import pytest

from cairn.llm import mixture, packing, subjects, tokens

needs_tokenizer = pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no tokenizer file")


@needs_tokenizer
def test_token_counts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (4, "a b " * 50_000), (5, "<|endoftext|>")], "doc_id int, text string")
    got = {r["doc_id"]: r["tokens"] for r in tokens.token_counts(df).collect()}
    assert got[1] == got[2] == 0 and got[3] == 2 and got[4] >= 100_000 and got[5] > 1


def best_fit(sizes, capacity):
    """One best-fit-decreasing run over single items."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= s]
        if fit:
            i = min(fit, key=lambda i: rooms[i])
            rooms[i] -= s
        else:
            rooms.append(capacity - s)
    return len(rooms)


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    sizes = [min(100, max(1, int(r.lognormvariate(3, 0.8)))) for _ in range(300)]
    histogram = {s: sizes.count(s) for s in set(sizes)}
    _, bins = packing.plan(histogram, [100])
    assert sum(e - f for f, e, _, _ in bins) == best_fit(sizes, 100)
    _, joint = packing.plan(histogram, [25, 50, 100])
    room = sum((e - f) * c for f, e, c, _ in joint)
    assert sum(sizes) <= room <= best_fit(sizes, 100) * 100 and {c for _, _, c, _ in joint} <= {25, 50, 100}


@pytest.mark.parametrize("capacities", [[64], [16, 64, 256], [1]])
def test_packing(spark, capacities):
    r = random.Random(3)
    rows = [(i, r.choice([None, 0, -1, 7, r.randrange(1, 90), 700 if len(capacities) > 1 else 150])) for i in range(200)] + [(500, 30), (500, 30)]
    df = spark.createDataFrame(rows, "doc_id int, tokens bigint").selectExpr("*", "1 AS piece", "2 AS container")
    out = packing.pack(df, [*capacities, None, 0]).collect()
    top = max(capacities)
    fill, want = {}, {}
    for x in out:
        fill.setdefault(x["container"], []).append(x)
    for xs in fill.values():
        t = sum(x["tokens"] for x in xs)
        c = xs[0]["capacity_tokens"]
        assert t == xs[0]["filled"] <= c and c == min(k for k in capacities if k >= t)
    for i, n in rows:
        if n and n > 0:
            want.setdefault(i, []).append(n)
    for i, ns in want.items():
        mine = [x for x in out if x["doc_id"] == i]
        assert sum(x["tokens"] for x in mine) == sum(ns) and len(mine) == sum(-(-n // top) for n in ns)
    assert {x["doc_id"] for x in out} == want.keys()
    rep = packing.report(packing.pack(df, capacities)).first()
    assert rep["tokens"] == sum(map(sum, want.values())) and rep["containers"] == len(fill)
    assert packing.pack(df, []).count() == 0 and packing.pack(df.where("false"), capacities).count() == 0


MIX = "mix_id bigint, source string, target_share double, max_repeats int"


def test_mixture(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["Big", "big ", "b-i-g", "Small", None, "other"]), r.randrange(1, 40)) for i in range(3000)] + [(9000, "big", 0), (9001, "big", None), (None, "big", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, tokens int").selectExpr("*", "1 AS share", "2 AS mix_id")
    targets = [(1, "big", 30.0, 2), (1, "SMALL", 70.0, 3), (1, "ghost", 10.0, 1), (1, "other", None, 5), (1, "other", 0.0, 5), (2, "big", 0.5, None), (2, "other", 0.5, 1), (2, "other", 0.5, 1), (3, "ghost", 1.0, 1), (None, "big", 1.0, 1)]
    mix = spark.createDataFrame(targets, MIX)
    sized = mixture.usable(df)
    mixed = mixture.mixture(sized, mix)
    out = mixed.collect()
    total = {k: sum(t for _, s, t in rows if t and s and s.strip().lower().replace("-", "") == k) for k in ("big", "small", "other")}
    for m, shares, repeats in ((1, {"big": 0.3, "small": 0.7}, {"big": 2, "small": 3}), (2, {"big": 0.5, "other": 0.5}, {"big": 1, "other": 1})):
        mine = [x for x in out if x["mix_id"] == m]
        used = sum(x["tokens"] for x in mine)
        budget = min(repeats[s] * total[s] / w for s, w in shares.items())
        assert budget - 200 < used <= budget
        for s, w in shares.items():
            assert abs(sum(x["tokens"] for x in mine if x["source"].lower().replace("-", "").strip() == s) / used - w) < 0.01
        ids = [(x["id"], x["copy"]) for x in mine]
        assert len(ids) == len(set(ids)) and all(c <= max(repeats.values()) for _, c in ids)
        # every prefix of the reading order is mixed as well
        half = [x for x in sorted(mine, key=lambda x: x["place"])][: len(mine) // 2]
        for s, w in shares.items():
            assert abs(sum(x["tokens"] for x in half if x["source"].lower() == s.lower() or x["source"].lower().replace("-", "").strip() == s) / sum(x["tokens"] for x in half) - w) < 0.03
    assert {x["mix_id"] for x in out} == {1, 2}
    rep = {(x["mix_id"], x["source"].lower()): x for x in mixture.reached(mixed, mix).collect()}
    assert rep[1, "ghost"]["tokens"] == 0 and rep[3, "ghost"]["share"] is None and abs(rep[2, "other"]["share"] - 0.5) < 0.01 and rep[1, "small"]["most_copies"] <= 3
    small = mixture.mixture(sized, mix, budget=1000)
    assert small.where("mix_id = 1").agg({"tokens": "sum"}).first()[0] <= 1000
    assert mixture.mixture(sized.where("false"), mix).count() == 0 and mixture.mixture(sized, mix.where("false")).count() == 0


NOUNS = {s: [f"{s}{c}" for c in "abcdefghij"] for s in ("law", "sport", "space")}


def made(seed=1, docs=400):
    r = random.Random(seed)
    common = "the a of and is was seen by near under with first".split()
    rows, truth = [], {}
    for i in range(docs):
        want = r.sample(sorted(NOUNS), r.choice([1, 1, 1, 2]))
        lines = []
        for k in range(r.randrange(3, 12)):
            s = want[k % len(want)]
            lines.append(" ".join([*r.sample(common, 4), *r.sample(NOUNS[s], 2), f"name{r.randrange(400)}"]).capitalize() + ".")
            if r.random() < 0.3:
                lines.append("Nothing of note was seen by the first of us.")
        rows.append((i, " ".join(lines), "en", "notes", f"/x/{i % 7}"))
        truth[i] = set(want)
    return rows, truth


D = "doc_id bigint, text string, lang string, source string, root_dir string"


def test_subjects(spark):
    rows, truth = made()
    r = random.Random(2)
    labels = [(i, s.upper() + " ") for i in r.sample(range(400), 120) for s in truth[i]] + [(i, r.choice(sorted(NOUNS))) for i in r.sample(range(400), 10)] + [(5, None), (10**6, "law"), (None, "law"), (6, "cooking"), (6, "cooking")]
    rows += [(1000, None, "en", "notes", None), (1001, "", None, None, None), (1002, "Nothing here.", "en", None, "/x/1"), (1003, ("Lawa and lawb were seen. " * 3000), "en", "notes", "/x/2"), (None, "lawa lawb.", "en", "notes", "/x/2"), (0, rows[0][1], "en", "notes", "/x/0")]
    areas = spark.createDataFrame([("law", ""), ("Sport", ""), ("space ", ""), (None, "")], "subject string, about string")
    df = spark.createDataFrame(rows, D).selectExpr("*", "1 AS id", "'z' AS subject", "2 AS s")
    model = subjects.SubjectModel(df, spark.createDataFrame(labels, "doc_id bigint, subject string"), areas)
    got = {}
    for x in model.document_subjects().collect():
        got.setdefault(x["id"], set()).add(x["subject"])
    assert {n for ns in NOUNS.values() for n in ns} == set(model.lexicon.at)
    assert sum(got.get(i) == truth[i] for i in truth) >= 0.98 * len(truth)
    assert not {1000, 1001, 1002, None} & got.keys() and got[1003] == {"law"}
    assert model.accuracy[0] > 0.9
    total = subjects.composition(model.document_subjects()).collect()
    assert {x["subject"] for x in total} == {"law", "sport", "space"}


def test_names_decide_where_terms_do_not(spark):
    """Words that two subjects share say nothing alone; the folder or the source does, and the model learns to trust it."""
    r = random.Random(6)
    rows, truth = [], {}
    for i in range(600):
        vague = i % 5 == 1
        s = r.choice(["law", "sport"] if vague else ["law", "sport", "space", "space"])
        shared = ["ruling"] if s != "space" and i % 3 == 0 else []
        lines = [f"Ruling and more ruling of the name{r.randrange(400)}." for _ in range(2)] if vague else [" ".join(["The", *r.sample(NOUNS[s], 2), *shared, f"name{r.randrange(400)}"]) + "." for _ in range(4)]
        rows.append((i, " ".join(lines), "en", f"{s}-desk" if i % 7 else "notes", f"/x/{s}/{i % 7}" if i % 3 else "/x/misc/1"))
        truth[i] = s
    labels = spark.createDataFrame([(i, truth[i]) for i in range(600) if i % 5 in (0, 2)], "doc_id bigint, subject string")
    areas = spark.createDataFrame([("law", "Courts"), ("sport", "Players"), ("space", None)], "subject string, about string")
    df = spark.createDataFrame(rows, D)
    right = {}
    for name, how in (("all", {}), ("terms", {"address_col": "none", "source_col": "lang"})):
        model = subjects.SubjectModel(df, labels, areas, **how)
        got = {}
        for x in model.document_subjects().collect():
            got.setdefault(x["id"], set()).add(x["subject"])
        right[name] = sum(got.get(i) == {truth[i]} for i in range(1, 600, 5))
        told = {x["function"]: x for x in model.functions().collect()}
        if name == "all":
            assert told["address"]["coverage"] > 0.5 and told["source"]["coverage"] > 0.5 and told["address"]["accuracy"] > 0.9 and told["source"]["accuracy"] > 0.9
        else:
            assert told["address"]["coverage"] == 0
    assert right["all"] > 108 and right["terms"] < 90  # of 120


def test_patterns_in_jobs(spark, monkeypatch):
    rows, truth = made(docs=120)
    labels = spark.createDataFrame([(i, s) for i in truth if i % 2 for s in truth[i]], "doc_id bigint, subject string")
    areas = spark.createDataFrame([(s, None) for s in NOUNS], "subject string, about string")
    monkeypatch.setattr(subjects, "TERMS_AT_ONCE", 300)
    one = subjects.SubjectModel(spark.createDataFrame(rows, D), labels, areas)
    acc, prior = one._fit_in_jobs(3)
    assert np.allclose(acc, one.accuracy) and np.allclose(prior, one.prior)


def test_subjects_without_labels(spark):
    rows, _ = made(docs=20)
    none = spark.createDataFrame([], "doc_id bigint, subject string")
    areas = spark.createDataFrame([("law", "")], "subject string, about string")
    for a in (areas, areas.where("false")):
        assert subjects.SubjectModel(spark.createDataFrame(rows, D), none, a).document_subjects().count() == 0
    assert subjects.SubjectModel(spark.createDataFrame([], D), none, areas).document_subjects().count() == 0


def test_label_model_learns_who_is_right():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 4, 6000)
    votes = np.stack([np.where(rng.random(6000) < a, y, rng.integers(0, 4, 6000)) for a in (0.95, 0.7, 0.3)], axis=1)
    votes[rng.random(votes.shape) < 0.2] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    acc, _ = subjects.fit_accuracies(patterns, counts.astype(float), 4)
    assert acc[0] > 0.9 and acc[0] > acc[1] > acc[2]
    assert (subjects.posterior(votes, acc, np.full(4, 0.25)).argmax(axis=1) == y).mean() > 0.9


def test_no_rule_is_broken_and_breaks_are_seen(spark):
    r = random.Random(9)
    rows = [(i, r.choice(["a", "b", "c"]), r.randrange(1, 300)) for i in range(500)]
    sized = mixture.usable(spark.createDataFrame(rows, "doc_id bigint, source string, tokens int"))
    mix = spark.createDataFrame([(1, "a", 0.2, 1), (1, "b", 0.8, 2), (2, "c", 1.0, 3)], MIX)
    for fill in (0, 2):
        mixed = mixture.mixture(sized, mix, fill=fill)
        assert all(not any(x[1:]) for x in mixture.broken(sized, mix, mixed).collect())
    plan = {(x["mix_id"], x["source"]): x["binding"] for x in mixture.reached(mixed, mix, mixture.shares(sized, mix)).collect()}
    assert sorted(plan) == [(1, "a"), (1, "b"), (2, "c")] and plan[2, "c"] and plan[1, "a"] + plan[1, "b"] == 1
    seen = mixture.broken(sized, mix, mixed.unionByName(mixed.where("mix_id = 1"))).where("mix_id = 1").first()
    assert seen["overused"] and seen["doubled"] and seen["gaps"] and seen["over_budget"]
    items = spark.createDataFrame([(i, r.randrange(1, 90)) for i in range(300)], "doc_id bigint, tokens int")
    packs = [(1, 32), (2, 64)]
    packed = packing.pack(items, [32, 64]).selectExpr("CAST(NULL AS BIGINT) AS pack_id", "*")
    for p, c in packs:
        packed = packed.unionByName(packing.pack(items, [c]).selectExpr(f"CAST({p} AS BIGINT) AS pack_id", "*"))
    assert [x[1:] for x in packing.broken(items, packed, packs).collect()] == [(300, 0, 0, 0)] * 3
    short = packing.broken(items, packed.where("doc_id <> 7 AND container <> 3"), packs).collect()
    assert all(x["bad_texts"] > 0 for x in short)
    assert all(x["bad_containers"] > 0 for x in packing.broken(items, packed.withColumn("tokens", packed["tokens"] + 1), packs).collect())
    assert packing.broken(items, packed, []).count() == 0
