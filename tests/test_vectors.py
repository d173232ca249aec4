import numpy as np
from pyspark.sql import functions as F

from cairn.functions import vectors as V
from cairn.operators import ann


def test_functions(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([], []), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert np.allclose(got, [0.5**0.5, 0, 0, 0])
    q = spark.range(1).select(V.quantize(F.array(*map(F.lit, [2.0, -2.0, 0.5 / 127, -0.5 / 127, 1.0]))).alias("q")).first()["q"]
    assert q == [127, -127, 1, -1, 127]
    r = spark.range(1).select(V.cosine_int8(F.expr("array(127Y, -127Y)"), F.expr("array(127Y, -127Y)")).alias("c"), V.hamming(F.lit(-1).cast("bigint"), F.lit(0).cast("bigint")).alias("h"), V.normalize(F.expr("array(0D, 0D)")).alias("z")).first()
    assert abs(r["c"] - 1) < 1e-12 and r["h"] == 64 and r["z"] == [0, 0]
    V.register_sql(spark)
    s = spark.sql("SELECT vec_cosine(array(3D, 4D), array(3D, 4D)) AS c, vec_norm(array(3D, 4D)) AS n, vec_quantize(array(1D)) AS q, vec_dequantize(vec_quantize(array(-1D))) AS d, vec_cosine(array(0D), array(1D)) AS z").first()
    assert abs(s["c"] - 1) < 1e-12 and s["n"] == 5 and s["q"] == [127] and s["d"] == [-1] and s["z"] == 0


def test_signatures_and_tiers(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-127, 128, 8).tolist()) for i in range(120)] + [(500, [0] * 8), (501, None), (502, [1])]
    planes = V.gaussian_planes(128, 8)
    index = ann.BucketIndex(spark.createDataFrame(rows, "doc_id int, q array<tinyint>"), planes, prefix_bits=4)
    kept = {r["doc_id"]: r for r in index.rows.collect()}
    assert set(kept) == {i for i, q in rows if q is not None and len(q) == 8} and kept[500]["sig"] == -1 and kept[500]["sig_high"] == -1
    for i, q in rows[:20]:
        bits = (np.array(q) @ planes.T >= 0).astype(object)
        assert kept[i]["sig"] & (2**64 - 1) == sum(1 << k for k in range(64) if bits[k]) and kept[i]["bucket"] == sum(1 << k for k in range(4) if bits[k])
    unit = lambda q: np.array(q) / max(np.linalg.norm(q), 1e-30)
    for k in (2, 12, 60, 200):
        for qi in (0, 7):
            own = kept[qi]["bucket"]
            tier = {i: bin(own ^ r["bucket"]).count("1") for i, r in kept.items()}
            n0, n1 = sum(t == 0 for t in tier.values()), sum(t <= 1 for t in tier.values())
            reach = 0 if n0 >= 2 * k else 1 if n1 >= k else 4
            want = sorted((-round(float(unit(kept[qi]["q"]) @ unit(kept[i]["q"])), 6) + 0.0, i) for i, t in tier.items() if t <= reach)[:k]
            got = index.query(spark.createDataFrame([(0, kept[qi]["q"])], "query_id int, q array<tinyint>"), k).orderBy("rank").collect()
            assert [r["doc_id"] for r in got] == [i for _, i in want]


def test_exact_and_recall(spark):
    v = spark.createDataFrame([(1, [1, 0]), (2, [1, 1]), (3, [0, 1])], "doc_id int, q array<tinyint>")
    best = ann.exact(v, spark.createDataFrame([(9, [1, 0])], "query_id int, q array<tinyint>"), 2)
    assert [r["doc_id"] for r in best.orderBy("rank").collect()] == [1, 2]
    assert ann.recall(best.where("rank = 1"), best).first()["recall"] == 0.5


def test_buckets_in_parts_and_passes_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.integers(-127, 128, (400, 16))
    x[:200] = x[0]  # half of all vectors in one bucket, all equal
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id bigint, q array<tinyint>")
    asked = df.where("doc_id % 9 = 0").selectExpr("doc_id AS query_id", "q")
    planes = V.hashed_planes(64, 16)
    key = lambda rows: sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in rows.collect())
    whole, exact = key(ann.BucketIndex(df, planes).query(asked, 7)), key(ann.exact(df, asked, 7))
    monkeypatch.setattr(ann, "PART", 30)
    monkeypatch.setattr(ann, "BLOCKS", 2)
    assert key(ann.BucketIndex(df, planes).query(asked, 7)) == whole
    assert key(ann.exact(df.repartition(3), asked, 7, block=5)) == exact
    m = x.astype(float)
    cos = np.round(m @ m.T / np.linalg.norm(m, axis=1)[:, None] / np.linalg.norm(m, axis=1), 6)
    for q in (0, 207, 396):
        want = sorted(range(400), key=lambda i: (-cos[q, i], i))[:7]
        assert [d for a, _, d, _ in exact if a == q] == want
    assert ann.exact(df.where("false"), asked, 3).count() == 0 and ann.exact(df, asked.where("false"), 3).count() == 0
