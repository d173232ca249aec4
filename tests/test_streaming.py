from cairn.operators.changelog import ChangeStore
from cairn.streaming import feed


def test_change_stream(spark, tmp_path):
    t = 1_704_000_000_000_000_000
    rows = [(1, 1, t + 5, "a", b"1"), (2, 2, t + 3, "a", None), (3, 1, t + 1, "b", b"2"), (4, 2, t + 2, "b", None), (5, 1, t + 9, "c", b"3")]
    for i, part in enumerate((rows[3:], rows[:2], rows[2:3])):
        spark.createDataFrame(part, feed.FEED).coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
    store = ChangeStore(spark, str(tmp_path / "store"), fanout=10)
    for _ in range(2):  # the second run finds nothing new
        feed.apply_stream(feed.read_changes(spark, str(tmp_path / "in/*"), 1), store, str(tmp_path / "check")).awaitTermination()
    assert {r["key"]: r["ts"] for r in store.read().collect()} == {"a": t + 5, "c": t + 9}
    assert len(store.runs) == 3


def test_ingest_stream(spark, tmp_path):
    spark.createDataFrame([("/a/x.txt", "one"), ("/a/y.txt", "one"), ("/a/z.txt", " "), ("/a/n.txt", None)], feed.TEXTS).coalesce(1).write.parquet(str(tmp_path / "in/p0"))
    go = lambda: feed.ingest_stream(feed.read_texts(spark, str(tmp_path / "in/*")), str(tmp_path / "docs"), str(tmp_path / "check")).awaitTermination()
    go()
    spark.createDataFrame([("/b/x.txt", "one"), ("/b/q.txt", "two")], feed.TEXTS).coalesce(1).write.parquet(str(tmp_path / "in/p1"))
    go()
    assert sorted(r["path"] for r in spark.read.parquet(str(tmp_path / "docs")).collect()) == ["/a/x.txt", "/b/q.txt"]


def test_change_rates(spark):
    t = 1_704_000_000
    df = spark.createDataFrame([(1, 1, t * 10**9, "a", None), (2, 2, t * 1000, "a", None), (3, 1, (t + 3600) * 10**6, "a", None), (4, None, t, "a", None)], feed.FEED)
    assert sorted((r["puts"], r["deletes"]) for r in feed.change_rates(df).collect()) == [(1, 0), (1, 1)]
