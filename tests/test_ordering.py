from cairn.operators.ordering import join_counted, number_rows
from cairn.operators.prefix import running_sums


def test_number_rows(spark):
    df = spark.createDataFrame([(i % 7, f"n{i:04}") for i in range(500)] + [(3, "hot")] * 300, "a int, b string")
    got = [(r["a"], r["b"]) for r in sorted(number_rows(df, ["a", "b"]).collect(), key=lambda r: r["pos"])]
    assert got == sorted(got) and len(got) == 800
    assert sorted(r["pos"] for r in number_rows(df, ["a", "b"]).collect()) == list(range(800))
    assert number_rows(df.where("false"), ["a"]).columns == ["a", "b", "pos"] and number_rows(df.where("false"), ["a"]).count() == 0


def test_running_sums(spark):
    rows = [("x" if i % 3 else "y", i, i % 5) for i in range(400)]
    got = {(r["g"], r["o"]): r["sum"] for r in running_sums(spark.createDataFrame(rows, "g string, o int, v int"), ["g"], ["o"], "v").collect()}
    for g in "xy":
        total = 0
        for _, o, v in sorted(r for r in rows if r[0] == g):
            total += v
            assert got[g, o] == total


def test_join_counted(spark):
    facts = spark.createDataFrame([("hot", i) for i in range(5000)] + [(f"c{i % 50}", i) for i in range(500)], "k string, i int")
    sizes = facts.groupBy("k").count()
    got = join_counted(facts, sizes, "k", "count", 5500)
    assert got.count() == 5500 and got.where("k = 'hot' AND count <> 5000").count() == 0


def test_intermediate_tables_are_released(spark):
    import os

    from cairn import session

    made = session.materialize(spark.range(5), "kept")
    folder = session._WRITTEN[spark.sparkContext.applicationId][-1]
    assert made.count() == 5 and os.path.isdir(folder)
    before = session._WRITTEN.pop(spark.sparkContext.applicationId)
    session._WRITTEN[spark.sparkContext.applicationId] = [folder]
    assert session.release(spark) == 1 and not os.path.exists(folder)
    session._WRITTEN[spark.sparkContext.applicationId] = before[:-1]
