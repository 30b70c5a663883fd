from pyspark.sql import functions as F

from lexigraph.operators import picks as p

S = "k string, v string, source string, o int"


def df(spark, data):
    return spark.createDataFrame(data, S)


def test_first_and_last(spark, rows):
    d = df(spark, [("a", "x", "s", 2), ("a", "y", "s", 1), ("a", "z", "s", None), ("b", None, None, 5)])
    assert rows(p.first_wins(d, ["k"], "o")) == [("a", "y", "s", 1), ("b", None, None, 5)]
    assert rows(p.last_wins(d, ["k"], "o")) == [("a", "x", "s", 2), ("b", None, None, 5)]


def test_priority_earliest_wins_ties(spark, rows):
    d = df(spark, [("a", "x", "s1", 2), ("a", "y", "s1", 1), ("a", "w", "s0", 0), ("b", None, "s1", 1), ("c", "q", "other", 1)])
    assert rows(p.priority_pick(d, ["k"], "v", p.priority(F.col("source"), {"s0": 1, "s1": 2}), "o")) == [("a", "y"), ("c", "q")]


def test_tie_goes_to_review(spark, rows):
    d = df(spark, [("a", "child", "s", 1), ("a", "adult", "s", 2), ("b", "child", "s", 1), ("b", "adult", "t", 2), ("b", "unknown", "s", 0), ("c", "unknown", "s", 1)])
    got = rows(p.tie_pick(d, ["k"], "v", p.priority(F.col("source"), {"s": 2, "t": 3})))
    assert got == [("a", "unknown", 2, True), ("b", "adult", 1, False)]


def test_conflicts_take_first_two_seen(spark, rows):
    d = df(spark, [("a", "z", "s", 1), ("a", "b", "s", 2), ("a", "a", "s", 3), ("b", "x", "s", 1), ("b", "unknown", "s", 2)])
    assert rows(p.conflicts(d, ["k"], "v", "o")) == [("a", "z", "b", 3)]


def test_backfill_csv_upsert(spark, rows):
    d = df(spark, [("a", " ", "t,s", 1), ("a", "v2", "s , u", 2), ("a", "v3", None, 3)])
    assert rows(p.backfill(d, ["k"], ["v"], "o")) == [("a", "v2")]
    assert d.agg(p.sorted_csv(F.col("source"))).first()[0] == "s,t,u"
    old, new = spark.createDataFrame([("a", "1", "1"), ("b", "1", "1")], "k string, x string, y string"), spark.createDataFrame([("a", None, None), ("c", "3", None)], "k string, x string, y string")
    assert rows(p.upsert(old, new, ["k"], ["y"])) == [("a", None, "1"), ("b", "1", "1"), ("c", "3", None)]


def test_empty(spark):
    e = df(spark, [])
    assert p.first_wins(e, ["k"], "o").count() == p.tie_pick(e, ["k"], "v", F.lit(1)).count() == p.conflicts(e, ["k"], "v", "o").count() == 0
