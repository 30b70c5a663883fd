import pytest
from pyspark.sql import functions as F

from lexigraph.operators import catalog as c
from lexigraph.operators import quality as q
from lexigraph.operators import review as r
from lexigraph.operators import search as s


def test_paging_and_ids(spark):
    df = spark.range(10)
    assert [x.id for x in c.page(df, [F.col("id").desc()], 3, 2).collect()] == [7, 6, 5]
    for bad in ((0, 0), (301, 0), (5, -1)):
        with pytest.raises(ValueError):
            c.page(df, [F.col("id")], *bad)
    assert c.parse_ids("7, 3,x,²,3,-1,") == [7, 3, 3]
    assert [x.id for x in c.by_ids(df, "id", [7, 3, 3, 99]).collect()] == [7, 3, 3]


def test_filters_only_when_set(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string")
    assert c.entities(df, {"v": None}).count() == 2 and c.entities(df, {"v": "a"}, [(spark.createDataFrame([(1,), (1,)], "id bigint"), "id")]).count() == 1


def test_literal_search(spark):
    df = spark.createDataFrame([("50% off",), ("50x off",), ("a_b",), (None,)], "t string")
    assert [x.t for x in df.where(c.contains_literal(F.col("t"), "50%")).collect()] == ["50% off"]
    assert [x.t for x in df.where(c.contains_literal(F.col("t"), "_")).collect()] == ["a_b"]


def test_nest_does_not_multiply(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id bigint")
    child = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "pid bigint, o int, v string")
    got = {x.id: ([v.v for v in x.a], [v.v for v in x.b]) for x in c.nest(parent, "id", {"a": (child, "pid", ["o"], ["v"]), "b": (child, "pid", ["v"], ["v"])}).collect()}
    assert got == {1: (["a", "b"], ["a", "b"]), 2: ([], [])}


def test_search_stages_and_syntax(spark):
    names = spark.createDataFrame([(1, "Agumon"), (2, "BlackAgumon"), (3, "Gabumon")], "entity bigint, n string")
    alias = spark.createDataFrame([(3, "agumon"), (2, "x agumon")], "entity bigint, alias string")
    got = [(x.entity, x.stage) for x in s.staged(names, "entity", ["n"], alias, ["AGUMON"], 10).collect()]
    assert got == [(1, 1), (3, 2), (2, 3)]
    assert s.query_terms("a b*") == [("a", False), ("b", True)] and s.query_terms("a AND (b") is None and s.query_terms("") is None
    post = s.postings(spark.createDataFrame([(1, "red dragon"), (2, "red"), (3, None), (4, "")], "doc_id bigint, t string"), "doc_id", F.col("t"))
    assert [x.doc_id for x in s.match_all(post, "red drag*").collect()] == [1] and s.match_all(post, "a AND (b").count() == 0


def test_quality_and_review(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, None, "y")], "id bigint, k string, v string")
    assert q.duplicates(df, ["k"], "error", "c").first().n == 1
    assert q.same_but_different(df, ["k"], "v", "warning", "c").first().n == 1
    assert q.outside(df, "v", ["x"], "error", "c").first().n == 1
    assert q.coverage(df.limit(0), {"k": F.col("k").isNotNull()}).first().pct == 0.0
    queue = spark.createDataFrame([(1, "e", "Ambiguous name", "d", "open", None, None), (2, "e", "conflict", None, "resolved", "n", None)], "id bigint, entity_type string, reason string, detail string, status string, note string, resolved_at string")
    assert r.select(queue, status="open", category="matching_failure", text="AMBIG").count() == 1
    done = {x.id: (x.status, x.note) for x in r.resolve(queue, 1, "wontfix", "why", "now").collect()}
    assert done == {1: ("wontfix", "why"), 2: ("resolved", "n")}
    with pytest.raises(ValueError):
        r.resolve(queue, 1, "wontfix", " ", "now")
    again = queue.withColumns({"status": F.lit("open"), "note": F.lit(None).cast("string")})
    assert {x.reason: x.status for x in r.keep_history(queue, again).collect()} == {"Ambiguous name": "open", "conflict": "resolved"}


def test_full_text_prefixes_accents_and_order(spark):
    docs = [(1, "the café lantern"), (2, "lantern lantern lantern"), (3, "a lantana grows by the cafe, far away from it all"), (4, "nothing")]
    post = s.postings(spark.createDataFrame(docs, "doc_id bigint, t string"), "doc_id", F.col("t"))
    assert {r.doc_id for r in s.match_all(post, "cafe").collect()} == {r.doc_id for r in s.match_all(post, "CAFÉ").collect()} == {1, 3}
    scores = {r.doc_id: r.score for r in s.bm25(post, "lant*").collect()}
    assert set(scores) == {1, 2, 3} and scores[2] > scores[1] > scores[3]
    assert {r.doc_id for r in s.bm25(post, "cafe lant*").collect()} == {1, 3} and s.bm25(post, "(bad").count() == 0
    names = spark.createDataFrame([(4, "lantern keeper")], "entity bigint, name string")
    got = [(r.entity, r.stage) for r in s.staged(names, "entity", ["name"], None, ["lantern"], 10, post).collect()]
    assert got == [(4, 3), (2, 5), (1, 5)]
