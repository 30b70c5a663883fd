from datetime import datetime as D

import pytest

from lexigraph.operators import orphans as o

REF = "id bigint, parent bigint, recorded_at timestamp_ntz, created_at string"  # created_at clashes with the parents' column
PAR = "id bigint, created_at timestamp_ntz, deleted_at timestamp_ntz, parent_id string"
DAY = lambda n: D(2024, 1, 1 + n)
MONTH = lambda n: D(2024 + n // 12, n % 12 + 1, 5)


def refs_of(spark, refs):
    return o.reference_rows(spark.createDataFrame([(*x, "x") for x in refs], REF), "t", ["parent"])


def parents_of(spark, parents):
    return spark.createDataFrame([(*x, "x") for x in parents], PAR)


def frames(spark, refs, parents):
    return refs_of(spark, refs), o.parent_index(parents_of(spark, parents))


def reasons(df):
    return {(r.row_id, r.parent_id): r.reason for r in df.collect()}


def test_all_reasons(spark):
    refs = [(1, 10, DAY(5)), (2, 11, DAY(5)), (3, 12, DAY(5)), (4, 99, DAY(5)), (5, None, DAY(5)), (6, 11, None), (7, 12, None), (8, 98, None), (1, 10, DAY(5)), (9, 12, DAY(3)), (10, 13, DAY(9)), (11, 14, DAY(3))]
    parents = [(10, DAY(0), None), (11, DAY(7), None), (12, DAY(0), DAY(5)), (13, None, None), (None, DAY(0), None), (14, DAY(5), DAY(6)), (14, DAY(2), None)]
    got = reasons(o.probe(*frames(spark, refs, parents)))
    assert got == {(1, 10): None, (2, 11): "late", (3, 12): "deleted", (4, 99): "missing", (6, 11): None, (7, 12): "deleted", (8, 98): "missing", (9, 12): None, (10, 13): None, (11, 14): None}


def test_three_batches(spark):
    """A redelivered reference, a parent that comes late, a deletion and the reopening of what it had settled."""
    events = lambda *e: spark.createDataFrame(list(e), "parent_id bigint, at timestamp_ntz, arrived int, deleted int")
    r1, c1 = refs_of(spark, [(1, 10, DAY(1)), (2, 11, DAY(1)), (2, 11, DAY(1))]), events((10, DAY(0), 1, 0))
    s1 = o.advance(None, r1, None, c1, r1.limit(0))
    assert reasons(s1) == {(2, 11): "missing"}
    r2, c2 = refs_of(spark, [(2, 11, DAY(1)), (3, 10, DAY(5)), (4, 12, DAY(5))]), events((11, DAY(4), 1, 0))
    s2 = o.advance(s1, r2, c1, c2, r1)
    assert reasons(s2) == {(2, 11): "late", (4, 12): "missing"} and s2.where("row_id = 2").first().resolved_at == DAY(4) and s2.count() == 2
    c3 = events((10, DAY(8), 0, 1), (12, DAY(7), 1, 0))
    s3 = {r.row_id: r for r in o.advance(s2, refs_of(spark, [(5, 10, DAY(9)), (4, 12, DAY(5))]), c1.unionByName(c2), c3, r1.unionByName(r2)).collect()}
    assert {k: r.reason for k, r in s3.items()} == {1: None, 2: "late", 3: None, 4: "late", 5: "deleted"}
    assert s3[1].reopened_at == s3[3].reopened_at == DAY(8) and s3[4].resolved_at == DAY(7)


def test_events_of_a_key_are_merged(spark, rows):
    one = o.parent_changes(parents_of(spark, [(1, DAY(3), None)]))
    two = o.parent_changes(parents_of(spark, [(1, DAY(1), DAY(5)), (2, None, DAY(4)), (2, DAY(2), DAY(6))]))
    assert rows(o.index(one.unionByName(two))) == [(1, DAY(1), None), (2, None, DAY(6))]


@pytest.mark.parametrize("months", [1, 6])
def test_batches_equal_one_probe(spark, rows, months):
    refs = [(i, 10 + i % 7, MONTH(i % 17) if i % 11 else None) for i in range(80)] + [(3, 13, MONTH(3))]
    parents = [(10, MONTH(0), None), (11, MONTH(6), None), (12, MONTH(2), MONTH(8)), (13, MONTH(14), None), (14, None, MONTH(3)), (15, MONTH(1), MONTH(2)), (15, MONTH(4), None), (15, MONTH(4), MONTH(30))]
    r, p = refs_of(spark, refs), parents_of(spark, parents)
    seen = []
    state = o.replay(r, o.parent_changes(p), months, snapshot=lambda s, end: seen.append(s.count()))
    want = o.probe(o.told_once(r), o.parent_index(p)).where("reason is not null or reopened_at is not null")
    assert rows(state) == rows(want) and len(seen) == len(o.batches(MONTH(0), MONTH(16), months)) and seen[-1] == want.count()
    assert rows(o.replay(r, o.parent_changes(p), months, reopen=False).where("reason is not null")) == rows(want.where("reason is not null"))


def test_empty(spark):
    r, p = refs_of(spark, []), o.parent_changes(parents_of(spark, []))
    assert o.period_counts(r, o.replay(r, p)).count() == 0
    r = refs_of(spark, [(1, 2, None)])
    got = o.period_counts(r, o.replay(r, p)).first()
    assert (got.period, got.n_missing, got.n_refs) == ("none", 1, 1)
    assert o.batches(None, None, 6) == [(None, None)] and o.batches(D(2024, 1, 5), D(2024, 6, 30), 6) == [(None, None)]
