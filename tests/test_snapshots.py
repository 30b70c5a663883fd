from datetime import date
from datetime import datetime as D

from lexigraph.operators import snapshots as s

SCHEMA = "snapshot_date string, digimon_id bigint, content_hash string, delivered_at timestamp_ntz, day string"


def run(spark, data):
    df = spark.createDataFrame([(*r, "x") for r in data], SCHEMA)
    return {tuple(r) for r in s.changes(s.current_rows(df, "snapshot_date", "digimon_id", "content_hash", "delivered_at")).collect()}


def test_changes(spark):
    t = lambda h: D(2025, 1, 1, h)
    got = run(spark, [
        ("2025-01-31", 1, "aa", t(1)), ("20250228", 1, " AA ", t(1)), ("2025/03/31", 1, "bb", t(1)),  # same, then changed
        ("2025.01.31", 2, "aa", t(1)), ("2025-03-31T06:00:00Z", 2, "aa", t(1)),  # removed, added
        (" 2025-01-31", 3, None, t(1)), ("2025-02-28 06:00:00", 3, "cc", t(1)), ("2025-03-31", 3, None, t(2)),  # nulls never change
        ("2025-01-31", 4, "old", t(1)), ("2025-01-31", 4, "new", t(2)), ("2025-02-28", 4, "new", t(3)), ("2025-02-28", 4, "old", None), ("2025-03-31", 4, "new", t(1)),
        ("not a date", 5, "x", t(1)), ("2025-01-31", None, "x", t(1)), (None, 6, "x", t(1)),
    ])
    feb, mar = date(2025, 2, 28), date(2025, 3, 31)
    assert got == {(mar, 1, "changed"), (feb, 2, "removed"), (mar, 2, "added")}


def test_one_or_no_snapshot(spark):
    assert run(spark, []) == set()
    assert run(spark, [("2025-01-31", 1, "a", None)]) == set()
