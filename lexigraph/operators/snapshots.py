"""What changed between full snapshots: full outer join on the key, comparing canonical row hashes.

Defined cases: a delivery whose date cannot be read, or without a key, belongs to no snapshot and is left out;
of several deliveries for one date and key the one delivered last counts (null delivery time first; full ties
by the greater hash, null first, so that the result does not depend on row order); a hash that is null on
either side never makes a change; the first snapshot has no predecessor and gives no rows; empty input gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_day(raw: Column) -> Column:
    """The day of a date written as 2025-01-31, 2025/01/31, 2025.01.31 or 20250131, with or without a time."""
    digits = F.regexp_extract(F.trim(raw), r"^(\d{4})[-/.]?(\d{2})[-/.]?(\d{2})(?:$|[T ])", 0)
    day = F.regexp_replace(F.substring(F.regexp_replace(digits, r"[-/.T ]", ""), 1, 8), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.try_to_date(day, "yyyy-MM-dd")


def canonical_hash(raw: Column) -> Column:
    """A hash without case and outer blanks."""
    return F.lower(F.regexp_replace(raw, r"^\s+|\s+$", ""))


def current_rows(df: DataFrame, date: str, key: str, row_hash: str, delivered_at: str) -> DataFrame:
    """(day, key, hash): the row delivered last per day and key. Pre-aggregates before the shuffle."""
    rows = df.select(snapshot_day(F.col(date)).alias("day"), F.col(key).alias("key"), canonical_hash(F.col(row_hash)).alias("hash"), F.col(delivered_at).alias("at"))
    rows = rows.where(F.col("day").isNotNull() & F.col("key").isNotNull())
    best = F.max(F.struct(F.col("at").isNotNull().alias("a"), F.col("at"), F.col("hash").isNotNull().alias("b"), F.col("hash"))).alias("m")
    return rows.groupBy("day", "key").agg(best).select("day", "key", F.col("m.hash").alias("hash"))


def changes(current: DataFrame) -> DataFrame:
    """(day, key, change) of every two consecutive days of ``current``.

    The list of days is bounded by the number of deliveries, not by their rows; it is the only broadcast side.
    Every row is shifted to the following day and joined with that day's rows.
    """
    days = current.select("day").distinct()
    w = Window.orderBy("day")  # over the few distinct days only
    steps = days.select("day", F.lead("day").over(w).alias("next_day"), F.lag("day").over(w).alias("last_day"))
    rows = current.join(F.broadcast(steps), "day")
    new = rows.where(F.col("last_day").isNotNull()).select("day", "key", F.col("hash").alias("new_hash"), F.lit(1).alias("in_new"))
    old = rows.where(F.col("next_day").isNotNull()).select(F.col("next_day").alias("day"), "key", F.col("hash").alias("old_hash"), F.lit(1).alias("in_old"))
    both = new.join(old, ["day", "key"], "full")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("new_hash") != F.col("old_hash"), "changed")
    return both.select("day", "key", change.alias("change")).where(F.col("change").isNotNull())
