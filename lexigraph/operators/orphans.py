"""References to records that do not exist: keyed pending-orphan state, kept batch by batch.

A reference row names a parent at the time it was recorded. A parent row is valid from its creation (inclusive; null:
since ever) to its deletion (exclusive; null: for ever).

* ``parent_changes`` are events: a parent row arrives or is deleted. Events of one key add up (``index``), so a late event
  merges with what is known of the key and replaces nothing.
* ``advance`` takes one batch. New references probe the parent index; only orphans enter the state. Parents that arrive resolve the
  orphans that wait for them, deletions reopen references that were settled before. Of the old state only the keys that
  the batch changes are judged again.
* ``replay`` cuts tables into batches of periods and runs ``advance`` over them; ``period_counts`` is the snapshot of
  the counts.

The state holds the references that were orphans when they were told or have become so; the settled ones stay in their
table, which is the log that deletions are looked up in.

Defined cases: a null reference is no reference and gives no row; a reference delivered again, in the same batch or a later one,
counts once, with its earliest orphan telling; a reference without a time comes last and is an orphan only if its parent was never
listed or is deleted; several parent rows with one id stand for one parent from the first creation on, deleted only if
all are; empty tables give an empty state. Extra columns of either table are ignored, whatever their names.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraph.session import cut

REFERENCE = ("ref_table", "ref_column", "row_id", "parent_id")
STATE_COLUMNS = (*REFERENCE, "recorded_at", "reason", "resolved_at", "reopened_at")


def reference_rows(df: DataFrame, ref_table: str, ref_columns: list[str], row_id: str = "id", recorded_at: str = "recorded_at") -> DataFrame:
    """One row per telling of a non-null reference: (ref_table, ref_column, row_id, parent_id, recorded_at), in one scan, without a shuffle."""
    arms = F.array(*[F.struct(F.lit(c).alias("ref_column"), F.col(c).cast("bigint").alias("parent_id")) for c in ref_columns])
    rows = df.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(recorded_at).alias("recorded_at"), F.explode(arms).alias("r"))
    return rows.select(F.lit(ref_table).alias("ref_table"), "r.ref_column", "row_id", "r.parent_id", "recorded_at").where(F.col("parent_id").isNotNull())


def told_once(refs: DataFrame) -> DataFrame:
    """Every reference once, with its earliest time. The row id spreads evenly, whatever parent is hot."""
    return refs.groupBy(*REFERENCE).agg(F.min("recorded_at").alias("recorded_at"))


def parent_changes(df: DataFrame, key: str = "id", created_at: str = "created_at", deleted_at: str = "deleted_at") -> DataFrame:
    """(parent_id, at, arrived, deleted): one event for the arrival and one for the deletion of every parent row; ``at`` null: since ever."""
    arrival = F.struct(F.col(created_at).alias("at"), F.lit(1).alias("arrived"), F.lit(0).alias("deleted"))
    deletion = F.when(F.col(deleted_at).isNotNull(), F.struct(F.col(deleted_at).alias("at"), F.lit(0).alias("arrived"), F.lit(1).alias("deleted")))
    events = F.explode(F.array_compact(F.array(arrival, deletion))).alias("e")
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("parent_id"), events).select("parent_id", "e.at", "e.arrived", "e.deleted")


def index(changes: DataFrame) -> DataFrame:
    """(parent_id, created_at, deleted_at) of all events so far: one row per parent key, combined in every task before the shuffle."""
    ever = F.count_if((F.col("arrived") == 1) & F.col("at").isNull()) > 0
    return changes.groupBy("parent_id").agg(
        F.when(~ever, F.min(F.when(F.col("arrived") == 1, F.col("at")))).alias("created_at"),
        F.when(F.sum("deleted") >= F.sum("arrived"), F.max(F.when(F.col("deleted") == 1, F.col("at")))).alias("deleted_at"),
    )


def parent_index(df: DataFrame, key: str = "id", created_at: str = "created_at", deleted_at: str = "deleted_at") -> DataFrame:
    """The index of a whole parent table."""
    return index(parent_changes(df, key, created_at, deleted_at))


def _judge(listed: Column, recorded: Column, created: Column, deleted: Column) -> list[Column]:
    """reason, resolved_at and reopened_at of a reference from its parent's validity."""
    late = created.isNotNull() & recorded.isNotNull() & (created > recorded)
    gone = deleted.isNotNull() & (recorded.isNull() | (deleted <= recorded))
    reason = F.when(listed.isNull(), "missing").when(gone, "deleted").when(late, "late")
    return [reason.alias("reason"), F.when(reason == "late", created).alias("resolved_at"), F.when(deleted.isNotNull() & ~gone, deleted).alias("reopened_at")]


def probe(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The state columns of every reference against the parent index.

    One equi-join on the parent key. The index has one row per key, so a hot parent makes only the reference
    side large, and adaptive execution splits that side's partition.
    """
    p = parents.select("parent_id", F.col("created_at").alias("_created"), F.col("deleted_at").alias("_deleted"), F.lit(1).alias("_listed"))
    return refs.join(p, "parent_id", "left").select(*REFERENCE, "recorded_at", *_judge(F.col("_listed"), F.col("recorded_at"), F.col("_created"), F.col("_deleted")))


def _once(state: DataFrame) -> DataFrame:
    """State rows told more than once: the earliest orphan telling."""
    first = F.min_by(F.struct("recorded_at", "reason", "resolved_at", "reopened_at"), F.struct(F.col("reason").isNull().alias("r"), F.col("recorded_at").isNull().alias("n"), "recorded_at"))
    return state.groupBy(*REFERENCE).agg(first.alias("s")).select(*REFERENCE, "s.*").where("reason is not null or reopened_at is not null")


def advance(state: DataFrame | None, new_refs: DataFrame, old_changes: DataFrame | None, changes: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """One incremental step: the new state. ``state`` and ``old_changes`` are None at the first batch.

    ``changes`` holds the events of the batch, ``old_changes`` those before it. ``log`` has the references recorded before the
    batch; with it, deletions reopen those that were settled, without it only orphans are kept.
    """
    known = changes if old_changes is None else old_changes.unionByName(changes)
    fresh = probe(new_refs, index(known)).where("reason is not null" if log is None else "reason is not null or reopened_at is not null")
    if state is None:
        return cut(_once(fresh))
    keys = changes.select("parent_id").distinct()
    touched = index(known.join(keys, "parent_id", "left_semi"))
    again = probe(state.join(keys, "parent_id", "left_semi").select(*REFERENCE, "recorded_at"), touched)
    parts = [state.join(keys, "parent_id", "left_anti"), again, fresh]
    if log is not None:
        gone = changes.where("deleted = 1").select("parent_id").distinct()
        settled = log.join(gone, "parent_id", "left_semi")
        parts.append(probe(settled, touched).where("reopened_at is not null"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return cut(_once(out))


def batches(first: datetime.datetime | None, last: datetime.datetime | None, months: int) -> list[tuple[datetime.datetime | None, datetime.datetime | None]]:
    """Half-open intervals of so many months that cover all time; the first has no beginning, the last no end."""
    if first is None or last is None:
        return [(None, None)]
    at, bounds = first.year * 12 + (first.month - 1) // months * months, []
    while (at := at + months) <= last.year * 12 + last.month - 1:
        bounds.append(datetime.datetime(at // 12, at % 12 + 1, 1))
    return list(zip([None, *bounds], [*bounds, None]))


def _within(at: str, begin: datetime.datetime | None, end: datetime.datetime | None) -> Column:
    """Whether a time lies in a batch; a missing time lies in the last one."""
    inside = F.lit(True)
    if begin is not None:
        inside = inside & (F.col(at) >= F.lit(begin).cast("timestamp_ntz"))
    if end is not None:
        inside = inside & (F.col(at) < F.lit(end).cast("timestamp_ntz"))
    return inside | F.col(at).isNull() if end is None else inside


def replay(refs: DataFrame, parents: DataFrame, months: int = 6, reopen: bool = True, snapshot: Callable[[DataFrame, datetime.datetime | None], None] | None = None) -> DataFrame:
    """The state after all batches of so many months of references (``reference_rows``) and parent events (``parent_changes``).

    Every batch reads its own part of the tables by a filter on the time. ``snapshot`` is told the state at the end of each.
    """
    span = refs.agg(F.min("recorded_at"), F.max("recorded_at")).first()
    state, before = None, None
    for begin, end in batches(span[0], span[1], months):
        # a parent that exists since ever is there in the first batch
        arriving = _within("at", begin, end) & F.col("at").isNotNull()
        changes = parents.where(arriving | F.col("at").isNull() if begin is None else arriving)
        log = refs.where(F.col("recorded_at") < F.lit(begin).cast("timestamp_ntz")) if reopen and begin is not None else None
        if reopen and log is None:
            log = refs.limit(0)
        state = advance(state, refs.where(_within("recorded_at", begin, end)), before, changes, log)
        before = parents.where(F.col("at").isNull() | (F.col("at") < F.lit(end).cast("timestamp_ntz"))) if end is not None else parents
        if snapshot is not None:
            snapshot(state, end)
    return state


def period(recorded_at: Column) -> Column:
    """'YYYY-MM', or 'none' for a missing time."""
    return F.coalesce(F.date_format(recorded_at, "yyyy-MM"), F.lit("none"))


def period_counts(refs: DataFrame, state: DataFrame) -> DataFrame:
    """Per table, column and period: references, orphans among them, by reason, and how many have been resolved and reopened since."""
    keys = ("ref_table", "ref_column", "period")
    all_refs = told_once(refs).groupBy("ref_table", "ref_column", period(F.col("recorded_at")).alias("period")).agg(F.count(F.lit(1)).alias("n_refs"))
    orphans = state.groupBy("ref_table", "ref_column", period(F.col("recorded_at")).alias("period")).agg(
        F.count("reason").alias("n_orphans"),
        F.count_if(F.col("reason") == "missing").alias("n_missing"),
        F.count_if(F.col("reason") == "deleted").alias("n_deleted"),
        F.count_if(F.col("reason") == "late").alias("n_late"),
        F.count("resolved_at").alias("n_resolved"),
        F.count("reopened_at").alias("n_reopened"),
    )
    return all_refs.join(orphans, list(keys), "left").na.fill(0)
