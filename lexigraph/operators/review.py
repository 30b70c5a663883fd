"""The manual review queue: list, count, stats, resolve, history, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.functions.text import review_category
from lexigraph.operators.catalog import contains_literal

EXPORT_CAP = 10_000
CLOSED = ("resolved", "wontfix")


def select(queue: DataFrame, status: str | None = None, entity_type: str | None = None, text: str | None = None, category: str | None = None) -> DataFrame:
    """Rows of the queue that meet all filters that are set, with their category."""
    q = queue.withColumn("category", review_category(F.col("reason")))
    if status:
        q = q.where(F.col("status") == status)
    if entity_type:
        q = q.where(F.col("entity_type") == entity_type)
    if text:
        q = q.where(contains_literal(F.col("reason"), text) | contains_literal(F.coalesce(F.col("detail"), F.lit("")), text))
    if category:
        q = q.where(F.col("category") == category)
    return q


def stats(queue: DataFrame) -> DataFrame:
    """(dimension, value, n): by status, by entity type, and by category of the open rows, in one shuffle."""
    rows = queue.withColumn("category", F.when(F.col("status") == "open", review_category(F.col("reason"))))
    arms = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("status", "entity_type", "category")])
    e = rows.select(F.explode(arms).alias("r")).where("r.value is not null")
    return e.groupBy("r.dimension", "r.value").agg(F.count(F.lit(1)).alias("n"))


def resolve(queue: DataFrame, item: int, status: str, note: str, at) -> DataFrame:
    """The queue with one open item closed; a note is needed, and closed items stay as they are."""
    if status not in CLOSED or not note.strip():
        raise ValueError("an item is closed as resolved or wontfix, with a note")
    hit = (F.col("id") == item) & (F.col("status") == "open")
    return queue.withColumns({"status": F.when(hit, status).otherwise(F.col("status")), "note": F.when(hit, note).otherwise(F.col("note")), "resolved_at": F.when(hit, F.lit(at)).otherwise(F.col("resolved_at"))})


def keep_history(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rebuilt queue with the verdicts of the old one: one row per (entity_type, reason, detail), a closed row wins over an open one."""
    key = ["entity_type", "reason", "detail"]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in key and c != "_new"]
    rank = F.struct(F.col("status").isin(*CLOSED).alias("c"), F.col("_new"), (-F.col("id")).alias("i"))
    g = both.groupBy(*[F.coalesce(F.col(k), F.lit("\u0000")).alias(k) for k in key]).agg(F.max_by(F.struct(*rest), rank).alias("r"))
    return g.select(*[F.nullif(F.col(k), F.lit("\u0000")).alias(k) for k in key], *[F.col("r")[c].alias(c) for c in rest])


def export(queue: DataFrame, path: str, fmt: str = "json") -> int:
    """Write the selected rows; more than the cap is refused, never cut off."""
    n = queue.limit(EXPORT_CAP + 1).count()
    if n > EXPORT_CAP:
        raise ValueError(f"more than {EXPORT_CAP} rows: narrow the filters")
    w = queue.write.mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.json(path)
    return n
