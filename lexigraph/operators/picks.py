"""Deterministic choices per key: first or last wins, upsert, priority pick, tie to review, conflicts, backfill.

All of them aggregate with ``max_by``/``min_by`` over ordered structs, so that every task combines its rows before the
shuffle and a hot key costs no more than others. Nulls in the order column come last for 'first' and first for 'last'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _others(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The earliest row per key (insert-or-ignore)."""
    rest = _others(df, keys)
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.col(order).isNull(), F.col(order))).alias("_r"))
    return g.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row per key (insert-or-replace)."""
    rest = _others(df, keys)
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order).isNotNull(), F.col(order))).alias("_r"))
    return g.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: list[str] | None = None) -> DataFrame:
    """Rows of both; where both have a key the new value, but for ``keep_old`` columns only if it is not null."""
    rest, kept = _others(new, keys), set(keep_old or [])
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in rest], F.lit(1).alias("_in_old"))
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in rest], F.lit(1).alias("_in_new"))
    j = o.join(n, keys, "full")
    pick = lambda c: F.coalesce(F.col(f"_n_{c}"), F.col(f"_o_{c}")) if c in kept else F.when(F.col("_in_new") == 1, F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}"))
    return j.select(*keys, *[pick(c).alias(c) for c in rest])


def priority(source: Column, ranks: dict[str, int]) -> Column:
    """The rank of a source; unknown ones rank lowest."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), source), F.lit(-1))


def priority_pick(df: DataFrame, keys: list[str], value: str, rank: Column, order: str) -> DataFrame:
    """The value of the highest rank per key; the earliest row wins ties; null values are no candidates."""
    rows = df.where(F.col(value).isNotNull())
    return rows.groupBy(*keys).agg(F.max_by(F.col(value), F.struct(rank.alias("r"), (-F.col(order)).alias("o"))).alias(value))


def tie_pick(df: DataFrame, keys: list[str], value: str, rank: Column, default: str = "unknown") -> DataFrame:
    """(keys, value, n_top, needs_review): a unique value at the top rank, else the default and a review."""
    rows = df.where(F.col(value).isNotNull() & (F.col(value) != default)).groupBy(*keys, value).agg(F.max(rank).alias("_p"))
    # the distinct values of one key come in one pass: the sum of values at the maximum needs the maximum first
    top = rows.groupBy(*keys).agg(F.max("_p").alias("_top"))
    at_top = rows.join(top, keys).where("_p = _top").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_top"), F.min(value).alias("_v"))
    return at_top.select(*keys, F.when(F.col("n_top") == 1, F.col("_v")).otherwise(F.lit(default)).alias(value), "n_top", (F.col("n_top") > 1).alias("needs_review"))


def conflicts(df: DataFrame, keys: list[str], value: str, order: str, ignore: str = "unknown") -> DataFrame:
    """(keys, value_a, value_b, n_values): keys with two or more distinct values; a and b are the first two seen."""
    rows = df.where(F.col(value).isNotNull() & (F.col(value) != ignore)).groupBy(*keys, value).agg(F.min(order).alias("_at"))
    a = rows.groupBy(*keys).agg(F.min_by(value, F.struct("_at", value)).alias("value_a"), F.count(F.lit(1)).alias("n_values")).where("n_values > 1")
    rest = rows.join(a, keys).where(F.col(value) != F.col("value_a"))
    return rest.groupBy(*keys, "value_a", "n_values").agg(F.min_by(value, F.struct("_at", value)).alias("value_b")).select(*keys, "value_a", "value_b", "n_values")


def backfill(df: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """The first non-blank value of every column per key."""
    told = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c))
    return df.groupBy(*keys).agg(*[F.min_by(told(c), F.when(told(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def sorted_csv(c: Column) -> Column:
    """The distinct values of a group, sorted, joined by commas; empty parts of comma lists are taken apart."""
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(F.split(c, r"\s*,\s*"), lambda x: x != ""))))), ",")
