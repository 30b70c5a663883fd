"""Data-quality checks: each is a DataFrame (level, check, n); a report is their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraph.functions.text import is_blank, is_unknown


def _row(df: DataFrame, level: str, check: str, n: Column) -> DataFrame:
    return df.agg(F.coalesce(n, F.lit(0)).cast("bigint").alias("n")).select(F.lit(level).alias("level"), F.lit(check).alias("check"), "n")


def conditions(df: DataFrame, checks: list[tuple[str, str, Column]]) -> DataFrame:
    """Many row conditions of one table in a single pass."""
    counted = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, (_, _, c) in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(name).alias("check"), F.col(f"c{i}").alias("n")) for i, (level, name, _) in enumerate(checks)])
    return counted.select(F.explode(rows).alias("r")).select("r.level", "r.check", "r.n")


def duplicates(df: DataFrame, keys: list[str], level: str, check: str) -> DataFrame:
    """The number of non-null keys that occur more than once."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return _row(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where("c > 1"), level, check, F.count(F.lit(1)))


def orphans(child: DataFrame, fk: str, parent: DataFrame, key: str, level: str, check: str) -> DataFrame:
    """The number of child rows whose non-null key has no parent."""
    lone = child.select(F.col(fk).alias("k")).where("k is not null").join(parent.select(F.col(key).alias("k")).distinct(), "k", "left_anti")
    return _row(lone, level, check, F.count(F.lit(1)))


def childless(parent: DataFrame, key: str, child: DataFrame, fk: str, level: str, check: str) -> DataFrame:
    """The number of parents without any child."""
    return _row(parent.select(F.col(key).alias("k")).join(child.select(F.col(fk).alias("k")), "k", "left_anti"), level, check, F.count(F.lit(1)))


def outside(df: DataFrame, column: str, allowed: list[str], level: str, check: str) -> DataFrame:
    """The number of non-null values outside a closed vocabulary."""
    return _row(df.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed)), level, check, F.count(F.lit(1)))


def empty(df: DataFrame, level: str, check: str) -> DataFrame:
    """1 if the table has no row, else 0."""
    return _row(df, level, check, (F.count(F.lit(1)) == 0).cast("int"))


def same_but_different(df: DataFrame, keys: list[str], other: str, level: str, check: str) -> DataFrame:
    """The number of keys under which another column has several values (null counts as one)."""
    for k in keys:
        df = df.where(~is_blank(F.col(k)))
    g = df.groupBy(*keys).agg((F.countDistinct(other) + F.max(F.col(other).isNull().cast("int"))).alias("c"))
    return _row(g.where("c > 1"), level, check, F.count(F.lit(1)))


def report(checks: list[DataFrame]) -> DataFrame:
    """All checks as one table."""
    return reduce(lambda a, b: a.unionByName(b), checks)


def coverage(df: DataFrame, fields: dict[str, Column], verified: dict[str, Column] | None = None) -> DataFrame:
    """(field, total, present, verified, pct): one pass over the table; pct to one place, half to even."""
    v = verified or {}
    aggs = [F.count(F.lit(1)).alias("total")]
    for i, (name, present) in enumerate(fields.items()):
        aggs += [F.count_if(present).alias(f"p{i}"), F.count_if(present & v.get(name, F.lit(False))).alias(f"v{i}")]
    rows = F.array(*[F.struct(F.lit(n).alias("field"), F.col("total").alias("total"), F.col(f"p{i}").alias("present"), F.col(f"v{i}").alias("verified")) for i, n in enumerate(fields)])
    g = df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")
    return g.withColumn("pct", F.when(F.col("total") > 0, F.bround(100.0 * F.col("present") / F.col("total"), 1)).otherwise(0.0))


def field_audit(df: DataFrame, key: str, statuses: dict[str, Column]) -> DataFrame:
    """(key, field, status): the audit rows of every entity, unpivoted."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), s.alias("status")) for f, s in statuses.items()])
    return df.select(F.col(key), F.explode(rows).alias("r")).select(key, "r.field", "r.status")


def field_status(value: Column, conflict: Column, has_source: Column) -> Column:
    """present, conflict, no_source or no_value."""
    return F.when(conflict, "conflict").when(~is_unknown(value), "present").when(~has_source, "no_source").otherwise("no_value")


def percentile_nearest_rank(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """(share, value): the value at rank ceil(share * n), nulls left out; counts per value combine before the shuffle."""
    g = df.agg(*[F.expr(f"percentile_disc({s}) WITHIN GROUP (ORDER BY {column})").alias(f"x{i}") for i, s in enumerate(shares)])
    rows = F.array(*[F.struct(F.lit(s).alias("share"), F.col(f"x{i}").alias("value")) for i, s in enumerate(shares)])
    return g.select(F.explode(rows).alias("r")).select("r.share", "r.value")


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A repeatable sample of n rows without replacement: the n smallest hashes of the key."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def sample_category(statuses: Column) -> Column:
    """The gravest finding of an entity's audit statuses."""
    order = ["match_failure", "parse_failure", "fetch_failure", "conflict", "image_missing", "no_source"]
    out = F.lit("ok")
    for s in reversed(order):
        out = F.when(F.array_contains(statuses, s), s).otherwise(out)
    return out
