"""The read facade: composable filters, sorting, paging, lookups, nested detail, counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraph.functions.text import ascii_lower

MAX_LIMIT, MAX_IDS = 300, 500


def entities(df: DataFrame, equals: dict[str, object] | None = None, having: list[tuple[DataFrame, str]] | None = None) -> DataFrame:
    """Rows that meet all filters that are set. ``having``: (table, key) semi joins, each present only when asked for."""
    for column, value in (equals or {}).items():
        if value is not None:
            df = df.where(F.col(column) == value)
    for other, key in having or []:
        df = df.join(other.select(key), key, "left_semi")
    return df


def sort_key(name: str, sorts: dict[str, Column], descending: bool = False, nulls_last: bool = False) -> Column:
    """An order by name; an unknown name means the first one. With ``nulls_last`` nulls come last both ways."""
    c = sorts.get(name) if name in sorts else next(iter(sorts.values()))
    if nulls_last:
        return c.desc_nulls_last() if descending else c.asc_nulls_last()
    return c.desc() if descending else c.asc()


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page; the order must end in a unique column."""
    if not 1 <= limit <= MAX_LIMIT or offset < 0:
        raise ValueError("limit must be 1..300 and offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def parse_ids(text: str) -> list[int]:
    """ASCII digit items of a comma list, at most 500."""
    return [int(x) for x in (p.strip() for p in text.split(",")) if re.fullmatch("[0-9]+", x)][:MAX_IDS]


def by_ids(df: DataFrame, key: str, ids: list[int]) -> DataFrame:
    """Rows in the order asked for: missing ids drop out, repeated ids repeat. Adds ``pos``."""
    asked = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids[:MAX_IDS])], f"pos int, {key} bigint")
    return F.broadcast(asked).join(df, key).orderBy("pos")  # at most 500 asked rows


def lookup(df: DataFrame, ident: str, id_column: str, name_column: str) -> DataFrame:
    """The row of an id (ASCII digits) or of a name."""
    return df.where(F.col(id_column) == int(ident)) if re.fullmatch("[0-9]+", ident) else df.where(F.col(name_column) == ident)


def nest(parent: DataFrame, key: str, children: dict[str, tuple[DataFrame, str, list[str], list[str]]]) -> DataFrame:
    """One row per parent with ordered child arrays.

    ``children``: name -> (table, foreign key, order columns, value columns). Every child is aggregated before the
    join, so children do not multiply each other.
    """
    for name, (child, fk, order, values) in children.items():
        rows = child.groupBy(F.col(fk).alias(key)).agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*values).alias("v")))).alias("_l"))
        parent = parent.join(rows, key, "left").withColumn(name, F.transform(F.coalesce("_l", F.array().cast(rows.schema["_l"].dataType)), lambda x: x["v"])).drop("_l")
    return parent


def members(bridge: DataFrame, entity: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Entities of one group in binary order."""
    return entity.join(bridge.select(key).distinct(), key, "left_semi").orderBy(*order)


def counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """Total and conditional counts in one pass."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def contains_literal(c: Column, text: str) -> Column:
    """Substring match without wildcards, ignoring ASCII case."""
    return ascii_lower(c).contains(ascii_lower(F.lit(text)))
