"""Best representative of each duplicate group, field by field.

Records are ranked per (group, field) by trust, then recency, then the smallest id, among the values that
tell something real and whole; a window ordering keeps the top record. ``row_number() = 1`` is cut to one row
per group in every task before the shuffle (WindowGroupLimit), so a hot group costs no more than others.

Defined cases: a null key, or one without letters and digits, belongs to no group; a group of one record has no
survivors; a field without a usable value gives no row; equal trust and recency are settled by the id; null
recency comes last; null trust counts as 0; repeated rows (same id) count once; empty input gives no rows.
Only the named columns are used, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts that stand for a missing value, compared without case, blanks, brackets and final stops.
PLACEHOLDERS = (
    "", "-", "--", "?", "??", "???", "n/a", "na", "none", "null", "nil", "tbd", "tba", "todo", "unknown", "stub", "pending", "untitled",
    "coming soon", "see japanese page", "no profile available", "description missing", "no description", "profile to be added",
    "to be added", "no text", "未知", "未命名", "暂无", "暂无译名", "待定", "待翻译", "待补充", "无", "不明", "未定", "未設定",
)
#: The words of filler text.
FILLER_WORDS = (
    "lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "adipiscing", "elit", "sed", "do", "eiusmod", "tempor", "nulla", "nunc", "justo",
    "magna", "massa", "porta", "odio", "pede", "risus", "quam", "felis", "velit", "vitae", "augue", "arcu", "urna", "orci", "lacus",
)
#: Names of image files that show nothing.
EMPTY_IMAGE = r"(?i)(placeholder|no[-_ ]?image|coming[-_ ]?soon|(^|/)1x1[._]|spacer|blank\.|missing\.|default[-_]?(image|avatar))"


def group_key(slug: Column) -> Column:
    """The letters and digits of a slug, ignoring case; null if there are none."""
    key = F.regexp_replace(F.lower(slug), r"[^\p{L}\p{N}]", "")
    return F.when(key != "", key)


def tells(value: Column) -> Column:
    """Not null, blank or a placeholder, and with at least one letter or digit."""
    bare = F.regexp_replace(F.lower(value), r"^[\s\p{Z}\(（\[【]+|[\s\p{Z}\)）\]】.。!！]+$", "")
    return value.isNotNull() & ~bare.isin(*PLACEHOLDERS) & bare.rlike(r"[\p{L}\p{N}]")


def tells_whole_text(value: Column) -> Column:
    """A text that is not cut off and not filler."""
    cut_off = value.rlike(r"(?i)(\.\.|…)[\s)\]]*$|(\.\.\.|…)\s*(read\s+)?more[\s)\]]*$|[\[(]\s*(\.{2,}|…|read more|continued)\s*[\])]\s*$")
    words = F.regexp_extract_all(F.lower(value), F.lit(r"\p{L}+"), F.lit(0))
    filler = F.size(F.filter(words, lambda w: w.isin(*FILLER_WORDS)))
    return tells(value) & ~cut_off & ~((F.size(words) >= 3) & (filler >= F.size(words) * 0.8))


def tells_image(value: Column) -> Column:
    """An address of a picture on the web that shows something."""
    return tells(value) & F.trim(value).rlike(r"(?i)^https?://[^\s/]+/\S+") & ~value.rlike(EMPTY_IMAGE)


def survivors(df: DataFrame, key: Column, fields: dict[str, Column], trust: Column, recency: Column, row_id: str = "id") -> DataFrame:
    """(group_id, field, row_id): the record whose value survives. ``fields`` has the test of usability by field."""
    flags = [F.coalesce(test, F.lit(False)).alias(f"_u_{i}") for i, test in enumerate(fields.values())]
    rows = df.select(key.alias("_key"), F.col(row_id).cast("bigint").alias("_id"), F.coalesce(trust, F.lit(0)).alias("_trust"), recency.alias("_recency"), *flags)
    rows = rows.where("_key is not null and _id is not null")
    groups = rows.groupBy("_key").agg(F.min("_id").alias("group_id"), F.max("_id").alias("_last")).where("_last > group_id")
    arms = F.array_compact(F.array(*[F.when(F.col(f"_u_{i}"), F.lit(name)) for i, name in enumerate(fields)]))
    usable = rows.select("_key", "_id", "_trust", "_recency", F.explode(arms).alias("field"))
    order = Window.partitionBy("_key", "field").orderBy(F.col("_trust").desc(), F.col("_recency").desc_nulls_last(), F.col("_id").asc())
    top = usable.withColumn("_rank", F.row_number().over(order)).where("_rank = 1")
    return top.join(groups, "_key").select("group_id", "field", F.col("_id").alias(row_id))


def golden_records(df: DataFrame, chosen: DataFrame, fields: list[str], row_id: str = "id") -> DataFrame:
    """One built record per group: group_id and the surviving value of every field (null where none survives)."""
    names = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    values = df.select(F.col(row_id).cast("bigint").alias(row_id), F.explode(F.array(*names)).alias("v")).select(row_id, "v.field", "v.value")
    picked = chosen.join(values, [row_id, "field"])
    return picked.groupBy("group_id").pivot("field", fields).agg(F.min("value"))
