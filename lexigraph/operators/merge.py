"""Merging source records into canonical entities: names, aliases, bridges, skills, profiles, provenance.

Input rows are source records with an ``entity`` column (the slug they were resolved to). Every function is an
aggregation per entity and independent of the others, so Spark shares the scan and combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.functions.text import alias_type, is_blank, normalize_key, to_simplified
from lexigraph.operators import picks
from lexigraph.session import cut

#: Trust of the sources for facts, for images, and of the states of names.
SOURCE_RANK = {"official": 4, "wikimon": 3, "dapi": 2, "manual": 2, "digimons_net": 1, "digidb": 0}
IMAGE_RANK = {"dapi": 3, "official": 2, "manual": 2, "wikimon": 1}
STATUS_RANK = {"official": 4, "official_game": 3, "official_anime": 3, "community": 2, "transliteration": 1, "unverified": 0}
MAIN_LANGUAGES = ("zh_cn", "en", "ja")


def names(records: DataFrame) -> DataFrame:
    """(entity, ordinal, pos, value, language, status, source): the non-blank names of the records."""
    n = records.select("entity", "ordinal", F.posexplode("names").alias("pos", "n")).select("entity", "ordinal", "pos", "n.value", "n.language", "n.status", "n.source")
    return n.where(~is_blank(F.col("value")))


def main_names(records: DataFrame) -> DataFrame:
    """(entity, language, name, status): the best name per language; the first of equally trusted ones."""
    rank = F.struct(picks.priority(F.col("status"), STATUS_RANK).alias("r"), (-F.col("ordinal")).alias("o"), (-F.col("pos")).alias("p"))
    n = names(records).where(F.col("language").isin(*MAIN_LANGUAGES))
    best = n.groupBy("entity", "language").agg(F.max_by(F.struct("value", "status"), rank).alias("b"))
    return best.select("entity", "language", F.col("b.value").alias("name"), F.col("b.status").alias("status"))


def alias_rows(records: DataFrame) -> DataFrame:
    """(entity, alias, language, alias_type, verified): names that are not the main one; of equal ones the first.

    Other languages always give aliases, main ones only where a main name with another key exists.
    """
    n = names(records)
    main = main_names(records).select("entity", "language", F.col("name").alias("main"))
    j = n.join(main, ["entity", "language"], "left")
    spark = records.sparkSession
    key = lambda c: F.when(F.col("language").startswith("zh"), normalize_key(to_simplified(c, spark))).otherwise(normalize_key(c))
    other = ~F.col("language").isin(*MAIN_LANGUAGES) | F.col("language").isNull()
    j = j.where(other | (F.col("main").isNotNull() & (key(F.col("value")) != key(F.col("main")))))
    at = F.struct("ordinal", "pos")
    g = j.groupBy("entity", F.col("value").alias("alias"), "language").agg(F.min(at).alias("_at"))
    return g.select("entity", "alias", "language", alias_type(F.col("language")).alias("alias_type"), F.lit(0).alias("verified"))


def canonical_fields(records: DataFrame, fields: tuple[str, ...] = ("level", "attribute")) -> DataFrame:
    """(entity, field, value, needs_review): tie-to-review picks of closed-vocabulary fields."""
    rows = records.select("entity", "source", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("r"))
    rows = rows.select("entity", "source", "r.field", "r.value")
    return picks.tie_pick(rows, ["entity", "field"], "value", picks.priority(F.col("source"), SOURCE_RANK)).select("entity", "field", "value", "needs_review")


def value_conflicts(records: DataFrame, fields: tuple[str, ...] = ("level", "attribute")) -> DataFrame:
    """(entity, field, value_a, value_b, n_values, status): disagreements; auto where the pick was unique."""
    rows = records.select("entity", "ordinal", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("r"))
    c = picks.conflicts(rows.select("entity", "ordinal", "r.field", "r.value"), ["entity", "field"], "value", "ordinal")
    p = canonical_fields(records, fields).select("entity", "field", "needs_review")
    return c.join(p, ["entity", "field"]).withColumn("status", F.when(F.col("needs_review"), "review").otherwise("auto")).drop("needs_review")


def flags(records: DataFrame) -> DataFrame:
    """(entity, x_antibody, is_official, level_raw, attribute_raw, main_image, first_ordinal)."""
    first = lambda c: F.min_by(F.col(c), F.when(~is_blank(F.col(c)), F.col("ordinal"))).alias(c)
    image = F.when(~is_blank(F.col("image_url")), F.struct(picks.priority(F.col("source"), IMAGE_RANK).alias("r"), (-F.col("ordinal")).alias("o")))
    return records.groupBy("entity").agg(
        F.coalesce(F.bool_or("x_antibody"), F.lit(False)).alias("x_antibody"),
        F.coalesce(F.bool_or("is_official"), F.lit(False)).alias("is_official"),
        first("level_raw"),
        first("attribute_raw"),
        F.max_by("image_url", image).alias("main_image"),
        F.min("ordinal").alias("first_ordinal"),
    )


def with_ids(entities: DataFrame, order: str = "first_ordinal") -> DataFrame:
    """Entities with ids 1..N in order of arrival, without one task for all: ids are counted per range partition."""
    ranged = entities.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    tagged = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id())
    tagged = cut(tagged)
    sizes = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("low"))
    starts = sizes.select("_part", "low", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("start"))  # one row per partition
    return tagged.join(F.broadcast(starts), "_part").withColumn("id", F.col("start") + F.col("_pos") - F.col("low") + 1).drop("_part", "_pos", "low", "start")


def bridge(records: DataFrame, column: str) -> DataFrame:
    """(entity, value, is_primary, pos): list values of the records, the first told of equal ones."""
    v = records.select("entity", "ordinal", F.posexplode(column).alias("pos", "value")).where(~is_blank(F.col("value")))
    g = v.groupBy("entity", "value").agg(F.min(F.struct("ordinal", "pos")).alias("at"))
    return g.select("entity", "value", (F.col("at.pos") == 0).cast("int").alias("is_primary"), F.col("at.pos").alias("pos"))


def skills(records: DataFrame) -> DataFrame:
    """(match_key, name_en, name_ja, name_zh_cn, n_records): skills by key; the first non-blank name per language; skills without a key stay apart."""
    s = records.select("ordinal", F.posexplode("skills").alias("pos", "s"))
    name = lambda lang: F.element_at("s.names", F.lit(lang))
    told = F.coalesce(*[F.when(~is_blank(name(lang)), name(lang)) for lang in ("en", "ja", "zh_cn")])
    s = s.select("ordinal", "pos", name("en").alias("name_en"), name("ja").alias("name_ja"), name("zh_cn").alias("name_zh_cn"), normalize_key(told).alias("match_key"))
    lone = F.when(F.col("match_key") == "", F.concat_ws(":", "ordinal", "pos"))
    at = F.struct("ordinal", "pos")
    first = lambda c: F.min_by(F.col(c), F.when(~is_blank(F.col(c)), at)).alias(c)
    return s.groupBy("match_key", lone.alias("_lone")).agg(first("name_en"), first("name_ja"), first("name_zh_cn"), F.countDistinct("ordinal").alias("n_records")).drop("_lone")


def profiles(records: DataFrame, languages: tuple[str, ...] = ("zh", "en", "ja")) -> DataFrame:
    """(entity, language, profile, source): the most trusted text per language; the earliest of equally trusted ones."""
    p = records.select("entity", "source", "ordinal", F.explode(F.array(*[F.struct(F.lit(x).alias("language"), F.element_at("profile", F.lit(x)).alias("text")) for x in languages])).alias("p"))
    p = p.select("entity", "source", "ordinal", "p.language", "p.text").where(~is_blank(F.col("text")))
    rank = F.struct(picks.priority(F.col("source"), SOURCE_RANK).alias("r"), (-F.col("ordinal")).alias("o"))
    return p.groupBy("entity", "language").agg(F.max_by(F.struct("text", "source"), rank).alias("b")).select("entity", "language", F.col("b.text").alias("profile"), F.col("b.source").alias("source"))


def provenance(records: DataFrame, fields: tuple[str, ...], run_id: str) -> DataFrame:
    """(entity, field, source, value_hash, run_id): the first value each source told per field."""
    rows = records.select("entity", "source", "ordinal", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("r"))
    rows = rows.select("entity", "source", "ordinal", "r.field", "r.value").where(~is_blank(F.col("value")))
    first = rows.groupBy("entity", "field", "source").agg(F.min_by("value", "ordinal").alias("value"))
    return first.select("entity", "field", "source", F.substring(F.sha2("value", 256), 1, 16).alias("value_hash"), F.lit(run_id).alias("run_id"))


def content_hash(records: DataFrame, columns: list[str]) -> DataFrame:
    """(entity, content_hash): a digest of all records in order; digests, not records, are gathered per entity."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)
    g = records.select("entity", "ordinal", row.alias("h")).groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("ordinal", "h"))).alias("l"))
    return g.select("entity", F.substring(F.sha2(F.array_join(F.transform("l", lambda x: x["h"]), ""), 256), 1, 32).alias("content_hash"))


def source_csv(c: Column) -> Column:
    """Sorted distinct sources as a comma list."""
    return picks.sorted_csv(c)
