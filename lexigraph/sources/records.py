"""Source records: the common schema, loaders for every landed format, and a registry of loaders.

Fetching is a landing job outside Spark; loaders read what has landed. A loader is a function
(spark, path) -> DataFrame of source records; ``register`` adds one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.functions.markup import parse_html, parse_infobox
from lexigraph.functions.text import int_or_null, parse_attribute, parse_level

RECORD = (
    "source string, source_id string, ordinal bigint, names array<struct<value:string,language:string,status:string,source:string,matchable:boolean>>, "
    "level string, level_raw string, attribute string, attribute_raw string, types array<string>, fields array<string>, groups array<string>, x_antibody boolean, "
    "profile map<string,string>, skills array<struct<names:map<string,string>,descriptions:map<string,string>,skill_type:string,is_signature:boolean,source:string>>, "
    "evolves_to array<string>, evolves_from array<string>, conditions map<string,string>, first_appearance_title string, first_appearance_date string, "
    "first_appearance_medium string, name_origin string, image_url string, image_page string, is_official boolean, "
    "extra struct<source_url:string,level_2:string,related:array<struct<slug:string,name:string>>,primary_to:array<string>,primary_from:array<string>,game_stats:map<string,string>,fetch_date:string>"
)
#: Entries of API lists that say nothing.
PLACEHOLDERS = ("unknown", "none", "no data", "no attribute", "not applicable", "no level")
_DETAIL = (
    "id bigint, name string, xAntibody boolean, releaseDate string, images array<struct<href:string,transparent:boolean>>, levels array<struct<level:string>>, types array<struct<type:string>>, "
    "attributes array<struct<attribute:string>>, fields array<struct<field:string>>, descriptions array<struct<language:string,description:string>>, "
    "skills array<struct<skill:string,translation:string,description:string>>, priorEvolutions array<struct<digimon:string,condition:string>>, nextEvolutions array<struct<digimon:string,condition:string>>"
)
Loader = Callable[[SparkSession, str], DataFrame]
LOADERS: dict[str, Loader] = {}


def register(name: str) -> Callable[[Loader], Loader]:
    """Make a loader known under a source name."""
    def add(loader: Loader) -> Loader:
        LOADERS[name] = loader
        return loader

    return add


def conform(df: DataFrame, source: str) -> DataFrame:
    """Bring a projection to the record schema; columns it lacks become null."""
    schema = df.sparkSession.createDataFrame([], RECORD).schema
    have = set(df.columns)
    cols = [F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType) for f in schema]
    out = df.select(*[c.alias(f.name) for c, f in zip(cols, schema)])
    return out.withColumn("source", F.lit(source))


def first_told(values: Column) -> Column:
    """The first entry of an array that is no placeholder, else the first one."""
    return F.coalesce(F.try_element_at(F.filter(values, lambda x: ~F.lower(x).isin(*PLACEHOLDERS)), F.lit(1)), F.try_element_at(values, F.lit(1)))


def name(value: Column, language: str, status: str | None, source: str, matchable: bool = True) -> Column:
    """A name entry of a record."""
    return F.struct(value.alias("value"), F.lit(language).alias("language"), F.lit(status).cast("string").alias("status"), F.lit(source).alias("source"), F.lit(matchable).alias("matchable"))


def complete(pages: DataFrame, page_size: int = 1000) -> DataFrame:
    """(n_items, complete): whether a paged list came to its end, by its last page being short; page counts told by the API are not trusted."""
    p = pages.select("page", F.size(F.from_json("body", "content array<struct<id:bigint,name:string>>")["content"]).alias("n"))
    return p.agg(F.sum("n").alias("n_items"), (F.max_by("n", "page") < page_size).alias("complete"))


@register("dapi")
def load_dapi(spark: SparkSession, path: str) -> DataFrame:
    """REST detail payloads, one JSON document per file."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", _DETAIL).alias("d")).select("d.*").where("id is not null")
    link = lambda c, side: F.transform(F.filter(c, lambda x: F.coalesce(x["condition"], F.lit("")) != ""), lambda x: F.struct(F.concat(F.lit(side), x["digimon"]).alias("k"), x["condition"].alias("v")))
    text = lambda code: F.try_element_at(F.transform(F.filter("descriptions", lambda x: x["language"] == code), lambda x: x["description"]), F.lit(1))
    level, attribute = first_told(F.transform("levels", lambda x: x["level"])), first_told(F.transform("attributes", lambda x: x["attribute"]))
    image = F.coalesce(F.try_element_at(F.filter("images", lambda x: x["transparent"]), F.lit(1)), F.try_element_at("images", F.lit(1)))["href"]
    described = lambda x: F.coalesce(F.when(F.trim(x["description"]) != "", F.concat(x["translation"], F.lit(" — "), x["description"])), x["translation"])
    skill = lambda x: F.struct(
        F.create_map(F.lit("en"), x["translation"], F.lit("ja"), x["skill"]).alias("names"), F.create_map(F.lit("en"), described(x)).alias("descriptions"),
        F.lit("special_move").alias("skill_type"), F.lit(False).alias("is_signature"), F.lit("dapi").alias("source"),
    )
    conditions = F.concat(link(F.coalesce("nextEvolutions", F.array()), "to:"), link(F.coalesce("priorEvolutions", F.array()), "from:"))
    return conform(
        raw.select(
            F.col("id").cast("string").alias("source_id"), F.col("id").alias("ordinal"), F.array(name(F.col("name"), "en", "community", "dapi")).alias("names"),
            level.alias("level_raw"), parse_level(level).alias("level"), attribute.alias("attribute_raw"), parse_attribute(attribute).alias("attribute"),
            F.transform("types", lambda x: x["type"]).alias("types"), F.transform("fields", lambda x: x["field"]).alias("fields"), F.col("xAntibody").alias("x_antibody"),
            F.map_filter(F.create_map(F.lit("en"), text("en_us"), F.lit("ja"), text("jap")), lambda k, v: v.isNotNull()).alias("profile"),
            F.transform("skills", skill).alias("skills"), F.transform("nextEvolutions", lambda x: x["digimon"]).alias("evolves_to"), F.transform("priorEvolutions", lambda x: x["digimon"]).alias("evolves_from"),
            F.map_from_entries(F.array_distinct(conditions)).alias("conditions"), F.col("releaseDate").alias("first_appearance_date"), image.alias("image_url"),
        ), "dapi",
    )


@register("official")
def load_official(spark: SparkSession, path: str) -> DataFrame:
    """Localised list pages ``<language>-<n>.json``: one record per directory name over the three languages."""
    row = "rows array<struct<directory_name:string,name:string,level:string,level_2:string,icon_20th:string,icon_new:string,relate_word6:string>>"
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([a-z]{2})-\d+\.json", 1).alias("lang"), F.posexplode(F.from_json("value", row)["rows"]).alias("pos", "r"))
    raw = raw.select("lang", "pos", "r.*").where("directory_name is not null")
    by = lambda c, lang: F.min_by(F.col(c), F.when(F.col("lang") == lang, F.col("pos"))).alias(f"{c}_{lang}")
    g = raw.groupBy("directory_name").agg(*[by(c, lang) for c in ("name", "level", "level_2") for lang in ("ja", "en", "zh")], F.bool_or(F.col("relate_word6").contains("〇")).alias("x"), F.min("pos").alias("ordinal"))
    trim = lambda c: F.regexp_replace(c, "^・+", "")
    told = F.filter(F.array(name(trim(F.col("name_ja")), "ja", "official", "official"), name(trim(F.col("name_en")), "en", "official", "official"), name(trim(F.col("name_zh")), "zh_cn", "official", "official")), lambda n: F.coalesce(n["value"], F.lit("")) != "")
    level = F.coalesce("level_en", "level_ja")
    extra = F.struct(F.lit(None).cast("string").alias("source_url"), F.coalesce("level_2_en", "level_2_ja").alias("level_2"), F.lit(None).cast("array<struct<slug:string,name:string>>").alias("related"), F.lit(None).cast("array<string>").alias("primary_to"), F.lit(None).cast("array<string>").alias("primary_from"), F.lit(None).cast("map<string,string>").alias("game_stats"), F.lit(None).cast("string").alias("fetch_date"))
    return conform(g.select(F.col("directory_name").alias("source_id"), "ordinal", told.alias("names"), level.alias("level_raw"), parse_level(level).alias("level"), F.col("x").alias("x_antibody"), F.lit(True).alias("is_official"), extra.alias("extra")), "official")


@register("digimons_net")
def load_index_table(spark: SparkSession, path: str) -> DataFrame:
    """An HTML index: rows with at least five cells (link, level, ja, en, zh); the first row per name key wins."""
    pages = spark.read.text(path, wholetext=True).select(parse_html(F.col("value")).alias("p"))
    rows = pages.select(F.posexplode("p.rows").alias("pos", "c")).where(F.size("c") >= 5)
    cell = lambda i: F.nullif(F.nullif(F.trim(F.col("c")[i]), F.lit("?")), F.lit("暂无"))
    r = rows.select(F.lower(F.regexp_replace(cell(0), r"[^A-Za-z0-9]+", "-")).alias("source_id"), "pos", cell(1).alias("level_raw"), cell(2).alias("ja"), cell(3).alias("en"), cell(4).alias("zh")).where("source_id is not null")
    r = r.groupBy("source_id").agg(F.min_by(F.struct("pos", "level_raw", "ja", "en", "zh"), "pos").alias("r")).select("source_id", "r.*")
    told = F.filter(F.array(name(F.col("ja"), "ja", "community", "digimons_net"), name(F.when(F.col("en") != F.col("ja"), F.col("en")), "en", "community", "digimons_net"), name(F.when(F.col("zh") != F.col("ja"), F.col("zh")), "zh_cn", "community", "digimons_net")), lambda n: n["value"].isNotNull())
    return conform(r.select("source_id", F.col("pos").alias("ordinal"), told.alias("names"), "level_raw", parse_level(F.col("level_raw")).alias("level")), "digimons_net")


@register("wikimon")
def load_wiki(spark: SparkSession, path: str) -> DataFrame:
    """Wiki pages as JSON lines (title, text); pages without an infobox give no record."""
    w = spark.read.schema("title string, text string").json(path)
    w = w.where(~F.col("text").rlike(r"(?i)^\s*#redirect")).withColumn("i", parse_infobox(F.col("text"), "S2")).where("i is not null")
    told = F.filter(F.array(name(F.col("title"), "en", None, "wikimon"), name(F.col("i")["kan"], "ja", "official", "wikimon"), name(F.col("i")["zho"], "zh_cn", None, "wikimon")), lambda n: F.coalesce(n["value"], F.lit("")) != "")
    return conform(w.select(F.col("title").alias("source_id"), told.alias("names"), F.col("i")["l1"].alias("level_raw"), parse_level(F.col("i")["l1"]).alias("level"), F.col("i")["a1"].alias("attribute_raw"), parse_attribute(F.col("i")["a1"]).alias("attribute")), "wikimon")


@register("digidb")
def load_game_stats(spark: SparkSession, path: str) -> DataFrame:
    """A game's table as one JSON array; figures are integers or null."""
    figures = ("memory", "hp", "sp", "atk", "def", "int", "spd")
    raw = spark.read.option("multiLine", True).json(path)
    for c in ("no", "digimon", "stage", "attribute", *figures):
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    stats = F.map_filter(F.create_map(*[x for c in figures for x in (F.lit(c), int_or_null(F.col(c).cast("string")).cast("string"))]), lambda k, v: v.isNotNull())
    extra = F.struct(F.lit(None).cast("string").alias("source_url"), F.lit(None).cast("string").alias("level_2"), F.lit(None).cast("array<struct<slug:string,name:string>>").alias("related"), F.lit(None).cast("array<string>").alias("primary_to"), F.lit(None).cast("array<string>").alias("primary_from"), stats.alias("game_stats"), F.lit(None).cast("string").alias("fetch_date"))
    return conform(raw.select(F.col("no").cast("string").alias("source_id"), F.col("no").cast("bigint").alias("ordinal"), F.array(name(F.col("digimon"), "en", "community", "digidb")).alias("names"), F.col("stage").alias("level_raw"), extra.alias("extra")), "digidb")


def load(spark: SparkSession, source: str, path: str) -> DataFrame:
    """Records of a registered source."""
    return LOADERS[source](spark, path)
