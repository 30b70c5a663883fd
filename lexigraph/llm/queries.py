"""Queries of the problems on training data, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigraph.llm import canonical, matching, names, packing, residue, survivorship, tokens, variants
from lexigraph.session import cut, drop_shuffles, sized_join, table

#: Container size of the packing queries, in tokens.
CAPACITY = 2048


def _free_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, row_id, position, vocabulary, value) of the values to be mapped."""
    d = table(spark, sf_dir, "digimon")
    pair = lambda field, vocabulary: F.struct(F.lit(field).alias("field"), F.lit(vocabulary).alias("vocabulary"), F.col(field).alias("value"))
    a = d.select(F.col("id").alias("row_id"), F.lit(0).alias("position"), F.explode(F.array(pair("level_raw", "level"), pair("attribute_raw", "attribute"))).alias("f"))
    a = a.select("f.field", "row_id", "position", "f.vocabulary", "f.value")
    s = table(spark, sf_dir, "source_digimon").select(F.col("ordinal").alias("row_id"), F.posexplode("types").alias("position", "value"))
    b = s.select(F.lit("types").alias("field"), "row_id", "position", F.lit("types").alias("vocabulary"), "value")
    rows = a.unionByName(b).where(F.col("value").isNotNull() & ~F.col("value").rlike(r"^[\s\p{Z}]*$"))
    listed = F.broadcast(table(spark, sf_dir, "canonical_term").select("vocabulary", F.col("canonical").alias("value")))  # a fixed list
    return rows.join(listed, ["vocabulary", "value"], "left_anti")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry meant by every free-entered value, 0 for none."""
    simplify = names.simplified_table(spark)
    docs = canonical.labels(table(spark, sf_dir, "canonical_term"), "term_id", "vocabulary", ["canonical", "label_en", "other_en", "label_zh", "label_ja"], simplify)
    rows = _free_values(spark, sf_dir)
    mapped = cut(canonical.map_values(rows, docs, simplify))
    return sized_join(rows, mapped, ["vocabulary", "value"]).select("field", "row_id", "position", "term_id")


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that mean no entry, with the number of rows."""
    simplify = names.simplified_table(spark)
    docs = canonical.labels(table(spark, sf_dir, "canonical_term"), "term_id", "vocabulary", ["canonical", "label_en", "other_en", "label_zh", "label_ja"], simplify)
    counts = _free_values(spark, sf_dir).groupBy("vocabulary", "value").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(canonical.map_values(counts, docs, simplify).where("term_id = 0"), ["vocabulary", "value"]).select("vocabulary", "value", "n_rows")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record per group and field."""
    d = table(spark, sf_dir, "digimon")
    # the reference list of levels: a fixed list, bounded by its vocabulary
    levels = F.broadcast(table(spark, sf_dir, "canonical_term").where("vocabulary = 'level' and canonical <> 'unknown'").select(F.col("canonical").alias("_level")).distinct())
    d = d.join(levels, d["level"] == levels["_level"], "left")
    fields = {
        "name_zh_cn": survivorship.tells(d["name_zh_cn"]),
        "level": F.col("_level").isNotNull(),
        "profile_en": survivorship.tells_whole_text(d["profile_en"]),
        "main_image": survivorship.tells_image(d["main_image"]),
    }
    s = survivorship.survivors(d, survivorship.group_key(d["canonical_slug"]), fields, F.col("is_official_reference"), F.col("updated_at"))
    return s.select("group_id", "field", F.col("id").alias("digimon_id"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", tokens.encode_column(F.col("text")).alias("ids"))


def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, tokens and characters per language code and kind."""
    d = table(spark, sf_dir, "documents").select("lang", "doc_kind", F.length("text").alias("n"), tokens.count_column(F.col("text")).alias("t"))
    return d.groupBy("lang", "doc_kind").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("t").alias("n_tokens"), F.sum("n").alias("n_code_points"))


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every piece of every document."""
    d = table(spark, sf_dir, "documents")
    n = d.count()  # from the footers
    sized = d.select("doc_id", tokens.count_column(F.col("text")).alias("n"))
    p = packing.pack(sized, "doc_id", F.col("n"), CAPACITY, packing.groups_for(n))
    return p.withColumnRenamed("item_id", "doc_id")


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, used and free room, and the lower bound of containers, per group."""
    r = packing.container_report(cut(p9_packed(spark, sf_dir)), CAPACITY)
    return r.groupBy("container_group").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("used"), F.sum("free").alias("free"), F.ceil(F.sum("used") / CAPACITY).alias("least_containers")
    )


#: What every name of this catalogue ends with.
GENERIC = ("mon", "モン", "兽", "数码兽")
#: Words by which a slug or an id tells the second bearer of a name.
SECOND = ("second", "2nd", "b")
#: Words by which an id tells a form.
ID_FORMS = {"x": "x", "xkt": "x", "black": "black", "blk": "black", "hei": "black"}


def _creature_names(spark: SparkSession, sf_dir: str, simplify: dict[int, str]) -> tuple[DataFrame, dict[str, str]]:
    """(space, words, form, entity, rank) of all names of all creatures, and the learned ideographs."""
    drop_shuffles(spark)
    d = table(spark, sf_dir, "digimon").select("id", "canonical_slug", "name_en", "name_ja", "name_zh_cn").withColumn("_key", survivorship.group_key(F.col("canonical_slug")))
    d = cut(d.where("_key is not null"))
    groups = cut(d.groupBy("_key").agg(F.min("id").alias("entity"), F.min_by("canonical_slug", "id").alias("slug")))
    d = d.join(groups, "_key")
    told = lambda c: F.when(survivorship.tells(F.col(c)), F.col(c))
    spelled = F.regexp_replace("slug", r"(?i)[\W_]+(" + "|".join(SECOND) + r")\W*$", "")
    # a bearer of a name that another had before is called by a longer slug and comes after it
    later = (F.col("slug") != F.col("spelled")).cast("int")
    own = d.withColumn("spelled", spelled).select("entity", "_key", "slug", later.alias("rank"), F.array_compact(F.array("spelled", told("name_en"), told("name_ja"), told("name_zh_cn"))).alias("names"), told("name_zh_cn").alias("zh"), "spelled")
    own = cut(own)
    han = names.learn_han(own, "spelled", "zh", simplify, GENERIC)
    of = own.select("entity", "_key", "slug", "rank").distinct()
    rows = own.select("entity", "slug", "rank", F.explode("names").alias("name"))
    # spellings that are linked already carry the nicknames; the form is the creature's
    ids = d.select(F.col("id").alias("digimon_id"), "entity")
    linked = table(spark, sf_dir, "digimon_alias").where("digimon_id is not null and alias is not null").select("digimon_id", "alias")
    linked = linked.join(ids.distinct(), "digimon_id").select("entity", F.col("alias").alias("name")).join(of, "entity").select("entity", "slug", (F.col("rank") + 2).alias("rank"), "name")
    noted = table(spark, sf_dir, "manual_aliases").where("canonical_slug is not null and alias is not null").select(survivorship.group_key(F.col("canonical_slug")).alias("_key"), "alias")
    noted = noted.join(of, "_key").select("entity", "slug", (F.col("rank") + 2).alias("rank"), F.col("alias").alias("name"))
    rows = rows.unionByName(linked).unionByName(noted).distinct()
    forms = groups.select("entity", names.read_column(F.col("slug"), simplify, None, GENERIC)["form"].alias("form"))
    rows = rows.withColumn("r", names.read_column(F.col("name"), simplify, han, GENERIC)).select("entity", "rank", "r.space", "r.words").where("words is not null")
    # only the slug is read in the other spaces: a creature has it in any case
    slugs = own.select("entity", "rank", "spelled").distinct().select("entity", "rank", F.inline(names.crossed_column(F.col("spelled"), simplify, GENERIC)))
    return rows.unionByName(slugs).join(forms, "entity").select("space", "words", "form", "entity", "rank"), han


def _unlinked(spark: SparkSession, sf_dir: str, simplify: dict[int, str], han: dict[str, str]) -> DataFrame:
    """(alias_table, alias_id, form, space, words) of the unlinked spellings."""
    a = table(spark, sf_dir, "digimon_alias").where("digimon_id is null").select(F.lit("digimon_alias").alias("alias_table"), F.col("id").alias("alias_id"), "alias")
    m = table(spark, sf_dir, "manual_aliases").where("canonical_slug is null").select(F.lit("manual_aliases").alias("alias_table"), F.col("id").alias("alias_id"), "alias")
    rows = a.unionByName(m).where("alias is not null").withColumn("r", names.read_column(F.col("alias"), simplify, han, GENERIC))
    return rows.select("alias_table", "alias_id", "r.form", "r.space", "r.words").where("words is not null")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The creature of every unlinked spelling."""
    simplify = names.simplified_table(spark)
    centres, han = _creature_names(spark, sf_dir, simplify)
    rows = cut(_unlinked(spark, sf_dir, simplify, han))
    links = variants.link(rows, centres)
    rows = rows.withColumn("key", variants.joined(F.array_join("words", " ")))
    return rows.join(links, ["space", "key", "form"]).groupBy("alias_table", "alias_id").agg(F.min("entity").alias("digimon_id"))


def p5_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stars of the unlinked spellings that name no known creature: every distinct one with its centre."""
    simplify = names.simplified_table(spark)
    centres, han = _creature_names(spark, sf_dir, simplify)
    rows = cut(_unlinked(spark, sf_dir, simplify, han))
    asked = cut(variants.vertices(rows, "form"))
    rest = cut(asked.join(variants.link(rows, centres).select("space", "key", "form"), ["space", "key", "form"], "left_anti"))
    node = lambda key: F.concat_ws("|", "space", "form", key)
    pairs = variants.similar_pairs(cut(rest.groupBy("space", "key").agg(F.max("spaced").alias("spaced"))))
    left = rest.select("space", F.col("key").alias("left_key"), "form")
    right = rest.select("space", F.col("key").alias("right_key"), "form")
    edges = pairs.join(left, ["space", "left_key"]).join(right, ["space", "right_key", "form"]).select(node(F.col("left_key")).alias("a"), node(F.col("right_key")).alias("b"), "similarity")
    s = variants.stars(edges, rest.select(node(F.col("key")).alias("node")))
    return s.select(F.col("node").alias("spelling"), F.col("centre").alias("star"), F.round("similarity", 6).alias("similarity"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold template residue, filler, error messages or notices about scripts."""
    return residue.residue(table(spark, sf_dir, "documents"), "doc_id", "text")


def _matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(a, b, confidence) of all candidate pairs of classes, and (cls, ordinal) of all rows in them."""
    drop_shuffles(spark)
    simplify = names.simplified_table(spark)
    s = table(spark, sf_dir, "source_digimon").where("source is not null and ordinal is not null")
    s = s.select("source", F.coalesce("source_id", F.concat(F.lit("#"), F.col("ordinal").cast("string"))).alias("sid"), "ordinal", "names", "level", "level_raw", "attribute", "attribute_raw", "x_antibody")
    # parsed values, else the raw one if it is a label of the fixed reference list
    terms = canonical.labels(table(spark, sf_dir, "canonical_term"), "term_id", "vocabulary", ["canonical", "label_en", "other_en", "label_zh", "label_ja"], simplify)
    known = table(spark, sf_dir, "canonical_term").select("term_id", "canonical")
    listed = cut(terms.where("size = 1").join(known, "term_id").select("vocabulary", "token", "canonical").distinct())
    for field in ("level", "attribute"):
        said = listed.where(F.col("vocabulary") == field).select(F.col("token").alias(f"{field}_token"), F.col("canonical").alias(f"{field}_said"))
        s = s.withColumn(f"{field}_token", canonical.squash(canonical.normal(F.col(f"{field}_raw"), simplify)))
        s = sized_join(s, said, f"{field}_token", "left")
        value = F.coalesce(F.when(F.col(field) != "unknown", F.col(field)), F.col(f"{field}_said"))
        s = s.withColumn(field, F.when(value != "unknown", value)).drop(f"{field}_raw", f"{field}_token", f"{field}_said")
    # ids that spell a name: brackets that hold a number tell pages apart, the last word may be a mark
    spelled_id = F.trim(F.regexp_replace("sid", r"[(（\[][^()（）\[\]]*\d[^()（）\[\]]*[)）\]]", " "))
    last = F.lower(F.regexp_extract(spelled_id, r"[-_ (\[]+([A-Za-z0-9]+)[)\]]?$", 1))
    marked = last.isin(*SECOND, *ID_FORMS)
    name_of_id = F.when(marked, F.regexp_replace(spelled_id, r"[-_ (\[]+[A-Za-z0-9]+[)\]]?$", "")).otherwise(spelled_id)
    # an id with a number is a number; one of short pieces is one word
    name_of_id = F.when(~name_of_id.rlike(r"\d") & name_of_id.rlike(r"^.*\p{L}{3}"), F.when(name_of_id.rlike(r"^[a-z]{1,4}(-[a-z]{1,4})+$"), F.replace(name_of_id, F.lit("-"), F.lit(""))).otherwise(name_of_id))
    s = s.withColumn("name_of_id", name_of_id).withColumn("mark", F.when(F.col("name_of_id").isNotNull(), F.when(marked, last).otherwise("")))
    listed_names = F.coalesce("names", F.array().cast(s.schema["names"].dataType))
    told = F.filter(listed_names, lambda n: F.coalesce(n["matchable"], F.lit(True)) & survivorship.tells(n["value"]))
    s = s.withColumn("told", F.transform(told, lambda n: F.struct(n["value"].alias("value"), n["language"].alias("language")))).drop("names")
    s = cut(s.withColumn("node", F.min("ordinal").over(Window.partitionBy("source", "sid"))))
    # ideographs learned from rows that also spell a Latin name
    latin = F.concat(F.transform(F.filter("told", lambda n: n["language"] == "en"), lambda n: n["value"]), F.array(F.col("name_of_id")))
    han = F.transform(F.filter("told", lambda n: n["language"].startswith("zh")), lambda n: n["value"])
    both = s.select(F.explode(latin).alias("latin"), han.alias("han")).select("latin", F.explode("han").alias("han")).where("latin <> ''")
    table_of_han = names.learn_han(both, "latin", "han", simplify, GENERIC)
    all_names = F.filter(F.concat(F.transform("told", lambda n: n["value"]), F.array(F.col("name_of_id"))), lambda v: v.isNotNull() & (v != ""))
    r = names.read_column(F.col("name"), simplify, table_of_han, GENERIC)
    read = s.select("node", "source", "mark", "x_antibody", F.explode(F.array_distinct(all_names)).alias("name")).withColumn("r", r)
    marks = F.create_map(*[F.lit(x) for pair in ID_FORMS.items() for x in pair])
    form_of_id = F.coalesce(marks[F.col("mark")], F.lit(""))
    x = F.col("r.form").contains("x") | F.coalesce(F.col("x_antibody"), F.lit(False)) | (form_of_id == "x")
    black = F.col("r.form").contains("black") | (form_of_id == "black")
    second = F.when(F.col("mark").isin(*SECOND), 1).when(F.col("mark").isNotNull(), 0)
    flag = lambda c, name: F.when(F.bool_or(F.coalesce(c, F.lit(False))), name).otherwise("")
    own = F.collect_set(F.when(F.col("r.words").isNotNull(), F.struct(F.col("r.space").alias("space"), F.col("r.words").alias("words"))))
    a_latin = F.max(F.when(F.col("r.space") == "latin", F.struct(F.size("r.words").alias("n"), F.col("name"))))
    nodes = read.groupBy("node").agg(F.first("source").alias("source"), F.concat(flag(x, "x"), flag(black, "black")).alias("form"), F.max(second).alias("second"), own.alias("own"), a_latin["name"].alias("latin_name"))
    nodes = cut(nodes.where(F.size("own") > 0))
    has = lambda space: F.exists("own", lambda k: k["space"] == space)
    # a node reads its Latin name in another space only if it has no name of its own there
    lent = names.crossed_column(F.when(~has("kana") | ~has("syllable"), F.col("latin_name")), simplify, GENERIC)
    nodes = nodes.withColumn("lent", lent)
    keys = F.concat("own", F.filter("lent", lambda k: ((k["space"] == "kana") & ~has("kana")) | ((k["space"] == "syllable") & ~has("syllable"))))
    nodes = nodes.withColumn("keys", F.array_sort(F.array_distinct(keys))).drop("own", "lent", "latin_name")
    facts = s.groupBy("node").agg(F.max("level").alias("level"), F.max("attribute").alias("attribute"))
    nodes = cut(matching.classes(nodes.join(facts, "node")))
    kinds = nodes.where("node = cls")
    latin = F.exists("keys", lambda k: k["space"] == "latin").alias("latin")
    spelled = kinds.select("cls", "source", "form", latin, F.explode("keys").alias("k")).select("cls", "source", "form", "latin", "k.space", "k.words")
    pairs = matching.candidates(spelled)
    beliefs = cut(matching.propagate(matching.log_odds(pairs, kinds.select("node", "source", "n", "level", "attribute", "second"))))
    rows = s.select("node", "ordinal").distinct().join(nodes.select("node", "cls"), "node")
    return beliefs, rows.select("cls", "ordinal")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows of different sources that describe the same creature."""
    beliefs, rows = _matched(spark, sf_dir)
    # more than one half is given to one partner only: both classes have one node
    j = beliefs.where("confidence > 0.5").join(rows.select(F.col("cls").alias("a"), F.col("ordinal").alias("o_a")), "a").join(rows.select(F.col("cls").alias("b"), F.col("ordinal").alias("o_b")), "b")
    return j.select(F.least("o_a", "o_b").alias("ordinal_a"), F.greatest("o_a", "o_b").alias("ordinal_b"))


def p2_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidate pairs of classes of rows that cannot be told apart, with the match probability of a member of one with one of the other."""
    beliefs, _ = _matched(spark, sf_dir)
    return beliefs.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), F.round("confidence", 6).alias("confidence"))


def p2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every row that has a name."""
    _, rows = _matched(spark, sf_dir)
    return rows.select("ordinal", F.col("cls").alias("class_id"))


QUERIES = {"p1_found": p1_found, "p1_unmatched": p1_unmatched, "p2_found": p2_found, "p2_confidence": p2_confidence, "p2_members": p2_members, "p3_found": p3_found, "p5_found": p5_found, "p5_stars": p5_stars, "p8_ids": p8_ids, "p8_counts": p8_counts, "p9_packed": p9_packed, "p9_fill": p9_fill, "p10_found": p10_found}

_PLACEHOLDERS = ", ".join("'" + x.replace("'", "''") + "'" for x in survivorship.PLACEHOLDERS)
_FILLER = ", ".join(f"'{x}'" for x in survivorship.FILLER_WORDS)
_TELLS = r"""({c} IS NOT NULL AND regexp_replace(lower({c}), '^[\s\p{Z}\(（\[【]+|[\s\p{Z}\)）\]】.。!！]+$', '', 'g') NOT IN ({p})
  AND regexp_matches(regexp_replace(lower({c}), '^[\s\p{Z}\(（\[【]+|[\s\p{Z}\)）\]】.。!！]+$', '', 'g'), '[\p{L}\p{N}]'))"""


def _tells(c: str) -> str:
    return _TELLS.replace("{c}", c).replace("{p}", _PLACEHOLDERS)


SQL = {
    "p3_found": r"""
WITH r AS (
  SELECT regexp_replace(lower(canonical_slug), '[^\p{L}\p{N}]', '', 'g') AS k, id, coalesce(is_official_reference, 0) AS o, updated_at AS u,
    TELLS_NAME AS f1, coalesce(level IN (SELECT canonical FROM canonical_term WHERE vocabulary = 'level' AND canonical <> 'unknown'), false) AS f2,
    TELLS_PROFILE AND NOT regexp_matches(profile_en, '(?i)(\.\.|…)[\s)\]]*$|(\.\.\.|…)\s*(read\s+)?more[\s)\]]*$|[\[(]\s*(\.{2,}|…|read more|continued)\s*[\])]\s*$')
      AND NOT (len(regexp_extract_all(lower(profile_en), '\p{L}+')) >= 3
        AND len(list_filter(regexp_extract_all(lower(profile_en), '\p{L}+'), lambda w: w IN (FILLER))) >= 0.8 * len(regexp_extract_all(lower(profile_en), '\p{L}+'))) AS f3,
    TELLS_IMAGE AND regexp_matches(trim(main_image), '(?i)^https?://[^\s/]+/\S+') AND NOT regexp_matches(main_image, 'EMPTY_IMAGE') AS f4
  FROM digimon),
g AS (SELECT k, min(id) AS group_id FROM r WHERE k <> '' GROUP BY k HAVING count(DISTINCT id) > 1),
v AS (
  SELECT k, id, o, u, unnest(['name_zh_cn', 'level', 'profile_en', 'main_image']) AS field, unnest([f1, f2, f3, f4]) AS ok FROM r),
t AS (SELECT *, row_number() OVER (PARTITION BY k, field ORDER BY o DESC, u DESC NULLS LAST, id) AS n FROM v WHERE ok)
SELECT group_id, field, id AS digimon_id FROM t JOIN g USING (k) WHERE n = 1
""".replace("TELLS_NAME", _tells("name_zh_cn")).replace("TELLS_PROFILE", _tells("profile_en")).replace("TELLS_IMAGE", _tells("main_image")).replace("FILLER", _FILLER).replace("EMPTY_IMAGE", survivorship.EMPTY_IMAGE),
}
