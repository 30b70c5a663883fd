"""Registry queries of the core operators, each with its SQL where SQL can say the same over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.functions import text as T
from lexigraph.functions.markup import clean_markup
from lexigraph.operators import catalog, graph, merge, picks, quality, resolve, review, search
from lexigraph.session import table
from lexigraph.streaming import events as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- filters, paging, lookups


def _segment_customers(s: SparkSession, d: str) -> DataFrame:
    nations = table(s, d, "nation").join(table(s, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    orders = table(s, d, "orders").where("o_orderpriority = '1-URGENT'")
    return catalog.entities(table(s, d, "customer"), {"c_mktsegment": "BUILDING"}, [(nations.select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey"), (orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")])


_SEG = """FROM customer WHERE c_mktsegment = 'BUILDING'
 AND c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')
 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"""


@query("q_list_filter", f"SELECT c_custkey, c_name, c_acctbal {_SEG} ORDER BY lower(c_name), c_custkey LIMIT 60 OFFSET 5")
def _(s, d):
    return catalog.page(_segment_customers(s, d), [T.ascii_lower(F.col("c_name")), F.col("c_custkey")], 60, 5).select("c_custkey", "c_name", "c_acctbal")


@query("q_count_filter", f"SELECT count(DISTINCT c_custkey) AS n {_SEG}")
def _(s, d):
    return _segment_customers(s, d).agg(F.countDistinct("c_custkey").alias("n"))


@query("q_entity_filter", """SELECT id, canonical_slug, level, attribute FROM digimon WHERE level = 'ultimate' AND attribute = 'vaccine' AND is_official_reference = 1
 AND id IN (SELECT digimon_id FROM digimon_alias WHERE language = 'ja')""")
def _(s, d):
    alias = table(s, d, "digimon_alias").where("language = 'ja'").select(F.col("digimon_id").alias("id"))
    return catalog.entities(table(s, d, "digimon"), {"level": "ultimate", "attribute": "vaccine", "is_official_reference": 1, "x_antibody": None}, [(alias, "id")]).select("id", "canonical_slug", "level", "attribute")


for _direction in ("asc", "desc"):

    @query(f"q_list_sort_debut_{_direction}", f"SELECT id, updated_at FROM digimon ORDER BY updated_at {_direction} NULLS LAST, id LIMIT 100")
    def _(s, d, desc=_direction == "desc"):
        sorts = {"name": T.ascii_lower(F.col("name_en")), "debut": F.col("updated_at")}
        return catalog.page(table(s, d, "digimon").select("id", "updated_at", "name_en"), [catalog.sort_key("debut", sorts, desc, nulls_last=True), F.col("id")], 100).select("id", "updated_at")


@query("q_list_sort_unknown_key", "SELECT id, name_en FROM digimon ORDER BY translate(name_en, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ASC NULLS FIRST, id LIMIT 50 OFFSET 20")
def _(s, d):
    sorts = {"name": T.ascii_lower(F.col("name_en")), "id": F.col("id")}
    return catalog.page(table(s, d, "digimon").select("id", "name_en"), [catalog.sort_key("no such key", sorts), F.col("id")], 50, 20)


@query("q_by_ids", "SELECT CAST(pos AS INTEGER) AS pos, s_suppkey, s_name FROM (VALUES (0, 7), (1, 3), (2, 3), (3, 99999)) t(pos, k) JOIN supplier ON s_suppkey = k")
def _(s, d):
    return catalog.by_ids(table(s, d, "supplier"), "s_suppkey", catalog.parse_ids("7,3,x,²,3,99999")).select("pos", "s_suppkey", "s_name")


@query("q_point_lookup", "SELECT id, canonical_slug FROM digimon WHERE id = 12 UNION ALL SELECT id, canonical_slug FROM digimon WHERE canonical_slug = (SELECT canonical_slug FROM digimon WHERE id = 3)")
def _(s, d):
    df = table(s, d, "digimon").select("id", "canonical_slug")
    slug = df.where("id = 3").first()["canonical_slug"]
    return catalog.lookup(df, "12", "id", "canonical_slug").unionByName(catalog.lookup(df, slug, "id", "canonical_slug"))


@query("q_detail_nested", """SELECT g.id, coalesce(a.aliases, '') AS aliases, coalesce(e.next, '') AS next FROM digimon g
 LEFT JOIN (SELECT digimon_id, string_agg(alias, '|' ORDER BY verified DESC, id) AS aliases FROM digimon_alias WHERE alias IS NOT NULL GROUP BY digimon_id) a ON a.digimon_id = g.id
 LEFT JOIN (SELECT f, string_agg(CAST(t AS VARCHAR), '|' ORDER BY t) AS next FROM (SELECT DISTINCT from_digimon_id AS f, to_digimon_id AS t FROM evolution_edge WHERE is_primary_line = 1) GROUP BY f) e ON e.f = g.id""")
def _(s, d):
    aliases = table(s, d, "digimon_alias").where("digimon_id is not null and alias is not null").withColumn("nv", -F.coalesce("verified", F.lit(0)))
    edges = table(s, d, "evolution_edge").where("is_primary_line = 1 and from_digimon_id is not null and to_digimon_id is not null").select("from_digimon_id", "to_digimon_id").distinct()
    full = catalog.nest(table(s, d, "digimon").select("id"), "id", {"aliases": (aliases, "digimon_id", ["nv", "id"], ["alias"]), "next": (edges, "from_digimon_id", ["to_digimon_id"], ["to_digimon_id"])})
    return full.select("id", F.array_join(F.transform("aliases", lambda x: x["alias"]), "|").alias("aliases"), F.array_join(F.transform("next", lambda x: x["to_digimon_id"].cast("string")), "|").alias("next"))


@query("q_members", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) ORDER BY s_name, s_suppkey")
def _(s, d):
    bridge = table(s, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey"))
    return catalog.members(bridge, table(s, d, "supplier"), "s_nationkey", ["s_name", "s_suppkey"]).select("s_suppkey", "s_name")


@query("q_meta_counts", """SELECT count(*) AS total, count(*) FILTER (is_official_reference = 1) AS official, count(*) FILTER (is_official_reference = 0) AS extended,
 count(*) FILTER (x_antibody = 1) AS x FROM digimon""")
def _(s, d):
    return catalog.counts(table(s, d, "digimon"), official=F.col("is_official_reference") == 1, extended=F.col("is_official_reference") == 0, x=F.col("x_antibody") == 1)


@query("q_group_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def _(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


# ---------------------------------------------------------------- quality

_V = {
    "duplicate_slug": "SELECT 'error', 'duplicate_slug', count(*) FROM (SELECT canonical_slug FROM digimon WHERE canonical_slug IS NOT NULL GROUP BY 1 HAVING count(*) > 1)",
    "orphan_from": "SELECT 'error', 'orphan_from', count(*) FROM evolution_edge WHERE from_digimon_id IS NOT NULL AND from_digimon_id NOT IN (SELECT id FROM digimon)",
    "orphan_to": "SELECT 'error', 'orphan_to', count(*) FROM evolution_edge WHERE to_digimon_id IS NOT NULL AND to_digimon_id NOT IN (SELECT id FROM digimon)",
    "orphan_alias": "SELECT 'error', 'orphan_alias', count(*) FROM digimon_alias WHERE digimon_id IS NOT NULL AND digimon_id NOT IN (SELECT id FROM digimon)",
    "no_alias": "SELECT 'info', 'no_alias', count(*) FROM digimon WHERE id NOT IN (SELECT digimon_id FROM digimon_alias WHERE digimon_id IS NOT NULL)",
    "duplicate_edge": "SELECT 'warning', 'duplicate_edge', count(*) FROM (SELECT 1 FROM evolution_edge WHERE from_digimon_id IS NOT NULL AND to_digimon_id IS NOT NULL AND evolution_type IS NOT NULL GROUP BY from_digimon_id, to_digimon_id, evolution_type HAVING count(*) > 1)",
    "duplicate_entity": """SELECT 'warning', 'duplicate_entity', count(*) FROM (SELECT 1 FROM digimon WHERE trim(coalesce(name_ja, ''), ' ') <> '' AND trim(coalesce(name_zh_cn, ''), ' ') <> ''
      GROUP BY name_ja, name_zh_cn HAVING count(DISTINCT name_en) + max((name_en IS NULL)::INT) > 1)""",
    "invalid_level": "SELECT 'error', 'invalid_level', count(*) FROM digimon WHERE level NOT IN ('digi_egg', 'baby_i', 'baby_ii', 'child', 'adult', 'perfect', 'ultimate', 'super_ultimate', 'armor', 'hybrid', 'unknown')",
    "missing_name_zh_cn": "SELECT 'warning', 'missing_name_zh_cn', count(*) FROM digimon WHERE name_zh_cn IS NULL OR trim(name_zh_cn, ' ') = ''",
    "missing_name_en": "SELECT 'warning', 'missing_name_en', count(*) FROM digimon WHERE name_en IS NULL OR trim(name_en, ' ') = ''",
    "missing_name_ja": "SELECT 'warning', 'missing_name_ja', count(*) FROM digimon WHERE name_ja IS NULL OR trim(name_ja, ' ') = ''",
    "missing_attribute": "SELECT 'info', 'missing_attribute', count(*) FROM digimon WHERE attribute IS NULL OR trim(attribute, ' ') = '' OR attribute = 'unknown'",
    "invalid_attribute": "SELECT 'error', 'invalid_attribute', count(*) FROM digimon WHERE attribute NOT IN ('" + "', '".join([*T.ATTRIBUTES, "unknown"]) + "')",
    "snapshot_missing": "SELECT 'warning', 'snapshot_missing', (count(*) = 0)::INT FROM catalog_snapshot",
    "missing_level": "SELECT 'info', 'missing_level', count(*) FROM digimon WHERE level IS NULL OR trim(level, ' ') = '' OR level = 'unknown'",
    "count_inconsistency": "SELECT 'error', 'count_inconsistency', count(*) FROM digimon WHERE is_official_reference NOT IN (0, 1) OR is_official_reference IS NULL",
    "self_evolution": "SELECT 'warning', 'self_evolution', count(*) FROM evolution_edge WHERE from_digimon_id = to_digimon_id",
}


@query("q_validation_report", "SELECT * FROM (" + " UNION ALL ".join(_V.values()) + ") t(level, \"check\", n)")
def _(s, d):
    g, a, e = table(s, d, "digimon"), table(s, d, "digimon_alias"), table(s, d, "evolution_edge")
    levels = [*T.LEVELS, "unknown"]
    return quality.report([
        quality.duplicates(g, ["canonical_slug"], "error", "duplicate_slug"),
        quality.orphans(e, "from_digimon_id", g, "id", "error", "orphan_from"), quality.orphans(e, "to_digimon_id", g, "id", "error", "orphan_to"),
        quality.orphans(a, "digimon_id", g, "id", "error", "orphan_alias"), quality.childless(g, "id", a, "digimon_id", "info", "no_alias"),
        quality.duplicates(e, ["from_digimon_id", "to_digimon_id", "evolution_type"], "warning", "duplicate_edge"),
        quality.same_but_different(g, ["name_ja", "name_zh_cn"], "name_en", "warning", "duplicate_entity"),
        quality.outside(g, "level", levels, "error", "invalid_level"),
        quality.outside(g, "attribute", [*T.ATTRIBUTES, "unknown"], "error", "invalid_attribute"), quality.empty(table(s, d, "catalog_snapshot"), "warning", "snapshot_missing"),
        quality.conditions(g, [*[("warning", f"missing_{c}", T.is_blank(F.col(c))) for c in ("name_zh_cn", "name_en", "name_ja")], *[("info", f"missing_{c}", T.is_unknown(F.col(c))) for c in ("level", "attribute")],
                               ("error", "count_inconsistency", ~F.coalesce(F.col("is_official_reference").isin(0, 1), F.lit(False)))]),
        quality.conditions(e, [("warning", "self_evolution", F.col("from_digimon_id") == F.col("to_digimon_id"))]),
    ])


@query("q_duplicates", "SELECT p_name, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY p_name HAVING count(*) > 1")
def _(s, d):
    return table(s, d, "part").where("p_name is not null").groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("q_near_duplicates", "SELECT p_name, p_type, count(DISTINCT p_brand) AS n_brands FROM part GROUP BY p_name, p_type HAVING count(DISTINCT p_brand) > 1")
def _(s, d):
    return table(s, d, "part").groupBy("p_name", "p_type").agg(F.countDistinct("p_brand").alias("n_brands")).where("n_brands > 1")


@query("q_coverage", """SELECT field, total, present, verified, CASE WHEN total > 0 THEN round_even(100.0 * present / total, 1) ELSE 0.0 END AS pct FROM (
 SELECT unnest(['name_zh_cn', 'name_en', 'level']) AS field, total, unnest([a, b, c]) AS present, unnest([v, 0, 0]) AS verified FROM (
 SELECT count(*) AS total, count(*) FILTER (trim(coalesce(name_zh_cn, ''), ' ') <> '') AS a, count(*) FILTER (trim(coalesce(name_en, ''), ' ') <> '') AS b,
  count(*) FILTER (trim(coalesce(level, ''), ' ') <> '' AND level <> 'unknown') AS c, count(*) FILTER (trim(coalesce(name_zh_cn, ''), ' ') <> '' AND name_zh_cn_verified = 1) AS v FROM digimon))""")
def _(s, d):
    g = table(s, d, "digimon")
    told = {"name_zh_cn": ~T.is_blank(F.col("name_zh_cn")), "name_en": ~T.is_blank(F.col("name_en")), "level": ~T.is_unknown(F.col("level"))}
    return quality.coverage(g, told, {"name_zh_cn": F.coalesce(F.col("name_zh_cn_verified") == 1, F.lit(False))})


@query("q_field_coverage", """SELECT field, status, count(*) AS n FROM (SELECT unnest(['level', 'attribute']) AS field,
 unnest([CASE WHEN trim(coalesce(level, ''), ' ') NOT IN ('', 'unknown') THEN 'present' WHEN level_raw IS NULL THEN 'no_source' ELSE 'no_value' END,
         CASE WHEN trim(coalesce(attribute, ''), ' ') NOT IN ('', 'unknown') THEN 'present' WHEN attribute_raw IS NULL THEN 'no_source' ELSE 'no_value' END]) AS status FROM digimon) GROUP BY field, status""")
def _(s, d):
    status = lambda c: quality.field_status(F.trim(F.col(c)), F.lit(False), F.col(f"{c}_raw").isNotNull())
    audit = quality.field_audit(table(s, d, "digimon"), "id", {"level": status("level"), "attribute": status("attribute")})
    return audit.groupBy("field", "status").agg(F.count(F.lit(1)).alias("n"))


_KINDS = ("profile", "forum", "recap", "guide", "trivia", "help", "patch_note", "review", "stat_block", "none")


@query("q_coverage_pivot", "SELECT lang, " + ", ".join(f"count(*) FILTER (coalesce(doc_kind, 'none') = '{k}') AS \"{k}\"" for k in _KINDS) + ", count(*) AS n FROM documents GROUP BY lang")
def _(s, d):
    # every kind of the catalogue's documents has a column, no kind has one, and the total shows that none is missing
    p = table(s, d, "documents").select("lang", F.coalesce("doc_kind", F.lit("none")).alias("kind")).groupBy("lang")
    return p.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in _KINDS], F.count(F.lit(1)).alias("n"))


@query("q_percentile", """SELECT share, min(value) AS value FROM (SELECT value, row_number() OVER (ORDER BY value) AS k, count(*) OVER () AS n FROM events WHERE value IS NOT NULL),
 (VALUES (0.5::DOUBLE), (0.95::DOUBLE)) t(share) WHERE k >= ceil(share * n) GROUP BY share""")
def _(s, d):
    return quality.percentile_nearest_rank(table(s, d, "events"), "value", [0.5, 0.95])


@query("q_sample")
def _(s, d):
    return quality.sample(table(s, d, "digimon").select("id", "canonical_slug"), "id", 30, 20260815)


# ---------------------------------------------------------------- names, keys, enumerations, paths


@query("q_normalize_key", r"""SELECT p_partkey, lower(regexp_replace(regexp_replace(p_name, '(?i)\b(x[\s\-_]*antibody|xa?b?)\b', 'xantibody', 'g'), '[\s\-_:/\\().,]+', '', 'g')) AS key FROM part""")
def _(s, d):
    return table(s, d, "part").select("p_partkey", T.ascii_key(F.col("p_name")).alias("key"))


@query("q_normalize_key_unicode")
def _(s, d):
    g = table(s, d, "digimon")
    return g.select("id", T.normalize_key(F.col("name_en")).alias("key_en"), T.normalize_key(F.col("name_ja")).alias("key_ja"), T.normalize_key(T.to_simplified(F.col("name_zh_cn"), s)).alias("key_zh"))


@query("q_slug", r"""SELECT p_partkey, CASE WHEN k > 1 THEN slug || '-' || (k - 1) ELSE slug END AS slug FROM (
 SELECT p_partkey, slug, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS k FROM (
 SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part))""")
def _(s, d):
    from pyspark.sql import Window

    p = table(s, d, "part").select("p_partkey", T.canonical_slug(F.col("p_name")).alias("base"))
    k = F.row_number().over(Window.partitionBy("base").orderBy("p_partkey")) - 1
    return p.select("p_partkey", F.when(k > 0, F.concat_ws("-", "base", k.cast("string"))).otherwise(F.col("base")).alias("slug"))


@query("q_parse_enum", """SELECT id, CASE WHEN r IN ('fresh', 'babyi', 'baby', 'intrainingi') THEN 'baby_i' WHEN r IN ('child', 'rookie') THEN 'child'
 WHEN r IN ('adult', 'champion') THEN 'adult' WHEN r = 'perfect' THEN 'perfect' ELSE 'other' END AS level
 FROM (SELECT id, replace(lower(trim(level_raw, ' ')), ' ', '') AS r FROM digimon WHERE level_raw IS NOT NULL) WHERE regexp_full_match(r, '[a-z]*')""")
def _(s, d):
    g = table(s, d, "digimon").where(F.col("level_raw").isNotNull() & F.lower(F.trim("level_raw")).rlike("^[a-z ]*$"))
    v = T.parse_level(F.col("level_raw"))
    return g.select("id", F.when(v.isin("baby_i", "child", "adult", "perfect"), v).otherwise("other").alias("level"))


@query("q_parse_enum_all")
def _(s, d):
    return table(s, d, "source_digimon").select("ordinal", T.parse_level(F.col("level_raw")).alias("level"), T.parse_attribute(F.col("attribute_raw")).alias("attribute"))


@query("q_script_detect", "SELECT id, coalesce(regexp_matches(alias, '[\\x{4E00}-\\x{9FFF}]'), false) AS han, coalesce(regexp_matches(alias, '[\\x{3040}-\\x{30FF}\\x{31F0}-\\x{31FF}]'), false) AS kana FROM digimon_alias")
def _(s, d):
    return table(s, d, "digimon_alias").select("id", F.coalesce(T.has_han(F.col("alias")), F.lit(False)).alias("han"), F.coalesce(T.has_kana(F.col("alias")), F.lit(False)).alias("kana"))


@query("q_path_rules", r"""SELECT id, regexp_matches(main_image, '^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)|^data[/\\]images([/\\]|$)') AS bad, nullif(lower(regexp_extract(main_image, '^https?://([^/?#]+)', 1)), '') AS host,
 substr(sha256(main_image), 1, 8) AS sha8 FROM digimon WHERE main_image IS NOT NULL""")
def _(s, d):
    g = table(s, d, "digimon").where("main_image is not null")
    return g.select("id", T.bad_stored_path(F.col("main_image")).alias("bad"), T.url_host(F.when(F.col("main_image").rlike("^https?://"), F.col("main_image"))).alias("host"), F.substring(F.sha2("main_image", 256), 1, 8).alias("sha8"))


@query("q_json_props", """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, '{"k":' || json_extract_string(props, '$.k') || '}' AS again FROM events""")
def _(s, d):
    p = F.from_json("props", "k int")
    return table(s, d, "events").select("event_id", p["k"].alias("k"), F.to_json(p).alias("again"))


@query("q_text_escape_search", "SELECT doc_id FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '% in the')")
def _(s, d):
    return table(s, d, "documents").where(catalog.contains_literal(F.col("text"), "% in the")).select("doc_id")


@query("q_evo_type", """SELECT id, CASE WHEN regexp_matches(c, 'jogress|dna|fusion') THEN 'jogress' WHEN regexp_matches(c, 'x[- ]antibody') THEN 'x_evolution' WHEN c LIKE '%warp%' THEN 'special'
 WHEN regexp_matches(c, 'armor evolve|armor digivolution') THEN 'armor' WHEN regexp_matches(c, 'mode change|changer') THEN 'mode_change' ELSE 'normal' END AS etype
 FROM (SELECT DISTINCT id, lower(coalesce(condition, '')) AS c FROM evolution_edge)""")
def _(s, d):
    return table(s, d, "evolution_edge").select("id", F.col("condition")).distinct().select("id", T.evolution_type(F.col("condition")).alias("etype"))


@query("q_transliterate")
def _(s, d):
    return table(s, d, "digimon_alias").select("id", T.transliterate_kana(F.col("alias")).alias("han"))


# ---------------------------------------------------------------- search


@query("q_search_staged", """SELECT entity, CAST(min(stage) AS INTEGER) AS stage FROM (
 SELECT id AS entity, CASE WHEN lower(name_en) = 'rispob sizkuxmon' THEN 1 WHEN contains(lower(name_en), 'rispob') THEN 3 END AS stage FROM digimon
 UNION ALL SELECT digimon_id, CASE WHEN contains(lower(alias), 'rispob') THEN 4 END FROM digimon_alias WHERE digimon_id IS NOT NULL) WHERE stage IS NOT NULL GROUP BY entity""")
def _(s, d):
    g = table(s, d, "digimon").select(F.col("id").alias("entity"), "name_en")
    a = table(s, d, "digimon_alias").where("digimon_id is not null").select(F.col("digimon_id").alias("entity"), "alias")
    part = search.staged(g, "entity", ["name_en"], a, ["rispob"], None)
    exact = search.staged(g, "entity", ["name_en"], None, ["rispob sizkuxmon"], None)
    return part.unionByName(exact).groupBy("entity").agg(F.min("stage").alias("stage"))


_TOKENS = r"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS token FROM documents WHERE text IS NOT NULL),
 l AS (SELECT doc_id, count(*) AS length FROM t GROUP BY doc_id), p AS (SELECT token, doc_id, count(*) AS tf FROM t WHERE token IN ('lantern', 'market') GROUP BY token, doc_id)"""


@query("q_fts_and", _TOKENS + " SELECT doc_id FROM p GROUP BY doc_id HAVING count(*) = 2")
def _(s, d):
    docs = table(s, d, "documents").where("text is not null")
    return search.match_all(search.postings(docs, "doc_id", F.col("text")), "lantern market")


@query("q_fts_bm25", _TOKENS + """, st AS (SELECT count(*) AS n, avg(length) AS a FROM l), df AS (SELECT token, count(*) AS df FROM p GROUP BY token)
 SELECT doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / a))), 6) AS score
 FROM p JOIN df USING (token) JOIN l USING (doc_id), st GROUP BY doc_id HAVING count(*) = 2""")
def _(s, d):
    docs = table(s, d, "documents").where("text is not null")
    return search.bm25(search.postings(docs, "doc_id", F.col("text")), "lantern market").select("doc_id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- picks and merging

_TEXT_KEY = r"md5(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g'))"


def _keyed_docs(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", "source", "lang", "n_chars", F.md5(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", "").cast("binary")).alias("k"))


@query("q_first_wins", f"SELECT k, min(doc_id) AS doc_id FROM (SELECT doc_id, {_TEXT_KEY} AS k FROM documents WHERE text IS NOT NULL) GROUP BY k")
def _(s, d):
    return picks.first_wins(_keyed_docs(s, d).select("k", "doc_id"), ["k"], "doc_id")


@query("q_last_wins", f"SELECT k, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM (SELECT doc_id, coalesce(source, '') AS source, {_TEXT_KEY} AS k FROM documents WHERE text IS NOT NULL) GROUP BY k")
def _(s, d):
    return picks.last_wins(_keyed_docs(s, d).select("k", "doc_id", F.coalesce("source", F.lit("")).alias("source")), ["k"], "doc_id")


_RANK = "CASE source WHEN 'official' THEN 4 WHEN 'wikimon' THEN 3 WHEN 'dapi' THEN 2 WHEN 'manual' THEN 2 WHEN 'digimons_net' THEN 1 WHEN 'digidb' THEN 0 ELSE -1 END"


@query("q_priority_pick", f"""SELECT k, lang FROM (SELECT k, lang, row_number() OVER (PARTITION BY k ORDER BY r DESC, doc_id) AS i FROM (
 SELECT doc_id, lang, {_RANK} AS r, {_TEXT_KEY} AS k FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL)) WHERE i = 1""")
def _(s, d):
    return picks.priority_pick(_keyed_docs(s, d), ["k"], "lang", picks.priority(F.col("source"), merge.SOURCE_RANK), "doc_id")


@query("q_tie_review", f"""WITH v AS (SELECT k, lang, max(r) AS p FROM (SELECT lang, {_RANK} AS r, {_TEXT_KEY} AS k FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND lang <> 'unknown') GROUP BY k, lang),
 t AS (SELECT k, lang FROM v QUALIFY p = max(p) OVER (PARTITION BY k))
 SELECT k, CASE WHEN count(*) = 1 THEN min(lang) ELSE 'unknown' END AS lang, count(*) AS n_top, count(*) > 1 AS needs_review FROM t GROUP BY k""")
def _(s, d):
    return picks.tie_pick(_keyed_docs(s, d), ["k"], "lang", picks.priority(F.col("source"), merge.SOURCE_RANK))


@query("q_conflicts", """WITH v AS (SELECT regexp_replace(lower(names[1].value), '[^a-z0-9]', '', 'g') AS entity, level, min(ordinal) AS first FROM source_digimon WHERE regexp_replace(lower(names[1].value), '[^a-z0-9]', '', 'g') <> '' AND level IS NOT NULL AND level <> 'unknown' GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY first, level) AS i, count(*) OVER (PARTITION BY entity) AS n_values FROM v)
 SELECT a.entity, a.level AS value_a, b.level AS value_b, a.n_values FROM r a JOIN r b ON a.entity = b.entity AND a.i = 1 AND b.i = 2""")
def _(s, d):
    return picks.conflicts(table(s, d, "source_digimon").select(T.bare_key(F.try_element_at("names", F.lit(1))["value"]).alias("entity"), "level", "ordinal").where("entity <> ''"), ["entity"], "level", "ordinal")


@query("q_backfill", """SELECT digimon_id, arg_min(region, id) FILTER (trim(region, ' ') <> '') AS region, arg_min(source, id) FILTER (trim(source, ' ') <> '') AS source FROM digimon_alias WHERE digimon_id IS NOT NULL GROUP BY digimon_id""")
def _(s, d):
    return picks.backfill(table(s, d, "digimon_alias").where("digimon_id is not null"), ["digimon_id"], ["region", "source"], "id")


@query("q_upsert", """SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.status ELSE o.status END AS status, coalesce(n.prio, o.prio) AS prio FROM
 (SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(nullif(o_orderpriority, '5-LOW'), o_orderkey) AS prio FROM orders WHERE o_orderdate < '1996-01-01' GROUP BY 1) o FULL JOIN
 (SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS status, arg_max_null(nullif(o_orderpriority, '5-LOW'), o_orderkey) AS prio FROM orders WHERE o_orderdate >= '1996-01-01' GROUP BY 1) n ON n.k = o.k""")
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("prio"), "o_orderkey", (F.col("o_orderdate") < "1996-01-01").alias("before"))
    old = o.where("before").groupBy("k").agg(F.max_by("status", "o_orderkey").alias("status"), F.max_by("prio", F.when(F.col("prio").isNotNull(), F.col("o_orderkey"))).alias("prio"))
    new = picks.last_wins(o.where("not before").drop("before"), ["k"], "o_orderkey").drop("o_orderkey")
    return picks.upsert(old, new, ["k"], ["prio"])


def _records(s, d):
    """Source records with an entity: here the digits and letters of the source id."""
    return table(s, d, "source_digimon").withColumn("entity", T.bare_key(F.col("source_id"))).where("entity <> ''")


_ENT = "regexp_replace(lower(source_id), '[^a-z0-9]', '', 'g')"


@query("q_merge_flags", f"""SELECT entity, coalesce(bool_or(x_antibody), false) AS x_antibody, coalesce(bool_or(is_official), false) AS is_official,
 arg_min(level_raw, ordinal) FILTER (trim(level_raw, ' ') <> '') AS level_raw, arg_min(attribute_raw, ordinal) FILTER (trim(attribute_raw, ' ') <> '') AS attribute_raw,
 arg_max(image_url, (CASE source WHEN 'dapi' THEN 3 WHEN 'official' THEN 2 WHEN 'manual' THEN 2 WHEN 'wikimon' THEN 1 ELSE -1 END)::BIGINT * 1000000000 - ordinal) FILTER (trim(image_url, ' ') <> '') AS main_image, min(ordinal) AS first_ordinal
 FROM (SELECT *, {_ENT} AS entity FROM source_digimon) WHERE entity <> '' GROUP BY entity""")
def _(s, d):
    return merge.flags(_records(s, d))


@query("q_merge_fields", f"""WITH r AS (SELECT {_ENT} AS entity, source, unnest(['level', 'attribute']) AS field, unnest([level, attribute]) AS value FROM source_digimon),
 v AS (SELECT entity, field, value, max({_RANK}) AS p FROM r WHERE entity <> '' AND value IS NOT NULL AND value <> 'unknown' GROUP BY ALL), t AS (SELECT * FROM v QUALIFY p = max(p) OVER (PARTITION BY entity, field))
 SELECT entity, field, CASE WHEN count(*) = 1 THEN min(value) ELSE 'unknown' END AS value, count(*) > 1 AS needs_review FROM t GROUP BY entity, field""")
def _(s, d):
    return merge.canonical_fields(_records(s, d))


@query("q_merge_names", f"""WITH n AS (SELECT {_ENT} AS entity, ordinal, unnest(names) AS n, generate_subscripts(names, 1) AS pos FROM source_digimon)
 SELECT entity, language, name, status FROM (SELECT entity, n.language AS language, n.value AS name, n.status AS status, row_number() OVER (PARTITION BY entity, n.language ORDER BY
 CASE n.status WHEN 'official' THEN 4 WHEN 'official_game' THEN 3 WHEN 'official_anime' THEN 3 WHEN 'community' THEN 2 WHEN 'transliteration' THEN 1 WHEN 'unverified' THEN 0 ELSE -1 END DESC, ordinal, pos) AS i
 FROM n WHERE entity <> '' AND trim(coalesce(n.value, ''), ' ') <> '' AND n.language IN ('zh_cn', 'en', 'ja')) WHERE i = 1""")
def _(s, d):
    return merge.main_names(_records(s, d))


@query("q_alias_rows")
def _(s, d):
    return merge.alias_rows(_records(s, d))


@query("q_bridges", f"""WITH v AS (SELECT {_ENT} AS entity, ordinal, unnest(types) AS value, generate_subscripts(types, 1) - 1 AS pos FROM source_digimon)
 SELECT entity, value, CAST(pos = 0 AS INTEGER) AS is_primary, CAST(pos AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY entity, value ORDER BY ordinal, pos) AS i FROM v WHERE entity <> '' AND trim(coalesce(value, ''), ' ') <> '') WHERE i = 1""")
def _(s, d):
    return merge.bridge(_records(s, d), "types")


@query("q_skill_merge")
def _(s, d):
    return merge.skills(_records(s, d))


@query("q_profiles")
def _(s, d):
    return merge.profiles(_records(s, d))


@query("q_provenance", f"""SELECT entity, field, source, substr(sha256(value), 1, 16) AS value_hash, 'run-1' AS run_id FROM (
 SELECT entity, field, source, arg_min(value, ordinal) AS value FROM (SELECT {_ENT} AS entity, ordinal, source, unnest(['level', 'attribute', 'image_url']) AS field, unnest([level, attribute, image_url]) AS value FROM source_digimon)
 WHERE entity <> '' AND trim(coalesce(value, ''), ' ') <> '' GROUP BY entity, field, source)""")
def _(s, d):
    return merge.provenance(_records(s, d), ("level", "attribute", "image_url"), "run-1")


@query("q_content_hash")
def _(s, d):
    return merge.content_hash(_records(s, d), ["source", "level", "attribute", "types", "image_url"])


@query("q_entity_ids", f"SELECT entity, row_number() OVER (ORDER BY first_ordinal) AS id FROM (SELECT {_ENT} AS entity, min(ordinal) AS first_ordinal FROM source_digimon GROUP BY 1) WHERE entity <> ''")
def _(s, d):
    return merge.with_ids(merge.flags(_records(s, d)).select("entity", "first_ordinal")).select("entity", "id")


@query("q_resolve_entities")
def _(s, d):
    r = table(s, d, "source_digimon")
    told = F.filter("names", lambda n: F.coalesce(n["matchable"], F.lit(True)) & (F.trim(n["value"]) != ""))
    named = r.select("source", "source_id", "ordinal", F.explode_outer(told).alias("n")).withColumn("key", T.normalize_key(T.to_simplified(F.col("n.value"), s)))
    keys = F.array_compact(F.collect_list(F.when(F.col("key") != "", F.struct("n.language", "key"))))
    base = F.min_by("n.value", F.when(F.col("n.language") == "en", 0).when(F.col("n.language") == "ja", 1).when(F.col("n.language") == "zh_cn", 2))
    rows = named.groupBy("source", "source_id", "ordinal").agg(keys.alias("keys"), base.alias("base"))
    rows = rows.select("ordinal", "source", "source_id", T.canonical_slug(F.col("base")).alias("base_slug"), F.filter("keys", lambda k: k["language"].isNotNull()).alias("keys"))
    return resolve.resolve(rows)


# ---------------------------------------------------------------- graphs


def _edges(s, d):
    e = table(s, d, "lineitem").where("l_suppkey is not null and l_partkey is not null")
    return e.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000_000).alias("dst"), F.col("l_returnflag").alias("etype"), F.col("l_linestatus").alias("source"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("condition"), F.lit(0).alias("is_primary"), "l_orderkey", "l_linenumber")


_EDGE = """SELECT l_suppkey AS src, l_partkey + 1000000000 AS dst, l_returnflag AS etype, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS sources,
 strftime(arg_max(l_shipdate, (l_orderkey, l_linenumber, l_shipdate)), '%Y-%m-%d') AS condition, 0 AS is_primary, 'medium' AS confidence FROM lineitem GROUP BY 1, 2, 3"""


@query("q_edge_build", _EDGE)
def _(s, d):
    return graph.consolidate(_edges(s, d), ["l_orderkey", "l_linenumber", "condition"])


@query("q_edge_sources", """SELECT src, dst, etype, string_agg(DISTINCT p, ',' ORDER BY p) AS sources, max(pr) AS is_primary FROM (SELECT from_digimon_id AS src, to_digimon_id AS dst, coalesce(evolution_type, 'normal') AS etype,
 unnest(list_filter(regexp_split_to_array(coalesce(source, ''), '\\s*,\\s*'), lambda x: x <> '')) AS p, coalesce(is_primary_line, 0) AS pr FROM evolution_edge WHERE from_digimon_id IS NOT NULL AND to_digimon_id IS NOT NULL AND source IS NOT NULL) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY src, dst, etype"))
def _(s, d):
    e = table(s, d, "evolution_edge").where("from_digimon_id is not null and to_digimon_id is not null and source is not null")
    e = e.select(F.col("from_digimon_id").alias("src"), F.col("to_digimon_id").alias("dst"), F.coalesce("evolution_type", F.lit("normal")).alias("etype"), "source", "condition", F.col("is_primary_line").alias("is_primary"), "id")
    return graph.consolidate(e, ["id"]).where("sources <> ''").select("src", "dst", "etype", "sources", "is_primary")


@query("q_relations_bidir", """SELECT src AS node, dst AS other, relation, 'out' AS direction FROM (SELECT DISTINCT from_digimon_id AS src, to_digimon_id AS dst, evolution_type AS relation FROM evolution_edge WHERE from_digimon_id IS NOT NULL AND to_digimon_id IS NOT NULL) WHERE src = 5
 UNION ALL SELECT dst, src, relation, 'in' FROM (SELECT DISTINCT from_digimon_id AS src, to_digimon_id AS dst, evolution_type AS relation FROM evolution_edge WHERE from_digimon_id IS NOT NULL AND to_digimon_id IS NOT NULL) WHERE dst = 5 AND src <> 5""")
def _(s, d):
    r = table(s, d, "evolution_edge").where("from_digimon_id is not null and to_digimon_id is not null").select(F.col("from_digimon_id").alias("src"), F.col("to_digimon_id").alias("dst"), F.col("evolution_type").alias("relation")).distinct()
    return graph.both_directions(r, 5)


@query("q_degree", """SELECT node, count(DISTINCT o) AS n_out, count(DISTINCT i) AS n_in FROM (SELECT from_digimon_id AS node, to_digimon_id AS o, NULL::BIGINT AS i FROM evolution_edge WHERE from_digimon_id IS NOT NULL AND to_digimon_id IS NOT NULL
 UNION ALL SELECT to_digimon_id, NULL, from_digimon_id FROM evolution_edge WHERE from_digimon_id IS NOT NULL AND to_digimon_id IS NOT NULL) GROUP BY node""")
def _(s, d):
    return graph.degrees(table(s, d, "evolution_edge").where("from_digimon_id is not null and to_digimon_id is not null").select(F.col("from_digimon_id").alias("src"), F.col("to_digimon_id").alias("dst")))


@query("q_variant_infer", """WITH e AS (SELECT id, canonical_slug AS slug FROM digimon WHERE canonical_slug IS NOT NULL),
 v AS (SELECT id AS from_id, slug, CASE WHEN slug LIKE 'black-_%' THEN 'black-*' WHEN slug LIKE '_%-x-antibody' THEN '*-x-antibody' WHEN slug LIKE '_%-x' THEN '*-x' WHEN slug LIKE '_%-black' THEN '*-black' END AS rule FROM e),
 b AS (SELECT *, CASE rule WHEN 'black-*' THEN substr(slug, 7) WHEN '*-x-antibody' THEN substr(slug, 1, length(slug) - 11) WHEN '*-x' THEN substr(slug, 1, length(slug) - 2) ELSE substr(slug, 1, length(slug) - 6) END AS base FROM v WHERE rule IS NOT NULL),
 x AS (SELECT slug, min(id) AS id FROM e GROUP BY slug), n AS (SELECT regexp_replace(lower(slug), '[^a-z0-9]', '', 'g') AS k, min(id) AS id FROM e GROUP BY 1)
 SELECT from_id, coalesce(x.id, n.id) AS to_id, CASE WHEN rule IN ('*-x-antibody', '*-x') THEN 'x_antibody' ELSE 'black_variant' END AS relation, rule, base
 FROM b LEFT JOIN x ON x.slug = base LEFT JOIN n ON n.k = regexp_replace(lower(base), '[^a-z0-9]', '', 'g') WHERE coalesce(x.id, n.id) IS DISTINCT FROM from_id""")
def _(s, d):
    return graph.infer_variants(table(s, d, "digimon"), "id", "canonical_slug")


def _small_graph(s, d):
    e = table(s, d, "evolution_edge").where("from_digimon_id is not null and to_digimon_id is not null")
    return e.groupBy(F.col("from_digimon_id").alias("src"), F.col("to_digimon_id").alias("dst"), F.coalesce("evolution_type", F.lit("normal")).alias("etype")).agg(F.min("id").alias("id"))


for _depth in (1, 2, 3):

    @query(f"q_bfs_d{_depth}")
    def _(s, d, depth=_depth):
        return graph.neighbourhood(_small_graph(s, d), 1, depth)[0]


@query("q_bfs_full", """WITH e AS (SELECT DISTINCT from_digimon_id AS src, to_digimon_id AS dst FROM evolution_edge WHERE from_digimon_id IS NOT NULL AND to_digimon_id IS NOT NULL),
 b AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), h1 AS (SELECT DISTINCT b AS n FROM b WHERE a = 2 AND b <> 2), h2 AS (SELECT DISTINCT b AS n FROM b WHERE a IN (SELECT n FROM h1) AND b <> 2 AND b NOT IN (SELECT n FROM h1))
 SELECT 2::BIGINT AS node, 0 AS hop UNION ALL SELECT n, 1 FROM h1 UNION ALL SELECT n, 2 FROM h2""")
def _(s, d):
    return graph.hops(_small_graph(s, d).select("src", "dst"), 2, 2)


_SLUG_INDEX = """x AS (SELECT canonical_slug AS k, min(id) AS id FROM digimon WHERE canonical_slug IS NOT NULL GROUP BY 1),
 n AS (SELECT regexp_replace(lower(canonical_slug), '[^a-z0-9]', '', 'g') AS k, min(id) AS id FROM digimon WHERE canonical_slug IS NOT NULL GROUP BY 1)"""


def _slug_indexes(s, d):
    g = table(s, d, "digimon").where("canonical_slug is not null")
    exact = g.groupBy(F.col("canonical_slug").alias("key")).agg(F.min("id").alias("id"))
    loose = g.groupBy(T.bare_key(F.col("canonical_slug")).alias("key")).agg(F.min("id").alias("id"))
    return exact, loose


@query("q_link_resolve", f"""WITH {_SLUG_INDEX}, l AS (SELECT ordinal, unnest(evolves_to) AS ref, 'to' AS direction FROM source_digimon UNION ALL SELECT ordinal, unnest(evolves_from), 'from' FROM source_digimon)
 SELECT ordinal, ref, direction, coalesce(x.id, n.id) AS target FROM l LEFT JOIN x ON x.k = ref LEFT JOIN n ON n.k = regexp_replace(lower(ref), '[^a-z0-9]', '', 'g')
 WHERE ref IS NOT NULL AND NOT regexp_matches(lower(ref), 'card game|battle spirits|any adult|any child|any digimon|any armor|also evolves from|lv[.]')""")
def _(s, d):
    exact, loose = _slug_indexes(s, d)
    links = graph.link_rows(table(s, d, "source_digimon").withColumn("entity", F.col("ordinal"))).select("ordinal", "ref", "direction")
    r = graph.resolve_refs(links, "ref", exact).withColumnRenamed("target", "t0").withColumn("loose", T.bare_key(F.col("ref")))
    return graph.resolve_refs(r, "loose", loose).select("ordinal", "ref", "direction", F.coalesce("t0", "target").alias("target"))


@query("q_unresolved_targets", f"""WITH {_SLUG_INDEX}, l AS (SELECT source, unnest(evolves_to) AS ref FROM source_digimon)
 SELECT source, count(*) AS n_links, count(*) FILTER (coalesce(x.id, n.id) IS NULL) AS n_unresolved FROM l LEFT JOIN x ON x.k = ref LEFT JOIN n ON n.k = regexp_replace(lower(ref), '[^a-z0-9]', '', 'g') WHERE ref IS NOT NULL GROUP BY source""")
def _(s, d):
    exact, loose = _slug_indexes(s, d)
    links = table(s, d, "source_digimon").select("source", F.explode("evolves_to").alias("ref")).where("ref is not null")
    r = graph.resolve_refs(links, "ref", exact).withColumnRenamed("target", "t0").withColumn("loose", T.bare_key(F.col("ref")))
    r = graph.resolve_refs(r, "loose", loose)
    return r.groupBy("source").agg(F.count(F.lit(1)).alias("n_links"), F.count_if(F.coalesce("t0", "target").isNull()).alias("n_unresolved"))


@query("q_cascade_match", """WITH e AS (SELECT name_en AS k, min(id) AS id FROM digimon WHERE name_en IS NOT NULL GROUP BY 1), b AS (SELECT regexp_replace(lower(name_en), '[^a-z0-9]', '', 'g') AS k, min(id) AS id FROM digimon WHERE name_en IS NOT NULL GROUP BY 1),
 r AS (SELECT ordinal, list_filter(names, lambda x: x.language = 'en')[1].value AS name FROM source_digimon WHERE source = 'digidb')
 SELECT ordinal, name, coalesce(e.id, b.id) AS id, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN b.id IS NOT NULL THEN 'key' ELSE 'review' END AS how
 FROM r LEFT JOIN e ON e.k = name LEFT JOIN b ON b.k = regexp_replace(lower(name), '[^a-z0-9]', '', 'g')""")
def _(s, d):
    g = table(s, d, "digimon").where("name_en is not null")
    exact = g.groupBy(F.col("name_en").alias("key")).agg(F.min("id").alias("id"))
    loose = g.groupBy(T.bare_key(F.col("name_en")).alias("key")).agg(F.min("id").alias("id"))
    en = F.try_element_at(F.filter("names", lambda n: n["language"] == "en"), F.lit(1))["value"]
    r = table(s, d, "source_digimon").where("source = 'digidb'").select("ordinal", en.alias("name"), T.bare_key(en).alias("loose"))
    r = graph.resolve_refs(graph.resolve_refs(r, "name", exact).withColumnRenamed("target", "t0"), "loose", loose)
    how = F.when(F.col("t0").isNotNull(), "exact").when(F.col("target").isNotNull(), "key").otherwise("review")
    return r.select("ordinal", "name", F.coalesce("t0", "target").alias("id"), how.alias("how"))


@query("q_snapshot_stale", """SELECT (SELECT snapshot_date FROM catalog_snapshot ORDER BY id DESC LIMIT 1) AS snapshot_date, (SELECT total_count FROM catalog_snapshot ORDER BY id DESC LIMIT 1) AS told, count(*) AS counted,
 count(*) IS DISTINCT FROM (SELECT total_count FROM catalog_snapshot ORDER BY id DESC LIMIT 1) AS stale FROM digimon WHERE deleted_at IS NULL""")
def _(s, d):
    last = table(s, d, "catalog_snapshot").agg(F.max_by(F.struct("snapshot_date", "total_count"), "id").alias("l")).select("l.*").first()
    n = table(s, d, "digimon").where("deleted_at is null").agg(F.count(F.lit(1)).alias("counted"))
    told = F.lit(last["total_count"]).cast("bigint")
    return n.select(F.lit(last["snapshot_date"]).alias("snapshot_date"), told.alias("told"), "counted", (~F.col("counted").eqNullSafe(told)).alias("stale"))


# ---------------------------------------------------------------- history, review, exports, events


@query("q_latest_per_user", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def _(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("q_history_union", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def _(s, d):
    e = table(s, d, "events")
    earlier, now = e.where("event_type <> 'click'").select("user_id", "event_id"), e.select("user_id", "event_id", "event_type")
    return picks.first_wins(earlier.unionByName(now, allowMissingColumns=True).select("user_id", "event_id"), ["user_id"], "event_id")


def _queue(s, d):
    """Review rows from inferred variants and unlinked aliases."""
    v = graph.infer_variants(table(s, d, "digimon"), "id", "canonical_slug").where("to_id is null")
    a = v.select(F.col("from_id").alias("id"), F.lit("digimon").alias("entity_type"), F.concat(F.lit("unresolved base "), "base").alias("reason"), F.lit("open").alias("status"))
    b = table(s, d, "digimon_alias").where("digimon_id is null").select((F.col("id") + 1_000_000_000).alias("id"), F.lit("alias").alias("entity_type"), F.lit("ambiguous alias").alias("reason"), F.when(F.col("verified") == 1, "resolved").otherwise("open").alias("status"))
    return a.unionByName(b).withColumn("detail", F.lit(None).cast("string"))


@query("q_review_list")
def _(s, d):
    return review.select(_queue(s, d), status="open", text="BASE", category="external_target").select("id", "entity_type", "reason", "category")


@query("q_review_stats", """SELECT 'status' AS dimension, CASE WHEN verified = 1 THEN 'resolved' ELSE 'open' END AS value, count(*) AS n FROM digimon_alias WHERE digimon_id IS NULL GROUP BY 2
 UNION ALL SELECT 'entity_type', 'alias', count(*) FROM digimon_alias WHERE digimon_id IS NULL UNION ALL SELECT 'category', 'matching_failure', count(*) FROM digimon_alias WHERE digimon_id IS NULL AND verified IS DISTINCT FROM 1""")
def _(s, d):
    return review.stats(_queue(s, d).where("entity_type = 'alias'"))


@query("q_export_edges", """SELECT e.id, a.canonical_slug AS from_slug, b.canonical_slug AS to_slug, coalesce(evolution_type, '') AS evolution_type FROM (SELECT DISTINCT id, from_digimon_id, to_digimon_id, evolution_type FROM evolution_edge) e
 JOIN digimon a ON a.id = from_digimon_id JOIN digimon b ON b.id = to_digimon_id""")
def _(s, d):
    e = table(s, d, "evolution_edge").select("id", "from_digimon_id", "to_digimon_id", "evolution_type").distinct()
    g = table(s, d, "digimon").select("id", "canonical_slug")
    a = g.select(F.col("id").alias("from_digimon_id"), F.col("canonical_slug").alias("from_slug"))
    b = g.select(F.col("id").alias("to_digimon_id"), F.col("canonical_slug").alias("to_slug"))
    return e.join(a, "from_digimon_id").join(b, "to_digimon_id").select("id", "from_slug", "to_slug", F.coalesce("evolution_type", F.lit("")).alias("evolution_type"))


@query("q_markup_clean")
def _(s, d):
    wiki = F.concat(F.lit("'''"), F.coalesce("name_en", F.lit("")), F.lit("''' {{Ety|"), F.coalesce("profile_en", F.lit("")), F.lit("}} [[Link|shown]]<ref>note</ref>"))
    return table(s, d, "digimon").select("id", clean_markup(wiki).alias("c")).select("id", "c.text", "c.unresolved")


@query("X_events_window", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(s, d):
    w = streaming.windowed(table(s, d, "events"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


