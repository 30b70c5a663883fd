"""Column functions for names, keys, slugs, enumerations, paths and texts."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Signs that are no part of a key.
KEY_PUNCTUATION = r"[\s\-_:/\\()（）\[\]【】.,・·~～'\"`“”‘’]+"
#: Spellings of the X-Antibody mark.
X_ANTIBODY = r"(?iU)\b(x[\s\-_]*antibody|xa?b?)\b"
#: Marks that a name carries and the slug endings they become.
SLUG_MARKS = (
    (r"(?i)\((2006 anime version|2006 anime|2006|anime version)\)", "-2006"),
    (r"(?i)\(x-antibody\)", "-x-antibody"), (r"(?i)\(black\)", "-black"), (r"(?i)\(virus\)", "-virus"), (r"(?i)\(deva\)", "-deva"),
    (r"(?i)\(dub\)", "-dub"), (r"(?i)\(male\)", "-male"), (r"(?i)\(female\)", "-female"),
)
#: Spellings of the levels.
LEVELS = {
    "digi_egg": "digi-egg|digi egg|digitama|数码蛋|蛋|幼生体",
    "baby_i": "fresh|baby i|baby|幼年期|幼年期i|幼年期ⅰ|幼年期1|幼年期i期|intrainingi",
    "baby_ii": "in training|in-training|intraining|baby ii|幼年期ⅱ|幼年期ii|幼年期2|幼年期ii期|intrainingii",
    "child": "child|rookie|成长期|成長期|成长期i",
    "adult": "adult|champion|成熟期|成熟期i",
    "perfect": "perfect|完全体",
    "ultimate": "ultimate|mega|究极体|究極体|究極體",
    "super_ultimate": "super ultimate|超究极体|超究極体",
    "armor": "armor|armour|装甲体|裝甲體",
    "hybrid": "hybrid|fusion|混合体|混合體|鬥士體",
}
#: Spellings of the attributes.
ATTRIBUTES = {
    "vaccine": "vaccine|ワクチン種|疫苗种|疫苗種|疫苗|vaccine type",
    "virus": "virus|ウィルス種|ウイルス種|病毒种|病毒種|病毒|virus type",
    "data": "data|データ種|资料种|資料種|资料|資料|data type",
    "free": "free|フリー種|自由种|自由種|free type",
    "variable": "variable|バリアブル種|可变种|可變種|variable type",
}


def ascii_lower(c: Column) -> Column:
    """Lower case for A to Z only."""
    return F.translate(c, _UPPER, _LOWER)


def is_blank(c: Column) -> Column:
    """Null or nothing but spaces."""
    return c.isNull() | (F.trim(c) == "")


def is_unknown(c: Column) -> Column:
    """Null, blank or 'unknown'."""
    return is_blank(c) | (c == "unknown")


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition by the library that ships with Spark."""
    return F.when(c.isNotNull(), F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True)))


def nfkd(c: Column) -> Column:
    """Unicode compatibility decomposition."""
    return F.when(c.isNotNull(), F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), c, F.lit(True)))


def fold_case(c: Column) -> Column:
    """Full Unicode case folding."""
    return F.when(c.isNotNull(), F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True)))


def key_of_normalised(c: Column) -> Column:
    """The key of a text already in compatibility form: mark, punctuation, case."""
    return fold_case(F.regexp_replace(F.regexp_replace(c, X_ANTIBODY, "xantibody"), KEY_PUNCTUATION, ""))


def normalize_key(c: Column) -> Column:
    """The lossy key by which names are compared; empty for null."""
    return F.coalesce(key_of_normalised(nfkc(c)), F.lit(""))


def ascii_key(c: Column) -> Column:
    """``normalize_key`` for texts known to be ASCII: stays in generated code."""
    return F.coalesce(F.lower(F.regexp_replace(F.regexp_replace(c, X_ANTIBODY, "xantibody"), KEY_PUNCTUATION, "")), F.lit(""))


@lru_cache(maxsize=4)
def _han_map(direction: str, transliterate) -> tuple[str, str]:
    codes = "".join(map(chr, [*range(0x3400, 0x4DC0), *range(0x4E00, 0xA000)]))
    got = transliterate(direction, codes)
    pairs = [(a, b) for a, b in zip(codes, got) if a != b] if len(got) == len(codes) else []
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _transliterator(spark: SparkSession):
    jvm = spark._jvm
    return lambda direction, text: jvm.com.ibm.icu.text.Transliterator.getInstance(direction).transliterate(text)


def to_simplified(c: Column, spark: SparkSession) -> Column:
    """Traditional to simplified ideographs, sign by sign, as one ``translate``."""
    return F.translate(c, *_han_map("Traditional-Simplified", _transliterator(spark)))


def to_traditional(c: Column, spark: SparkSession) -> Column:
    """Simplified to traditional ideographs."""
    return F.translate(c, *_han_map("Simplified-Traditional", _transliterator(spark)))


def has_han(c: Column) -> Column:
    """Any ideograph."""
    return c.rlike("[\\x{4E00}-\\x{9FFF}]")


def has_kana(c: Column) -> Column:
    """Any kana."""
    return c.rlike("[\\x{3040}-\\x{30FF}\\x{31F0}-\\x{31FF}]")


def slugify(c: Column) -> Column:
    """An ASCII slug of a name."""
    plain = F.regexp_replace(nfkd(c), r"[^\x00-\x7F]", "")
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, X_ANTIBODY, "xantibody"), KEY_PUNCTUATION, "-"), "^-+|-+$", ""))


def canonical_slug(en: Column, romanized: Column | None = None, ja: Column | None = None, zh: Column | None = None) -> Column:
    """The slug of an entity from its names: the first name told, its marks, a digest where no Latin letter is left."""
    told = [F.when(~is_blank(n), n) for n in (en, romanized, ja, zh) if n is not None]
    base = F.coalesce(*told, F.lit(""))
    s = F.trim(base)
    for pattern, ending in SLUG_MARKS:
        s = F.regexp_replace(s, pattern, ending)
    s = F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s != "", s).otherwise(F.concat(F.lit("digimon-"), F.substring(F.sha1(base), 1, 10)))


def bare_key(c: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def _literal_map(spellings: dict[str, str], compact: bool) -> Column:
    pairs = {}
    for value, forms in spellings.items():
        for form in forms.split("|"):
            pairs.setdefault(_compact_text(form) if compact else form, value)
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _compact_text(s: str) -> str:
    import re

    return re.sub(r"[\s\-_.,·]+", "", s)


def compact(c: Column) -> Column:
    """Lower case, Roman numerals spelled out, without a (XW) mark, blanks and light punctuation."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[Ⅱⅱ]", "ii"), "[Ⅰⅰ]", "i")
    return F.regexp_replace(F.regexp_replace(s, r"[（(]\s*xw\s*[）)]", ""), r"[\s\-_.,·]+", "")


def parse_level(c: Column) -> Column:
    """The level that a raw text names: as it stands, else in compact form, else 'unknown'."""
    direct = F.element_at(_literal_map(LEVELS, False), F.lower(F.trim(c)))
    return F.coalesce(direct, F.element_at(_literal_map(LEVELS, True), compact(c)), F.lit("unknown"))


def parse_attribute(c: Column) -> Column:
    """The attribute that a raw text names, else 'unknown'."""
    return F.coalesce(F.element_at(_literal_map(ATTRIBUTES, False), F.lower(F.trim(c))), F.lit("unknown"))


def evolution_type(condition: Column) -> Column:
    """The kind of a link by the words of its condition."""
    low = F.lower(F.coalesce(condition, F.lit("")))
    any_of = lambda *words: low.rlike("|".join(words))
    return (
        F.when(any_of("jogress", "dna", "fusion"), "jogress")
        .when(any_of("x[- ]antibody"), "x_evolution")
        .when(any_of("warp"), "special")
        .when(any_of("armor evolve", "armor digivolution"), "armor")
        .when(any_of("mode change", "changer"), "mode_change")
        .otherwise("normal")
    )


def review_category(reason: Column) -> Column:
    """The category of a review reason."""
    low = ascii_lower(F.coalesce(reason, F.lit("")))
    return (
        F.when(low.contains("wikitext"), "wikitext")
        .when(low.contains("unresolved") | low.contains("target"), "external_target")
        .when(low.contains("ambiguous") | low.contains("needs review"), "matching_failure")
        .when(low.contains("conflict"), "conflict")
        .otherwise("other")
    )


def alias_type(language: Column) -> Column:
    """The type of an alias by its language."""
    return F.when(language == "romanized", "romanization").when(language == "en_dub", "dub").when(language.isin("zh_hk", "zh_tw"), "alternative_spelling").otherwise("official")


def int_or_null(c: Column) -> Column:
    """An integer from a text that may hold decimals."""
    return c.try_cast("double").try_cast("int")


def bad_stored_path(c: Column) -> Column:
    """A path that is absolute, climbs, names a drive or repeats the cache root."""
    return c.rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)|^data[/\\]images([/\\]|$)")


def rebase_path(c: Column) -> Column:
    """The part of a path after the cache root, the path itself if it is clean, else null."""
    slashes = F.replace(c, F.lit("\\"), F.lit("/"))
    tail = F.regexp_extract(slashes, r"(?:^|/)data/images/(.+)$", 1)
    return F.when(tail != "", tail).when(~bad_stored_path(slashes), slashes)


def image_name(entity_id: Column, url: Column) -> Column:
    """The relative name of a cached image."""
    suffix = F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"(\.[A-Za-z0-9]{1,6})$", 1)
    return F.concat(F.format_string("digi_%05d_", entity_id), F.substring(F.sha2(url, 256), 1, 8), F.when(suffix != "", F.lower(suffix)).otherwise(".img"))


def url_host(c: Column) -> Column:
    """The host of a URL in lower case, null if there is none."""
    return F.lower(F.try_parse_url(c, F.lit("HOST")))


def markdown_cell(c: Column) -> Column:
    """A text safe in a Markdown table cell."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("|", "\\|"), ("\r\n", "<br>"), ("\n", "<br>")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


#: Ideographs that spell kana in transliterated names.
KANA_TO_HAN = {
    "ア": "阿", "イ": "伊", "ウ": "乌", "エ": "埃", "オ": "奥",
    "カ": "卡", "キ": "基", "ク": "库", "ケ": "凯", "コ": "科",
    "サ": "萨", "シ": "西", "ス": "斯", "セ": "塞", "ソ": "索",
    "タ": "塔", "チ": "奇", "ツ": "茨", "テ": "铁", "ト": "托",
    "ナ": "纳", "ニ": "尼", "ヌ": "努", "ネ": "内", "ノ": "诺",
    "ハ": "哈", "ヒ": "希", "フ": "夫", "ヘ": "赫", "ホ": "霍",
    "マ": "玛", "ミ": "米", "ム": "姆", "メ": "梅", "モ": "莫",
    "ヤ": "雅", "ユ": "尤", "ヨ": "约",
    "ラ": "拉", "リ": "利", "ル": "鲁", "レ": "雷", "ロ": "罗",
    "ワ": "瓦", "ヲ": "沃", "ン": "恩",
    "ガ": "加", "ギ": "吉", "グ": "古", "ゲ": "盖", "ゴ": "戈",
    "ザ": "扎", "ジ": "吉", "ズ": "兹", "ゼ": "泽", "ゾ": "佐",
    "ダ": "达", "ヂ": "治", "ヅ": "兹", "デ": "德", "ド": "多",
    "バ": "巴", "ビ": "比", "ブ": "布", "ベ": "贝", "ボ": "博",
    "パ": "帕", "ピ": "皮", "プ": "普", "ペ": "佩", "ポ": "波",
    "ヴ": "武", "ァ": "阿", "ィ": "伊", "ゥ": "乌", "ェ": "埃", "ォ": "奥",
    "ャ": "亚", "ュ": "尤", "ョ": "约",
}


def transliterate_kana(c: Column) -> Column:
    """Pure katakana of at most eight signs in ideographs; null otherwise."""
    short = F.regexp_replace(c, "[ッー]", "")
    table = KANA_TO_HAN
    return F.when(c.rlike("^[ァ-ヶー]{1,8}$") & ~short.rlike("[^" + "".join(table) + "]"), F.translate(short, "".join(table), "".join(table.values())))


def search_variants(query: str, spark: SparkSession) -> list[str]:
    """The spellings under which a query is looked up: itself, without punctuation, simplified, traditional."""
    import re

    out = [query, re.sub(KEY_PUNCTUATION, "", query)]
    if re.search("[一-鿿]", query):
        for direction in ("Traditional-Simplified", "Simplified-Traditional"):
            a, b = _han_map(direction, _transliterator(spark))
            out.append(query.translate(str.maketrans(a, b)))
    return [v for v in dict.fromkeys(out) if v.strip()]


def label_dimension(spark: SparkSession) -> DataFrame:
    """(vocabulary, value, spelling) of levels and attributes as a small table."""
    rows = [(v, value, s) for v, m in (("level", LEVELS), ("attribute", ATTRIBUTES)) for value, forms in m.items() for s in forms.split("|")]
    return spark.createDataFrame(rows, "vocabulary string, value string, spelling string")
