"""Mapping free-entered values to a reference list: token repair by edit distance, ranking by soft TF-IDF.

Only distinct values are mapped, so a value that holds a third of all rows is worked on once.

1. Values are normalised (compatibility forms, case, simplified ideographs) and cut into tokens: words, segments
   between separators without their blanks, and the whole value without blanks.
2. Token repair. Each distinct token is joined to the vocabulary of the reference list: by equal deletion
   neighbours for edits (one edit from four letters on, two from nine; tokens with ideographs must match as they
   stand) and by equal beginnings for abbreviations (from three letters on). A join finds the candidates, the
   edit distance verifies them; a token of the vocabulary holds no edits.
3. Soft TF-IDF. Every label of an entry is a document of its words, and one of its letters without blanks. A
   label counts only if all its tokens are found; its score is the sum over its tokens of squared idf times
   similarity, over its length. The best label wins; a tie between different entries means none.

Defined cases: a null or blank value is not mapped; a value that names no entry, or several alike, gets 0, as does
one whose letters are mostly foreign to every label; values and lists of any length are read whole; empty tables
give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.session import cut, sized_join

#: Words beside a value that say nothing about which entry is meant.
QUALIFIERS = ("a", "an", "the", "level", "lvl", "lv", "stage", "type", "types", "attribute", "attr", "digimon", "probably", "maybe", "perhaps", "likely", "xw", "tbc", "unconfirmed", "form")
#: Share of a value's letters, qualifiers aside, that its label must account for.
LEAST_SHARE = 0.5


def normal(value: Column, simplify: dict[int, str]) -> Column:
    """Compatibility forms, lower case, simplified ideographs."""
    nfkc = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), value, F.lit(True))
    low = F.lower(F.when(value.isNotNull(), nfkc))
    if simplify:
        pairs = sorted(simplify.items())
        low = F.translate(low, "".join(chr(a) for a, _ in pairs), "".join(b for _, b in pairs))
    return low


def value_tokens(low: Column, camel: Column | None = None) -> Column:
    """Distinct tokens of a normalised value."""
    words = F.regexp_extract_all(low, F.lit(r"\p{IsLatin}+|\p{N}+|[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]+"), F.lit(0))
    segments = F.transform(F.split(low, r"[/,、，;；・:：()（）\[\]【】|]+"), squash)
    return F.filter(F.array_distinct(F.concat(words, segments, F.array(squash(low)))), lambda t: t != "")


def squash(low: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(low, r"[^\p{L}\p{N}ー]", "")


def labels(terms: DataFrame, term_id: str, vocabulary: str, columns: list[str], simplify: dict[int, str]) -> DataFrame:
    """(vocabulary, term_id, label, token, idf, length): the documents of the reference list, by words and squashed."""
    arms = F.array_compact(F.array(*[F.col(c) for c in columns]))
    t = terms.select(F.col(vocabulary).alias("vocabulary"), F.col(term_id).alias("term_id"), F.explode(arms).alias("raw"))
    t = t.withColumn("low", F.regexp_replace(normal(F.col("raw"), simplify), "_", " ")).where(squash(F.col("low")) != "")
    words = F.array_distinct(F.regexp_extract_all("low", F.lit(r"[\p{L}\p{N}ー]+"), F.lit(0)))
    docs = t.select("vocabulary", "term_id", F.explode(F.array_distinct(F.array(words, F.array(squash(F.col("low")))))).alias("doc")).distinct()
    n = docs.groupBy("vocabulary").agg(F.count(F.lit(1)).alias("n_docs"))
    rows = docs.select("vocabulary", "term_id", F.concat_ws(" ", "doc").alias("label"), F.explode("doc").alias("token"))
    df = rows.groupBy("vocabulary", "token").agg(F.countDistinct("term_id", "label").alias("df"))
    rows = rows.join(df, ["vocabulary", "token"]).join(n, "vocabulary").withColumn("idf", F.log1p(F.col("n_docs") / F.col("df")))
    length = F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(Window.partitionBy("vocabulary", "term_id", "label")))
    size = F.count(F.lit(1)).over(Window.partitionBy("vocabulary", "term_id", "label"))
    return rows.select("vocabulary", "term_id", "label", "token", "idf", length.alias("length"), size.alias("size"))


def _edits(token: Column) -> Column:
    """How many edits a token of this kind and length may hold."""
    plain = ~token.rlike(r"[\p{IsHan}\p{N}]")
    n = F.length(token)
    return F.when(plain & (n >= 9), 2).when(plain & (n >= 3), 1).otherwise(0)


def _neighbours(token: Column, most: Column) -> Column:
    """The token and all that is left after up to two deletions."""
    def less(t: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))

    one = less(token)
    two = F.flatten(F.transform(one, lambda x: F.when(F.length(x) > 0, less(x)).otherwise(F.array(x))))
    return F.array_distinct(F.when(most == 2, F.concat(F.array(token), one, two)).when(most == 1, F.concat(F.array(token), one)).otherwise(F.array(token)))


def repair(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(vocabulary, token, known, sim): tokens with the vocabulary tokens they may stand for. Both: distinct (vocabulary, token)."""
    known = vocabulary.select("vocabulary", F.col("token").alias("known"))
    exact = tokens.join(F.broadcast(known), (tokens["vocabulary"] == known["vocabulary"]) & (tokens["token"] == known["known"]), "left_semi")
    exact = exact.select("vocabulary", "token", F.col("token").alias("known"), F.lit(1.0).alias("sim"))
    rest = tokens.join(F.broadcast(known), (tokens["vocabulary"] == known["vocabulary"]) & (tokens["token"] == known["known"]), "left_anti")
    # deletion neighbours; the reference list is fixed and small, so its variants are broadcast after a count in sized_join
    # a token longer than every known one by more than the edits cannot be one of them
    longest = known.agg(F.max(F.length("known"))).first()[0] or 0
    a = rest.where(F.length("token") <= longest + 2).select("vocabulary", "token", F.explode(_neighbours(F.col("token"), _edits(F.col("token")))).alias("v"))
    b = cut(known.select("vocabulary", "known", F.explode(_neighbours(F.col("known"), _edits(F.col("known")))).alias("v")))
    near = sized_join(a, b, ["vocabulary", "v"]).select("vocabulary", "token", "known").distinct()
    swapped = (F.length("token") == F.length("known")) & (F.array_sort(F.split("token", "")) == F.array_sort(F.split("known", "")))
    d = F.levenshtein("token", "known")
    d = F.when(swapped & (d == 2), 1).otherwise(d)
    near = near.withColumn("d", d).where(F.col("d") <= F.least(_edits(F.col("token")), _edits(F.col("known"))))
    near = near.select("vocabulary", "token", "known", (1 - F.col("d") / F.greatest(F.length("token"), F.length("known"))).alias("sim"))
    # beginnings of the known tokens
    starts = known.where(F.length("known") > 3).select("vocabulary", "known", F.explode(F.transform(F.sequence(F.lit(3), F.length("known") - 1), lambda i: F.substring("known", F.lit(1), i))).alias("v"))
    short = tokens.select("vocabulary", "token", F.col("token").alias("v")).where(F.length("token") >= 3)
    short = sized_join(short, cut(starts), ["vocabulary", "v"])
    # one similarity for all, so that a beginning common to several entries is a tie
    short = short.select("vocabulary", "token", "known", F.lit(0.6).alias("sim"))
    return exact.unionByName(near).unionByName(short).groupBy("vocabulary", "token", "known").agg(F.max("sim").alias("sim"))


def map_values(values: DataFrame, docs: DataFrame, simplify: dict[int, str]) -> DataFrame:
    """(vocabulary, value, term_id): the entry of every distinct (vocabulary, value), 0 for none."""
    docs = cut(docs)
    rows = values.select("vocabulary", "value").distinct().withColumn("low", F.regexp_replace(normal(F.col("value"), simplify), "_", " "))
    rows = cut(rows.withColumn("tokens", value_tokens(F.col("low"))))
    exploded = rows.select("vocabulary", "value", F.explode("tokens").alias("token"))
    repaired = repair(exploded.select("vocabulary", "token").distinct(), docs.select("vocabulary", "token").distinct())
    hits = exploded.join(repaired, ["vocabulary", "token"])
    hits = hits.groupBy("vocabulary", "value", "known").agg(F.max_by(F.struct("token", "sim"), F.struct("sim", "token")).alias("h"))
    d = docs.withColumnRenamed("token", "known")
    scored = sized_join(hits, d, ["vocabulary", "known"])
    scored = scored.groupBy("vocabulary", "value", "term_id", "label", "length", "size").agg(
        F.count(F.lit(1)).alias("found"),
        F.sum(F.col("idf") * F.col("idf") * F.col("h.sim")).alias("s"),
        F.collect_set("h.token").alias("used"),  # at most the tokens of one label
    )
    scored = scored.where("found = size and size(used) = size").withColumn("score", F.round(F.col("s") / F.col("length"), 9))
    # the labels of one entry in several languages may stand side by side: together they explain the value
    per_term = scored.groupBy("vocabulary", "value", "term_id").agg(
        F.struct(F.max("score").alias("score"), F.array_distinct(F.flatten(F.collect_list("used"))).alias("used")).alias("b")
    )
    best = per_term.groupBy("vocabulary", "value").agg(
        F.max_by(F.struct("term_id", "b"), F.struct("b.score", "term_id")).alias("m"), F.max("b.score").alias("top"), F.collect_list("b.score").alias("scores")
    )
    best = best.select("vocabulary", "value", F.col("m.term_id").alias("term_id"), F.col("m.b.used").alias("used"), F.size(F.filter("scores", lambda x: x == F.col("top"))).alias("ties"))
    out = rows.join(best, ["vocabulary", "value"], "left")
    words = F.filter(F.regexp_extract_all("low", F.lit(r"[\p{L}\p{N}ー]+"), F.lit(0)), lambda w: ~w.isin(*QUALIFIERS))
    letters = F.aggregate(words, F.lit(0), lambda acc, w: acc + F.length(w))
    # the letters of words that the label explains: a used token is a word, a segment or the whole
    explained = F.aggregate("used", F.lit(0), lambda acc, w: acc + F.length(w))
    ok = (F.col("ties") == 1) & (explained >= letters * LEAST_SHARE * 0.999)
    return out.select("vocabulary", "value", F.when(ok, F.col("term_id")).otherwise(F.lit(0)).cast("bigint").alias("term_id"))
