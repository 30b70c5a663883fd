"""Full-text search: postings, AND matching with prefixes, BM25, and staged ranking over names and aliases."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraph.functions.text import ascii_lower

K1, B = 1.2, 0.75


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Accented small Latin letters and their plain ones, from the decompositions of Unicode."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(a, b) for a, b in pairs if b != a and "a" <= b <= "z"]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case, without diacritics of Latin letters."""
    return F.filter(F.split(F.regexp_replace(F.translate(F.lower(text), *_accents()), r"[^\p{L}\p{N}]+", " "), " "), lambda t: t != "")


def postings(docs: DataFrame, doc_id: str, text: Column) -> DataFrame:
    """(token, doc_id, tf, length): one row per token and document, the document's length beside it."""
    t = docs.select(F.col(doc_id).alias("doc_id"), tokens(text).alias("t")).where(F.size("t") > 0)
    # the length travels with the tokens, so ranking needs no second join; counting combines before the shuffle
    return t.select("doc_id", F.size("t").alias("length"), F.explode("t").alias("token")).groupBy("token", "doc_id", "length").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(query: str) -> list[tuple[str, bool]] | None:
    """(token, is prefix) of a query of bare words; None if it holds any other syntax."""
    words = query.replace('"', " ").split()
    plain = str.maketrans(*_accents())
    out = [(re.sub(r"\*$", "", w).lower().translate(plain), w.endswith("*")) for w in words]
    if not out or any(not re.fullmatch(r"\w+", t) for t, _ in out):
        return None
    return out


def match_all(post: DataFrame, query: str) -> DataFrame:
    """(doc_id): documents that hold every term."""
    terms = query_terms(query)
    if terms is None:
        return post.select("doc_id").limit(0)
    cond = lambda t, p: F.col("token").startswith(t) if p else F.col("token") == t
    any_term = F.lit(False)
    for t, p in terms:
        any_term = any_term | cond(t, p)
    g = post.where(any_term).groupBy("doc_id").agg(*[F.max(cond(t, p)).alias(f"m{i}") for i, (t, p) in enumerate(terms)])
    for i in range(len(terms)):
        g = g.where(F.col(f"m{i}"))
    return g.select("doc_id")


def bm25(post: DataFrame, query: str) -> DataFrame:
    """(doc_id, score) of documents that hold every term; only the query's postings are scored. A prefix counts all words it begins."""
    terms = list(dict.fromkeys(query_terms(query) or []))
    if not terms:
        return post.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    per_doc = post.select("doc_id", "length").distinct()
    n, average = per_doc.agg(F.count(F.lit(1)), F.avg("length")).first()  # one row of corpus statistics
    found = [F.col("token").startswith(t) if p else F.col("token") == t for t, p in terms]
    met = [F.when(c, F.lit(i)) for i, c in enumerate(found)]
    # a filter on the token goes below the counting of the postings: only the query's words are shuffled
    hits = post.where(reduce(or_, found)).select("doc_id", "length", "tf", F.explode(F.array_compact(F.array(*met))).alias("term"))
    hits = hits.groupBy("doc_id", "length", "term").agg(F.sum("tf").alias("tf"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    s = hits.join(F.broadcast(df), "term")  # one row per query term
    idf = F.greatest(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(average or 1.0)))
    g = s.withColumn("w", weight).groupBy("doc_id").agg(F.sum("w").alias("score"), F.count(F.lit(1)).alias("found"))
    return g.where(F.col("found") == len(terms)).select("doc_id", "score")


def staged(names: DataFrame, entity: str, columns: list[str], aliases: DataFrame | None, variants: list[str], limit: int | None, post: DataFrame | None = None) -> DataFrame:
    """(entity, stage, sub): exact name, exact alias, part of a name, part of an alias, full text; the first stage wins.

    ``aliases`` has (entity, alias). Every stage is a filter of one scan; full-text hits are ordered by their score. Without
    a limit all hits are told, else the result is a bounded top-k.
    """
    def stage_rows(df: DataFrame, cols: list[str], exact: int, part: int) -> DataFrame:
        out = F.lit(None).cast("struct<stage:int,sub:int>")
        for v_i in reversed(range(len(variants))):
            low = ascii_lower(F.lit(variants[v_i]))
            some = F.lit(False)
            for c in cols:
                some = some | ascii_lower(F.col(c)).contains(low)
            out = F.when(some, F.struct(F.lit(part).alias("stage"), F.lit(v_i).alias("sub"))).otherwise(out)
        for v_i in reversed(range(len(variants))):
            low = ascii_lower(F.lit(variants[v_i]))
            same = F.lit(False)
            for c in cols:
                same = same | F.coalesce(ascii_lower(F.col(c)) == low, F.lit(False))
            out = F.when(same, F.struct(F.lit(exact).alias("stage"), F.lit(v_i).alias("sub"))).otherwise(out)
        return df.select(F.col(entity).alias("entity"), out.alias("s")).where("s is not null").select("entity", "s.stage", "s.sub")

    rows = stage_rows(names, columns, 1, 3)
    if aliases is not None:
        rows = rows.unionByName(stage_rows(aliases, ["alias"], 2, 4))
    rows = rows.withColumn("score", F.lit(0.0))
    if post is not None and not any(re.search("[぀-ヿ一-鿿]", v) for v in variants):
        found = bm25(post, variants[0])
        rows = rows.unionByName(found.select(F.col("doc_id").alias("entity"), F.lit(5).alias("stage"), F.lit(0).alias("sub"), "score"))
    best = rows.groupBy("entity").agg(F.min(F.struct("stage", "sub", (-F.col("score")).alias("s"))).alias("s"))
    out = best.select("entity", "s.stage", "s.sub", "s.s").orderBy("stage", "sub", "s", "entity").drop("s")
    return out if limit is None else out.limit(limit)
