"""Entity resolution by exact keys: blocked, then folded in order of arrival within each block.

Records that share a name key, an external id or a slug stem are linked to one block by connected components
(minimum labels spread by joins). Inside a block the records are taken in order: the external id decides, else the
first language whose first known name has hits; one hit joins, several make a flagged entity of its own, none a new
one. Blocks are independent, so they run in parallel.

Defined cases: null or blank names give no key; names not meant for matching are ignored; records without any key are
entities of their own; equal slugs get endings -1, -2, … in order of arrival.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.session import cut

#: The order in which languages are tried.
LANGUAGES = ("ja", "en", "romanized", "zh_cn", "en_dub", "zh_hk", "zh_tw")
_OUT = "ordinal bigint, slug string, how string, needs_review boolean, first_ordinal bigint"


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, label): connected components of (node, key) links by the smallest node.

    Every round joins nodes with the smallest label of each of their keys; sizes per key are combined before the
    shuffle, so a hot key is one aggregate, not all its pairs.
    """
    links = cut(links.distinct())
    label = cut(links.select("node").distinct().withColumn("label", F.col("node")))
    for _ in range(max_rounds):
        keyed = links.join(label, "node")
        low = keyed.groupBy("key").agg(F.min("label").alias("low"))
        nxt = links.join(low, "key").groupBy("node").agg(F.min("low").alias("low"))
        new = label.join(nxt, "node").select("node", F.least("label", "low").alias("label"), (F.col("low") < F.col("label")).alias("moved"))
        # jump to the label of the label: chains shrink by half each round
        up = new.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = cut(new.join(up, "label", "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "moved"))
        stable = new.where("moved").isEmpty()
        label = new.drop("moved")
        if stable:
            return label
    raise RuntimeError(f"labels still move after {max_rounds} rounds")


def fold_block(records: pd.DataFrame) -> pd.DataFrame:
    """Resolve the records of one block in order. Columns: ordinal, source, source_id, base_slug, keys (list of language, key)."""
    by_id: dict[tuple, str] = {}
    by_name: dict[str, list[str]] = {}
    taken: set[str] = set()
    first: dict[str, int] = {}
    out = []
    for r in records.sort_values("ordinal", kind="stable").itertuples(index=False):
        keys = [(k["language"], k["key"]) for k in r.keys]
        slug, how, review = by_id.get((r.source, r.source_id)) if r.source_id else None, "external_id", False
        if slug is None:
            how = "new"
            for language in LANGUAGES:
                hits = next((h for lang, k in keys if lang == language and (h := by_name.get(k))), [])
                if len(hits) == 1:
                    slug, how = hits[0], "name"
                elif hits:
                    how, review = "ambiguous", True
                if hits:
                    break
        if slug is None:
            slug, i = r.base_slug, 0
            while slug in taken:
                i += 1
                slug = f"{r.base_slug}-{i}"
            taken.add(slug)
            first[slug] = r.ordinal
        if r.source_id:
            by_id[(r.source, r.source_id)] = slug
        for _, k in keys:
            known = by_name.setdefault(k, [])
            if slug not in known:
                known.append(slug)
        out.append((r.ordinal, slug, how, review, first[slug]))
    return pd.DataFrame(out, columns=["ordinal", "slug", "how", "needs_review", "first_ordinal"])


def resolve(records: DataFrame) -> DataFrame:
    """(ordinal, slug, how, needs_review, first_ordinal) of records (ordinal, source, source_id, base_slug, keys).

    ``keys`` is array<struct<language,key>> of the names meant for matching.
    """
    stem = F.concat(F.lit("s:"), F.regexp_replace("base_slug", r"(-\d+)+$", ""))
    ext = F.when(F.col("source_id").isNotNull(), F.concat_ws("\u0001", F.lit("x"), "source", "source_id"))
    blocks = F.array_compact(F.concat(F.transform("keys", lambda k: F.concat(F.lit("n:"), k["key"])), F.array(stem, ext)))
    links = records.select(F.col("ordinal").alias("node"), F.explode(blocks).alias("key"))
    label = components(links).withColumnRenamed("node", "ordinal")
    rows = records.select("ordinal", "source", "source_id", "base_slug", "keys").join(label, "ordinal")
    return rows.groupBy("label").applyInPandas(lambda pdf: fold_block(pdf.drop(columns="label")), _OUT)
