"""Directed multigraphs: edge building, neighbourhoods within budgets, variants, degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.functions.text import bare_key, evolution_type
from lexigraph.operators.picks import first_wins, sorted_csv
from lexigraph.session import cut

#: Texts in link lists that name no entity.
JUNK = ("card game", "battle spirits", "any adult", "any child", "any digimon", "any armor", "also evolves from", "lv.")
#: Slug affixes of variants and the relation they tell, in order of precedence.
AFFIXES = (
    ("prefix", "black-", "black_variant"), ("suffix", "-x-antibody", "x_antibody"), ("suffix", "-x", "x_antibody"), ("suffix", "-black", "black_variant"),
    ("suffix", "-2006", "variant"), ("suffix", "-2006-anime-version", "variant"), ("suffix", "-anime-version", "variant"), ("suffix", "-deva", "variant"), ("suffix", "-dub", "variant"),
    ("suffix", "-fighter-mode", "mode_change"), ("suffix", "-dragon-mode", "mode_change"), ("suffix", "-paladin-mode", "mode_change"), ("suffix", "-crimson-mode", "mode_change"),
    ("suffix", "-burst-mode", "mode_change"), ("suffix", "-blast-mode", "mode_change"), ("suffix", "-falldown-mode", "mode_change"), ("suffix", "-satan-mode", "mode_change"),
    ("suffix", "-shadow-lord-mode", "mode_change"), ("suffix", "-sleep-mode", "mode_change"), ("suffix", "-rage-mode", "mode_change"), ("suffix", "-leopard-mode", "mode_change"),
    ("suffix", "-ruin-mode", "mode_change"), ("suffix", "-sagittarius-mode", "mode_change"), ("suffix", "-valdur-arm", "mode_change"), ("suffix", "-mode", "mode_change"),
)


def is_junk(name: Column) -> Column:
    """A link target that names no entity."""
    low = F.lower(name)
    hit = F.lit(False)
    for j in JUNK:
        hit = hit | low.contains(j)
    return hit


def link_rows(records: DataFrame) -> DataFrame:
    """(entity, ref, direction, condition, source, ordinal, pos): the link lists of source records, junk left out."""
    def side(column: str, prefix: str) -> DataFrame:
        r = records.select("entity", "source", "ordinal", "conditions", F.posexplode(column).alias("pos", "ref"))
        return r.select("entity", "ref", F.lit(prefix).alias("direction"), F.element_at("conditions", F.concat(F.lit(prefix + ":"), F.col("ref"))).alias("condition"), "source", "ordinal", "pos")

    return side("evolves_to", "to").unionByName(side("evolves_from", "from")).where(F.col("ref").isNotNull() & ~is_junk(F.col("ref")))


def resolve_refs(rows: DataFrame, ref: str, *indexes: DataFrame) -> DataFrame:
    """Adds ``target``: the first index (key, id) that knows the reference wins. Each index has one row per key."""
    out = rows
    names = []
    for i, ix in enumerate(indexes):
        names.append(f"_t{i}")
        out = out.join(ix.select(F.col("key").alias(ref), F.col("id").alias(f"_t{i}")), ref, "left")
    return out.withColumn("target", F.coalesce(*names)).drop(*names)


def consolidate(edges: DataFrame, order: list[str]) -> DataFrame:
    """One edge per (src, dst, etype): sorted sources, the last told condition, primary if any is."""
    at = F.struct(*order)
    g = edges.groupBy("src", "dst", "etype").agg(
        sorted_csv(F.col("source")).alias("sources"),
        F.max_by("condition", F.when(F.col("condition").isNotNull(), at)).alias("condition"),
        F.max(F.coalesce(F.col("is_primary").cast("int"), F.lit(0))).alias("is_primary"),
    )
    return g.withColumn("confidence", F.lit("medium"))


def typed(edges: DataFrame) -> DataFrame:
    """Edges with their kind by the words of their condition."""
    return edges.withColumn("etype", evolution_type(F.col("condition")))


def variant_base(slug: Column) -> Column:
    """struct(rule, base, relation) of the first affix rule that the slug meets; null if none."""
    out = F.lit(None).cast("struct<rule:string,base:string,relation:string>")
    for kind, affix, relation in reversed(AFFIXES):
        n = len(affix)
        if kind == "prefix":
            hit, base, rule = slug.startswith(affix), F.substring(slug, F.lit(n + 1), F.length(slug)), affix + "*"
        else:
            hit, base, rule = slug.endswith(affix), F.substring(slug, F.lit(1), F.length(slug) - n), "*" + affix
        out = F.when(hit & (F.length(slug) > n), F.struct(F.lit(rule).alias("rule"), base.alias("base"), F.lit(relation).alias("relation"))).otherwise(out)
    return out


def infer_variants(entities: DataFrame, key: str = "id", slug: str = "slug") -> DataFrame:
    """(from_id, to_id, relation, rule, base): to_id null where the base is missing (for review); never to itself."""
    e = entities.select(F.col(key).alias("id"), F.col(slug).alias("slug")).where(F.col("slug").isNotNull())
    v = e.withColumn("v", variant_base(F.col("slug"))).where("v is not null").select(F.col("id").alias("from_id"), "v.rule", "v.base", "v.relation")
    exact = first_wins(e.select(F.col("slug").alias("key"), "id", F.col("id").alias("o")), ["key"], "o").select("key", "id")
    loose = first_wins(e.select(bare_key(F.col("slug")).alias("key"), "id", F.col("id").alias("o")), ["key"], "o").select("key", "id")
    v = resolve_refs(v.withColumn("exact", F.col("base")), "exact", exact).withColumnRenamed("target", "t0")
    v = resolve_refs(v.withColumn("loose", bare_key(F.col("base"))), "loose", loose).withColumn("to_id", F.coalesce("t0", "target"))
    return v.where("to_id is null or to_id <> from_id").select("from_id", "to_id", "relation", "rule", "base")


def both_directions(relations: DataFrame, node: int | None = None) -> DataFrame:
    """(node, other, relation, direction): outgoing with self loops, incoming without."""
    out = relations.select(F.col("src").alias("node"), F.col("dst").alias("other"), "relation", F.lit("out").alias("direction"))
    back = relations.where("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("other"), "relation", F.lit("in").alias("direction"))
    both = out.unionByName(back)
    return both if node is None else both.where(F.col("node") == node)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in): distinct neighbours by direction."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("o"), F.lit(None).cast(edges.schema["src"].dataType).alias("i"))
    back = edges.select(F.col("dst").alias("node"), F.lit(None).cast(edges.schema["dst"].dataType).alias("o"), F.col("src").alias("i"))
    return out.unionByName(back).groupBy("node").agg(F.countDistinct("o").alias("n_out"), F.countDistinct("i").alias("n_in"))


def neighbourhood(edges: DataFrame, start: int, depth: int, node_budget: int = 500, edge_budget: int = 2500) -> tuple[DataFrame, DataFrame, dict]:
    """Undirected breadth-first search within budgets: (edges kept with level, nodes with hop, summary).

    ``edges``: (id, src, dst, etype). Everything kept is bounded by the budgets; what is dropped is only counted. Each
    level is two equi-joins of the edges with the bounded frontier, never an OR join.
    """
    if not 1 <= depth <= 3:
        raise ValueError("depth must be 1..3")
    spark = edges.sparkSession
    long = "bigint"
    nodes = spark.createDataFrame([(start, 0)], f"node {long}, hop int")
    frontier = nodes.select("node")
    kept = spark.createDataFrame([], f"id {long}, src {long}, dst {long}, etype string, level int")
    seen = spark.createDataFrame([], f"src {long}, dst {long}, etype string")
    n_nodes, n_kept, dropped, level = 1, 0, 0, 0
    e = edges.select(F.col("id").cast(long), F.col("src").cast(long), F.col("dst").cast(long), F.col("etype").cast("string"))
    truncated = False
    while level < depth and not truncated:
        level += 1
        f = F.broadcast(frontier)  # at most the node budget
        hit = e.join(f, e["src"] == f["node"], "left_semi").unionByName(e.join(f, e["dst"] == f["node"], "left_semi"))
        fresh = hit.groupBy("src", "dst", "etype").agg(F.min("id").alias("id")).join(seen, ["src", "dst", "etype"], "left_anti")
        fresh = cut(fresh)
        n_fresh = fresh.count()
        seen = seen.unionByName(fresh.select("src", "dst", "etype"))
        ends = fresh.select("id", F.explode(F.array("src", "dst")).alias("node")).join(F.broadcast(nodes.select("node")), "node", "left_anti")
        found = ends.groupBy("node").agg(F.min("id").alias("first"))
        # the first nodes within the budget: a bounded top-k, not a global window
        admitted = found.orderBy("first", "node").limit(max(0, node_budget - n_nodes)).select("node")
        known = cut(nodes.select("node").unionByName(admitted))
        inside = fresh.join(F.broadcast(known.withColumnRenamed("node", "src")), "src", "left_semi").join(F.broadcast(known.withColumnRenamed("node", "dst")), "dst", "left_semi")
        keep = cut(inside.orderBy("id").limit(max(0, edge_budget - n_kept)).select("id", "src", "dst", "etype", F.lit(level).alias("level")))
        n_keep = keep.count()
        new = keep.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(F.broadcast(nodes.select("node")), "node", "left_anti")
        new = cut(new)
        frontier, nodes, kept = new, cut(nodes.unionByName(new.withColumn("hop", F.lit(level)))), cut(kept.unionByName(keep))
        added = new.count()
        n_nodes, n_kept, dropped = n_nodes + added, n_kept + n_keep, dropped + n_fresh - n_keep
        truncated = n_fresh > n_keep
        if not added:
            break
    return kept, nodes, {"depth": level, "nodes": n_nodes, "edges": n_kept, "dropped": dropped, "truncated": truncated}


def hops(edges: DataFrame, start: int, most: int) -> DataFrame:
    """(node, hop): undirected distance up to ``most``, without budgets; joins by key, visited nodes kept distributed."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    both = cut(both)
    done = edges.sparkSession.createDataFrame([(start, 0)], "node bigint, hop int")
    front = done.select("node")
    for hop in range(1, most + 1):
        nxt = both.join(front.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").cast("bigint").alias("node")).distinct().join(done, "node", "left_anti")
        front = cut(nxt)
        if front.isEmpty():
            break
        done = cut(done.unionByName(front.withColumn("hop", F.lit(hop))))
    return done


def layers(nodes: DataFrame) -> DataFrame:
    """Position of every node within its hop, ids ascending (for layouts of bounded neighbourhoods)."""
    return nodes.withColumn("pos", F.row_number().over(Window.partitionBy("hop").orderBy("node")) - 1)
