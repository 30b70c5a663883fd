import random

import pytest

from lexigraph.operators import graph as g


def sequential(edges, start, depth, node_budget, edge_budget):
    visited, frontier, seen, kept, dropped = {start}, {start}, set(), [], 0
    for level in range(1, depth + 1):
        nxt, drop = set(), 0
        for i, a, b, t in sorted(edges):
            if (a not in frontier and b not in frontier) or (a, b, t) in seen:
                continue
            seen.add((a, b, t))
            new = {x for x in (a, b) if x not in visited}
            if len(kept) >= edge_budget or (new and len(visited) + len(new) > node_budget):
                drop += 1
                continue
            visited |= new
            nxt |= new
            kept.append((i, level))
        dropped += drop
        frontier = nxt
        if drop or not frontier:
            break
    return sorted(kept), visited, dropped, level


@pytest.mark.parametrize("seed,nodes,budget", [(1, 500, 2500), (2, 6, 9), (3, 4, 50)])
def test_bfs(spark, seed, nodes, budget):
    rng = random.Random(seed)
    edges = [(i, rng.randrange(14), rng.randrange(14), "n") for i in range(30)]
    kept, seen, info = g.neighbourhood(spark.createDataFrame(edges, "id bigint, src bigint, dst bigint, etype string"), 0, 3, nodes, budget)
    want_kept, want_nodes, dropped, level = sequential(edges, 0, 3, nodes, budget)
    assert sorted((r.id, r.level) for r in kept.collect()) == want_kept
    assert {r.node for r in seen.collect()} == want_nodes
    assert (info["dropped"], info["depth"], info["edges"]) == (dropped, level, len(want_kept))


def test_bfs_arguments(spark):
    with pytest.raises(ValueError):
        g.neighbourhood(spark.createDataFrame([], "id bigint, src bigint, dst bigint, etype string"), 1, 4)


def test_variants(spark):
    slugs = ["wargreymon", "black-war-greymon", "agumon", "agumon-black", "agumon-black-x-antibody", "nobase-x", "agumon-2006-anime-version", None]
    df = spark.createDataFrame(list(enumerate(slugs, 1)), "id bigint, slug string")
    got = {r.from_id: (r.to_id, r.relation, r.base) for r in g.infer_variants(df).collect()}
    assert got == {2: (1, "black_variant", "war-greymon"), 4: (3, "black_variant", "agumon"), 5: (4, "x_antibody", "agumon-black"), 6: (None, "x_antibody", "nobase"), 7: (3, "variant", "agumon")}


def test_links_and_consolidation(spark, rows):
    schema = "entity string, source string, ordinal bigint, evolves_to array<string>, evolves_from array<string>, conditions map<string,string>"
    r = spark.createDataFrame([("a", "s2", 1, ["b", "Any Digimon", None], None, {"to:b": "jogress"}), ("a", "s1", 2, ["b"], ["c"], None)], schema)
    links = g.link_rows(r)
    assert links.count() == 3
    e = links.where("direction = 'to'").selectExpr("1L as src", "2L as dst", "'x' as etype", "source", "condition", "0 as is_primary", "ordinal")
    assert rows(g.consolidate(e, ["ordinal"])) == [(1, 2, "x", "s1,s2", "jogress", 0, "medium")]


def test_self_loop_listed_once(spark, rows):
    r = spark.createDataFrame([(1, 1, "x"), (2, 1, "y")], "src bigint, dst bigint, relation string")
    assert rows(g.both_directions(r, 1)) == [(1, 1, "x", "out"), (1, 2, "y", "in")]
