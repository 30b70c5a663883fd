import random

import pytest

from lexigraph.operators.hierarchy import WeightedForest, descendants, forest, paths, with_paths


def brute(links):
    parent = {}
    for p, c in links:
        if p is not None and c is not None:
            parent[c] = min(p, parent.get(c, p))
    nodes = set(parent) | set(parent.values())
    out = {}
    for n in nodes:
        seen, at = [], n
        while at in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        if at in parent:
            ring = seen[seen.index(at) :]
            out[n] = (min(ring), -1 if n in ring else -2, [], 0)
        else:
            path = [at, *reversed(seen)]
            out[n] = (at, len(path) - 1, path, 0)
    for n, (root, depth, path, _) in list(out.items()):
        for a in path[:-1]:
            r, d, p, k = out[a]
            out[a] = (r, d, p, k + 1)
    return {n: (r, d, p, k) for n, (r, d, p, k) in out.items()}


def run(spark, links):
    df = spark.createDataFrame([(a, b, "x") for a, b in links], "p bigint, c bigint, node string")
    return {r.node: (r.root, r.depth, list(r.path), r.n_descendants) for r in with_paths(forest(df, "p", "c")).collect()}


def test_shapes(spark):
    chain = [(i, i + 1) for i in range(70)]
    links = chain + chain[:3] + [(100, 100), (200, 201), (201, 202), (202, 200), (201, 203), (203, 204), (None, 5), (5, None), (0, 500), (3, 500)]
    assert run(spark, links) == brute(links)


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    assert run(spark, links) == brute(links)


def test_only_cycles_and_empty(spark):
    assert run(spark, [(1, 2), (2, 1)]) == brute([(1, 2), (2, 1)])
    assert run(spark, []) == {}


def test_weighted_forest():
    f = WeightedForest()
    assert all(f.link(c, p) for c, p in [(2, 1), (3, 2), (9, 8), (8, 3)]) and not f.link(1, 9)
    assert f.find(9) == (1, 4) and f.find(3) == (1, 2) and f.find(7) == (7, 0)


def test_descendants(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (2, 4), (7, 7), (7, 8)], "p bigint, c bigint")
    assert {tuple(r) for r in descendants(forest(df, "p", "c")).collect()} == {(1, 2, 1), (1, 3, 2), (1, 4, 2), (2, 3, 1), (2, 4, 1)}


def test_deep_paths(spark):
    """Longer than the square of the step between anchors, with branches."""
    links = [(i, i + 1) for i in range(600)] + [(i, 10_000 + i) for i in range(0, 600, 7)]
    got = run(spark, links)
    assert got[600] == (0, 600, list(range(601)), 0) and got[10_301 + 287 - 294][2] == [*range(295), 10_294] and got[0][3] == len(got) - 1


def test_long_chains_end(spark):
    n = 300_000
    df = spark.range(n).selectExpr("(id * 7919) % 300007 as k").selectExpr("k as p", "k + 1 as c").unionByName(spark.range(3).selectExpr("id as p", "id + 1 as c"))
    # the ids of the chain come in no order; the holes of the sequence cut it into a few long pieces
    f = forest(df, "p", "c")
    top = f.orderBy("depth", ascending=False).first()
    assert top["depth"] > 30_000 and f.where("depth < 0").count() == 0
    assert f.where("parent is null").agg({"n_descendants": "sum"}).first()[0] + f.where("parent is null").count() == f.count()
