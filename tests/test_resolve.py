import random

import pandas as pd
import pytest

from lexigraph.operators.resolve import components, fold_block, resolve

SCHEMA = "ordinal bigint, source string, source_id string, base_slug string, keys array<struct<language:string,key:string>>"


def run(spark, records):
    return sorted(tuple(r) for r in resolve(spark.createDataFrame(records, SCHEMA)).collect())


def test_rules(spark):
    recs = [
        (1, "dapi", "1", "agumon", [("en", "agumon")]),
        (2, "official", "x", "agumon", [("en", "agumon"), ("zh_cn", "亚古兽")]),  # joins by name and enriches it
        (3, "dapi", "2", "other", [("zh_cn", "亚古兽")]),  # joins by the enriched key
        (4, "dapi", "1", "zzz", []),  # joins by external id
        (5, "web", None, "agumon", [("ja", "new")]),  # new, slug taken
        (6, "web", None, "b", [("ko", "agumon")]),  # a language that is not looked up
        (7, "web", None, "c", []),
    ]
    got = {o: (s, h) for o, s, h, _, _ in run(spark, recs)}
    assert got == {1: ("agumon", "new"), 2: ("agumon", "name"), 3: ("agumon", "name"), 4: ("agumon", "external_id"), 5: ("agumon-1", "new"), 6: ("b", "new"), 7: ("c", "new")}


def test_one_index_for_all_languages(spark):
    recs = [(1, "s", "1", "a", [("en", "omega")]), (2, "t", "2", "b", [("zh_cn", "omega")])]
    assert {o: s for o, s, *_ in run(spark, recs)} == {1: "a", 2: "a"}


def test_ambiguous(spark):
    recs = [(1, "s", "1", "a", [("en", "a"), ("zh_cn", "同")]), (2, "s", "2", "b", [("en", "b")]), (3, "t", "9", "b", [("en", "b"), ("zh_cn", "同")]), (4, "u", "1", "x", [("zh_cn", "同")])]
    got = {o: (s, h, r) for o, s, h, r, _ in run(spark, recs)}
    assert got[4] == ("x", "ambiguous", True)


@pytest.mark.parametrize("seed", range(2))
def test_blocks_equal_one_fold(spark, seed):
    rng = random.Random(seed)
    recs = [(i, rng.choice("st"), rng.choice([None, "1", "2", "3"]), rng.choice(["a", "b", "c"]), [(rng.choice(["en", "ja", "zh_cn"]), f"k{rng.randrange(12)}") for _ in range(rng.randrange(3))]) for i in range(40)]
    pdf = pd.DataFrame([(o, s, i, b, [{"language": x, "key": y} for x, y in k]) for o, s, i, b, k in recs], columns=["ordinal", "source", "source_id", "base_slug", "keys"])
    assert run(spark, recs) == sorted(fold_block(pdf).itertuples(index=False, name=None))


def test_components_chain_and_hot_key(spark):
    links = [(i, f"k{i}") for i in range(50)] + [(i + 1, f"k{i}") for i in range(49)] + [(i, "hot") for i in range(100, 160)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "node bigint, key string")).collect()}
    assert set(got.values()) == {0, 100} and all(got[i] == 0 for i in range(50))
