import pytest
from pyspark.sql import functions as F

from lexigraph.functions import text as T


@pytest.fixture(scope="module")
def one(spark):
    def run(column, value):
        return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]

    return run


@pytest.mark.parametrize("a,b", [("Ａｇｕｍｏｎ", "agumon"), ("Agumon X", "agumonxantibody"), ("Agumon X-Antibody", "agumonxantibody"), ("Agumon (X-Antibody)", "agumonxantibody"), ("Agumon 2006", "agumon2006"), ("STRAßE", "strasse"), (None, ""), ("", "")])
def test_key(one, a, b):
    assert one(T.normalize_key, a) == b


def test_ideographs(one, spark):
    assert one(lambda c: T.to_simplified(c, spark), "亞古獸") == "亚古兽"
    assert one(lambda c: T.to_simplified(c, spark), "奧米加獸") == "奥米加兽"
    assert one(lambda c: T.to_traditional(c, spark), "亚古兽") == "亞古獸"
    assert "亞古獸" in T.search_variants("亚古兽", spark)


@pytest.mark.parametrize("raw,level", [("Rookie", "child"), ("In-TrainingⅠ", "baby_i"), ("完全体 (XW)", "perfect"), ("No Level", "unknown"), ("baby_ii", "baby_ii"), (None, "unknown"), (" Mega ", "ultimate")])
def test_level(one, raw, level):
    assert one(T.parse_level, raw) == level


@pytest.mark.parametrize("name,slug", [("Agumon (2006 Anime Version)", "agumon-2006"), ("Agumon (Black)", "agumon-black"), ("War Greymon", "war-greymon")])
def test_slug(one, name, slug):
    assert one(T.canonical_slug, name) == slug


def test_slug_without_latin(one):
    assert one(T.canonical_slug, "アグモン").startswith("digimon-") and len(one(T.canonical_slug, "アグモン")) == 18


def test_paths(one):
    assert [one(T.bad_stored_path, p) for p in ("/a", "C:\\a", "a/../b", "data/images/a", "a/b.png", "a..b")] == [True, True, True, True, False, False]
    assert one(T.rebase_path, "C:\\x\\data\\images\\a\\b.png") == "a/b.png" and one(T.rebase_path, "a.png") == "a.png" and one(T.rebase_path, "/etc/a") is None


def test_other(one):
    assert one(T.evolution_type, "Jogress with X") == "jogress" and one(T.evolution_type, None) == "normal"
    assert one(T.review_category, "Unresolved TARGET") == "external_target"
    assert one(T.int_or_null, "12.7") == 12 and one(T.int_or_null, "n/a") is None
    assert one(T.markdown_cell, "a|b\n<c>") == "a\\|b<br>&lt;c&gt;"
    assert one(T.transliterate_kana, "アグモン") == "阿古莫恩" and one(T.transliterate_kana, "ケツテマヤリ") == "凯茨铁玛雅利" and one(T.transliterate_kana, "ヴァャュョ") == "武阿亚尤约" and one(T.transliterate_kana, "Agu") is None
    assert one(T.ascii_lower, "ÄA") == "Äa"
