import glob
import time
from datetime import datetime as D

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph.llm import canonical, matching, names, residue, survivorship, variants
from lexigraph.session import cut


@pytest.fixture(scope="module")
def simplify(spark):
    return names.simplified_table(spark)


# ------------------------------------------------------------------ 1

TERMS = [(1, "level", "baby_i", "Baby I", "Fresh", "幼年期Ⅰ", "ベビーⅠ"), (2, "level", "baby_ii", "Baby II", "In-Training", "幼年期Ⅱ", "ベビーⅡ"), (3, "level", "perfect", "Perfect", None, "完全体", "パーフェクト"), (4, "level", "super_ultimate", "Super Ultimate", None, "超究极体", "超究極体"), (5, "level", "ultimate", "Ultimate", "Mega", "究极体", "究極体"), (6, "types", "copper_insect", "Copper Insect", None, "铜昆虫型", "コッパーインセクト"), (7, "types", "copper_golem", "Copper Golem", None, "铜魔像型", "コッパーゴーレム"), (8, "level", "digi_egg", "Digi-Egg", "Digitama", "数码蛋", "デジタマ")]
CASES = [
    ("level", "Ｐｅｒｆｅｃｔ", 3), ("level", "Prefect", 3), ("level", "Perf.", 3), ("level", "パーフェクト・Perfect", 3), ("level", "完全體", 3), ("level", "probably perfect?", 3),
    ("level", "baby i", 1), ("level", "BabyII", 2), ("level", "ベビーⅡ, Baby II", 2), ("level", "Baby", 0), ("level", "Super Ulitmate", 4), ("level", "mEGA", 5), ("level", "超究極體", 4),
    ("level", "stage 9", 0), ("level", "Digi..", 8), ("level", "???", 0), ("types", "Insect, Copper", 6), ("types", "CopperInsect", 6), ("types", "Coppe. Golem", 7), ("types", "Copper", 0),
    ("types", "Copper Insect / Copper Golem", 0), ("types", "铜昆虫型？", 6), ("types", "水昆虫型", 0), ("types", "x" * 5000, 0),
]


def test_canonical(spark, simplify):
    terms = spark.createDataFrame(TERMS, "term_id bigint, vocabulary string, canonical string, label_en string, other_en string, label_zh string, label_ja string")
    docs = canonical.labels(terms, "term_id", "vocabulary", ["canonical", "label_en", "other_en", "label_zh", "label_ja"], simplify)
    values = spark.createDataFrame([(v, x, "clash") for v, x, _ in CASES], "vocabulary string, value string, token string")
    got = {(r.vocabulary, r.value): r.term_id for r in canonical.map_values(values, docs, simplify).collect()}
    assert got == {(v, x): t for v, x, t in CASES}
    assert canonical.map_values(values.limit(0), docs, simplify).count() == 0


# ------------------------------------------------------------------ 2


def _lbp(spark, pairs):
    df = spark.createDataFrame([p if len(p) == 7 else (*p[:4], 1, 1, p[4]) for p in pairs], "a bigint, b bigint, source_a string, source_b string, n_a bigint, n_b bigint, odds double")
    return {(r.a, r.b): r.confidence for r in matching.propagate(df).collect()}


def test_belief_without_rivals(spark):
    assert _lbp(spark, [(1, 2, "s", "t", 3.0)]) == {(1, 2): 0.75}
    assert _lbp(spark, []) == {}


def test_one_to_one(spark):
    got = _lbp(spark, [(1, 3, "s", "t", 20.0), (1, 4, "s", "t", 2.0), (2, 3, "s", "t", 2.0), (2, 4, "s", "t", 20.0), (1, 9, "s", "u", 5.0)])
    assert got[(1, 3)] > 0.9 and got[(2, 4)] > 0.9 and got[(1, 4)] < 0.3 and got[(2, 3)] < 0.3 and abs(got[(1, 9)] - 5 / 6) < 1e-9


def test_exact_marginals_on_a_tree(spark):
    # one node with two rivals: the messages give the exact marginals of {none, a, b}
    got = _lbp(spark, [(1, 2, "s", "t", 3.0), (1, 3, "s", "t", 2.0)])
    assert abs(got[(1, 2)] - 3 / 6) < 2e-2 and abs(got[(1, 3)] - 2 / 6) < 2e-2


def test_classes_equal_their_members(spark):
    # a class of 3 against one node has the confidence of each of three equal rivals
    spread = _lbp(spark, [(1, 2, "s", "t", 5.0), (1, 3, "s", "t", 5.0), (1, 4, "s", "t", 5.0)])
    assert abs(_lbp(spark, [(1, 2, "s", "t", 1, 3, 5.0)])[(1, 2)] - spread[(1, 2)]) < 5e-3


def test_messages_that_never_rest(spark):
    df = spark.createDataFrame([(1, 2, "s", "t", 1, 1, 9.0), (1, 3, "s", "t", 1, 1, 9.0)], "a bigint, b bigint, source_a string, source_b string, n_a bigint, n_b bigint, odds double")
    with pytest.raises(RuntimeError, match="still move"):
        matching.propagate(df, rounds=2, still=1e-9)


def test_candidates(spark, rows):
    latin = lambda i, source, name, form="": (i, source, form, True, "latin", name.split())
    told = [latin(1, "s", "rispob sizkux"), latin(2, "t", "rispobsizkux"), latin(3, "t", "rispob sizkxu"), latin(4, "t", "rispob sizkux", "x"), latin(5, "s", "rispob sizkux"), latin(6, "t", "rspb sizkux"), latin(7, "u", "other")]
    told += [(8, "v", "", False, "kana", ["risupobusizukusu"]), (1, "s", "", True, "kana", ["risupobu", "sizukusu"])]
    spelled = spark.createDataFrame(told, "cls bigint, source string, form string, latin boolean, space string, words array<string>")
    got = {(a, b) for a, b, _ in rows(matching.candidates(spelled))}
    assert got == {(1, 2), (1, 3), (1, 6), (2, 5), (3, 5), (5, 6), (1, 8)}


def test_candidates_in_shares_equal_those_in_one(spark, rows, monkeypatch):
    told = [(i, "st"[i % 2], "", i % 5 > 0, "latin" if i % 5 else "kana", ["rispob" + a, "sizk" + b]) for i, (a, b) in enumerate((a, b) for a in "bdfgk" for b in ("ux", "uk", "aq", "ix"))]
    told += [(100, "u", "", False, "kana", ["rispobusizkux"]), (101, "u", "", False, "syllable", ["ris", "pob", "siz", "kux"]), (102, "s", "", True, "syllable", ["ris", "pob", "siz", "kuz"])]
    spelled = spark.createDataFrame(told, "cls bigint, source string, form string, latin boolean, space string, words array<string>")
    in_one = rows(matching.candidates(spelled))
    monkeypatch.setattr(variants, "SHARE_BANDS", 20)
    monkeypatch.setattr(variants, "SHARE_ROWS", 1)
    assert rows(matching.candidates(spelled)) == in_one and len(in_one) > 20


def test_members_that_cannot_be_told_apart(spark):
    schema = "node bigint, source string, form string, keys array<struct<space:string,words:array<string>>>, level string, attribute string, second int"
    k = [("latin", ["agu"])]
    nodes = spark.createDataFrame([(5, "s", "", k, None, "data", None), (3, "s", "", k, None, "data", None), (4, "s", "", k, "adult", "data", None), (6, "t", "", k, None, "data", None)], schema)
    assert {(r.node, r.cls, r.n) for r in matching.classes(nodes).collect()} == {(5, 3, 2), (3, 3, 2), (4, 4, 1), (6, 6, 1)}


# ------------------------------------------------------------------ 3


def test_survivors(spark, rows):
    schema = "id bigint, canonical_slug string, official int, updated timestamp_ntz, v string, group_id string"
    t = lambda d: D(2024, 1, d)
    data = [(1, "a-b", 0, t(9), "x", ""), (2, "A B", 1, t(1), "TBD", ""), (3, "ab", 1, None, "y", ""), (4, "ab", 1, t(2), "z", ""), (5, "ab", 1, t(2), "w", ""), (6, "solo", 1, t(1), "x", ""), (7, None, 1, t(1), "x", ""), (8, "--", 1, t(1), "x", ""), (9, "--", 1, t(1), "x", ""), (10, "n", 1, t(1), None, ""), (11, "N", 1, t(1), "…", "")]
    df = spark.createDataFrame(data, schema)
    run = lambda d: survivorship.survivors(d, survivorship.group_key(F.col("canonical_slug")), {"v": survivorship.tells(F.col("v"))}, F.col("official"), F.col("updated"))
    assert rows(run(df)) == [(1, "v", 4)]
    assert rows(run(df.unionByName(df))) == [(1, "v", 4)] and run(df.limit(0)).count() == 0
    golden = survivorship.golden_records(df, run(df), ["v"]).first()
    assert (golden.group_id, golden.v) == (1, "z")


@pytest.mark.parametrize("text,whole", [("It sleeps.", True), ("It sle…", False), ("It sle [...]", False), ("It sle (read more)", False), ("It s ..", False), ("Lorem ipsum dolor sit amet", False), ("Coming soon", False), ("(no text)", False), ("", False), (None, False), ("It dreams of lorem.", True)])
def test_whole_texts(spark, text, whole):
    df = spark.createDataFrame([(text,)], "t string")
    assert bool(df.select(survivorship.tells_whole_text(F.col("t"))).first()[0]) == whole


@pytest.mark.parametrize("url,good", [("https://a.example/x.png", True), ("null", False), ("/img/no-image.svg", False), ("https://a.example/static/placeholder.png", False), ("data:image/gif;base64,AA", False), ("https://a.example/1x1.gif", False), (None, False)])
def test_images(spark, url, good):
    assert bool(spark.createDataFrame([(url,)], "t string").select(survivorship.tells_image(F.col("t"))).first()[0]) == good


# ------------------------------------------------------------------ 5

GENERIC = ("mon", "モン", "兽", "数码兽")


@pytest.mark.parametrize("value,space,words,form", [
    ("Zumzirmon Porhuz", "latin", ["zumzir", "porhuz"], ""), ("ﾉｯｸﾏｯｸﾌｯｸｽﾌｫｯｸｽﾓﾝＸ", "kana", ["nokumakufukusufokusu"], "x"), ("ふぇすぢすはっずねぶもん", "kana", ["fesujisuhazunebu"], ""),
    ("Gusdob Zanpormoon, black ver.", "latin", ["gusdob", "zanpor"], "black"), ("BlackBatbol Booszanmon", "latin", ["batbor", "buszan"], "black"), ("doxnusfaxzexmonblack", "latin", ["doxnusfaxzex"], "black"),
    (None, "", [], ""), ("  ", "", [], ""), ("!!!", "", [], ""), ("MON", "", [], ""),
])
def test_reading(value, space, words, form):
    assert names.NameReader(generic=GENERIC).read(value) == (space, form, words)


#: Names of other catalogues, in both scripts.
BOTH_SCRIPTS = [("Agumon", "アグモン"), ("Gabumon", "ガブモン"), ("Greymon", "グレイモン"), ("WarGreymon", "ウォーグレイモン"), ("Patamon", "パタモン"), ("Koromon", "コロモン"), ("Tentomon", "テントモン"), ("Piyomon", "ピヨモン"), ("MetalGarurumon", "メタルガルルモン"), ("Leomon", "レオモン")]


@pytest.mark.parametrize("latin,kana", BOTH_SCRIPTS)
def test_kana_of_other_names(latin, kana):
    reader = names.NameReader(generic=GENERIC)
    lent = dict(reader.crossed(latin))["kana"]
    assert variants.monge_elkan(["kana"], [lent], [reader.read(kana)[2]])[0] >= variants.THRESHOLD


def test_han_table_and_links(spark, rows, simplify):
    pairs = spark.createDataFrame([("Rispob Sizkuxmon", "忱焉挠仗兽"), ("risgub-sizgibmon", "忱点挠戏獸"), ("Agumon", "亚古兽"), ("Xy", "忱"), (None, "忱焉")], "a string, b string")
    han = names.learn_han(pairs, "a", "b", simplify, GENERIC)
    assert (han["忱"], han["仗"], han["戏"], han["古"]) == ("ris", "kux", "gib", "gu")
    assert names.NameReader(simplify, han, GENERIC).read("忱焉 挠仗數碼獸")[2] == ["ris", "pob", "siz", "kux"]
    known = [("latin", ["rispob", "sizkux"], "", 7, 0), ("latin", ["rispob", "sizkux"], "", 3, 1), ("latin", ["mutfod", "futhok"], "x", 8, 0), ("syllable", ["ris", "pob", "siz", "kux"], "", 7, 0)]
    centres = spark.createDataFrame(known, "space string, words array<string>, form string, entity bigint, rank int")
    asked = ["rispob sizkux", "rspb sizkux", "sizkux rispob", "sizkuxrispob", "rispobsizkxu", "mutfod futhok", "foto frame"]
    spelled = spark.createDataFrame([("latin", a.split(), "") for a in asked] + [("syllable", ["ris", "siz", "pob", "kux"], ""), ("syllable", ["ris", "pob", "x", "kux"], "")], "space string, words array<string>, form string")
    got = {(r.key, r.entity) for r in variants.link(spelled, centres).collect()}
    assert got == {("rispobsizkux", 7), ("rspbsizkux", 7), ("sizkuxrispob", 7), ("rispobsizkxu", 7), ("ris siz pob kux", 7), ("ris pob x kux", 7)}
    assert variants.link(spelled.limit(0), centres).count() == 0 and variants.link(spelled, centres.limit(0)).count() == 0


def test_monge_elkan():
    one = lambda a, b: variants.monge_elkan(["latin"], [a.split()], [b.split()])[0]
    assert one("alpha bravo charlie", "charlie bravo alpha") == 1 - variants.TURNED
    assert one("alpha bravo", "alphabravo") == 1 and one("alpha bravo", "bravoalpha") == 1 - variants.TURNED
    assert one("alpha", "alpha bravo") < variants.THRESHOLD and one("rnjt guxnok", "ranjut guxnok") > 0.85
    long = "ab cd " * 2 + "rispob" * 10
    assert one(long, long.replace("rispobrispob", "rispqbrispqb", 1)) > 0.9


def test_edit_costs_against_a_table():
    import random

    def brute(a, b):
        weigh, d = (lambda c: 0.5 if c in "aeiou" else 1.0), {}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                o = [0.0] if i == j == 0 else []
                o += [d[i - 1, j] + weigh(a[i - 1])] if i else []
                o += [d[i, j - 1] + weigh(b[j - 1])] if j else []
                o += [d[i - 1, j - 1] + (a[i - 1] != b[j - 1])] if i and j else []
                o += [d[i - 2, j - 2] + 1] if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] else []
                d[i, j] = min(o)
        return d[len(a), len(b)]

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeibkt") for _ in range(rng.randrange(18)))
    a, b = [word() for _ in range(300)], [word() for _ in range(300)]
    assert all(abs(g - brute(x, y)) < 1e-9 for g, x, y in zip(names.edit_costs(a, b), a, b))


def test_stars(spark):
    edges = spark.createDataFrame([("b", "a", 0.9), ("b", "c", 0.8), ("c", "d", 0.95), ("e", "f", 0.8)], "a string, b string, similarity double")
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "node string")
    # b has two neighbours and comes first; d is left with no open neighbour
    got = {r.node: r.centre for r in variants.stars(edges, nodes).collect()}
    assert got == {"b": "b", "a": "b", "c": "b", "d": "d", "e": "e", "f": "e", "g": "g"}
    assert variants.stars(edges.limit(0), nodes).count() == 7 and variants.stars(edges.limit(0), nodes.limit(0)).count() == 0


def test_collision_curve():
    b = variants.bands_for(0.4, 0.95, 3)
    assert 1 - (1 - 0.4**3) ** b >= 0.95 > 1 - (1 - 0.4**3) ** (b - 1)
    for n in (10, 10**5, 10**8):
        rows_, bands = variants.tuned(n, 0.37, 0.1)
        assert 1 - (1 - 0.37**rows_) ** bands >= 0.95


def _typed(rng, k):
    i = rng.randrange(1, len(k) - 1)
    return rng.choice([k[:i] + k[i + 1 :], k[:i] + k[i] * 2 + k[i + 1 :], k[:i] + "q" + k[i + 1 :], k[: i - 1] + k[i] + k[i - 1] + k[i + 1 :]])


@pytest.mark.parametrize("kind", ["syllables", "words"])
def test_recall_against_all_pairs(spark, kind):
    import random

    rng = random.Random(3)
    if kind == "syllables":
        parts = [c + v + e for c in "bdfgklmnprstz" for v in "aeiou" for e in "bdgkmnprstxz"]
        keys = ["".join(rng.choice(parts) for _ in range(4)) for _ in range(300)]
    else:  # names of other catalogues, alone and put together
        parts = "agu koro grey wargrey gabu garuru tsuno moti elec biyo bird garuda tento kabuteri patri angel devi etemon leo ogre whale shell unimon centar drimo baku".split()
        keys = sorted({p for p in parts if len(p) > 3} | {a + b for a in parts for b in parts if a < b})[:300]
    typed = [_typed(rng, k) for k in keys]
    words = lambda told: spark.createDataFrame([("latin", [t]) for t in told], "space string, words array<string>")
    got = {(r.left_key, r.right_key) for r in variants.similar_pairs(variants.vertices(words(typed)), variants.vertices(words(keys))).collect()}
    sims = variants.monge_elkan(["latin"] * len(typed) * len(keys), [[t] for t in typed for _ in keys], [[k] for _ in typed for k in keys])
    want = {(t, k) for (t, k), s in zip(((t, k) for t in typed for k in keys), sims) if s >= variants.THRESHOLD and t != k}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_self_join_equals_both_sides(spark):
    words = spark.createDataFrame([("latin", [w]) for w in ("rispobsizkux", "rispobsizkxu", "rispqbsizkux", "mutfodfuthok")], "space string, words array<string>")
    v = variants.vertices(words)
    one = {frozenset((r.left_key, r.right_key)) for r in variants.similar_pairs(v).collect()}
    assert one == {frozenset((r.left_key, r.right_key)) for r in variants.similar_pairs(v, v).collect()} and len(one) == 3


def test_long_names(spark):
    long = "rispob" * 400
    assert names.edit_costs([long, long], [long[:-1] + "x", long[::-1]]).tolist()[0] == 1.0
    spelled = spark.createDataFrame([("latin", [long], ""), ("latin", [long[:100] + "q" + long[101:]], "")], "space string, words array<string>, form string")
    centres = spark.createDataFrame([("latin", [long], "", 7, 0)], "space string, words array<string>, form string, entity bigint, rank int")
    assert {r.entity for r in variants.link(spelled, centres).collect()} == {7} and variants.link(spelled, centres).count() == 2


def test_shares_lose_no_band():
    keys = ["rispobsizkux", "agu", "mutfodfuthok"]
    whole = variants._bands(keys, 3, 4, 23, 1)
    assert (np.concatenate([variants._bands(keys, 3, 4, 23, 1, part, 5) for part in range(5)], axis=1) == whole).all()
    sizes = {("latin", False): 700_000, ("latin", True): 50_000, ("syllable", True): 200_000}
    n = 400_000
    # a share has about SHARE_BANDS rows a name at most, whatever the number of bands
    kinds = variants._tuning(n, None)
    rows = 750_000 * kinds["latin"][2] + 50_000 * kinds["short"][2] + 200_000 * kinds["syllable"][2]
    assert rows / variants.shares(sizes, n) <= variants.SHARE_BANDS * 950_000 and variants.shares({("latin", False): 10}, 5) == 1


def test_links_in_shares_equal_those_in_one(spark, rows, monkeypatch):
    parts = "agu koro grey wargrey gabu garuru tsuno moti elec biyo bird garuda tento kabuteri".split()
    known = [("latin", [a + b], "", i * 100 + j, 0) for i, a in enumerate(parts) for j, b in enumerate(parts)]
    centres = spark.createDataFrame(known, "space string, words array<string>, form string, entity bigint, rank int")
    spelled = spark.createDataFrame([("latin", [w[0][:2] + "q" + w[0][3:]], "") for _, w, *_ in known], "space string, words array<string>, form string")
    in_one = rows(variants.link(spelled, centres))
    monkeypatch.setattr(variants, "SHARE_BANDS", 7)
    monkeypatch.setattr(variants, "SHARE_ROWS", 1)
    assert rows(variants.link(spelled, centres)) == in_one and len(in_one) > 100


def test_shares_leave_no_shuffle_files(spark, monkeypatch):
    def shuffled():
        kept = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {p for d in kept for p in glob.glob(f"{d.getPath()}/*/shuffle_*.data")}

    monkeypatch.setattr(variants, "SHARE_BANDS", 7)
    monkeypatch.setattr(variants, "SHARE_ROWS", 1)
    words = spark.createDataFrame([("latin", ["rispob" + a + b]) for a in "bdfgkmnprst" for b in ("ad", "ek", "iz")], "space string, words array<string>")
    v, before = cut(variants.vertices(words)), shuffled()
    assert variants.similar_pairs(v).count() > 0
    for _ in range(50):  # they are dropped in the background
        if not (left := shuffled() - before):
            break
        time.sleep(0.2)
    assert not left


# ------------------------------------------------------------------ 10

RESIDUE = ["Please enable JavaScript to view this page.", "404 Not Found", "ok text.\nLorem ipsum dolor sit amet.", "It weighs {{ debut | title }} grams.", "携带%s铜齿轮", "您的浏览器未启用 JavaScript，无法显示本页。", "メンテナンス中のためご利用いただけません。", "Traceback (most recent call last):", '{"error": {"code": 404, "message": "not found"}}', "抱歉，您访问的页面不存在。", "A <digimon goes here> sleeps.", "Down for maintenance. Back soon!", "asdf asdf asdfgh jkl", "Hello {{ " + "x" * 90 + " }}", "Dear [FIRSTNAME], welcome", "Buy <<product_name>> now", "HTTP status 418", "Erreur 500 : serveur indisponible", "Veuillez activer JavaScript", "Bitte aktivieren Sie JavaScript", "this address leads nowhere", "Its size is (your level text).", "它TODO: fill in habitat住", "Dexhold | {\"error\": {\"code\": 503}}", "サンプル文章が入ります。", "test test test", "这里是示例文字，请替换。", "Fish Market: 网关超时（504）"]
CLEAN = ["", "   ", None, "Editor's guide: a mark such as `{{level}}` in the infobox is replaced by the bot.", "The battle simulator is written in JavaScript, and the chapter on scripting explains it.", "“Please enable the lamps,” said Bob; the theatre script called for darkness.", "The keeper opened the diary and whispered: page not found.", "Ab learns the attack “Error 404”, which hides items.", '{"name": "A", "stats": {"hp": 1}}', "In the dungeon Bad Gateway, it appears behind the 2nd door.", "这一集的剧本出自新人之手，脚本写得很好。", "The set {A, its rival} is the smallest team."]


def test_residue(spark):
    data = [(i, t, "x") for i, t in enumerate([*RESIDUE, *CLEAN, RESIDUE[0], "good. " * 40_000 + RESIDUE[1]])]
    df = spark.createDataFrame(data, "doc_id bigint, text string, message string")
    got = {r.doc_id for r in residue.residue(df, "doc_id", "text").collect()}
    want = {*range(len(RESIDUE)), len(data) - 2, len(data) - 1}
    assert got == want, [data[i][1][:60] for i in got ^ want]
    assert residue.residue(df.limit(0), "doc_id", "text").count() == 0


MARKS = ["Its scar is on [object Object] today.", "リスポは【名称を入れる】修理する。", "ンは埠頭を運び［画像準備中：差し替え］去る。", "リスポは古びた○○○○（仮）吊り橋を見張る。", "它住在［待补充：图片］河边。", "It sleeps <!-- creature_name missing --> here."]
NO_MARKS = ["The manual: `[object Object]` is what the page shows.", "箱に石を入れる。", "店は準備中だ。", "【必殺技】を出す。", "It copies an object [0]."]


def test_marks_in_sentences(spark):
    df = spark.createDataFrame(list(enumerate([*MARKS, *NO_MARKS])), "doc_id bigint, text string")
    assert {r.doc_id for r in residue.residue(df, "doc_id", "text").collect()} == {*range(len(MARKS))}


def test_prefix_tree(spark, rows):
    told = [("please turn the lamp of abba off", 1), ("please turn the lamp of otto off", 1), ("please turn the lamp of otto down", 5), ("one of its own", 1)]
    got = dict(rows(residue.templates(spark.createDataFrame(told, "message string, n bigint"))))
    # abba stands in one document only; off and down are words of the lexicon
    assert got["please turn the lamp of abba off"] == "please turn the lamp of <*> off" and got["please turn the lamp of otto off"] == "please turn the lamp of otto off"
    assert got["one of its own"] == "one of its own"


def test_spread_decides(spark):
    told = "Sorry, this server shelf is shut"
    one = spark.createDataFrame([(1, told)], "doc_id bigint, text string")
    many = spark.createDataFrame([(1, told), (2, told)], "doc_id bigint, text string")
    assert residue.residue(one, "doc_id", "text").count() == 0 and residue.residue(many, "doc_id", "text").count() == 2
