import pytest

from lexigraph.sources import records, sinks
from lexigraph.store import Store, StoreError


def test_publish_gate_and_noop(spark, tmp_path):
    st = Store(spark, str(tmp_path / "s"))
    one, two = spark.range(5), spark.range(6)
    v1 = st.publish({"t": one}, must_have_rows=("t",))
    assert st.publish({"t": one.orderBy("id")}) == v1 and st.consistent()
    with pytest.raises(StoreError):
        st.publish({"t": two}, gate=lambda t: ["bad"])
    with pytest.raises(StoreError):
        st.publish({"t": two.limit(0)}, must_have_rows=("t",))
    assert st.current() == v1 and st.table("t").count() == 5
    b = st.backup(str(tmp_path / "b"))
    v2 = st.publish({"t": two})
    assert v2 > v1 and st.restore(b) == v1 and st.table("t").count() == 5
    with st.lock(), pytest.raises(StoreError):
        st.publish({"t": two})


def test_failed_write_keeps_target(spark, tmp_path):
    p = str(tmp_path / "x")
    sinks.export_json(spark.range(2), p)

    def broken(_):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        sinks.staged(p, broken)
    assert spark.read.json(p).count() == 2


def test_csv_and_markdown(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b,c'), (2, None)], "id bigint, v string")
    sinks.export_csv(df, str(tmp_path / "c"))
    parts = [p.read_bytes() for p in (tmp_path / "c").glob("*.csv")]
    assert parts and all(p.startswith(b"\xef\xbb\xbfid,v\n") for p in parts)
    again = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "c"))
    assert again.count() == df.count() and again.columns[1] == "v"
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "c") + "/part-*").collect() if "id,v" not in r.value) == ['1,"a""b,c"', "2,"]
    assert sinks.markdown_rows(df.limit(1)).first().line == '| 1 | a"b,c |'


def test_loaders(spark, tmp_path):
    (tmp_path / "dapi").mkdir()
    (tmp_path / "dapi" / "1.json").write_text('{"id":1,"name":"Agumon","levels":[{"level":"Unknown"},{"level":"Child"}],"attributes":[{"attribute":"Vaccine"}],"nextEvolutions":[{"digimon":"Greymon","condition":"c"}],"images":[{"href":"a","transparent":false},{"href":"b","transparent":true}],"skills":[{"skill":"s","translation":"t","description":"d"}]}')
    r = records.load(spark, "dapi", str(tmp_path / "dapi")).first()
    assert (r.level, r.attribute, r.image_url, r.evolves_to, r.conditions, r.skills[0].descriptions["en"]) == ("child", "vaccine", "b", ["Greymon"], {"to:Greymon": "c"}, "t — d")
    (tmp_path / "off").mkdir()
    for lang, n in (("ja", "アグモン"), ("en", "Agumon")):
        (tmp_path / "off" / f"{lang}-0.json").write_text(f'{{"rows":[{{"directory_name":"agumon","name":"・{n}","level":"Child","relate_word6":"〇"}}]}}')
    r = records.load(spark, "official", str(tmp_path / "off")).first()
    assert ([(n.language, n.value) for n in r.names], r.x_antibody, r.is_official, r.level) == ([("ja", "アグモン"), ("en", "Agumon")], True, True, "child")
    (tmp_path / "index.html").write_text("<table><tr><td>Agu Mon</td><td>Child</td><td>ア</td><td>Agumon</td><td>暂无</td></tr><tr><td>short</td></tr></table>")
    r = records.load(spark, "digimons_net", str(tmp_path / "index.html")).first()
    assert r.source_id == "agu-mon" and [n.language for n in r.names] == ["ja", "en"]
    (tmp_path / "wiki.json").write_text('{"title":"Agumon","text":"{{S2|l1=Child|a1=Vaccine|kan=ア}}"}\n{"title":"R","text":"#REDIRECT [[Agumon]]"}\n{"title":"N","text":"no box"}')
    assert [(r.source_id, r.level) for r in records.load(spark, "wikimon", str(tmp_path / "wiki.json")).collect()] == [("Agumon", "child")]
    (tmp_path / "game.json").write_text('[{"no":1,"digimon":"Agumon","hp":"12.7","sp":"n/a"}]')
    assert records.load(spark, "digidb", str(tmp_path / "game.json")).first().extra.game_stats == {"hp": "12"}
