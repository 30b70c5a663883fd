from pyspark.sql import functions as F

from lexigraph.functions import markup as M


def test_clean():
    assert M.clean("'''A''' [[X|shown]] and [[Y]] {{Ety|root|x}}<ref>note</ref>{{ref|n}} {{JP}}<br/>b") == ("A shown and Y root Japanese b", False)
    assert M.clean("a {{Ety|{{at|Move}}}} b") == ("a Move b", False)
    assert M.clean("{{unknown|x}} y") == ("{{unknown|x}} y", True)
    assert M.clean("open {{Ety|x") == ("open {{Ety|x", True)
    assert M.clean("[[File:a.png|thumb]]z") == ("z", False)
    assert M.clean(None) == ("", False) and M.clean("") == ("", False)


def test_deep_nesting_is_linear():
    assert M.clean("{{ety|" * 2000 + "x" + "}}" * 2000) == ("x", False)


def test_parameters():
    t = "pre {{S2\n|l1=Child|a1={{at|Va|b}}|n=[[A|B]]|l1=Adult}} post"
    assert M.template_parameters(t, "s2") == {"l1": "Adult", "a1": "{{at|Va|b}}", "n": "[[A|B]]"}
    assert M.template_parameters("none", "S2") is None and M.template_parameters("{{S2|a=1", "S2") is None


def test_other_fields():
    assert M.other_languages("{{CHI}} 亞古獸; {{KOR}} 아구몬; {{FRA}}") == {"zh_tw": "亞古獸", "ko": "아구몬"}
    assert M.section_bullets("==A==\n* x\n** y\n==B==\n* z", "a") == ["x", "y"]
    assert M.strip_residual("a {{b|{{c}}}} [[d]]  e") == "a e"


def test_html():
    p = M.read_html("<html><title>T</title><body><script>no</script><a href='/x?y=1'>l</a><table><tr><td>1</td><td>a<b>b</b></td></tr></table></body>")
    assert p["title"] == "T" and p["links"] == ["/x?y=1"] and p["rows"] == [["1", "ab"]] and "no" not in p["text"]


def test_image_headers():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (320).to_bytes(4, "big") + (200).to_bytes(4, "big")
    gif = b"GIF89a" + (7).to_bytes(2, "little") + (9).to_bytes(2, "little")
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + (50).to_bytes(2, "big") + (60).to_bytes(2, "big") + b"\0" * 8
    assert [M.sniff_size(x) for x in (png, gif, jpg, b"", None, b"junk junk junk")] == [(320, 200), (7, 9), (60, 50), (None, None), (None, None), (None, None)]


def test_columns(spark):
    df = spark.createDataFrame([("{{Ety|a}}",), (None,)], "t string")
    assert [tuple(r.c) for r in df.select(M.clean_markup(F.col("t")).alias("c")).collect()] == [("a", False), ("", False)]
