import random

import pytest
from pyspark.sql import functions as F

from lexigraph.llm import packing, tokens

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


EDGE = ["", " ", "  ", "\n \n x", "a  b   c", "it's we'll 'S", "<|endoftext|>", "a" * 3000, " " * 500 + "x", "=" * 700, "亚古兽进化成暴龙兽。", "アグモンは进化する", "ß Ünïcödé — “x”", " 🐉🔥 👨‍👩‍👧 é", "​zero width　", "tab\tnew\r\nline ", "١٢٣ ́combining", "x" * 60 + " " + "y" * 90]


@pytest.mark.parametrize("text", EDGE)
def test_edge_texts(reference, text):
    assert tokens.encoder(tokens.vocabulary_path()).encode(text) == reference(text)


def test_random_texts(reference):
    rng, e = random.Random(5), tokens.encoder(tokens.vocabulary_path())
    signs = "ab cdeZ  \n\t.,'1亚古兽アグé🐉 "
    for _ in range(400):
        s = "".join(rng.choice(signs) for _ in range(rng.randrange(40)))
        assert e.encode(s) == reference(s), repr(s)


def test_column(spark, reference):
    df = spark.createDataFrame([(1, "Agumon digivolves"), (2, None), (3, "")], "doc_id bigint, text string")
    got = {r.doc_id: (r.ids, r.n) for r in df.select("doc_id", tokens.encode_column(F.col("text")).alias("ids"), tokens.count_column(F.col("text")).alias("n")).collect()}
    ids = reference("Agumon digivolves")
    assert got == {1: (ids, len(ids)), 2: (None, None), 3: ([], 0)}
    assert df.limit(0).select(tokens.encode_column(F.col("text"))).count() == 0


def naive(sizes, capacity):
    free, out = [], []
    for s in sizes:
        for i, f in enumerate(free):
            if f >= s:
                break
        else:
            i = len(free)
            free.append(capacity)
        free[i] -= s
        out.append(i)
    return out


def test_tree_equals_first_fit():
    rng = random.Random(1)
    for _ in range(50):
        sizes = sorted((rng.randrange(0, 101) for _ in range(rng.randrange(60))), reverse=True)
        assert packing.first_fit_decreasing(sizes, 100) == naive(sizes, 100)


def test_pack(spark):
    rng = random.Random(2)
    items = [(i, rng.choice([0, 5, 30, 60, 99, 100, 101, 250, 300])) for i in range(300)] + [(1000, None), (1001, -4)]
    df = spark.createDataFrame([(i, n, "x") for i, n in items], "doc_id bigint, n bigint, size string")
    got = packing.pack(df, "doc_id", F.col("n"), 100, 3).collect()
    per, used = {}, {}
    for r in got:
        per.setdefault(r.item_id, []).append(r)
        used[(r.container_group, r.container)] = used.get((r.container_group, r.container), 0) + r.size
    assert max(used.values()) <= 100 and set(per) == {i for i, _ in items}
    for i, n in items:
        n = max(0, n or 0)
        pieces = sorted(per[i], key=lambda r: r.offset)
        assert sum(r.size for r in pieces) == n and len(pieces) == (1 if n <= 100 else -(-n // 100))
        assert [r.offset for r in pieces] == [100 * k for k in range(len(pieces))]
    assert len(used) <= sum(used.values()) / 100 * 1.25 + 3 * 3
    assert packing.pack(df.limit(0), "doc_id", F.col("n"), 100, 3).count() == 0
