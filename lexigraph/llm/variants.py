"""Variant spellings of names: MinHash banding over padded q-grams, Monge-Elkan check, star clustering.

A spelling is a vertex (space, key, spaced): its words in one of the spaces of ``names``, joined, and with their borders.

1. Banding. The q-grams of a key are padded with its own beginning, so that the set does not depend on where a name of
   two words begins. MinHash bands over the set propose pairs. Rows and bands of each space are tuned from the collision
   curve 1 - (1 - s^r)^b: pairs at the similarity ``target`` of the sets meet with probability ``recall``. Only distinct
   keys are banded, so copies of a name add nothing, and a bucket holds different spellings only.
2. Monge-Elkan similarity verifies a pair: the mean, over the words of one name, of the similarity to the best matching
   word of the other, taken in both directions, the lower of the two; a word pair is judged by weighted edits over the
   weight of its letters. A name written without borders is one word, and the other is then read joined as well.
   Ideographs are words of one sign.
3. Star clustering over the graph of similar spellings: known names are centres beforehand, every spelling similar to one
   joins the most similar. Among the rest the spelling of the highest degree becomes a centre and its neighbours its
   satellites, and so on until none is left (in parallel: every one that ranks before all its open neighbours).

Defined cases: null, blank and letterless spellings have no words and are no vertices; a form mark (X-Antibody, black) must
agree; ties between known centres go to the lower rank, then to the smallest id, ties of degree to the smaller key; the
same spelling told twice is linked twice, once per row; empty tables give no links; names of any length are compared whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraph.llm.names import edit_costs
from lexigraph.session import cut, default_parallelism, drop_shuffles

#: Per space: letters of a q-gram (0: a word), similarity of the sets at which the recall holds, similarity of two names by chance.
BANDING = {"latin": (3, 0.37, 0.1), "kana": (3, 0.37, 0.1), "syllable": (0, 0.5, 0.17), "short": (1, 0.6, 0.2)}
#: Keys of letters up to this length are also banded by their letters alone: one edit leaves them few q-grams.
SHORT_KEY = 9
RECALL = 0.95
#: Share of all names that have much by chance in common with a given one, and how many of them a name may meet.
COMMON, STRANGERS = 0.02, 30
THRESHOLD = 0.72
#: Band rows that are worked on at a time: so many per name, or so many in all where names are few.
SHARE_BANDS, SHARE_ROWS = 16, 2_000_000
#: Taken off for words in another order.
TURNED = 0.05

_U = np.uint64


def bands_for(target: float, recall: float, rows: int) -> int:
    """The least number of bands by which pairs of similarity ``target`` collide with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - target**rows)))


def tuned(n: int, target: float, chance: float) -> tuple[int, int]:
    """(rows, bands) for n names: the recall at ``target`` is the same for every n; the rows are the least for which a name
    meets no more than about ``STRANGERS`` of the others by chance."""
    rows = 2
    while n * COMMON * chance**rows * bands_for(target, RECALL, rows) > STRANGERS:
        rows += 1
    return rows, bands_for(target, RECALL, rows)


def joined(spaced: Column, space: Column | None = None) -> Column:
    """The key of a spelling given by its words with blanks between: joined letters; ideographs keep their borders."""
    return F.when((F.col("space") if space is None else space) == "syllable", spaced).otherwise(F.replace(spaced, F.lit(" "), F.lit("")))


def vertices(spelled: DataFrame, *more: str) -> DataFrame:
    """(space, key, ..., spaced): the distinct spellings of rows (space, words, ...); of several borders the most count."""
    s = spelled.withColumn("spaced", F.array_join("words", " ")).withColumn("key", joined(F.col("spaced")))
    return s.groupBy("space", "key", *more).agg(F.max_by("spaced", F.struct(F.length("spaced"), "spaced")).alias("spaced"))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    return h ^ (h >> _U(29))


def _grams(keys: list[str], q: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed q-grams of all keys in one row, and where each key begins. q = 0: the words; q = 1: letters, numbered when repeated."""
    if q == 0:
        split = [k.split(" ") for k in keys]
        flat = np.array([zlib.crc32(w.encode()) for ws in split for w in ws], dtype=_U)
        sizes = np.array([len(ws) for ws in split])
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return _mix(flat + _U(1)), begins
    codes = np.frombuffer("".join(keys).encode("utf-32-le"), dtype=np.uint32).astype(_U)
    sizes = np.array([len(k) for k in keys])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at = np.arange(len(codes))
    owner, place = np.repeat(begins, sizes), at - np.repeat(begins, sizes)
    if q == 1:
        same = np.argsort(np.repeat(np.arange(len(keys)), sizes).astype(np.int64) * (1 << 21) + codes.astype(np.int64), kind="stable")
        k = np.repeat(np.arange(len(keys)), sizes)[same].astype(np.int64) * (1 << 21) + codes[same].astype(np.int64)
        first = np.concatenate([[True], k[1:] != k[:-1]])
        run = np.arange(len(k)) - np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))
        number = np.empty(len(k), dtype=_U)
        number[same] = run.astype(_U)
        return _mix(codes * _U(0x9E3779B97F4A7C15) + number + _U(1)), begins
    h = codes.copy()
    size = np.repeat(sizes, sizes)
    for i in range(1, q):
        h = h * _U(0x100000001B3) + codes[owner + (place + i) % size]
    return _mix(h * _U(0x9E3779B97F4A7C15) + _U(q)), begins


def _bands(keys: list[str], q: int, rows: int, bands: int, seed: int, part: int = 0, parts: int = 1) -> np.ndarray:
    """The bands (keys x bands) of keys that are not empty; of the bands only one of ``parts`` like shares."""
    factors = np.random.default_rng(seed).integers(1, 1 << 62, (bands, rows, 2)).astype(_U)
    own = range(bands * part // parts, bands * (part + 1) // parts)
    with np.errstate(over="ignore"):
        grams, begins = _grams(keys, q)
        out = np.empty((len(keys), len(own)), dtype=_U)
        for at, b in enumerate(own):
            v = np.full(len(keys), b + seed * 1000, dtype=_U)
            for a, c in factors[b]:
                low = np.minimum.reduceat((grams * (a | _U(1)) + c) >> _U(16), begins)
                v = v * _U(0x9E3779B97F4A7C15) + low
            out[:, at] = _mix(v)
    return out.view(np.int64)


def _tuning(n: int, target: float | None) -> dict[str, tuple[int, int, int]]:
    """(letters of a q-gram, rows, bands) per kind of banding, for n names."""
    return {name: (q, *tuned(n, target if target and q > 1 else least, chance)) for name, (q, least, chance) in BANDING.items()}


def band_rows(named: DataFrame, n: int, target: float | None = None, part: int = 0, parts: int = 1) -> DataFrame:
    """(band, id): one of ``parts`` like shares of the MinHash bands of vertices (id, space, key) among n."""
    tuning = _tuning(n, target)

    def hashed(batches):
        for batch in batches:
            ids, spaces, keys = batch.column("id").to_numpy(), np.array(batch.column("space").to_pylist(), dtype=object), batch.column("key").to_pylist()
            for seed, (name, (q, rows, bands)) in enumerate(tuning.items(), 1):
                if name == "short":
                    at = [i for i, k in enumerate(keys) if spaces[i] != "syllable" and len(k) <= SHORT_KEY]
                else:
                    at = np.flatnonzero(spaces == name).tolist()
                if at:
                    chosen = [keys[i] for i in at]
                    # u and o may be what Japanese adds to a closed consonant: they tell least in kana
                    got = _bands([re.sub("[uo]", "", k) or k for k in chosen] if name == "kana" else chosen, q, rows, bands, seed, part, parts)
                    if name == "short":  # latin and kana keys share the short bands, so these hold the space as well
                        got = got ^ (spaces[at] == "kana").astype(np.int64)[:, None]
                    yield pa.RecordBatch.from_arrays([pa.array(got.ravel()), pa.array(np.repeat(ids[at], got.shape[1]))], ["band", "id"])

    return named.select("id", "space", "key").mapInArrow(hashed, "band bigint, id bigint")


def shares(sizes: dict[tuple[str, bool], int], n: int, target: float | None = None) -> int:
    """The shares in which the bands of names are worked on; ``sizes``: names per space and whether they are short; ``n`` as in the tuning."""
    bands = {name: b for name, (_, _, b) in _tuning(n, target).items()}
    rows = sum(k * (bands[space] + (bands["short"] if short and space != "syllable" else 0)) for (space, short), k in sizes.items())
    return max(1, min(max(bands.values()), math.ceil(rows / max(SHARE_ROWS, SHARE_BANDS * sum(sizes.values())))))


def _bags(keys: list[str]) -> np.ndarray:
    """Letter counts of keys, letters folded into 64 classes."""
    codes = np.frombuffer("".join(keys).encode("utf-32-le"), dtype=np.uint32) % 64
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    return np.bincount(owner * 64 + codes, minlength=64 * len(keys)).reshape(len(keys), 64)


_WEIGHT = np.where(np.isin(np.arange(64), [ord(c) % 64 for c in "aeiou"]), 0.5, 1.0)


def monge_elkan(spaces: list[str], left: list[list[str]], right: list[list[str]], threshold: float = 0.0) -> np.ndarray:
    """Monge-Elkan similarities of pairs of word lists of one space each; below ``threshold`` they may be told as 0."""
    out = np.zeros(len(spaces))
    letters = []
    for i, (s, a, b) in enumerate(zip(spaces, left, right)):
        if s == "syllable":
            # a word of one sign matches wholly or not at all
            same = sum((Counter(a) & Counter(b)).values())
            turned = a != b and [w for w in a if w in b] != [w for w in b if w in a]
            out[i] = same / max(len(a), len(b)) - (TURNED if turned else 0.0)
        else:
            letters.append(i)
    if not letters:
        return out
    joined_a, joined_b = ["".join(left[i]) for i in letters], ["".join(right[i]) for i in letters]
    # no pair of too different letters can reach the threshold: the words' costs add up to at least the difference of the bags
    bags_a, bags_b = _bags(joined_a) * _WEIGHT, _bags(joined_b) * _WEIGHT
    apart = np.maximum(np.maximum(bags_a - bags_b, 0).sum(axis=1), np.maximum(bags_b - bags_a, 0).sum(axis=1))
    room = np.maximum(bags_a.sum(axis=1), bags_b.sum(axis=1))
    for k, i in enumerate(letters):
        if len(left[i]) > 1 and len(right[i]) > 1:  # the mean over words lets a long word differ more
            room[k] = max(room[k], max(len(left[i]), len(right[i])) * max(map(len, left[i] + right[i])))
    kept = np.flatnonzero(apart <= (1 - threshold) * room + 1e-9)
    pairs: dict[tuple[str, str], int] = {}
    number = lambda a, b: pairs.setdefault((a, b), len(pairs))
    turns = lambda ws: ["".join(ws[i:] + ws[:i]) for i in range(1, len(ws))]
    grids = []
    for k in kept:
        a, b = left[letters[k]], right[letters[k]]
        # a name without borders may begin with any word of the other
        more = [(x, joined_b[k]) for x in turns(a)] if len(b) == 1 else [(joined_a[k], x) for x in turns(b)] if len(a) == 1 else []
        grids.append((number(joined_a[k], joined_b[k]), [number(x, y) for x, y in more], [[number(x, y) for y in b] for x in a] if len(a) > 1 and len(b) > 1 else None))
    firsts, seconds = [a for a, _ in pairs], [b for _, b in pairs]
    weight = np.maximum((_bags(firsts) * _WEIGHT).sum(axis=1), (_bags(seconds) * _WEIGHT).sum(axis=1)) if pairs else np.zeros(0)
    sims = 1 - edit_costs(firsts, seconds) / np.maximum(weight, 0.5)
    for k, (whole, more, grid) in zip(kept, grids):
        best = max([sims[whole], *(sims[n] - TURNED for n in more)])
        if grid is not None:
            rows = [[sims[n] for n in row] for row in grid]
            there = sum(map(max, rows)) / len(rows)
            back = sum(map(max, zip(*rows))) / len(rows[0])
            in_order = len(rows) == len(rows[0]) and all(row[i] == max(row) for i, row in enumerate(rows))
            best = max(best, min(there, back) - (0.0 if in_order else TURNED))
        out[letters[k]] = best
    return out


def verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (space, left, right, ...) of words with blanks between, with their similarity, those that reach the threshold."""

    @F.pandas_udf("double")
    def sim(space: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(monge_elkan(space.tolist(), [x.split(" ") for x in a], [x.split(" ") for x in b], threshold))

    return pairs.withColumn("similarity", sim("space", "left", "right")).where(F.col("similarity") >= threshold)


def similar_pairs(left: DataFrame, right: DataFrame | None = None, threshold: float = THRESHOLD, target: float | None = None) -> DataFrame:
    """(space, left_key, right_key, similarity): vertices (space, key, spaced) that share a band and pass the check.

    Without ``right``: the pairs within ``left``, each once. Pairs with equal keys are not told. ``target``: the similarity
    of q-gram sets from which on the recall holds, if not that of ``BANDING``. The bands are worked on in shares, all of
    them: the pairs of a share are checked and its rows dropped before the next, so that few lie on disk at a time.
    """
    drop_shuffles(left.sparkSession)
    short = (F.length("key") <= SHORT_KEY).alias("short")
    sizes = [{(r["space"], r["short"]): r["n"] for r in v.groupBy("space", short).agg(F.count(F.lit(1)).alias("n")).collect()} for v in (left, right) if v is not None]
    n, m = sum(sizes[0].values()), sum(sizes[-1].values())
    n = n * m // max(1, n + m)  # strangers are counted for a name of either side
    parts = shares({k: sum(s.get(k, 0) for s in sizes) for s in sizes for k in s}, n, target)
    ident = F.xxhash64("space", "key").alias("id")
    tasks = default_parallelism(left.sparkSession)  # small rows, much work: not to be put together into one task
    named = [v.select(ident, "space", "key", "spaced") for v in (left, right) if v is not None]
    told = lambda v, i, space, words: v.select(F.col("id").alias(i), F.col("space").alias(space), F.col("spaced").alias(words))
    keys = [joined(F.col(c)).alias(f"{c}_key") for c in ("left", "right")]

    def share(part: int) -> DataFrame:
        # a band row is two numbers; both sides of a pairing within one table are the same rows, shuffled once
        banded = [band_rows(v, n, target, part, parts) for v in named]
        met = banded[0].select("band", F.col("id").alias("a")).join(banded[-1].select("band", F.col("id").alias("b")), "band")
        met = met.where("a < b" if right is None else "a <> b").select("a", "b").repartition(tasks, "a").distinct()
        met = met.join(told(named[0], "a", "space", "left"), "a").repartition(tasks, "b")
        met = met.join(told(named[-1], "b", "_space", "right"), "b").where(F.col("space") == F.col("_space")).select("space", "left", "right")
        return verified(met, threshold).select("space", *keys, "similarity").where("left_key <> right_key")

    if parts == 1:
        return share(0)
    found = None
    for part in range(parts):
        # the shuffle of distinct keeps the check from being done again for the checkpoint
        new = cut(share(part).distinct())
        found = new if found is None else found.unionByName(new)
    return found.distinct()


def link(spellings: DataFrame, centres: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(space, key, form, entity, similarity): each spelling that is similar to a known name, with the entity of its star.

    ``spellings``: rows (space, words, form). ``centres``: rows (space, words, form, entity, rank), any number of names
    per entity; of equally similar centres the one of lower rank wins, then the smaller entity.
    """
    # of equal names only the first entity can win
    first = F.min(F.struct("rank", "entity")).alias("o")
    known = centres.withColumn("spaced", F.array_join("words", " ")).withColumn("key", joined(F.col("spaced")))
    known = known.groupBy("space", "key", "form").agg(first, F.max_by("spaced", F.struct(F.length("spaced"), "spaced")).alias("spaced"))
    known = cut(known.select("space", "key", "form", "spaced", "o.entity", "o.rank"))
    asked = vertices(spellings, "form")
    equal = asked.join(known.select("space", "key", "form", "entity"), ["space", "key", "form"], "left")
    equal = cut(equal)
    # nothing is more similar than an equal name: only the others are looked for
    rest = equal.where("entity is null").select("space", "key", "form", "spaced")
    distinct = lambda v: v.groupBy("space", "key").agg(F.max_by("spaced", F.struct(F.length("spaced"), "spaced")).alias("spaced"))
    pairs = similar_pairs(distinct(rest), cut(distinct(known)), threshold)
    close = rest.select("space", F.col("key").alias("left_key"), "form").join(pairs, ["space", "left_key"])
    close = close.join(known.select("space", F.col("key").alias("right_key"), "form", "entity", "rank"), ["space", "right_key", "form"])
    best = F.max_by(F.struct("entity", "similarity"), F.struct("similarity", (-F.col("rank")).alias("a"), (-F.col("entity")).alias("b"))).alias("s")
    close = close.groupBy("space", F.col("left_key").alias("key"), "form").agg(best).select("space", "key", "form", "s.entity", "s.similarity")
    return equal.where("entity is not null").select("space", "key", "form", "entity", F.lit(1.0).alias("similarity")).unionByName(close)


def stars(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, centre, similarity): star clustering of the nodes by the edges (a, b, similarity), each edge told once.

    A node becomes a centre when no open neighbour ranks before it (degree, then the smaller node); its open neighbours
    become satellites of the most similar such centre. At least the first of the open nodes is settled in every round.
    """
    edges = cut(graph.select("a", "b", "similarity").unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")))
    degree = edges.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    alone = nodes.join(degree, nodes["node"] == degree["a"], "left_anti")
    done = alone.select("node", F.col("node").alias("centre"), F.lit(1.0).alias("similarity"))
    order = degree.select("a", F.struct((-F.col("degree")).alias("d"), F.col("a").alias("n")).alias("o"))
    open_edges = cut(edges.join(order, "a").join(order.select(F.col("a").alias("b"), F.col("o").alias("o_b")), "b"))
    while not open_edges.isEmpty():
        first = open_edges.groupBy("a", "o").agg(F.min("o_b").alias("least")).where("o < least").select(F.col("a").alias("centre"))
        centres = cut(first)
        taken = open_edges.join(centres.withColumnRenamed("centre", "b"), "b").groupBy("a").agg(F.max_by(F.struct("b", "similarity"), F.struct("similarity", (-F.col("o_b")["d"]).alias("d"))).alias("m"))
        new = cut(centres.select(F.col("centre").alias("node"), "centre", F.lit(1.0).alias("similarity")).unionByName(taken.select(F.col("a").alias("node"), F.col("m.b").alias("centre"), "m.similarity")))
        done = done.unionByName(new)
        settled = new.select(F.col("node").alias("a"))
        left = open_edges.join(settled, "a", "left_anti").join(settled.withColumnRenamed("a", "b"), "b", "left_anti")
        # a node whose neighbours are all settled is a star of its own
        lone = open_edges.select("a").distinct().join(settled, "a", "left_anti")
        left = cut(left)
        lone = lone.join(left.select("a").distinct(), "a", "left_anti")
        done = cut(done.unionByName(lone.select(F.col("a").alias("node"), F.col("a").alias("centre"), F.lit(1.0).alias("similarity"))))
        open_edges = left
    return done
