"""Reading names typed in Latin letters, kana or ideographs into words of a space in which they can be compared.

A name is normalised (compatibility forms, case, simplified ideographs), its form marks (X-Antibody, black) are taken
off, and so are the generic words that the caller names ("...mon" in a catalogue where every name ends so). What is
left is a list of words in one of three spaces:

* ``latin``: words of letters with spelling habits folded (doubled letters, oo for u, ks for x, q or c for k, l for r);
* ``kana``: words in the letters of the Japanese sound system. A Latin name has a reading there, too: the sounds by which
  Japanese renders foreign words (a vowel after a closed consonant, a long vowel for a closing r). Silent letters are read as sounds;
* ``syllable``: one word per ideograph: the syllable learned for it, else the ideograph. A Latin name has a reading
  there, too: its syllables.

Defined cases: a null or blank name, or one without letters, has no words; an ideograph that was never seen beside a
Latin name stands for itself; a name of any length is read whole.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kana of every consonant in the order a i u e o (a dot where there is none).
KANA_ROWS = {
    "": "アイウエオ", "k": "カキクケコ", "g": "ガギグゲゴ", "s": "サシスセソ", "z": "ザジズゼゾ", "t": "タチツテト", "d": "ダ・ヅデド", "n": "ナニヌネノ",
    "h": "ハヒ・ヘホ", "b": "バビブベボ", "p": "パピプペポ", "m": "マミムメモ", "y": "ヤ・ユ・ヨ", "r": "ラリルレロ", "w": "ワヰ・ヱヲ", "f": "・・フ・・", "v": "・・ヴ・・", "j": "・ヂ・・・",
}
#: Small kana and their vowels.
SMALL_KANA = {"ァ": "a", "ィ": "i", "ゥ": "u", "ェ": "e", "ォ": "o", "ャ": "a", "ュ": "u", "ョ": "o", "ヮ": "a"}
#: Marks of forms of their own.
X_MARK = r"(?i)x[\s\-_]*anti(?:[\s\-]*body)?(?![a-z])|(?<![A-Za-z])x[\s\-_]*ab(?![A-Za-z])|x[\s\-]*抗[体體]|(?<![A-Za-z])x(?![A-Za-z])|エックス抗体"
BLACK_MARK = r"(?i)(?<![a-z])(black|blk)\.?(?:[\s,]*ver(?:sion|\.)?)?(?![a-z])|^ブラック|ブラック$|[(]黑[)]|黑色?版|^黑"

_BLANKS = re.compile(r"[^\w]+|_+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HAN = re.compile(r"[㐀-鿿豈-﫿]")
_KANA = re.compile(r"[ァ-ヺ]")
_KANA_WORD = re.compile(r"[ァ-ヺー]+")
_X, _BLACK = re.compile(X_MARK), re.compile(BLACK_MARK)
_MARKED = re.compile(r"[xXｘＸエ]|[bBｂＢ][lLｌＬ]|黑|ブラック|ﾌﾞﾗ")
_TWICE = re.compile(r"(.)\1+")
_HABITS = ((re.compile("oo"), "u"), (re.compile("ee"), "i"), (re.compile("ck|q|c"), "k"), (re.compile("ks"), "x"), (re.compile("ph"), "f"))
_SYLLABLE = re.compile(r"[^aeiou]*[aeiou]+(?:[^aeiou]+$|[^aeiou]*(?=[^aeiou][aeiou]))?")


@lru_cache(maxsize=1)
def _kana() -> dict[str, tuple[str, str]]:
    return {k: (c, v) for c, row in KANA_ROWS.items() for k, v in zip(row, "aiueo") if k != "・"}


def kana_sounds(kana: str) -> str:
    """Kana in letters; doubled consonants and long vowels are short."""
    table, out = _kana(), []
    for ch in kana:
        v = SMALL_KANA.get(ch)
        if v and out:
            c, was = out[-1]
            # a vowel of its own before a small one is a glide: ウィ wi, イェ ye; ジ before one is j: ジェ je
            out[-1] = ({"u": "w", "i": "y"}.get(was, "") if not c else "j" if c == "z" and was == "i" else c, v)
        elif ch == "ン":
            out.append(("n", ""))
        elif ch in table:
            out.append(table[ch])
    return _TWICE.sub(r"\1", "".join(c + v for c, v in out))


#: What Japanese adds to a consonant without a vowel after it.
CLOSED = {"t": "to", "d": "do", "n": "n", "r": "", "l": "ru", "x": "kusu", "h": "", "y": "i", "w": "u", "j": "ji"}
_SPELLED = ((re.compile("ph"), "f"), (re.compile("sh|th"), "s"), (re.compile("ch"), "t"), (re.compile("ck|[qc]"), "k"), (re.compile("ks"), "x"), (re.compile("oo"), "u"), (re.compile("ee"), "i"), (_TWICE, r"\1"))


def latin_sounds(letters: str) -> str:
    """A Latin word in the letters by which Japanese renders it."""
    for pattern, to in _SPELLED:
        letters = pattern.sub(to, letters)
    out = []
    for i, c in enumerate(letters):
        follows = letters[i + 1 : i + 2]
        if c in "aeiou":
            out.append(c)
        elif follows and follows in "aeiou":
            if c == "x":
                out.append("kus")
            elif (c, follows) not in (("w", "u"), ("y", "i")):
                out.append("r" if c == "l" else "f" if c == "h" and follows == "u" else c)
        else:
            out.append(CLOSED.get(c, c + "u"))
    return _TWICE.sub(r"\1", "".join(out))


def fold(letters: str) -> str:
    """Letters without spelling habits."""
    for pattern, to in _HABITS:
        letters = pattern.sub(to, letters)
    return _TWICE.sub(r"\1", letters.replace("l", "r"))


def syllables(letters: str) -> list[str]:
    """The syllables of a Latin word: one vowel group each, the last consonant between two groups begins the next."""
    got = _SYLLABLE.findall(letters)
    return got if "".join(got) == letters else [letters] if letters else []


class NameReader:
    """Reads names. ``simplify``: ideograph -> simplified; ``han``: ideograph -> syllable; ``generic``: endings that all names have."""

    def __init__(self, simplify: dict[int, str] | None = None, han: dict[str, str] | None = None, generic: tuple[str, ...] = ()):
        self.simplify, self.han = simplify or {}, han or {}
        self.latin_ends = tuple(g for g in generic if g.isascii())
        self.other_ends = tuple(sorted((g for g in generic if not g.isascii()), key=len, reverse=True))
        # an ending may be mistyped: letters doubled, vowels others or left out
        loose = "|".join("".join("[aeiou]*" if c in "aeiou" else c + "+" for c in g) for g in self.latin_ends)
        self.loose = re.compile(f"(?:{loose})$") if loose else None
        # a mark may be glued to the ending
        self.glued = re.compile(f"(?i)({'|'.join(self.latin_ends)})(?=(?:x[\\W_]*anti\\w*|x|black|blk)+$)") if loose else None

    def normal(self, value: str) -> str:
        if value.isascii():
            return value.strip()
        s = unicodedata.normalize("NFKC", value).translate(self.simplify)
        return "".join(chr(ord(c) + 96) if "ぁ" <= c <= "ゖ" else c for c in s).strip()

    def bare(self, value: str) -> tuple[str, str, str]:
        """(text without form marks, form, script)."""
        s = self.normal(value)
        script, form = "latin", ""
        if not s.isascii():
            script = "syllable" if len(_HAN.findall(_X.sub("", s))) >= 2 else "kana" if _KANA.search(s) else "latin"
        if script == "latin":
            s = _CAMEL.sub(" ", s)
            if self.glued:
                s = self.glued.sub(r"\1 ", s)
        if _MARKED.search(s):
            for pattern, mark in ((_X, "x"), (_BLACK, "black")):
                got = pattern.sub(" ", s).strip()
                if got and got != s:
                    s, form = got, form + mark
        return s, form, script

    def _without_end(self, word: str) -> str:
        for e in self.latin_ends:
            if word.endswith(e) and len(word) > len(e):
                return word[: -len(e)]
        if self.loose and len(word) > 5:
            m = self.loose.search(word)
            if m and m.start() > 2:
                return word[: m.start()]
        return word

    def latin_words(self, s: str) -> list[str]:
        """Words as they are spelled, without generic endings."""
        words = []
        for w in _BLANKS.split(s):
            if w:
                w = w.casefold()
                if not w.isascii():
                    w = "".join(c for c in unicodedata.normalize("NFKD", w) if c.isalnum())
                w = self._without_end(w)
                if w and w not in self.latin_ends:
                    words.append(w)
        return words

    def read(self, value: str | None) -> tuple[str, str, list[str]]:
        """(script, form, words)."""
        if value is None:
            return "", "", []
        s, form, script = self.bare(value)
        if script == "latin":
            words = [fold(w) for w in self.latin_words(s)]
        elif script == "kana":
            words = [kana_sounds(self._less(w)) for w in _KANA_WORD.findall(s)]
        else:
            words = [self.han.get(c, c) for c in self.signs(s)]
        words = [w for w in words if w]
        return script if words else "", form, words

    def _less(self, text: str) -> str:
        for e in self.other_ends:
            if text.endswith(e) and len(text) > len(e):
                return text[: -len(e)]
        return text

    def signs(self, bare: str) -> list[str]:
        """The ideographs of a text without marks and generic endings."""
        return list(self._less("".join(_HAN.findall(bare))))

    def crossed(self, value: str | None) -> list[tuple[str, list[str]]]:
        """A Latin name in the other two spaces."""
        if value is None:
            return []
        s, _, script = self.bare(value)
        words = self.latin_words(s) if script == "latin" else []
        if not words:
            return []
        return [("kana", [x for x in map(latin_sounds, words) if x]), ("syllable", [x for w in words for x in syllables(fold(w))])]


def simplified_table(spark: SparkSession) -> dict[int, str]:
    """Traditional -> simplified ideographs from the transliterator that ships with Spark; bounded by the code block."""
    codes = [*range(0x3400, 0x4DC0), *range(0x4E00, 0xA000)]
    text = "".join(map(chr, codes))
    try:
        got = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified").transliterate(text)
    except Exception:  # another build of Spark: read names as they stand
        return {}
    if len(got) != len(text):
        return {}
    return {a: b for a, b in zip(codes, got) if chr(a) != b}


def read_column(value: Column, simplify: dict[int, str], han: dict[str, str] | None = None, generic: tuple[str, ...] = ()) -> Column:
    """A struct (form, space, words) of a name; a name without words has none of the last two."""

    @F.pandas_udf("form string, space string, words array<string>")
    def read(values: pd.Series) -> pd.DataFrame:
        reader = NameReader(simplify, han, generic)
        got = [reader.read(v) for v in values]
        return pd.DataFrame({"form": [f for _, f, _ in got], "space": [s or None for s, _, _ in got], "words": [w or None for _, _, w in got]})

    return read(value)


def crossed_column(value: Column, simplify: dict[int, str], generic: tuple[str, ...] = ()) -> Column:
    """A Latin name in the other spaces, as array<struct<space, words>>."""

    @F.pandas_udf("array<struct<space:string, words:array<string>>>")
    def cross(values: pd.Series) -> pd.Series:
        reader = NameReader(simplify, None, generic)
        return pd.Series([[{"space": s, "words": w} for s, w in reader.crossed(v) if w] for v in values])

    return cross(value)


def learn_han(pairs: DataFrame, latin: str, han: str, simplify: dict[int, str], generic: tuple[str, ...] = (), min_share: float = 0.6) -> dict[str, str]:
    """Ideograph -> Latin syllable from rows with a Latin and an ideographic name of one thing.

    Every row with as many ideographs as syllables votes once per sign; a sign is learned if one syllable has
    ``min_share`` of its votes. The table has at most one entry per ideograph of the code blocks, so it may be
    gathered. All rows are used.
    """

    @F.pandas_udf("array<struct<sign:string, syllable:string>>")
    def votes(latin_names: pd.Series, han_names: pd.Series) -> pd.Series:
        reader, out = NameReader(simplify, None, generic), []
        for a, b in zip(latin_names, han_names):
            s, _, script = reader.bare(b) if b else ("", "", "")
            signs = reader.signs(s) if script == "syllable" else []
            spoken = [x for w in reader.latin_words(reader.bare(a)[0]) for x in syllables(fold(w))] if len(signs) > 1 and a else []
            out.append([{"sign": c, "syllable": x} for c, x in zip(signs, spoken)] if len(spoken) == len(signs) else [])
        return pd.Series(out)

    v = pairs.where(F.col(latin).isNotNull() & F.col(han).isNotNull()).select(F.explode(votes(F.col(latin), F.col(han))).alias("v")).groupBy("v.sign", "v.syllable").count()
    best = v.groupBy("sign").agg(F.max_by("syllable", F.struct("count", "syllable")).alias("syllable"), F.max("count").alias("n"), F.sum("count").alias("all"))
    return {r["sign"]: r["syllable"] for r in best.where(F.col("n") >= F.col("all") * min_share).collect()}


_VOWELS = np.array([ord(c) for c in "aeiou"], dtype=np.int32)


def edit_costs(left: list[str], right: list[str]) -> np.ndarray:
    """Weighted edits of each pair: a vowel put in or left out 0.5, all else (also a swap of neighbours) 1.

    All pairs of like length are worked on together, row by row; any length is compared whole.
    """
    out = np.zeros(len(left))
    todo: dict[tuple[int, int], list[int]] = {}
    for i, (a, b) in enumerate(zip(left, right)):
        if a != b:
            todo.setdefault((len(a), max(8, 1 << (max(1, len(b)) - 1).bit_length())), []).append(i)
    for (n, width), members in todo.items():
        step = max(1, 4_000_000 // (width * 8))
        for at in range(0, len(members), step):
            part = members[at : at + step]
            out[part] = _costs([left[i] for i in part], [right[i] for i in part], n, width)
    return out


def _costs(left: list[str], right: list[str], n: int, width: int) -> np.ndarray:
    a = np.array([[ord(c) for c in x] for x in left], dtype=np.int32).reshape(len(left), n)
    b = np.zeros((len(right), width), dtype=np.int32)
    for i, x in enumerate(right):
        b[i, : len(x)] = [ord(c) for c in x]
    lengths = np.array([len(x) for x in right])
    take = np.where(np.isin(b, _VOWELS), 0.5, 1.0)
    base = np.concatenate([np.zeros((len(b), 1)), np.cumsum(take, axis=1)], axis=1)  # from nothing to b[:j]
    before2, before = None, base
    shifted = np.concatenate([np.full((len(b), 1), -1, dtype=np.int32), b[:, :-1]], axis=1)
    for i in range(n):
        c = a[:, i : i + 1]
        row = np.empty_like(base)
        drop = np.where(np.isin(c, _VOWELS), 0.5, 1.0)
        row[:, 0] = before[:, 0] + drop[:, 0]
        np.minimum(before[:, :-1] + (b != c), before[:, 1:] + drop, out=row[:, 1:])
        if i:
            swap = (shifted == c) & (b == a[:, i - 1 : i])
            row[:, 2:] = np.where(swap[:, 1:], np.minimum(row[:, 2:], before2[:, :-2] + 1), row[:, 2:])
        row = np.minimum.accumulate(row - base, axis=1) + base
        before2, before = before, row
    return before[np.arange(len(b)), lengths]
