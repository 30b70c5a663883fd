"""Exact byte-pair encoding by dynamic programming over prefixes.

For every prefix of a piece the last token of its encoding is unique. All vocabulary entries that end at a
position are found by a suffix automaton (Aho-Corasick) over the bytes; the entry is the last token if it is
compatible with the last token of the prefix before it, which the pair test decides from the merge table
alone. The ids are read off the back-pointers. The time is linear in the text for any input: a run of one letter
costs no more than other text.

Two exact cuts keep the tables small. A piece always ends before a blank that follows a character other than white
space, so words can be looked up as they stand; and no merge crosses two characters whose adjoining bytes
are neighbours in no vocabulary entry, so a long run of ideographs falls into short stretches.

Defined cases: a null text has null ids, an empty text an empty list; blank and any other text is encoded as
it stands, whole, with special-token strings as ordinary text. Text that is not valid Unicode (lone
surrogates) is encoded with the replacement mark.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces whose ids a Python worker remembers; beyond it the memory starts afresh, which changes no result.
REMEMBERED = 300_000


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """Where the installed public tokenizers keep a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Memory(dict):
    """Results by text; long texts are worked out each time."""

    def __init__(self, work):
        super().__init__()
        self.work = work

    def __missing__(self, text: str) -> tuple[int, ...]:
        got = tuple(self.work(text))  # tuples of numbers are no burden to the garbage collector
        if len(text) <= 64:
            self[text] = got
        return got


class Encoder:
    """The encoder of one ranks file (token bytes in base64, rank)."""

    def __init__(self, path: str, pattern: str | None = None):
        import ahocorasick
        import public_tokenizers
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self.size = max(ranks.values()) + 1
        self.left, self.right = list(range(self.size)), list(range(self.size))
        self.merged: dict[int, int] = {}
        for token, rank in ranks.items():
            if len(token) > 1:
                a, b = self._parts(token, rank, ranks)
                self.left[rank], self.right[rank] = a, b
                self.merged[a * self.size + b] = rank
        self.automaton = ahocorasick.Automaton()
        self.neighbours = bytearray(1 << 16)  # byte pairs inside vocabulary entries
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
            for x, y in zip(token, token[1:]):
                self.neighbours[x << 8 | y] = 1
        self.automaton.make_automaton()
        self.blank_runs = regex.compile(r"\s ").search
        self.pairs: dict[int, bool] = {}
        self.parts = _Memory(self.encode_stretch)
        self.pieces = _Memory(self.encode_piece)
        self.words = _Memory(lambda word: self.encode_pieces(" " + word))

    @staticmethod
    def _parts(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[int, int]:
        """The two tokens whose merge made this one: merge in order of rank with all ranks below it."""
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the tokens a, b can stand side by side: no merge across their border comes before their own merges."""
        limit = self.size
        merged, size, left, right = self.merged, self.size, self.left, self.right
        while True:
            if merged.get(a * size + b, size) < limit:
                return False
            # undo the later merge of the two; the border may only be crossed by a merge of lower rank
            if a > b:
                limit, part = a, right[a]
                if part == a:  # a single byte: go on with the other side
                    limit, part = b + 1, left[b]
                    if part == b:
                        return True
                    b = part
                else:
                    a = part
            else:
                limit, part = b + 1, left[b]
                if part == b:
                    limit, part = a, right[a]
                    if part == a:
                        return True
                    a = part
                else:
                    b = part

    def stretches(self, piece: str) -> list[str]:
        """The piece, cut between characters that no merge can join."""
        raw, joins, n = piece.encode("utf-8", "replace"), self.neighbours, len(piece)
        if "\u0800" <= min(piece) and max(piece) <= "\uffff":  # ideographs and kana: the border bytes lie at fixed places
            cuts = [i for i, x, y in zip(range(1, n), raw[2::3], raw[3::3]) if not joins[x << 8 | y]]
        else:
            ends = [c.encode("utf-8", "replace") for c in piece]
            cuts = [i for i in range(1, n) if not joins[ends[i - 1][-1] << 8 | ends[i][0]]]
        if len(cuts) == n - 1:
            return list(piece)
        return [piece[a:b] for a, b in zip([0, *cuts], [*cuts, n])]

    def encode_stretch(self, part: str) -> list[int]:
        raw = part.encode("utf-8", "replace").decode("latin-1")
        last, size = [0] * (len(raw) + 1), [0] * (len(raw) + 1)
        pairs, width, done = self.pairs, self.size, -1
        for end, (token, length) in self.automaton.iter(raw):  # at each end the longest entry first
            if end == done:
                continue
            start = end + 1 - length
            if start:
                pair = last[start] * width + token
                ok = pairs.get(pair)
                if ok is None:
                    ok = pairs[pair] = self.compatible(last[start], token)
                if not ok:
                    continue
            last[end + 1], size[end + 1], done = token, length, end
        out, at = [], len(raw)
        while at:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def encode_piece(self, piece: str) -> list[int]:
        if piece.isascii():
            return self.encode_stretch(piece)
        return list(chain.from_iterable(map(self.parts.__getitem__, self.stretches(piece))))

    def encode_pieces(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def encode(self, text: str) -> list[int]:
        for memory in (self.parts, self.pieces, self.words, self.pairs):
            if len(memory) > REMEMBERED:
                memory.clear()
        if self.blank_runs(text):  # runs of white space: their last blank belongs to the next word
            return self.encode_pieces(text)
        first, *rest = text.split(" ")
        ids = self.encode_pieces(first)
        ids.extend(chain.from_iterable(map(self.words.__getitem__, rest)))
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per vocabulary file and Python worker."""
    return Encoder(path)


def encode_column(text: Column, path: str | None = None) -> Column:
    """The ids of a text column as array<int>."""
    path = path or vocabulary_path()

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for texts in batches:
            yield texts.map(lambda t: None if t is None else e.encode(t))

    return ids(text)


def count_column(text: Column, path: str | None = None) -> Column:
    """The number of tokens of a text column; null for a null text."""
    path = path or vocabulary_path()

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for texts in batches:
            yield texts.map(lambda t: None if t is None else len(e.encode(t))).astype("Int64")

    return count(text)
