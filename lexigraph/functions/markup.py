"""Wiki markup and HTML read in one pass with a stack, and their vectorised column functions."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Templates that stand for their first argument.
FIRST_ARGUMENT = ("ety", "etyk", "etyf", "etyq", "fgu", "fgm", "fmk", "fm", "fmo", "fmok", "eq", "eqk", "eqo", "eqok", "nn", "nnk", "nno", "nnok", "at", "atk", "at2", "specialattack", "ato", "atok", "dub", "ruby", "nihongo")
#: Templates that leave nothing.
NOTHING = ("ref", "rfc", "rf", "cite", "citeweb", "citep", "dd", "dd2", "noun", "noun2", "disc", "kanji", "reflist", "note", "notes", "j", "j2", "s2ep", "br", "xab", "adj", "verb", "adv", "prep", "pron", "num", "suf", "pref", "comb", "conj", "interj", "s", "efn", "notelist")
#: Templates that name a language, or stand for their argument if they have one.
LANGUAGES = {
    "jp": "Japanese", "japanese": "Japanese", "ja": "Japanese", "jpn": "Japanese", "eng": "English", "english": "English", "en": "English", "chi": "Chinese",
    "zho": "Chinese", "zh": "Chinese", "kor": "Korean", "korean": "Korean", "heb": "Hebrew", "gre": "Greek", "hel": "Greek", "lat": "Latin", "fra": "French",
    "deu": "German", "ger": "German", "san": "Sanskrit", "ita": "Italian", "esp": "Spanish", "spa": "Spanish", "ga": "Irish/Gaelic", "egy": "Egyptian",
    "per": "Persian", "nrs": "Old Norse", "ara": "Arabic", "fin": "Finnish", "rus": "Russian", "por": "Portuguese", "nld": "Dutch", "swe": "Swedish",
    "dan": "Danish", "nor": "Norwegian", "tur": "Turkish", "hin": "Hindi", "tha": "Thai", "ukr": "Ukrainian", "pol": "Polish", "hun": "Hungarian",
    "ass": "Assyrian", "etr": "Etruscan", "may": "Malay", "cze": "Czech", "rom": "Romanian", "isl": "Icelandic",
}
#: Language codes of other-language fields.
FIELD_LANGUAGES = {"chi": "zh_tw", "zho": "zh_cn", "kor": "ko"}

_PIECES = re.compile(r"\{\{|\}\}|\[\[|\]\]|\||<ref[^>]*?/>|<ref\b.*?</ref>|<br\s*/?>|</?[A-Za-z][^<>]*>|<!--.*?-->|'{2,5}", re.DOTALL | re.IGNORECASE)


def _template(name: str, args: list[str]) -> str | None:
    """What a template leaves, or None for an unknown one."""
    name = name.strip().lower()
    first = args[0] if args else ""
    if name in LANGUAGES:
        return first or LANGUAGES[name]
    if name in FIRST_ARGUMENT:
        return first
    if name == "w":
        return args[1] if len(args) > 1 else first
    return "" if name in NOTHING else None


def clean(text: str | None) -> tuple[str, bool]:
    """The readable text and whether unknown or unbalanced markup is left in it."""
    if not text:
        return "", False
    unresolved = False
    # each open bracket has its kind and its parts so far; the lowest level is the text itself
    stack: list[tuple[str, list[list[str]], list[str]]] = [("", [[]], [])]

    def put(s: str, raw: str) -> None:
        stack[-1][1][-1].append(s)
        stack[-1][2].append(raw)

    at = 0
    for m in _PIECES.finditer(text):
        put(text[at : m.start()], text[at : m.start()])
        at, piece = m.end(), m.group()
        low = piece.lower()
        if piece in ("{{", "[["):
            stack.append((piece, [[]], [piece]))
        elif piece == "|":
            if len(stack) > 1:
                stack[-1][1].append([])
                stack[-1][2].append(piece)
            else:
                put(piece, piece)
        elif piece in ("}}", "]]"):
            if len(stack) > 1 and stack[-1][0] == ("{{" if piece == "}}" else "[["):
                kind, parts, raw = stack.pop()
                words = ["".join(p).strip() if kind == "{{" else "".join(p) for p in parts]
                source = "".join(raw) + piece
                if kind == "{{":
                    left = _template(words[0], words[1:])
                    if left is None:
                        unresolved, left = True, source
                else:
                    left = "" if words[0].lower().startswith(("file:", "image:", "category:")) else (words[-1] or words[0])
                put(left, source)
            else:
                put(piece, piece)
        elif low.startswith("<br"):
            put(" ", piece)
        else:  # comments, notes, other tags and quotes of emphasis leave nothing
            put("", piece)
    put(text[at:], text[at:])
    while len(stack) > 1:  # brackets that were never closed stand as they are
        _, _, raw = stack.pop()
        unresolved = True
        put("".join(raw), "".join(raw))
    return re.sub(r"[ \t]+", " ", "".join(stack[0][1][0])).strip(), unresolved


def strip_residual(text: str) -> str:
    """The text without any balanced template or link, blanks collapsed."""
    last = None
    while text != last:
        last, text = text, re.sub(r"\{\{[^{}]*\}\}|\[\[[^\[\]]*\]\]", "", text)
    return re.sub(r"\s+", " ", text).strip()


def template_parameters(text: str, name: str) -> dict[str, str] | None:
    """The named parameters of the first template of a name; of repeated names the last. None if it is missing or open."""
    start = re.search(r"\{\{\s*" + re.escape(name) + r"\s*(?=[|}\n])", text, re.IGNORECASE)
    if not start:
        return None
    depth, at, cuts = 1, start.end(), []
    for m in re.compile(r"\{\{|\}\}|\[\[|\]\]|\|").finditer(text, start.end()):
        piece = m.group()
        depth += piece in ("{{", "[[")
        depth -= piece in ("}}", "]]")
        if depth == 0:
            cuts.append(text[at : m.start()])
            return {k.strip(): v.strip() for k, eq, v in (c.partition("=") for c in cuts) if eq}
        if piece == "|" and depth == 1:
            cuts.append(text[at : m.start()])
            at = m.end()
    return None


def other_languages(field: str) -> dict[str, str]:
    """Language code -> name of an other-languages field such as '{{CHI}} 名; {{KOR}} 이름'."""
    out: dict[str, str] = {}
    for code, name in re.findall(r"\{\{\s*(\w+)\s*\}\}\s*:?\s*([^{};\n]*)", field or ""):
        if name.strip():
            out.setdefault(FIELD_LANGUAGES.get(code.lower(), code.lower()), name.strip())
    return out


def section_bullets(text: str, heading: str) -> list[str]:
    """The bullet lines under a heading, up to the next heading."""
    out, inside = [], False
    for line in (text or "").splitlines():
        title = re.match(r"\s*=+\s*(.*?)\s*=+\s*$", line)
        if title:
            inside = title.group(1).strip().lower() == heading.lower()
        elif inside and line.lstrip().startswith("*"):
            out.append(line.lstrip().lstrip("*").strip())
    return out


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.links, self.rows, self.text = "", [], [], []
        self.cell, self.inside = None, []

    def handle_starttag(self, tag, attrs):
        self.inside.append(tag)
        href = dict(attrs).get("href")
        if tag == "a" and href:
            self.links.append(href)
        if tag == "tr":
            self.rows.append([])
        if tag in ("td", "th") and self.rows:
            self.rows[-1].append("")
            self.cell = True

    def handle_endtag(self, tag):
        if tag in self.inside:
            while self.inside.pop() != tag:
                pass
        if tag in ("td", "th"):
            self.cell = None

    def handle_data(self, data):
        if "title" in self.inside:
            self.title += data
        elif not {"script", "style"} & set(self.inside):
            self.text.append(data)
            if self.cell and self.rows and self.rows[-1]:
                self.rows[-1][-1] += data


def read_html(html: str | None) -> dict:
    """title, links, rows (cells of every table row) and text of a page."""
    p = _Page()
    p.feed(html or "")
    p.close()
    rows = [[c.strip() for c in r] for r in p.rows if r]
    return {"title": p.title.strip(), "links": p.links, "rows": rows, "text": re.sub(r"\s+", " ", " ".join(p.text)).strip()}


def clean_markup(c: Column) -> Column:
    """struct(text, unresolved) of wiki markup."""

    @F.pandas_udf("text string, unresolved boolean")
    def cleaned(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clean(t) for t in texts], columns=["text", "unresolved"])

    return cleaned(c)


def parse_html(c: Column) -> Column:
    """struct(title, links, rows, text) of an HTML page."""

    @F.pandas_udf("title string, links array<string>, rows array<array<string>>, text string")
    def read(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_html(p) for p in pages], columns=["title", "links", "rows", "text"])

    return read(c)


def parse_infobox(c: Column, name: str) -> Column:
    """map<string,string> of a template's named parameters; null if it is missing."""

    @F.pandas_udf("map<string,string>")
    def params(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else template_parameters(t, name) for t in texts])

    return params(c)


def image_size(c: Column) -> Column:
    """struct(width, height) from the first bytes of a PNG, GIF, JPEG or WebP; nulls if they cannot be read."""

    @F.pandas_udf("width int, height int")
    def size(blobs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sniff_size(b) for b in blobs], columns=["width", "height"]).astype("Int32")

    return size(c)


def sniff_size(b: bytes | None) -> tuple[int | None, int | None]:
    """Width and height of an image by its header."""
    none = (None, None)
    if not b or len(b) < 10:
        return none
    be, le = (lambda x: int.from_bytes(x, "big")), (lambda x: int.from_bytes(x, "little"))
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        return (be(b[16:20]), be(b[20:24])) if len(b) >= 24 else none
    if b[:6] in (b"GIF87a", b"GIF89a"):
        return le(b[6:8]), le(b[8:10])
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP" and len(b) >= 30:
        kind = b[12:16]
        if kind == b"VP8X":
            return le(b[24:27]) + 1, le(b[27:30]) + 1
        if kind == b"VP8 ":
            return le(b[26:28]) & 0x3FFF, le(b[28:30]) & 0x3FFF
        if kind == b"VP8L":
            bits = le(b[21:25])
            return (bits & 0x3FFF) + 1, ((bits >> 14) & 0x3FFF) + 1
    if b[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(b) and b[at] == 0xFF:
            mark, length = b[at + 1], be(b[at + 2 : at + 4])
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                return be(b[at + 7 : at + 9]), be(b[at + 5 : at + 7])
            at += 2 + length
    return none
