"""Template residue, filler and error-page text.

1. Texts are cut into messages (lines and sentences). A message is masked: numbers, hex ids, addresses and capitalised words
   inside a sentence become classes.
2. Mining. A prefix tree of fixed depth routes every message by its number of tokens and its first tokens to a leaf. In
   a leaf a token stays if another document has it at the same place; the others become wildcards. What is left is the template.
3. Verdict, once per template, by structure and spread. Words of a small lexicon say what a word stands for in the language
   of systems: a THING (page, server, script), a FAULT (denied, not found), a REMEDY (reload, enable) or FILLER (sample,
   dummy). A template is a system's message if such words of two kinds make up most of its words; one that stands in several
   documents needs a smaller share than one that was seen once, and wildcards count against it. A template whose words are
   filler, or one unit again and again, is filler. Machine traces (stack frames, error objects) are read by a grammar. No
   whole message is listed. Verdicts are handed to all messages of the template and to their documents.
4. Unresolved slots are found apart from the templates inside ordinary messages, by a grammar of brackets and signs without
   limits of length, unless the message speaks of the notation.

A message without lexicon words of two kinds, or of filler, or a repetition, or a trace can be in no guilty template, as a
template has no more such words than its messages; such messages are left out before the tree.

Defined cases: null and blank texts hold no residue; texts of any length are read whole; copies of a text are judged
alike; the result does not depend on the order of messages; empty input gives no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraph.session import cut, sized_join

#: The lexicon, by kind and language.
LEXICON = {
    "thing": {
        "en": "javascript js script scripts scripting noscript cookie cookies browser client viewer device server servers host upstream gateway proxy backend page pages screen site website url link address "
        "request requests session database connection service http https status code access permission permissions traffic human robot captcha",
        "fr": "navigateur serveur page requête compte accès lien", "de": "seite browser server anfrage zugriff konto verbindung", "es": "navegador servidor página solicitud acceso cuenta conexión",
        "zh": "脚本 浏览器 客户端 页面 网页 条目 界面 地址 服务器 数据库 本站 网站 系统 请求 访问 登录 会话 权限 链接 本页 代码 管理员 网关 主机",
        "ja": "スクリプト ブラウザ クライアント クッキー ページ サーバー サーバ アクセス ログイン 権限 項目 画面 サイト 接続 データベース セッション",
    },
    "fault": {
        "en": "error errors exception fault fatal failed failure denied forbidden blocked expired disabled unavailable unsupported unauthorized unauthorised invalid timeout time-out timed missing found cannot can't couldn't "
        "doesn't wrong broke broken maintenance undefined moved gone nowhere internal sorry apologies oops whoops uh-oh refused unknown",
        "fr": "erreur indisponible introuvable refusé interdit désactivé expiré", "de": "fehler gefunden verweigert verboten deaktiviert abgelaufen", "es": "error encontrada denegado prohibido desactivado caducada",
        "zh": "不存在 找不到 无法 错误 失败 被禁用 已禁用 未启用 已被删除 删除 过期 繁忙 频繁 没有 开小差 超时 拒绝 抱歉 维护 异常 不支持 未找到 内部 过多 失效",
        "ja": "エラー 無効 見つかりません 見つかりませんでした 集中 期限 切れ ありません 失敗 できません メンテナンス 発生 いただけません お探し",
    },
    "remedy": {
        "en": "enable enabled enabling activate activated allow allowed turn turned switch switched requires required require reload refresh retry try again wait check checking verify continue redirected redirect please kindly loading looking update upgrade",
        "fr": "veuillez activer activez réessayer recharger actualiser autoriser", "de": "bitte aktivieren aktualisieren laden erneut versuchen erlauben", "es": "active activar habilite habilitar intente recargue permita favor",
        "zh": "启用 开启 打开 允许 刷新 重试 稍后 稍候 请 检查 返回 验证 重新 联系 再试 需要",
        "ja": "有効 許可 再度 お試し もう一度 しばらく お待ち 確認 必要 ください オン し直 お待ちください",
    },
    "helper": {
        "en": "need needs app dex entry profile account content login log sign contact search return back soon view run work works working properly using use looking find shown show display later minutes seconds moment complete completing "
        "action sent slow temporarily active supported answer connect could did not without down off many bad lost limit",
        "fr": "disponible sie", "de": "sie verfügbar nicht", "es": "disponible nuevo", "zh": "首页 继续 分钟后 显示 查看 完成 内容 正在 稍等 功能", "ja": "表示 設定 利用 少し 数分 中 ブラウザー",
    },
    "filler": {
        "en": "placeholder sample dummy headline lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore magna aliqua nulla nunc justo massa porta odio pede risus quam felis velit vitae augue arcu urna "
        "orci lacus donec fusce vestibulum mauris pellentesque asdf asdfgh jkl qwerty blah tbd tba",
        "zh": "占位 占位文字 占位文本 测试 排版 预览 示例 样例 此段落 仅用于 无实际内容 待补充 待填写", "ja": "ダミー サンプル テスト 仮の文章",
    },
    "around filler": {
        "en": "text texts paragraph section title story name copy here replace release body goes come your block passage test column show look under construction content",
        "zh": "文字 文本 内容 段落 标题 此处 这里 替换 请", "ja": "文章 テキスト 文字 大きさ 行間 入ります 入れて います 量 確認する ために タイトル",
    },
}
KINDS = {"thing": "t", "fault": "f", "remedy": "r", "helper": "h", "filler": "d", "around filler": "a"}
#: Words before "not" that make it a fault.
NEGATED = ("could", "did", "can", "does", "was")
#: Words that say nothing about the kind of a message.
FUNCTION_WORDS = frozenset(
    "a an the this that these those of to in at by for from with and or but if is are was were be been being has have had do does did will would it its you your we our us i my he she they their there as so too very "
    "something nothing happens side before best me may must can oh no few on up out le la les de du des un une et pour der die das ein eine und zu el los las una y para 您 您的 或 后 の が を に は で と".split()
)
#: Share of a template's words that must be a system's: seen in several documents, seen in one, and with words of one kind.
LEAST_SHARE, LEAST_SHARE_ONCE, LEAST_SHARE_ALONE = 0.5, 0.6, 0.8
#: Share of filler words.
LEAST_FILLER = 0.6
#: Tokens of the path in the prefix tree.
DEPTH = 3

#: The grammar of slots. Brackets and signs of common template languages, then instructions in brackets.
SLOTS = re.compile(
    r"\{\{\{?[^{}\n]*\}?\}\}|\{%[^%\n]*%\}|<%[^%\n]*%>|[$#]\{[^{}\n]*\}|%\(\w+\)[sd]|(?<![\w%])%s|%s(?![A-Za-z])|\[\[[A-Z][A-Z_ ]+\]\]|@@\w+@@|(?<![A-Za-z0-9_])__[A-Z][A-Z_]+__|"
    r"\$[A-Z][A-Z_]*\$|%%?[A-Z][A-Z_]+%%?|&lt;[A-Za-z_]+&gt;|<<\w+>>|\{\d+\}|\[[A-Z][A-Z_]{3,}\]|\[object [A-Z]\w*\]|<!--[^\n]*?\b(?:missing|here|insert)\b[^\n]*?-->|"
    r"(?<![A-Z])(?:TODO|FIXME|TBD):|[○〇×□]{3,}|[○〇×□]{2,}[（(](?:仮|占位)[）)]|"
    r"[<\[(（【［](?=[^<>\[\]()（）【】［］\n]*(?:\bgoes here\b|\bhere[\])>）]|\bTB[DA][\])>）]|\b(?:insert|fill in)\b|填写|输入|插入|添加|待补充|占位|入力|記入|挿入|入れる|差し替え|準備中|[（(]仮[）)]))[^<>\[\]()（）【】［］\n]*(?:[（(]仮[）)])?[>\])）】］]|"
    r"[\[(<](?:insert|add|enter|your)\s[A-Za-z_ ]*(?:text|name|here|title|value|url)[\])>]|\[(?:insert|add|enter|your)\s[A-Za-z_ ]+\]"
)
#: Signs one of which is in every slot.
SLOT_SIGNS = ("{{", "{%", "<%", "${", "#{", "%(", "%s", "%%", "[[", "@@", "__", "$", "%", "&lt;", "<<", "{0", "{1", "{2", "{3", "{4", "{5", "{6", "{7", "{8", "{9", "[", "<!--", "todo:", "fixme:", "tbd:", "○○", "〇〇", "××", "□□", "goes here", "here>", "here)", "(insert", "(your ", "(add ", "(enter ", "<insert", "<your ", "（", "【", "［", "fill in")
#: Words of a message that speaks of the notation.
ABOUT_SLOTS = re.compile(r"(?i)`[^`\n]*`|\b(?:guide|manual|syntax|notation|formula|placeholder syntax|is written|write it|mark such as)\b|写法|标出|指南|書き方|手引き|という記法")
#: The grammar of machine traces, on masked messages in lower case.
TRACES = re.compile(
    r"^\W*traceback\b|^\W*at [\w.$]+\([\w.]+:\s*<num>\)|\bfile \"[^\"]*\", line <num>|(?:^|[\s|:–-])(?:[a-z_]\w*\.)*[a-z]\w*(?:exception|error)(?::|$)(?=\s*(?:['\"(]|$|\w+ ))(?<!an error:)|"
    r"[{\[]\s*\"?(?:error|errors|exception)\"?\s*:|<error\b[^>]*>|<code>\w+</code>|\bin /\S.* on line <num>|segmentation fault|^\W*(?:fatal|parse|syntax) error\b|\buncaught \w*error"
)

#: Signs one of which is in every trace.
TRACE_SIGNS = ("exception:", "exception\n", "error:", "error\n", "exception\"", "error\"", "error'", "traceback", "<error", "<code>", "file \"", "\tat ", "  at ", " on line ", "segmentation fault", "parse error", "fatal error", "syntax error", "uncaught ", "exception", "{error", "[error", "(most recent")

_BORDER = re.compile(r"[\r\n]+|(?<=[.!?…])\s+|(?<=[。！？])")
_LABEL = re.compile(r"^((?:[^\s:：|–—]+\s){0,2}[^\s:：|–—]+)(?:[:：]|\s[|–—·])\s*(?=\S)")
_INVISIBLE = re.compile("[​-‏⁠﻿­]")
_MASKS = (
    (re.compile(r"https?://\S+"), "<url>"),
    (re.compile(r"\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{6,}\b"), "<hex>"),
    (re.compile(r"(?<![\w.])[45]\d\d(?![\w.])"), "<status>"),
    (re.compile(r"\d+"), "<num>"),
)
_TOKEN = re.compile(r"<[a-z*]+>|[a-zà-ÿ']+(?:-[a-zà-ÿ]+)*|[぀-ヿ㐀-鿿々ー]+|[^\s\w]|\w")
_CJK = re.compile(r"[぀-ヿ㐀-鿿々]")
_KANA_ONLY = re.compile(r"[぀-ゟー]+")
_WORDLIKE = re.compile(r"[a-zà-ÿ]")


@lru_cache(maxsize=1)
def _lexicon() -> tuple[dict[str, str], dict[str, str]]:
    """Spaced words -> signs of their kinds, and words of ideographs and kana -> the same."""
    spaced: dict[str, str] = {}
    joined: dict[str, str] = {}
    for kind, languages in LEXICON.items():
        for language, told in languages.items():
            for w in told.split():
                which = joined if language in ("zh", "ja") else spaced
                which[w] = which.get(w, "") + KINDS[kind]
    return spaced, joined


@lru_cache(maxsize=1)
def _automaton():
    """All words and signs in one automaton: what they stand for, and their length."""
    import ahocorasick

    a = ahocorasick.Automaton()
    spaced, joined = _lexicon()
    for w, kinds in spaced.items():
        a.add_word(w, (len(w), kinds, True))
    for w, kinds in joined.items():
        a.add_word(w, (len(w), kinds, False))
    for w in NEGATED:
        a.add_word(f"{w} not", (len(w) + 4, "f", True))
    for sign in SLOT_SIGNS:
        a.add_word(sign, (len(sign), "S", False))
    for sign in TRACE_SIGNS:
        a.add_word(sign, (len(sign), "X", False))
    a.make_automaton()
    return a


def _lower(text: str) -> str:
    """Lower case, sign by sign, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def masked(message: str) -> str:
    """A message with its variable parts masked, in lower case, with single blanks."""
    message = _INVISIBLE.sub("", message)
    # a capitalised word inside a sentence is a name, if the sentence is not in capitals throughout
    if not message.isupper():
        message = re.sub(r"(?<=[a-z,;] )[A-Z][a-z]+(?:[A-Z][a-z]+)*(?=[\s,;.!?]|$)", lambda m: m.group() if m.group().lower() in _lexicon()[0] else "<name>", message)
    message = message.lower().replace("’", "'")
    for pattern, to in _MASKS:
        message = pattern.sub(to, message)
    message = " ".join(message.split())
    # a label of a few words before a colon or bar that says nothing of a system is the name of the site
    m = _LABEL.match(message)
    if m and not any(t == "<status>" or t in _lexicon()[0] or t in _lexicon()[1] for t in tokens_of(m.group(1))):
        message = message[m.end() :]
    return message


def tokens_of(message: str) -> list[str]:
    """Tokens of a masked message: words, signs, and runs of ideographs and kana cut where a word of the lexicon begins or ends."""
    out = []
    for t in _TOKEN.findall(message):
        if _CJK.match(t):
            out += _cut(t)
        else:
            out.append(t)
    return out


@lru_cache(maxsize=1)
def _joined_pattern():
    return re.compile("|".join(sorted(map(re.escape, _lexicon()[1]), key=len, reverse=True)))


def _cut(run: str) -> list[str]:
    out, at = [], 0
    for m in _joined_pattern().finditer(run):
        out += [run[at : m.start()]] if m.start() > at else []
        out.append(m.group())
        at = m.end()
    return out + ([run[at:]] if at < len(run) else [])


def shares(tokens: list[str]) -> tuple[set[str], int, float, float]:
    """(kinds of system words, their number, their share, share of filler) of a template's words; ideographs weigh by sign.

    Without a word of filler proper, words that often stand around it are filler only if nothing else is said or one again and again.
    """
    spaced, joined = _lexicon()
    total = system = filler = 0.0
    kinds, number, proper, around = set(), 0, False, []
    for before, t in zip(["", *tokens], tokens):
        if t == "<status>":
            got, weight = "s", 1.0
        elif t in ("<*>", "<name>"):
            got, weight = "", 1.0
        elif _CJK.match(t):
            got, weight = joined.get(t, ""), len(t) / 2
            if not got and (_KANA_ONLY.fullmatch(t) or t in FUNCTION_WORDS):
                continue  # endings and particles
        elif _WORDLIKE.match(t):
            got, weight = spaced.get(t, ""), 1.0
            if not got and t in FUNCTION_WORDS:
                continue
        else:
            continue
        total += weight
        if "d" in got or "a" in got:
            filler += weight
            proper |= "d" in got
            around.append(t)
        here = set(got) & set("tfrs")
        if t == "not" and before in NEGATED:
            here.add("f")
        if here:
            kinds |= here
        if here or "h" in got:
            system += weight
            number += 1
    # words around filler, and nothing but these, are filler as well
    proper |= len(around) > 2 and (len(set(around)) == 1 or filler == total)
    return kinds, number, system / total if total else 0.0, filler / total if total and proper else 0.0


def guilty(template: str, spread: int) -> bool:
    """The verdict on a template (tokens with blanks between) that stands in ``spread`` documents."""
    tokens = template.split(" ")
    kinds, number, system, filler = shares(tokens)
    if filler >= LEAST_FILLER and len(tokens) > 2:
        return True
    least = (LEAST_SHARE if spread > 1 else LEAST_SHARE_ONCE) if len(kinds) > 1 else LEAST_SHARE_ALONE
    if {"“", "”", '"', "「", "」", "`"} & set(tokens):  # a message that is told of
        least = max(least, LEAST_SHARE_ALONE)
    alone = bool(kinds - {"t"}) and (spread > 1 or system == 1)
    return number > 1 and system >= least and (len(kinds) > 1 or alone)


def has_slot(message: str) -> bool:
    """An unresolved slot in a message that does not speak of the notation."""
    return bool(SLOTS.search(message)) and not ABOUT_SLOTS.search(message)


def read_text(text: str | None) -> tuple[bool, list[str]]:
    """(whether a slot or a trace stands in the text, the masked messages that may be in a guilty template)."""
    if not text or not text.strip():
        return False, []
    low = _lower(_INVISIBLE.sub(" ", text))
    if len(low) != len(text):
        low = _lower(text)
    borders = [0, *(m.end() for m in _BORDER.finditer(text)), len(text)]
    found: dict[int, set[str]] = {}
    b, n = 0, len(borders) - 1
    for end, (size, kinds, word) in _automaton().iter(low):
        start = end - size + 1
        if word and ((start and low[start - 1].isascii() and low[start - 1].isalnum()) or (end + 1 < len(low) and low[end + 1].isascii() and low[end + 1].isalnum())):
            continue
        while b + 1 < n and borders[b + 1] <= end:
            b += 1
        found.setdefault(b, set()).update(kinds)
    messages, spoiled = set(), False
    for b, kinds in found.items():
        raw = text[borders[b] : borders[b + 1]].strip()
        spoiled = spoiled or ("S" in kinds and has_slot(raw))
        system = kinds & set("tfr")
        if system & set("fr") or kinds & set("daX") or (system and re.search(r"(?<!\d)[45]\d\d(?!\d)", raw)):
            m = masked(raw)
            if "X" in kinds and TRACES.search(m):
                spoiled = True
            elif may_be_guilty(m):
                messages.add(m)
    return spoiled, sorted(messages)


def may_be_guilty(message: str) -> bool:
    """Whether a template of the message can be guilty: no template has more words of the lexicon than its messages."""
    kinds, number, system, filler = shares(tokens_of(message))
    return filler >= LEAST_FILLER or (number > 1 and system >= LEAST_SHARE and bool(kinds - {"t"}))


def read_column(text: Column) -> Column:
    """``read_text`` as struct<spoiled, messages>."""

    @F.pandas_udf("spoiled boolean, messages array<string>")
    def read(texts: pd.Series) -> pd.DataFrame:
        got = [read_text(t) for t in texts]
        return pd.DataFrame({"spoiled": [s for s, _ in got], "messages": [m for _, m in got]})

    return read(text)


def templates(messages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(message, template): the prefix tree over distinct masked messages (message, n documents).

    The leaf of a message is its number of tokens and its first ``depth`` tokens. A token stays in the template if it
    stands at its place in another document, is alone in its leaf or in the lexicon, or is a sign or a mask. The tokens of a leaf are counted by place,
    combined in every task before the shuffle, so that no task holds a leaf and no two messages are compared.
    """

    @F.pandas_udf("array<struct<token:string, known:boolean>>")
    def cut_up(told: pd.Series) -> pd.Series:
        spaced, joined = _lexicon()
        return told.map(lambda m: [{"token": t, "known": t in spaced or t in joined or not (_WORDLIKE.match(t) or _CJK.match(t))} for t in tokens_of(m)])

    t = cut(messages.select("message", "n", cut_up("message").alias("tokens")))
    leaf = F.concat_ws(" ", F.size("tokens").cast("string"), F.slice("tokens.token", 1, depth)).alias("leaf")
    places = t.select("message", "n", leaf, F.posexplode("tokens").alias("place", "t")).select("message", "n", "leaf", "place", "t.token", "t.known")
    often = places.where("not known").groupBy("leaf", "place", "token").agg(F.sum("n").alias("docs"))
    members = t.groupBy(leaf).agg(F.count(F.lit(1)).alias("members"))
    held = often.join(members, "leaf").where("docs > 1 or members = 1").select("leaf", "place", "token", F.lit(True).alias("held"))
    told = places.join(held, ["leaf", "place", "token"], "left")
    word = F.when(F.col("known") | F.col("held"), F.col("token")).otherwise("<*>")
    row = F.array_sort(F.collect_list(F.struct("place", word.alias("token"))))  # the tokens of one message
    return told.groupBy("message").agg(F.array_join(F.transform(row, lambda x: x["token"]), " ").alias("template"))


def residue(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id): documents any part of which is residue, each once."""
    told = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    read = cut(told.select("doc_id", read_column(F.col("text")).alias("r")).select("doc_id", "r.spoiled", "r.messages").where("spoiled or size(messages) > 0"))
    parts = read.select("doc_id", F.explode("messages").alias("message"))
    spread = parts.groupBy("message").agg(F.countDistinct("doc_id").alias("n"))
    spread = cut(spread)
    mined = cut(templates(spread).join(spread, "message"))

    @F.pandas_udf("boolean")
    def verdict(template: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([guilty(t, int(k)) for t, k in zip(template, n)])

    judged = mined.groupBy("template").agg(F.sum("n").alias("n")).where(verdict("template", "n")).select("template")
    bad = sized_join(mined, cut(judged), "template", "left_semi").select("message")
    return read.where("spoiled").select("doc_id").unionByName(sized_join(parts, cut(bad), "message", "left_semi").select("doc_id")).distinct()
