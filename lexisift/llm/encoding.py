"""Text decoded with the wrong character encoding: finding it and restoring it.

The garbled forms of letters under every pair of (true, wrong) encodings are computed once per worker and matched with an
Aho-Corasick automaton. The matched spans are the candidates: a word without one is never looked at, whatever its letters. A
pair of encodings is told by a whole word, so a span is widened to its word, and decoded back under the pairs; that is taken only
where the word can't be text of one language and the result can (``cost``), as many garbled forms occur in sound text too. All
else stays as it is. U+FFFD and C1 control characters mark text that is garbled but may be lost.

Nulls, empty and blank texts give no spans; texts are read whole; the restored text of a clean text is the text itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters beyond ASCII of each language (fixed values).
ALPHABETS = {
    "de": "äöüß", "fr": "àâæçéèêëîïôœùûüÿ", "es": "áéíñóúü", "pt": "áâãàçéêíóôõúü", "it": "àèéìíîòóùú", "ca": "àçèéíïòóúü",
    "cs": "áčďéěíňóřšťúůýž", "sk": "áäčďéíĺľňóôŕšťúýž", "pl": "ąćęłńóśźż", "hu": "áéíóöőúüű", "ro": "ăâîșşțţ", "tr": "âçğıîöşüİ",
    "da": "æøåéü", "sv": "åäöéü", "is": "áðéíóúýþæö", "nl": "éëïóöüáèê", "hr": "čćđšž", "lt": "ąčęėįšųūž", "lv": "āčēģīķļņšūž", "et": "äõöüšž", "eo": "ĉĝĥĵŝŭ",
}
CYRILLIC = {"ru": "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "uk": "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя", "sr": "абвгдђежзијклљмнњопрстћуфхцчџш", "be": "абвгдеёжзійклмнопрстуўфхцчшыьэюя", "mk": "абвгдѓежзѕијклљмнњопрстќуфхцчџш"}
_LATIN = [frozenset(a + a.upper().replace("SS", "")) for a in ALPHABETS.values()]
_CYR = [frozenset(a + a.upper()) for a in CYRILLIC.values()]
#: Shares of the letters in Russian text, in permille (fixed values), for text all in one case.
_RU = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (110, 85, 80, 74, 67, 63, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 16, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 3, 1, 1)))
#: Punctuation that stands next to letters in proper text.
_FINE = frozenset("’‘“”„‚«»‹›–—…¿¡ºª°·§©®™€   ​‌‍﻿、。「」『』（）・：；，！？《》【】〜～")
#: Fine ones that are seldom side by side with other signs.
_ODD = frozenset("ºª°§©®™€¡¿…‚„‹›–—“”")
WRONG = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8-r", "iso8859-2", "cp1254")
TRUE = ("utf-8", "cp1251", "koi8-r", "cp1250", "iso8859-2", "gbk", "euc_jp", "shift_jis", "big5", "euc_kr", "cp1252", "mac_roman", "cp850", "cp437", "cp866", "iso8859-5")
WIDE_WRONG = ("gbk", "shift_jis", "big5", "euc_kr")


@lru_cache(None)
def _table(codec: str) -> dict[str, int]:
    """Character -> byte; bytes that the codec leaves undefined stand for themselves, as decoders commonly do."""
    out = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


def _bytes(s: str, codec: str) -> bytes | None:
    t = _table(codec)
    try:
        return bytes([t[c] for c in s])
    except KeyError:
        return None


@lru_cache(100_000)
def _kind(c: str) -> str:
    """a ASCII letter, l Latin, y Cyrillic, g Greek, w wide, c control, s symbol, f fine, . other."""
    o = ord(c)
    if o < 128:
        return "a" if c.isalpha() else "."
    if 0x80 <= o < 0xA0:
        return "c"
    cat = unicodedata.category(c)
    if c in _FINE:
        return "f"
    if cat[0] == "L" and c not in "ªº":
        if o < 0x250 and o != 0x192:
            return "l"
        if 0x400 <= o < 0x530:
            return "y"
        if 0x370 <= o < 0x400:
            return "g"
        if 0x3040 <= o < 0xA000 or 0xAC00 <= o < 0xD7B0 or 0xFF66 <= o < 0xFFA0:
            return "w"
        return "s" if o == 0x192 else "o"
    return "s" if cat[0] in "SNCP" else "."


def cost(text: str) -> int:
    """How much speaks against text (a word or a line) being proper; 0 is clean."""
    total = 0
    kinds = [_kind(c) for c in text]
    n = len(text)
    for i, k in enumerate(kinds):
        if k in "a.":
            continue
        c = text[i]
        left = kinds[i - 1] if i else "."
        right = kinds[i + 1] if i + 1 < n else "."
        if k == "c":
            total += 2
        elif k == "s":
            odd = (left == "f" and text[i - 1] in _ODD) or (right == "f" and text[i + 1] in _ODD)
            if left in "alygsc" or right in "alygsc" or odd:
                total += 1 + (left in "alyg" and right in "alyg")
        elif k == "f":
            if c in "‚„¿¡°§©®™€·…‹›" and left in "alyg" and right in "alyg":
                total += 1
            elif c in "‚„‹›“”«»°§©·" and (left in "scl" or right in "scl"):
                total += 1
        elif k == "l":
            up = c.isupper()
            if up and left in "al" and text[i - 1].islower():
                total += 1
            if left in "yg" or right in "yg":
                total += 1
        elif k == "y":
            if c.isupper() and left == "y" and text[i - 1].islower():
                total += 1
            if left in "alg" or right in "alg":
                total += 1
        elif k == "g":
            if (left in "al" and right in "al") or left in "y" or right in "y":
                total += 1
            elif left in "al" and i >= 2 and kinds[i - 2] in "al":
                total += 1
        elif k == "w" and (left in "lyscg" or right in "lyscg"):
            total += 1
    for m in re.finditer(r"[À-ÖØ-öø-ÿ]{3,}", text):
        total += len(m[0]) - 2
    latin = {c for c, k in zip(text, kinds) if k == "l"}
    if latin and not any(latin <= a for a in _LATIN):
        total += 1
    for m in re.finditer(r"[Ѐ-ԯ]+", text):
        w = m[0]
        own = set(w)
        if not any(own <= a for a in _CYR):
            total += 1
        if len(w) >= 3 and w.isupper():
            rare = sum(_RU.get(c, 0) for c in w.lower()) / len(w)
            total += (rare < 22) + (w[0] in "ЪЬ")
    return total


def _candidates(word: str):
    """(rank, pair, text) of each pair of encodings under which the word decodes to proper text, or to less garbled UTF-8."""
    have = cost(word)
    for place, wrong in enumerate(WRONG):
        raw = _bytes(word, wrong)
        if raw is None:
            continue
        for order, true in enumerate(TRUE, 100 * place):
            if true == wrong:
                continue
            try:
                got = raw.decode(true)
            except UnicodeDecodeError:
                continue
            if got == word or (true != "utf-8" and len(got) < 2):
                continue
            c = cost(got)
            if true == "utf-8":
                if c < max(have, 1) or (c <= have + 2 and len(got) < len(word)):
                    yield (0, c, order), (wrong, true), got
            elif true in ("gbk", "euc_jp", "shift_jis", "big5", "euc_kr"):
                if not c and all(_common_wide(x) for x in got if ord(x) > 127):
                    kana = _kana(got)
                    yield (2, _rare(got) if true == "gbk" and not kana else -kana * (true != "gbk"), order), (wrong, true), got
            elif not c and any(_kind(x) in "ly" for x in got):
                known = sum(_RU.get(x, 0) for x in got.lower()) / len(got)
                yield (1, -known, order), (wrong, true), got


def _decoded(word: str, votes: dict) -> str | None:
    """The word decoded back by the pair that most words of its text speak for, or None where no pair gives proper text."""
    best = min(((rank[0] > 0, -votes.get(pair, 0), rank, got) for rank, pair, got in _candidates(word)), default=None)
    return best and best[-1]


def _votes(words: list[str]) -> dict:
    """How much the garbled words of a text speak for each pair: one vote a word, weighed by how natural the result is."""
    votes: dict = {}
    for w in words:
        for rank, pair, got in _candidates(w):
            weight = 1.0 + (min(60.0, -rank[1]) / 100 if rank[0] == 1 else 0.2 * (_kana(got) > 0 and pair[1] != "gbk") if rank[0] == 2 else 0)
            votes[pair] = votes.get(pair, 0) + weight
    return votes


def _kana(s: str) -> int:
    return sum(0x3040 <= ord(c) < 0x3100 for c in s)


@lru_cache(50_000)
def _common_wide(c: str) -> bool:
    o = ord(c)
    if 0x3000 <= o < 0x3100 or 0xAC00 <= o < 0xD7B0 or 0xFF00 <= o < 0xFF61:
        return True
    return 0x4E00 <= o < 0xA000 and (_row(c, "gb2312", 0xB0, 0xD7) or _row(c, "euc_jp", 0xB0, 0xCF))


def _row(c: str, codec: str, low: int, high: int) -> bool:
    try:
        return low <= c.encode(codec)[0] <= high
    except UnicodeEncodeError:
        return False


def _rare(s: str) -> int:
    return sum(not _row(c, "gb2312", 0xB0, 0xD7) for c in s if ord(c) > 0x2FFF)


def _from_wide(run: str) -> str | None:
    """UTF-8 read as a double-byte encoding."""
    for codec in WIDE_WRONG:
        try:
            got = run.encode(codec).decode("utf-8")
        except UnicodeError:
            continue
        if len(got) >= 1 and cost(got) == 0:
            return got
    return None


_WORD = re.compile(r"(?:(?<![A-Za-z0-9'’])[A-Za-z0-9'’]*)?[^\x00-\x7f](?:[^\x00-\x7f]|[A-Za-z0-9'’?](?=[^\x00-\x7f]|[A-Za-z]|$)|[A-Za-z0-9])*")
_WIDE = re.compile(r"[　-ヿ㐀-鿿가-힯豈-﫿＀-￯]{2,}")
_NON_ASCII = re.compile(r"[^\x00-\x7f]")
_LOST = re.compile("�|[\x80-\x84\x86-\x9f]|锟斤拷|ï¿½")


#: What is left of text that can't be restored: the replacement character, and what became of it in turn.
REPLACED = ("\ufffd", "锟斤拷", "ï¿½")


@lru_cache(1)
def automaton():
    """Garbled sequences with their lengths: of one letter in UTF-8, of two neighbouring letters in the single-byte encodings, of
    a letter beside another under the double-byte ones, control characters that no text has, and what replaces lost bytes."""
    import ahocorasick

    a = ahocorasick.Automaton()
    put = lambda g: a.add_word(g, len(g))
    letters = {chr(o) for o in (*range(0xA0, 0x180), 0x192, *range(0x370, 0x3FF), *range(0x400, 0x460), *range(0x2010, 0x2027), *range(0x2030, 0x203B), 0x20AC, 0x2122, 0x2190, 0x2192, *range(0x3001, 0x3100))}
    letters |= {bytes([x, y]).decode("gb2312", "ignore") for x in range(0xB0, 0xD8) for y in range(0xA1, 0xFF)} - {""}
    letters |= {bytes([x, y]).decode("euc_jp", "ignore") for x in range(0xB0, 0xD0) for y in range(0xA1, 0xFF)} - {""}
    back = {w: {b: c for c, b in _table(w).items()} for w in WRONG}
    for c in letters:
        raw = c.encode()
        for wrong in WRONG:
            g = "".join(back[wrong].get(b, "\0") for b in raw)
            if g != c:
                put(g)
    near = "aeionrstlukzdwmcpvyhgb"
    words: set[str] = set()
    for alphabet in ("cs", "pl", "de", "fr", "es", "pt", "hu", "tr", "sv"):
        for c in ALPHABETS[alphabet] + ALPHABETS[alphabet].upper().replace("SS", ""):
            words.update(x for n in near for x in (c + n, n + c))
    words.update(x + y for x in CYRILLIC["ru"] + CYRILLIC["ru"].upper() for y in CYRILLIC["ru"])
    for w in words:
        for true in TRUE[1:]:
            try:
                raw = w.encode(true)
            except UnicodeEncodeError:
                continue
            for wrong in WRONG:
                g = "".join(back[wrong].get(b, "\0") for b in raw)
                if g != w and g not in a and cost(g):
                    put(g)
    # between encodings of one family letters turn into letters of others: what no language has side by side is told by the words
    for true, wrong in SWAPPED:
        for c in _letters_of(true):
            g = _swapped(c, true, wrong)
            if g and g != c and g not in a:
                put(g)
    for o in (*range(0x80, 0x85), *range(0x86, 0xA0)):
        put(chr(o))
    for x in REPLACED:
        put(x)
    a.make_automaton()
    return a


#: Encodings that differ in some letters only, as (true, wrong).
SWAPPED = (("cp1250", "cp1252"), ("iso8859-2", "latin-1"), ("cp1252", "cp1250"), ("latin-1", "iso8859-2"), ("cp1254", "cp1252"), ("cp1252", "cp1254"), ("iso8859-7", "latin-1"), ("latin-1", "iso8859-7"), ("cp1252", "cp1253"), ("cp1252", "cp437"), ("latin-1", "cp437"))


def _letters_of(codec: str) -> set[str]:
    out = set()
    for b in range(0xA0, 0x100):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            continue
        if c.isalpha():
            out.add(c)
    return out


def _swapped(c: str, true: str, wrong: str) -> str | None:
    try:
        g = c.encode(true).decode(wrong)
    except UnicodeError:
        return None
    return g if g.isalpha() and g not in "ßªº" else None


def matched_spans(line: str) -> list[tuple[int, int]]:
    """Where garbled sequences lie, and runs of wide characters (UTF-8 read two bytes at a time), in order, without overlaps."""
    found = [(end + 1 - n, end + 1) for end, n in automaton().iter(line)]
    found += [m.span() for m in _WIDE.finditer(line)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def candidates(line: str) -> list[tuple[int, int]]:
    """The words in which garbled sequences lie: a pair of encodings is told by a whole word. What touches no sequence is none."""
    spans = matched_spans(line)
    if not spans:
        return []
    out, k = [], 0
    for m in _WORD.finditer(line):
        a, b = m.span()
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if k < len(spans) and spans[k][0] < b:
            out.append((a, b))
    return out


def restore(text: str | None) -> tuple[int, int, str | None]:
    """Garbled words, those of them that stay garbled, and the text with the others restored."""
    if not text or text.isascii():
        return 0, 0, text
    found = lost = 0
    hit = [(a, b, words) for a, b in _odd_lines(text) if (words := candidates(text[a:b]))]
    if not hit:
        return 0, 0, text
    votes = _votes([w for w in dict.fromkeys(text[a + x : a + y] for a, _, words in hit for x, y in words) if "\ufffd" not in w and cost(w)])
    out: list[str] = []
    at = 0
    for a, b, words in hit:
        new, n, gone = _line(text[a:b], words, votes)
        if n:
            out += [text[at:a], new]
            at = b
            found += n
            lost += gone
    out.append(text[at:])
    return found, lost, "".join(out)


def _odd_lines(text: str) -> Iterator[tuple[int, int]]:
    """The lines with a character beyond ASCII."""
    m = _NON_ASCII.search(text)
    while m:
        a, b = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.start())
        b = len(text) if b < 0 else b
        yield a, b
        m = _NON_ASCII.search(text, b)


def _word(w: str, votes: dict) -> tuple[str, int, int]:
    """(what to write, garbled, lost) of a candidate: decoded back if it can't be text and the result can."""
    if "\ufffd" in w:
        return w, 1, 1
    if not cost(w):
        got = _from_wide(w) if _WIDE.search(w) else None
        return (w, 0, 0) if got is None else (got, 1, 0)
    now, seen = w, {w}
    while cost(now):  # text can be garbled several times over
        got = _decoded(now, votes)
        if got is None or got in seen:
            break
        seen.add(got)
        now = got
    if now != w and (cost(now) < cost(w) or (len(now) < len(w) and cost(now) <= cost(w))) and _strong(w, now):
        return now, 1, int(cost(now) > 0)
    return (w, 1, 1) if _LOST.search(w) else (w, 0, 0)


def _line(line: str, words: list[tuple[int, int]], votes: dict) -> tuple[str, int, int]:
    """The line with its candidates decoded; all else is left as it is."""
    found = lost = at = 0
    out: list[str] = []
    for a, b in words:
        new, n, gone = _word(line[a:b], votes)
        found += n
        lost += gone
        if new != line[a:b]:
            out += [line[at:a], new]
            at = b
    if found or len(words) < 2 or not cost(line):
        return "".join(out) + line[at:], found, lost
    # candidates that are proper alone but not beside each other
    parts = [line[a:b] for a, b in words]
    latin = {c for w in parts for c in w if _kind(c) == "l"}
    if not any(latin <= x for x in _LATIN) and not any(map(cost, parts)):
        for true, wrong in SWAPPED:
            raw = _bytes(line, wrong)
            try:
                got = raw.decode(true) if raw else line
            except UnicodeDecodeError:
                continue
            if got != line and cost(got) == 0:
                return got, len(words), 0
    return line, 0, 0


def _strong(word: str, got: str) -> bool:
    """One odd sign in a short word isn't enough: m², Δt, 5µs."""
    odd = sum(ord(c) > 127 for c in word)
    return odd >= 2 or sum(c.isalpha() for c in got) >= 3


SPAN = "struct<n_garbled:int,n_lost:int,restored:string>"


def _restore_series(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([restore(t) for t in texts], columns=["n_garbled", "n_lost", "restored"])


def repair(df: DataFrame, text: str = "content", into: str = "repair") -> DataFrame:
    """df with a struct column of counts and the restored text. ASCII texts stay in the JVM."""
    c: Column = F.col(text)
    ascii_only = c.isNull() | ~c.rlike("[^\\x00-\\x7f]")
    marked = df.withColumn(into, F.when(ascii_only, F.struct(F.lit(0).alias("n_garbled"), F.lit(0).alias("n_lost"), c.alias("restored"))))
    return marked.withColumn(into, F.coalesce(F.col(into), F.pandas_udf(_restore_series, SPAN).asNondeterministic()(F.when(~ascii_only, c))))
