"""Tokens of JavaScript, Java and Go."""

from __future__ import annotations

import re

from .base import Token

_ID = r"[^\W\d][\w$]*|\$[\w$]*|#[^\W\d][\w$]*"
_NUM = r"0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.?\d[\d_]*\.?(?:[eE][+-]?[\d_]+)?"
_SUFFIX = {"js": "n?", "java": "[lLfFdD]?", "go": "i?"}
_OPS = {
    "js": r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@]",
    "java": r">>>=|\.\.\.|<<=|>>=|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@]",
    "go": r"<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[{}()\[\];,<>+\-*/%&|^!~:=.]",
}
_RE = {
    k: re.compile(
        rf"(?P<ws>[ \t\f\v\r  ﻿]+)|(?P<nl>\n)|(?P<lc>//[^\n]*)|(?P<bc>/\*)|(?P<id>{_ID})|(?P<num>(?:{_NUM}){_SUFFIX[k]})|(?P<q>\"\"\"|[\"'`])|(?P<op>{ops})"
    )
    for k, ops in _OPS.items()
}
_STRING = {"\"": re.compile(r'(?:[^"\\\n]|\\(?:\r?\n|.))*"'), "'": re.compile(r"(?:[^'\\\n]|\\(?:\r?\n|.))*'")}
_REGEX = re.compile(r"(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_BEFORE_VALUE = frozenset("return typeof case in of delete void throw new instanceof else do yield await".split())
_GO_ENDS = frozenset(("break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"))


def tokens(text: str, lang: str) -> tuple[list[Token], list[tuple[int, str]]]:
    out: list[Token] = []
    errors: list[tuple[int, str]] = []
    rx = _RE[lang]
    at, line, n = 0, 1, len(text)
    fresh = True
    if lang == "js" and text.startswith("#!"):
        at = text.find("\n") if "\n" in text else n
    braces: list[int] = []

    def end_line() -> None:
        """Go: a line that ends in a value ends a statement."""
        if lang == "go" and out:
            p = out[-1]
            if p.kind in ("num", "str", "tmpl") or (p.kind == "id" and (p.value not in GO_KEYWORDS or p.value in _GO_ENDS)) or (p.kind == "op" and p.value in _GO_ENDS):
                out.append(Token("op", ";", line, False))

    while at < n:
        m = rx.match(text, at)
        if not m:
            errors.append((line, f"no token begins with {text[at]!r}"))
            out.append(Token("bad", text[at], line, fresh))
            at += 1
            continue
        kind = m.lastgroup
        at = m.end()
        if kind == "ws" or kind == "lc":
            continue
        if kind == "nl":
            end_line()
            line += 1
            fresh = True
            continue
        if kind == "bc":
            end = text.find("*/", at)
            if end < 0:
                errors.append((line, "comment without end"))
                end = n
            breaks = text.count("\n", at, end)
            if breaks:
                end_line()
                fresh = True
            line += breaks
            at = min(n, end + 2)
            continue
        v = m[0]
        if kind == "q":
            start = line
            if v == '"""' and lang == "java":
                end = at
                while True:
                    end = text.find('"""', end)
                    if end < 0 or text[end - 1] != "\\":
                        break
                    end += 1
                if end < 0:
                    errors.append((line, "text block without end"))
                    end = n
                line += text.count("\n", at, end)
                at = min(n, end + 3)
                out.append(Token("str", "s", start, fresh))
            elif v == "`" and lang in ("js", "go"):
                if lang == "go":
                    end = text.find("`", at)
                    if end < 0:
                        errors.append((line, "string without end"))
                        end = n
                    line += text.count("\n", at, end)
                    at = end + 1
                    out.append(Token("str", "s", start, fresh))
                else:
                    end, inner, ok = _template(text, at)
                    if not ok:
                        errors.append((line, "template without end"))
                    for a, b in inner:
                        sub, more = tokens(text[a:b], "js")
                        base = line + text.count("\n", at, a)
                        errors += [(x + base - 1, y) for x, y in more]
                        INNER.append((sub, base))
                    line += text.count("\n", at, end)
                    at = end
                    out.append(Token("tmpl", "t", start, fresh))
            else:
                if v == '"""':
                    at -= 2
                    v = '"'
                if v == "`":
                    errors.append((line, "stray `"))
                    continue
                s = _STRING[v].match(text, at)
                if not s:
                    errors.append((line, "string without end"))
                    end = text.find("\n", at)
                    at = n if end < 0 else end
                else:
                    body = text[at : s.end() - 1]
                    if v == "'" and lang != "js" and not re.fullmatch(r"[^\\]|\\(?:[abfnrtvs\\'\"0]|[0-7]{1,3}|x[0-9a-fA-F]{2}|u+[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})", body, re.S):
                        if not (lang == "java" and len(body.encode("utf-16-le")) == 2):
                            errors.append((line, "not one character between quotes"))
                    line += s[0].count("\n")
                    at = s.end()
                out.append(Token("str", "s", start, fresh))
            fresh = False
            continue
        if kind == "op" and v == "/" and lang == "js" or kind == "op" and v == "/=" and lang == "js":
            p = out[-1] if out else None
            value_before = p is not None and (p.kind in ("num", "str", "tmpl", "regex") or (p.kind == "id" and p.value not in _BEFORE_VALUE) or (p.kind == "op" and p.value in (")", "]", "}", "++", "--")))
            if p is not None and p.kind == "op" and p.value == "}" and fresh:
                value_before = False
            if p is not None and p.kind == "op" and p.value == ")" and _head_before(out):
                value_before = False
            if not value_before:
                r = _REGEX.match(text, m.start() + 1)
                if r:
                    at = r.end()
                    out.append(Token("regex", "r", line, fresh))
                    fresh = False
                    continue
                errors.append((line, "regular expression without end"))
        if kind == "num" and at < n and (text[at].isalnum() or text[at] == "_"):
            errors.append((line, "name begins with a digit"))
            w = re.compile(r"\w+").match(text, at)
            at = w.end()
        if kind == "num" and v == ".":
            kind = "op"
        out.append(Token(kind, v, line, fresh))
        fresh = False
    end_line()
    out.append(Token("eof", "", line, True))
    return out, errors


#: Tokens of the expressions inside template literals, for the JavaScript parser to take up.
INNER: list[tuple[list[Token], int]] = []
GO_KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())


def _head_before(out: list[Token]) -> bool:
    """Whether the ) before closes the head of an if, while, for or with."""
    level = 0
    for k in range(len(out) - 1, max(-1, len(out) - 200), -1):
        v = out[k].value if out[k].kind == "op" else ""
        if v == ")":
            level += 1
        elif v == "(":
            level -= 1
            if level == 0:
                return k > 0 and out[k - 1].kind == "id" and out[k - 1].value in ("if", "while", "for", "with")
    return False


def _template(text: str, at: int) -> tuple[int, list[tuple[int, int]], bool]:
    """End of a template literal and the places of its expressions."""
    inner = []
    n = len(text)
    while at < n:
        c = text[at]
        if c == "\\":
            at += 2
        elif c == "`":
            return at + 1, inner, True
        elif c == "$" and text[at + 1 : at + 2] == "{":
            start = at = at + 2
            level = 1
            while at < n and level:
                c = text[at]
                if c == "{":
                    level += 1
                elif c == "}":
                    level -= 1
                elif c in "\"'":
                    s = _STRING[c].match(text, at + 1)
                    at = (s.end() if s else at + 1) - 1
                elif c == "`":
                    end, _, ok = _template(text, at + 1)
                    at = end - 1
                at += 1
            inner.append((start, at - 1))
        else:
            at += 1
    return n, inner, False
