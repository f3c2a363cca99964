"""JSON, XML, TOML and YAML: recursive descent over characters or lines."""

from __future__ import annotations

import re

from .base import MAX_DEPTH, Bad

# JSON

_SPACE = re.compile(r"[ \t\r\n]*")
_JSTRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
_JNUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])")
_JWORD = re.compile(r"(?:true|false|null)(?!\w)")


class Json:
    def __init__(self, text: str):
        self.s, self.at = text, 0
        self.line, self.counted = 1, 0
        self.errors: list[tuple[int, str]] = []

    def bad(self, cause: str) -> Bad:
        self.line += self.s.count("\n", self.counted, self.at)  # errors come in order
        self.counted = self.at
        return Bad(self.line, cause if self.at < len(self.s) else "end of text")

    def space(self) -> str:
        self.at = _SPACE.match(self.s, self.at).end()
        return self.s[self.at : self.at + 1]

    def run(self) -> list[tuple[int, str]]:
        try:
            self.value()
            if self.space():
                raise self.bad("text behind the value")
        except Bad as e:
            self.errors.append((e.line, e.cause))
            self.recover()
        return self.errors

    def recover(self) -> None:
        """Panic mode: go on behind the next line end with a fresh member or value, to find further errors."""
        while True:
            end = self.s.find("\n", self.at)
            if end < 0:
                return
            self.at = end + 1
            try:
                while self.space() and self.s[self.at] in "]},":
                    self.at += 1
                if not self.space():
                    return
                self.member_or_value()
                while self.space() == ",":
                    self.at += 1
                    if self.space() in "]}" or not self.space():
                        raise self.bad("comma before the end")
                    self.member_or_value()
            except Bad as e:
                if e.line > self.errors[-1][0]:
                    self.errors.append((e.line, e.cause))

    def member_or_value(self) -> None:
        self.value()
        if self.space() == ":":
            self.at += 1
            self.value()

    def name(self) -> None:
        self.space()
        m = _JSTRING.match(self.s, self.at)
        if not m:
            raise self.bad("expected a name in quotes")
        self.at = m.end()
        if self.space() != ":":
            raise self.bad("expected :")
        self.at += 1

    def value(self) -> None:
        """With a stack of its own: JSON nests as deep as it likes."""
        open_: list[str] = []
        while True:
            c = self.space()
            if c == "{" or c == "[":
                self.at += 1
                closer = "}" if c == "{" else "]"
                if self.space() != closer:
                    open_.append(closer)
                    if c == "{":
                        self.name()
                    continue
                self.at += 1
            else:
                m = _JSTRING.match(self.s, self.at) or _JNUMBER.match(self.s, self.at) or _JWORD.match(self.s, self.at)
                if not m:
                    raise self.bad("no value" if c != '"' else "string without end")
                self.at = m.end()
            while open_:
                c = self.space()
                if c != open_[-1] and c != ",":
                    raise self.bad(f"expected , or {open_[-1]}")
                self.at += 1
                if c == ",":
                    if open_[-1] == "}":
                        self.name()
                    break
                open_.pop()
            else:
                return


def json(text: str) -> list[tuple[int, str]]:
    return Json(text).run()


# XML

_NAME = r"[A-Za-z_:À-￿][\w:.·-]*"
_OPEN = re.compile(rf"<({_NAME})((?:\s+{_NAME}\s*=\s*(?:\"[^<\"]*\"|'[^<']*'))*)\s*(/?)>")
_CLOSE = re.compile(rf"</({_NAME})\s*>")
_ATTR = re.compile(rf"({_NAME})\s*=\s*(\"[^<\"]*\"|'[^<']*')")
_ENTITY = re.compile(rf"&(?:{_NAME}|#\d+|#x[0-9a-fA-F]+);")
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def xml(text: str) -> list[tuple[int, str]]:
    errors: list[tuple[int, str]] = []
    line = lambda k: text.count("\n", 0, k) + 1
    stack: list[tuple[str, int]] = []
    at, n, roots = 0, len(text), 0
    m = _ILLEGAL.search(text)
    if m:
        errors.append((line(m.start()), "illegal character"))
    m = re.compile(r"\s+<\?xml\s").match(text)
    if m:
        errors.append((1, "declaration not at the start"))
    known = set(re.findall(rf"<!ENTITY\s+({_NAME})", text)) | {"lt", "gt", "amp", "apos", "quot"}
    while at < n:
        k = text.find("<", at)
        piece = text[at : k if k >= 0 else n]
        if piece:
            if not stack and piece.strip("﻿ \t\r\n"):
                errors.append((line(at), "text outside the root"))
            if "]]>" in piece:
                errors.append((line(at), "]]> in text"))
            _entities(piece, at, known, errors, line)
        if k < 0:
            break
        if text.startswith("<!--", k):
            end = text.find("-->", k + 4)
            inner = text[k + 4 : end if end >= 0 else n]
            if end < 0 or "--" in inner or inner.endswith("-"):
                errors.append((line(k), "comment without end" if end < 0 else "-- in a comment"))
            if end < 0:
                break
            at = end + 3
        elif text.startswith("<![CDATA[", k):
            end = text.find("]]>", k)
            if end < 0 or not stack:
                errors.append((line(k), "CDATA without end" if end < 0 else "text outside the root"))
                if end < 0:
                    break
            at = end + 3
        elif text.startswith("<?", k):
            end = text.find("?>", k)
            if end < 0:
                errors.append((line(k), "instruction without end"))
                break
            if text.startswith("<?xml ", k) and k > 0 and text[:k].strip("﻿"):
                errors.append((line(k), "declaration not at the start"))
            at = end + 2
        elif text.startswith("<!DOCTYPE", k):
            end, level = k, 0
            while end < n:
                c = text[end]
                level += (c == "[") - (c == "]")
                if c == ">" and level <= 0:
                    break
                end += 1
            if end >= n or stack or roots:
                errors.append((line(k), "misplaced or open DOCTYPE"))
            at = end + 1
        elif text.startswith("</", k):
            m = _CLOSE.match(text, k)
            if not m:
                errors.append((line(k), "broken end tag"))
                at = k + 2
                continue
            at = m.end()
            if stack and stack[-1][0] == m[1]:
                stack.pop()
            else:
                errors.append((line(k), f"unexpected end of {m[1]}"))
                names = [s[0] for s in stack]
                if m[1] in names:
                    del stack[len(names) - 1 - names[::-1].index(m[1]) :]
        else:
            m = _OPEN.match(text, k)
            if not m:
                errors.append((line(k), "broken tag"))
                at = k + 1
                continue
            at = m.end()
            names = [a[1] for a in _ATTR.finditer(m[2])]
            if len(set(names)) != len(names):
                errors.append((line(k), "attribute given twice"))
            _entities(m[2], k, known, errors, line)
            if not stack:
                roots += 1
                if roots > 1:
                    errors.append((line(k), "second root"))
            if not m[3]:
                stack.append((m[1], k))
                if len(stack) > 5000:
                    errors.append((line(k), "nested too deeply"))
                    break
    if stack:
        errors.append((line(stack[-1][1]), f"{stack[-1][0]} was never closed"))
    if not roots and not errors:
        errors.append((1, "no root"))
    return errors


def _entities(piece: str, base: int, known: set[str], errors: list, line) -> None:
    at = piece.find("&")
    while at >= 0:
        m = _ENTITY.match(piece, at)
        if not m or (m[0][1] != "#" and m[0][1:-1] not in known):
            errors.append((line(base + at), "broken reference"))
        at = piece.find("&", at + 1)


# TOML

_BARE = re.compile(r"[A-Za-z0-9_-]+")
_TBASIC = re.compile(r'"(?:[^"\\\x00-\x08\x0a-\x1f]|\\(?:[btnfre"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{2}))*"')
_TLITERAL = re.compile(r"'[^'\x00-\x08\x0a-\x1f]*'")
_TSCALAR = re.compile(
    r"(?:true|false|[+-]?(?:inf|nan)|\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d:\d\d(?:\.\d+)?|0x[0-9a-fA-F]+(?:_[0-9a-fA-F]+)*|0o[0-7]+(?:_[0-7]+)*|0b[01]+(?:_[01]+)*"
    r"|[+-]?(?:0|[1-9]\d*(?:_\d+)*)(?:\.\d+(?:_\d+)*)?(?:[eE][+-]?\d+(?:_\d+)*)?)(?![\w.+:-])"
)


class Toml:
    def __init__(self, text: str):
        self.s, self.at = text.replace("\r\n", "\n"), 0
        self.errors: list[tuple[int, str]] = []
        self.tables: set = set()
        self.keys: set = set()
        self.here: tuple = ()

    def bad(self, cause: str) -> Bad:
        return Bad(self.s.count("\n", 0, self.at) + 1, cause)

    def run(self) -> list[tuple[int, str]]:
        n = len(self.s)
        while self.at < n:
            try:
                self.line()
            except Bad as e:
                self.errors.append((e.line, e.cause))
                end = self.s.find("\n", self.at)
                self.at = n if end < 0 else end + 1
        return self.errors

    def blank(self) -> None:
        while self.s[self.at : self.at + 1] in (" ", "\t") and self.at < len(self.s):
            self.at += 1

    def comment(self) -> None:
        self.blank()
        if self.s[self.at : self.at + 1] == "#":
            end = self.s.find("\n", self.at)
            self.at = len(self.s) if end < 0 else end

    def end(self) -> None:
        self.comment()
        if self.at < len(self.s):
            if self.s[self.at] != "\n":
                raise self.bad("text behind the value")
            self.at += 1

    def line(self) -> None:
        self.comment()
        c = self.s[self.at : self.at + 1]
        if c in ("\n", ""):
            self.at += 1
            return
        if c == "[":
            many = self.s.startswith("[[", self.at)
            self.at += 2 if many else 1
            self.blank()
            key = self.key()
            self.blank()
            close = "]]" if many else "]"
            if not self.s.startswith(close, self.at):
                raise self.bad("table without ]")
            self.at += len(close)
            self.end()
            if many:
                self.keys = {k for k in self.keys if k[: len(key)] != key}
                self.tables = {k for k in self.tables if k[: len(key)] != key}
            elif key in self.tables or key in self.keys:
                raise self.bad("table given twice")
            else:
                self.tables.add(key)
            self.here = key
            return
        key = self.here + self.key()
        self.blank()
        if self.s[self.at : self.at + 1] != "=":
            raise self.bad("expected =")
        self.at += 1
        self.blank()
        self.value(0)
        self.end()
        if key in self.keys or key in self.tables:
            raise self.bad("key given twice")
        self.keys.add(key)

    def key(self) -> tuple:
        out = []
        while True:
            m = _BARE.match(self.s, self.at) or _TBASIC.match(self.s, self.at) or _TLITERAL.match(self.s, self.at)
            if not m:
                raise self.bad("no key")
            out.append(m[0].strip("\"'"))
            self.at = m.end()
            self.blank()
            if self.s[self.at : self.at + 1] != ".":
                return tuple(out)
            self.at += 1
            self.blank()

    def value(self, depth: int) -> None:
        if depth > MAX_DEPTH:
            raise self.bad("nested too deeply")
        for q in ('"""', "'''"):
            if self.s.startswith(q, self.at):
                k = self.at + 3
                while True:
                    k = self.s.find(q, k)
                    if k < 0:
                        raise self.bad("string without end")
                    back = 0
                    while q == '"""' and self.s[k - 1 - back] == "\\":
                        back += 1
                    if back % 2 == 0:
                        break
                    k += 1
                if q == '"""' and re.search(r"(?<!\\)(?:\\\\)*\\[^btnfre\"\\uUx\s]", self.s[self.at + 3 : k]):
                    raise self.bad("unknown escape")
                self.at = k + 3
                while self.s[self.at : self.at + 1] == q[0]:
                    self.at += 1
                return
        c = self.s[self.at : self.at + 1]
        if c == "[":
            self.at += 1
            while True:
                self.filler()
                if self.s[self.at : self.at + 1] == "]":
                    self.at += 1
                    return
                self.value(depth + 1)
                self.filler()
                c = self.s[self.at : self.at + 1]
                if c not in (",", "]"):
                    raise self.bad("expected , or ]" if c else "end of text")
                if c == ",":
                    self.at += 1
        if c == "{":
            self.at += 1
            self.blank()
            if self.s[self.at : self.at + 1] == "}":
                self.at += 1
                return
            while True:
                self.blank()
                self.key()
                if self.s[self.at : self.at + 1] != "=":
                    raise self.bad("expected =")
                self.at += 1
                self.blank()
                self.value(depth + 1)
                self.blank()
                c = self.s[self.at : self.at + 1]
                self.at += 1
                if c == "}":
                    return
                if c != ",":
                    raise self.bad("expected , or }")
        m = _TBASIC.match(self.s, self.at) or _TLITERAL.match(self.s, self.at) or _TSCALAR.match(self.s, self.at)
        if not m:
            raise self.bad("no value" if c else "end of text")
        self.at = m.end()

    def filler(self) -> None:
        while True:
            self.comment()
            if self.s[self.at : self.at + 1] != "\n" or self.at >= len(self.s):
                return
            self.at += 1


def toml(text: str) -> list[tuple[int, str]]:
    return Toml(text).run()


# YAML

_YKEY = re.compile(r"(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|(?:[^\s#&*!|>%@`\"'\[\]{},?:-]|[?:-](?=\S))(?:[^:#]|:(?=\S)|(?<=\S)#)*?)\s*:(?=\s|$)")
_YPROP = re.compile(r"(?:[&!][^\s,\[\]{}]*(?:\s+|$))+")


class Yaml:
    """Block structure by indentation; scalars and flow collections by character. Covers what configuration uses."""

    def __init__(self, text: str):
        self.lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.n = 0
        self.errors: list[tuple[int, str]] = []

    def bad(self, cause: str, at: int | None = None) -> Bad:
        return Bad((self.n if at is None else at) + 1, cause)

    def run(self) -> list[tuple[int, str]]:
        while self.n < len(self.lines):
            before = self.n
            try:
                if not self.more():
                    break
                raw = self.lines[self.n]
                if raw.startswith("---"):
                    rest = raw[3:].strip()
                    self.n += 1
                    if rest and not rest.startswith(("#", "!", "&", "|", ">")):
                        self.scalar(rest, 0)
                    elif rest[:1] in "|>" and rest:
                        self.block_scalar(-1)
                    continue
                if raw.startswith("...") or (raw.startswith("%") and not raw.startswith("% ")):
                    self.n += 1
                    continue
                self.node(self.indent())
                if self.more() and not self.lines[self.n].startswith(("---", "...", "%")):
                    raise self.bad("text outside the structure")
            except Bad as e:
                if not self.errors or self.errors[-1][0] < e.line:
                    self.errors.append((e.line, e.cause))
                self.n = max(self.n, e.line - 1)
                if self.n == before or self.n < e.line:
                    self.n = max(self.n + 1, e.line)
        return self.errors

    def more(self) -> bool:
        while self.n < len(self.lines):
            s = self.lines[self.n].strip(" \t")
            if s and not s.startswith("#"):
                return True
            self.n += 1
        return False

    def indent(self) -> int:
        raw = self.lines[self.n]
        k = len(raw) - len(raw.lstrip(" "))
        if raw[k : k + 1] == "\t":
            raise self.bad("tab in the indentation")
        return k

    def node(self, level: int) -> None:
        if level > MAX_DEPTH:
            raise self.bad("nested too deeply")
        body = self.lines[self.n][level:]
        if body.startswith("- ") or body.rstrip() == "-":
            self.sequence(level)
        elif self.is_key(body):
            self.mapping(level)
        else:
            self.n += 1
            self.scalar(body, level)

    def is_key(self, body: str) -> bool:
        m = _YPROP.match(body)
        body = body[m.end() :] if m else body
        return bool(_YKEY.match(body)) or body.startswith("? ") or body.startswith("<<:") or bool(re.match(r"\*[\w-]+ :", body))

    def sequence(self, level: int) -> None:
        while self.more():
            k = self.indent()
            body = self.lines[self.n][k:]
            if k < level or (k == level and not (body.startswith("- ") or body.rstrip() == "-")):
                return
            if k > level:
                raise self.bad("unexpected indentation")
            rest = body[1:]
            inner = len(rest) - len(rest.lstrip(" "))
            item = rest.lstrip(" ")
            if item[:1] == "\t":
                item = item.lstrip("\t ")
            m = _YPROP.match(item)
            bare = item[m.end() :] if m else item
            if not bare.strip() or bare.startswith("#"):
                self.n += 1
                if self.more():
                    nxt = self.indent()
                    if nxt > level:
                        self.node(nxt)
                continue
            if bare.startswith("- ") or bare.rstrip() == "-" or self.is_key(item):
                at = level + 1 + inner
                self.lines[self.n] = " " * at + item
                self.node(at)
            else:
                self.n += 1
                self.scalar(bare, level + 1)

    def mapping(self, level: int) -> None:
        seen: set[str] = set()
        while self.more():
            k = self.indent()
            raw = self.lines[self.n]
            if k < level or (k == 0 and raw.startswith(("---", "..."))):
                return
            if k > level:
                raise self.bad("unexpected indentation")
            body = raw[k:]
            m = _YPROP.match(body)
            if m:
                body = body[m.end() :]
            if body.startswith("? ") or (body.startswith(": ") and seen):
                self.n += 1
                self.scalar(body[2:].strip(), level + 1) if body[2:].strip() else None
                continue
            m = _YKEY.match(body) or re.match(r"\*[\w-]+ :|<<:", body)
            if not m:
                if body.startswith("- "):
                    raise self.bad("item inside a mapping")
                raise self.bad("expected a key")
            key = m[0].rstrip().rstrip(":").strip()
            if key in seen and key != "<<":
                raise self.bad("key given twice")
            seen.add(key)
            value = body[m.end() :].strip(" \t")
            p = _YPROP.match(value)
            if p:
                value = value[p.end() :]
            self.n += 1
            if not value or value.startswith("#"):
                if self.more():
                    nxt = self.indent()
                    s = self.lines[self.n][nxt:]
                    if nxt > level or (nxt == level and (s.startswith("- ") or s.rstrip() == "-")):
                        self.node(nxt)
                continue
            self.scalar(value, level + 1)

    def block_scalar(self, level: int) -> None:
        """Lines that belong to | or > under a parent at level."""
        first = -1
        while self.n < len(self.lines):
            raw = self.lines[self.n]
            if raw.strip(" "):
                k = len(raw) - len(raw.lstrip(" "))
                if k <= level:
                    return
                if first < 0:
                    first = k
                elif k < first:
                    if raw.lstrip(" ").startswith("#"):
                        return
                    raise self.bad("line indented less than its block")
            self.n += 1

    def scalar(self, value: str, level: int) -> None:
        """A value whose first line is given; self.n is the next line. Further lines must lie at level or deeper."""
        c = value[:1]
        start = self.n - 1
        if c in "|>":
            if not re.fullmatch(r"[|>](?:[+-]?[1-9]?|[1-9][+-])\s*(?:\s#.*)?", value.rstrip()):
                raise self.bad("broken block scalar", start)
            self.block_scalar(level - 1)
            return
        if c in "\"'":
            self.quoted(value, c, start, level)
            return
        if c in "[{":
            self.flow(value, start, level)
            return
        if c in "@`%" or c in "]},":
            raise self.bad(f"value begins with {c}", start)
        if c == "*":
            if not re.fullmatch(r"\*[^\s,\[\]{}]+\s*(?:\s#.*)?", value):
                raise self.bad("broken alias", start)
            return
        if re.match(r"[-?:](?:\s|$)", value) and value.startswith("- "):
            raise self.bad("item where a value stands", start)
        self.plain(value, start)
        while self.more_plain(level):  # a plain value goes on over deeper lines
            body = self.lines[self.n].strip(" ")
            if re.search(r":(?:\s|$)", re.sub(r"\s#.*", "", body)):
                raise self.bad("key inside a value")
            self.n += 1

    def more_plain(self, level: int) -> bool:
        k = self.n
        while k < len(self.lines) and not self.lines[k].strip():
            k += 1
        if k >= len(self.lines):
            return False
        raw = self.lines[k]
        depth = len(raw) - len(raw.lstrip(" "))
        if raw[depth : depth + 1] == "\t" and depth < level:
            raise self.bad("tab in the indentation", k)
        if depth < max(level, 0) or raw.lstrip(" ").startswith("#") or (depth == 0 and raw.startswith(("---", "..."))):
            return False
        self.n = k
        return True

    def plain(self, value: str, start: int) -> None:
        bare = re.sub(r"\s#.*$", "", value)
        if re.search(r":(?:\s|$)", bare):
            raise self.bad("second key on a line", start)

    def quoted(self, value: str, q: str, start: int, level: int) -> None:
        text = value
        rx = re.compile(r'"(?:[^"\\]|\\.)*"' if q == '"' else r"'(?:[^']|'')*'", re.S)
        while not (m := rx.match(text)):
            if self.n >= len(self.lines):
                self.n = len(self.lines)
                raise self.bad("string without end", start)
            nxt = self.lines[self.n]
            if nxt.strip() and len(nxt) - len(nxt.lstrip(" ")) < level:
                raise self.bad("string without end", start)
            text += "\n" + nxt
            self.n += 1
        if q == '"' and re.search(r"(?<!\\)(?:\\\\)*\\[^0abtnvfre \"/\\N_LPxuU\n\t]", m[0]):
            raise self.bad("unknown escape", start)
        tail = text[m.end() :].strip()
        if tail and not tail.startswith("#"):
            raise self.bad("text behind the value", start)

    def flow(self, value: str, start: int, level: int) -> None:
        text = value
        while True:
            end = self._flow_end(text, start)
            if end >= 0:
                break
            if self.n >= len(self.lines):
                raise self.bad("flow collection without end", start)
            nxt = self.lines[self.n]
            if nxt.strip() and len(nxt) - len(nxt.lstrip(" ")) < level and not re.match(r"\s*[\]}]", nxt):
                raise self.bad("flow collection without end", start)
            text += "\n" + nxt
            self.n += 1
        tail = text[end:].strip()
        if tail and not tail.startswith("#"):
            raise self.bad("text behind the value", start)

    def _flow_end(self, text: str, start: int) -> int:
        """End of the collection, -1 if it goes on."""
        stack: list[str] = []
        k, n = 0, len(text)
        fresh = True  # a value may begin
        while k < n:
            c = text[k]
            if c in "[{":
                if not fresh:
                    raise self.bad("missing ,", start)
                stack.append("]" if c == "[" else "}")
                fresh = True
            elif c in "]}":
                if not stack or stack.pop() != c:
                    raise self.bad(f"unmatched {c}", start)
                if not stack:
                    return k + 1
                fresh = False
            elif c == ",":
                fresh = True
            elif c in "\"'" and fresh:
                m = re.compile(r'"(?:[^"\\]|\\.)*"' if c == '"' else r"'(?:[^']|'')*'", re.S).match(text, k)
                if not m:
                    return -1
                k = m.end() - 1
                fresh = False
            elif c == "#" and (k == 0 or text[k - 1] in " \t\n"):
                e = text.find("\n", k)
                if e < 0:
                    return -1
                k = e
            elif c == ":" and (k + 1 >= n or text[k + 1] in " \t\n,[]{}\"'"):
                fresh = True
            elif c not in " \t\n":
                if not fresh:
                    raise self.bad("missing ,", start)
                m = re.compile(r"(?:[^,\[\]{}:#\n]|:(?![\s,\[\]{}]|$)|(?<=\S)#)+").match(text, k)
                if m:
                    k = m.end() - 1
                fresh = False
            k += 1
        return -1


def yaml(text: str) -> list[tuple[int, str]]:
    return Yaml(text).run()
