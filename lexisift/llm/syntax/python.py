"""Python 3: indentation tokens, statements by recursive descent, expressions by precedence climbing."""

from __future__ import annotations

import re

from .base import Bad, Parser, Token

_TOKEN = re.compile(
    r"""(?P<ws>[ \t\f]+)|(?P<nl>\r?\n|\r)|(?P<com>\#[^\n\r]*)|(?P<join>\\\r?\n)"""
    r"""|(?P<str>(?:[rR][bBfFtT]?|[bB][rR]?|[fFtT][rR]?|[uU])?(?:'''|\"\"\"|'|\"))"""
    r"""|(?P<num>0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)"""
    r"""|(?P<id>[^\W\d]\w*)|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|<<|>>|\*\*|//|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[{}()\[\],:;.+\-*/%&|^~<>=@])"""
)
_END = {q: re.compile(r"(?:[^\\" + q + r"\n]|\\(?:\r?\n|.))*" + q, re.S) for q in "'\""} | {q * 3: re.compile(r"(?:[^\\]|\\.)*?" + q * 3, re.S) for q in "'\""}
KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_BINARY = {"or": 1, "and": 2, "in": 4, "is": 4, "not": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "==": 4, "!=": 4, "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "//": 10, "%": 10, "@": 10}
_AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
_PAIR = {")": "(", "]": "[", "}": "{"}


def _formatted(text: str, at: int, quote: str) -> int:
    """End of an f-string, whose fields may hold quotes, or -1."""
    n = len(text)
    while at < n:
        c = text[at]
        if c == "\\":
            at += 2
        elif text.startswith(quote, at):
            return at + len(quote)
        elif c == "\n" and len(quote) == 1:
            return -1
        elif c == "{" and text[at + 1 : at + 2] != "{":
            level = 1
            at += 1
            while at < n and level:
                c = text[at]
                if c in "([{":
                    level += 1
                elif c in ")]}":
                    level -= 1
                elif c in "'\"":
                    q = c * 3 if text.startswith(c * 3, at) else c
                    m = _END[q].match(text, at + len(q))
                    if text.startswith(quote, at) and not m:
                        return -1
                    if m:
                        at = m.end() - 1
                at += 1
        elif c == "{":
            at += 2
        else:
            at += 1
    return -1


def tokens(text: str) -> tuple[list[Token], list[tuple[int, str]]]:
    out: list[Token] = []
    errors: list[tuple[int, str]] = []
    indents, plains = [0], [0]
    opened: list[tuple[str, int]] = []
    at, line, n = 0, 1, len(text)
    start = True
    while at < n:
        if start and not opened:
            m = re.compile(r"[ \t\f]*").match(text, at)
            rest = text[m.end() : m.end() + 2]
            if rest[:1] in ("#", "\n", "\r", "") or rest == "\\\n":
                at = m.end()
            else:
                width = plain = 0  # with tabs to eight columns, and as one: both must agree on what lies deeper
                for c in m[0]:
                    width, plain = ((width // 8 + 1) * 8, plain + 1) if c == "\t" else (0, 0) if c == "\f" else (width + 1, plain + 1)
                while len(plains) > len(indents):
                    plains.pop()
                if (width > indents[-1]) != (plain > plains[-1]) or (width == indents[-1]) != (plain == plains[-1]) and width >= indents[-1]:
                    errors.append((line, "tabs and spaces mixed"))
                if width > indents[-1]:
                    indents.append(width)
                    plains.append(plain)
                    out.append(Token("indent", "", line, False))
                while width < indents[-1]:
                    indents.pop()
                    out.append(Token("dedent", "", line, False))
                    plains.pop()
                    if width > indents[-1]:
                        errors.append((line, "unindent to no outer level"))
                        indents.append(width)
                        plains.append(plain)
                        break
                    if width == indents[-1] and plain != plains[-1]:
                        errors.append((line, "tabs and spaces mixed"))
                at = m.end()
        start = False
        m = _TOKEN.match(text, at)
        if not m:
            if at >= n:
                break
            errors.append((line, f"no token begins with {text[at]!r}"))
            out.append(Token("bad", text[at], line, False))
            at += 1
            continue
        kind, v = m.lastgroup, m[0]
        at = m.end()
        if kind in ("ws", "com"):
            continue
        if kind == "join":
            line += 1
            continue
        if kind == "nl":
            if not opened:
                if out and out[-1].kind not in ("nl", "indent", "dedent"):
                    out.append(Token("nl", "", line, False))
                start = True
            line += 1
            continue
        if kind == "str":
            quote = v[-3:] if v[-3:] in ("'''", '"""') else v[-1]
            if "f" in v.lower() or "t" in v.lower()[:-1]:
                end = _formatted(text, at, quote)
            else:
                e = _END[quote].match(text, at)
                end = e.end() if e else -1
            first = line
            if end < 0:
                errors.append((line, "string without end"))
                stop = n if len(quote) == 3 else text.find("\n", at)
                end = n if stop < 0 else stop
            elif "b" in v.lower()[: -len(quote)] and not text[at:end].isascii():
                errors.append((line, "bytes literal with other characters"))
            line += text.count("\n", at, end)
            at = end
            out.append(Token("str", "b" if "b" in v.lower() else "s", first, False))
            continue
        if kind == "num":
            nxt = re.compile(r"[^\W\d]\w*").match(text, at)
            if nxt and nxt[0] not in ("and", "or", "in", "is", "if", "else", "for", "not") or re.fullmatch(r"0\d+", v) and v.strip("0"):
                errors.append((line, "invalid number"))
                at = nxt.end() if nxt else at
        elif kind == "op":
            if v in "([{":
                opened.append((v, line))
            elif v in ")]}":
                if not opened or opened[-1][0] != _PAIR[v]:
                    errors.append((line, f"unmatched {v}"))
                    if opened:
                        opened.pop()
                else:
                    opened.pop()
        out.append(Token(kind, v, line, False))
    if opened:
        errors.append((opened[-1][1], f"{opened[-1][0]} was never closed"))
    if out and out[-1].kind != "nl":
        out.append(Token("nl", "", line, False))
    out += [Token("dedent", "", line, False)] * (len(indents) - 1)
    out.append(Token("eof", "", line, False))
    return out, errors


class Python(Parser):
    def module(self) -> None:
        while self.tok.kind != "eof":
            before = self.i
            try:
                self.depth = 0
                self.statement()
            except Bad as e:
                self.record(e)
                self.recover(before)

    def recover(self, before: int) -> None:
        """Panic mode: to the end of the logical line, past an indented block that belongs to it."""
        while self.tok.kind not in ("nl", "eof"):
            self.next()
        if self.tok.kind == "nl":
            self.next()
        level = 0
        while self.tok.kind == "indent" or level:
            if self.tok.kind == "indent":
                level += 1
            elif self.tok.kind == "dedent":
                level -= 1
            elif self.tok.kind == "eof":
                return
            self.next()
        while self.tok.kind == "dedent":
            self.next()
        if self.i == before:
            self.next()

    def end(self) -> None:
        if self.tok.kind == "nl":
            self.next()
        elif self.tok.kind != "eof":
            raise self.fail("expected the end of the statement")

    def name(self) -> None:
        if self.tok.kind != "id" or self.tok.value in KEYWORDS:
            raise self.fail("expected a name")
        self.next()

    def suite(self) -> None:
        self.need(":")
        if self.tok.kind != "nl":
            self.simple_line()
            return
        self.next()
        if self.tok.kind != "indent":
            raise self.fail("expected an indented block")
        self.next()
        self.deeper()
        while self.tok.kind not in ("dedent", "eof"):
            self.statement()
        self.depth -= 1
        if self.tok.kind == "dedent":
            self.next()

    def statement(self) -> None:
        t = self.tok
        if t.kind == "indent":
            raise self.fail("unexpected indent")
        if t.kind in ("nl", "dedent"):
            self.next()
            return
        v = t.value if t.kind in ("id", "op") else ""
        if v == "async" and self.peek().value in ("def", "for", "with"):
            self.next()
            v = self.tok.value
        if v == "if" or v == "while":
            self.next()
            self.named()
            self.suite()
            while v == "if" and self.eat("elif"):
                self.named()
                self.suite()
            if self.eat("else"):
                self.suite()
        elif v == "for":
            self.next()
            self.targets()
            self.need("in")
            self.star_list()
            self.suite()
            if self.eat("else"):
                self.suite()
        elif v == "def":
            self.next()
            self.name()
            self.type_parameters()
            self.need("(")
            self.parameters(")", True)
            self.need(")")
            if self.eat("->"):
                self.expression()
            self.suite()
        elif v == "class":
            self.next()
            self.name()
            self.type_parameters()
            if self.at("("):
                self.arguments()
            self.suite()
        elif v == "@":
            self.next()
            self.named()
            self.end()
            if not (self.at("def", "class", "@") or (self.at("async") and self.peek().value == "def")):
                raise self.fail("nothing to decorate")
            self.statement()
        elif v == "try":
            self.attempt()
        elif v == "with":
            self.context()
        elif v == "match" and self.is_match():
            self.match()
        else:
            self.simple_line()

    def type_parameters(self) -> None:
        if self.eat("["):
            while not self.at("]"):
                self.eat("*") or self.eat("**")
                self.name()
                if self.eat(":"):
                    self.expression()
                if self.eat("="):
                    self.expression()
                if not self.at("]"):
                    self.need(",")
            self.next()

    def attempt(self) -> None:
        self.next()
        self.suite()
        some = False
        while self.eat("except"):
            some = True
            self.eat("*")
            if not self.at(":"):
                self.expression()
                while self.eat(","):
                    self.expression()
                if self.eat("as"):
                    self.name()
            self.suite()
        if self.eat("else"):
            if not some:
                raise self.fail("else without except")
            self.suite()
        if self.eat("finally"):
            some = True
            self.suite()
        if not some:
            raise self.fail("try without except")

    def context(self) -> None:
        self.next()
        start = self.i
        if self.eat("("):
            try:
                while not self.at(")"):
                    self.expression()
                    if self.eat("as"):
                        self.target()
                    if not self.at(")"):
                        self.need(",")
                self.next()
                if self.at(":"):
                    self.suite()
                    return
            except Bad:
                pass
            self.i = start
        while True:
            self.expression()
            if self.eat("as"):
                self.target()
            if not self.eat(","):
                break
        self.suite()

    def is_match(self) -> bool:
        """A match statement: its line ends in : and an indented case follows."""
        k = self.i + 1
        if self.t[k].kind == "nl" or (self.t[k].kind == "op" and self.t[k].value in ("=", ".", ",", ")", ":")):
            return False
        while self.t[k].kind not in ("nl", "eof"):
            k += 1
        return self.t[k - 1].value == ":" and self.t[min(k + 1, len(self.t) - 1)].kind == "indent" and self.t[min(k + 2, len(self.t) - 1)].value == "case"

    def match(self) -> None:
        self.next()
        self.star_list()
        self.need(":")
        self.next()
        self.next()
        while self.at("case"):
            self.next()
            self.pattern_list()
            if self.eat("if"):
                self.named()
            self.suite()
        if self.tok.kind not in ("dedent", "eof"):
            raise self.fail("expected case")
        if self.tok.kind == "dedent":
            self.next()

    def pattern_list(self) -> None:
        while not self.at(":", "if"):
            self.eat("*")
            self.binary(0)
            while self.eat("as"):
                self.name()
            if not self.eat(","):
                return

    def simple_line(self) -> None:
        while True:
            self.simple()
            if not self.eat(";"):
                break
            if self.tok.kind in ("nl", "eof"):
                break
        self.end()

    def simple(self) -> None:
        t = self.tok
        v = t.value if t.kind == "id" else ""
        if v in ("pass", "break", "continue"):
            self.next()
        elif v == "return":
            self.next()
            if self.tok.kind != "nl" and not self.at(";"):
                self.star_list()
        elif v == "raise":
            self.next()
            if self.tok.kind != "nl" and not self.at(";"):
                self.expression()
                if self.eat("from"):
                    self.expression()
        elif v == "del":
            self.next()
            self.targets()
        elif v in ("global", "nonlocal"):
            self.next()
            self.name()
            while self.eat(","):
                self.name()
        elif v == "assert":
            self.next()
            self.expression()
            if self.eat(","):
                self.expression()
        elif v == "import":
            self.next()
            while True:
                self.dotted()
                if self.eat("as"):
                    self.name()
                if not self.eat(","):
                    break
        elif v == "from":
            self.next()
            dots = False
            while self.at(".", "..."):
                dots = True
                self.next()
            if not (dots and self.at("import")):
                self.dotted()
            self.need("import")
            if self.eat("*"):
                return
            closed = self.eat("(")
            while True:
                self.name()
                if self.eat("as"):
                    self.name()
                if not self.eat(",") or (closed and self.at(")")):
                    break
            if closed:
                self.need(")")
        elif v == "type" and self.peek().kind == "id" and self.peek().value not in KEYWORDS and self.peek(2).value in ("=", "["):
            self.next()
            self.name()
            self.type_parameters()
            self.need("=")
            self.expression()
        else:
            simple = self.star_list(True)
            if self.eat(":"):
                if not simple:
                    raise self.fail("annotation on what is no target")
                self.expression()
                if self.eat("="):
                    self.star_list(True)
            elif self.tok.kind == "op" and self.tok.value in _AUGMENTED:
                if not simple:
                    raise self.fail("assignment to what is no target")
                self.next()
                self.star_list(True)
            else:
                while self.at("="):
                    if not simple:
                        raise self.fail("assignment to what is no target")
                    self.next()
                    simple = self.star_list(True)

    def dotted(self) -> None:
        self.name()
        while self.eat("."):
            self.name()

    def targets(self) -> None:
        self.target()
        while self.eat(","):
            if self.at("in", "=", ")") or self.tok.kind == "nl":
                return
            self.target()

    def target(self) -> None:
        self.eat("*")
        if not self.postfix():
            raise self.fail("no target to assign to")

    # expressions

    def star_list(self, allow_yield: bool = False) -> bool:
        """Expressions with commas; whether they could be assigned to."""
        simple = self.star(allow_yield)
        while self.eat(","):
            if self.tok.kind in ("nl", "eof") or self.at(")", "]", "}", "=", ":", ";"):
                break
            simple = self.star() and simple
        return simple

    def star(self, allow_yield: bool = False) -> bool:
        if self.eat("*"):
            return self.binary(3)
        if allow_yield and self.at("yield"):
            self.yields()
            return False
        return self.named()

    def yields(self) -> None:
        self.next()
        if self.eat("from"):
            self.expression()
        elif self.tok.kind not in ("nl", "eof") and not self.at(")", "]", "}", "=", ";"):
            self.star_list()

    def named(self) -> bool:
        if self.tok.kind == "id" and self.peek().kind == "op" and self.peek().value == ":=":
            self.name()
            self.next()
            self.expression()
            return False
        return self.expression()

    def expression(self) -> bool:
        self.deeper()
        try:
            if self.eat("lambda"):
                self.parameters(":", False)
                self.need(":")
                self.expression()
                return False
            simple = self.binary(0)
            if self.at("if"):
                self.next()
                self.binary(0)
                self.need("else")
                self.expression()
                return False
            return simple
        finally:
            self.depth -= 1

    def binary(self, least: int) -> bool:
        if self.at("not") and least < 4:
            self.next()
            self.binary(3)
            simple = False
        else:
            simple = self.unary()
        while True:
            t = self.tok
            p = _BINARY.get(t.value) if t.kind in ("op", "id") else None
            if p is None or p <= least:
                return simple
            self.next()
            if t.value == "is":
                self.eat("not")
            elif t.value == "not":
                self.need("in")
            if p == 2 or p == 1:
                self.binary(p)
            else:
                self.binary(p)
            simple = False

    def unary(self) -> bool:
        n = 0
        while self.at("+", "-", "~"):
            n += 1
            self.next()
            if n > 100:
                raise self.fail("nested too deeply")
        simple = self.postfix()
        if self.eat("**"):
            self.deeper()
            self.unary()
            self.depth -= 1
            return False
        return simple and not n

    def postfix(self) -> bool:
        awaits = self.eat("await")
        simple = self.atom()
        while True:
            if self.eat("."):
                self.name()
                simple = True
            elif self.at("("):
                self.arguments()
                simple = False
            elif self.eat("["):
                if self.at("]"):
                    raise self.fail("index without a value")
                while not self.at("]"):
                    self.slice()
                    if not self.at("]"):
                        self.need(",")
                self.next()
                simple = True
            else:
                return simple and not awaits

    def slice(self) -> None:
        if not self.at(":"):
            self.star()
        for _ in range(2):
            if self.eat(":") and not self.at(":", "]", ","):
                self.expression()

    def arguments(self) -> None:
        self.deeper()
        self.need("(")
        keyword = False
        while not self.at(")"):
            if self.eat("**"):
                self.expression()
                keyword = True
            elif self.eat("*"):
                self.expression()
            elif self.tok.kind == "id" and self.tok.value not in KEYWORDS and self.peek().kind == "op" and self.peek().value == "=":
                self.next()
                self.next()
                self.expression()
                keyword = True
            else:
                self.named()
                if self.at("for") or (self.at("async") and self.peek().value == "for"):
                    self.comprehension()
                elif keyword:
                    raise self.fail("positional argument after a keyword")
            if not self.at(")"):
                self.need(",")
        self.next()
        self.depth -= 1

    def comprehension(self) -> None:
        while self.at("for", "async"):
            self.eat("async")
            self.need("for")
            self.targets()
            self.need("in")
            self.binary(0)
            while self.eat("if"):
                if self.at("lambda"):
                    self.expression()
                else:
                    self.named_no_if()
            if self.at("else"):
                raise self.fail("unexpected else")

    def named_no_if(self) -> None:
        if self.tok.kind == "id" and self.peek().value == ":=":
            self.next()
            self.next()
        self.binary(0)

    def parameters(self, close: str, typed: bool) -> None:
        default = False
        star = False
        while not self.at(close):
            if self.eat("/"):
                pass
            elif self.eat("**"):
                self.name()
                if typed and self.eat(":"):
                    self.expression()
            elif self.eat("*"):
                star = True
                if not self.at(","):
                    self.name()
                    if typed and self.eat(":"):
                        self.star()
            else:
                self.name()
                if typed and self.eat(":"):
                    self.expression()
                if self.eat("="):
                    self.expression()
                    default = True
                elif default and not star:
                    raise self.fail("parameter without default behind one with")
            if not self.at(close):
                self.need(",")

    def atom(self) -> bool:
        t = self.tok
        if t.kind == "num":
            self.next()
            return False
        if t.kind == "str":
            while self.tok.kind == "str":
                if self.tok.value != t.value:
                    raise self.fail("bytes beside text")
                self.next()
            return False
        if t.kind == "id":
            if t.value in ("None", "True", "False"):
                self.next()
                return False
            if t.value in KEYWORDS:
                raise self.fail(f"unexpected {t.value}")
            self.next()
            return True
        if t.kind != "op":
            raise self.fail("unexpected end of the line" if t.kind == "nl" else "unexpected text" if t.kind != "eof" else "end of text inside an expression")
        self.deeper()
        try:
            if self.eat("..."):
                return False
            if self.eat("("):
                if self.eat(")"):
                    return True
                if self.at("yield"):
                    self.yields()
                    self.need(")")
                    return False
                simple = self.star()
                if self.at("for") or (self.at("async") and self.peek().value == "for"):
                    self.comprehension()
                    simple = False
                else:
                    while self.eat(","):
                        if self.at(")"):
                            break
                        simple = self.star() and simple
                self.need(")")
                return simple
            if self.eat("["):
                simple = True
                if not self.at("]"):
                    simple = self.star()
                    if self.at("for") or (self.at("async") and self.peek().value == "for"):
                        self.comprehension()
                        simple = False
                    else:
                        while self.eat(","):
                            if self.at("]"):
                                break
                            simple = self.star() and simple
                self.need("]")
                return simple
            if self.eat("{"):
                kind = ""
                while not self.at("}"):
                    if self.eat("**"):
                        self.binary(3)
                        now = "dict"
                    else:
                        self.star()
                        now = "set"
                        if self.eat(":"):
                            self.expression()
                            now = "dict"
                    if kind and now != kind:
                        raise self.fail("pairs beside single values")
                    kind = now
                    if self.at("for") or (self.at("async") and self.peek().value == "for"):
                        self.comprehension()
                        break
                    if not self.at("}"):
                        self.need(",")
                self.need("}")
                return False
        finally:
            self.depth -= 1
        raise self.fail(f"unexpected {t.value}")


def parse(text: str) -> list[tuple[int, str]]:
    if "\0" in text:
        return [(text.count("\n", 0, text.index("\0")) + 1, "null character")]
    toks, errors = tokens(text)
    toks += [toks[-1]] * 2
    Python(toks, errors).module()
    return errors
