"""JavaScript: statements by recursive descent, expressions by precedence climbing."""

from __future__ import annotations

from . import clike
from .base import Bad, Parser

_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_RESERVED = frozenset("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split())
_STOPS = (";",)


class JavaScript(Parser):
    def program(self) -> None:
        while self.tok.kind != "eof":
            before = self.i
            try:
                self.depth = 0
                self.statement()
            except Bad as e:
                self.record(e)
                self.skip_to(_STOPS)
                if self.i == before:
                    self.next()

    def block(self) -> None:
        self.need("{")
        while not self.at("}"):
            if self.tok.kind == "eof":
                raise self.fail("end of text inside a block")
            self.statement()
        self.next()

    def end(self) -> None:
        if self.eat(";") or self.at("}") or self.tok.kind == "eof" or self.tok.fresh:
            return
        raise self.fail("expected ; or a new line")

    def statement(self) -> None:
        self.deeper()
        t = self.tok
        v = t.value if t.kind in ("id", "op") else ""
        if v == "{":
            self.block()
        elif v == ";":
            self.next()
        elif t.kind == "id" and self.peek().kind == "op" and self.peek().value == ":" and v not in _RESERVED:
            self.next()
            self.next()
            self.statement()
        elif v in ("var", "const") or (v == "let" and (self.peek().kind == "id" or self.peek().value in ("[", "{"))):
            self.declaration(v, False)
            self.end()
        elif v == "function" or (v == "async" and self.peek().value == "function" and not self.peek().fresh):
            self.eat("async")
            self.function(True)
        elif v == "class":
            self.klass(True)
        elif v == "if":
            while True:  # arms of a chain lie beside each other, however many
                self.next()
                self.head()
                self.statement()
                if not self.eat("else"):
                    break
                if not self.at("if"):
                    self.statement()
                    break
        elif v == "for":
            self.loop()
        elif v in ("while", "with"):
            self.next()
            self.head()
            self.statement()
        elif v == "do":
            self.next()
            self.statement()
            self.need("while")
            self.head()
            self.eat(";")
        elif v == "return" or v == "throw":
            self.next()
            if not (self.at(";", "}") or self.tok.kind == "eof" or self.tok.fresh):
                self.expression()
            elif v == "throw":
                raise self.fail("throw without a value")
            self.end()
        elif v in ("break", "continue"):
            self.next()
            if self.tok.kind == "id" and not self.tok.fresh:
                self.next()
            self.end()
        elif v == "debugger":
            self.next()
            self.end()
        elif v == "switch":
            self.switch()
        elif v == "try":
            self.next()
            self.block()
            some = False
            if self.eat("catch"):
                some = True
                if self.eat("("):
                    self.binding()
                    self.need(")")
                self.block()
            if self.eat("finally"):
                some = True
                self.block()
            if not some:
                raise self.fail("try without catch")
        elif v == "import" and self.peek().value not in ("(", "."):
            self.importing()
        elif v == "export":
            self.exporting()
        elif t.kind == "id" and v in _RESERVED and v not in ("this", "new", "typeof", "delete", "void", "null", "true", "false", "super", "import"):
            raise self.fail(f"unexpected {v}")
        else:
            self.expression()
            self.end()
        self.depth -= 1

    def head(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def declaration(self, kind: str, in_for: bool) -> None:
        self.next()
        while True:
            pattern = self.at("{", "[")
            self.binding(False)
            if self.eat("="):
                self.assignment(not in_for)
            elif (pattern or kind == "const") and not (in_for and self.at("of", "in")):
                raise self.fail("declaration without a value")
            if not self.eat(","):
                return

    def binding(self, default: bool = True) -> None:
        self.deeper()
        if self.eat("["):
            while not self.at("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.binding()
                if not self.at("]"):
                    self.need(",")
            self.next()
        elif self.eat("{"):
            while not self.at("}"):
                if self.eat("..."):
                    self.binding()
                else:
                    simple = self.tok.kind == "id"
                    self.property_name()
                    if self.eat(":"):
                        self.binding()
                    elif not simple:
                        raise self.fail("expected :")
                    elif self.eat("="):
                        self.assignment()
                if not self.at("}"):
                    self.need(",")
            self.next()
        else:
            if self.tok.kind != "id" or self.tok.value in _RESERVED:
                raise self.fail("expected a name to bind" if self.tok.kind != "eof" else "end of text")
            self.next()
        if default and self.eat("="):
            self.assignment()
        self.depth -= 1

    def parameters(self) -> None:
        self.need("(")
        while not self.at(")"):
            self.eat("...")
            self.binding()
            if not self.at(")"):
                self.need(",")
        self.next()

    def function(self, named: bool) -> None:
        self.need("function")
        self.eat("*")
        if self.tok.kind == "id":
            self.next()
        elif named:
            raise self.fail("function without a name")
        self.parameters()
        self.block()

    def klass(self, named: bool) -> None:
        self.need("class")
        if self.tok.kind == "id" and self.tok.value != "extends":
            self.next()
        elif named:
            raise self.fail("class without a name")
        if self.eat("extends"):
            self.unary()
        self.need("{")
        while not self.at("}"):
            if self.tok.kind == "eof":
                raise self.fail("end of text inside a class")
            if self.eat(";"):
                continue
            self.member()
        self.next()

    def member(self) -> None:
        while self.at("static", "async", "get", "set", "*"):
            if self.peek().value in ("(", "=", ";", "}") and self.peek().kind == "op":
                break
            word = self.next().value
            if word == "static" and self.at("{"):
                self.block()
                return
        self.property_name()
        if self.at("("):
            self.parameters()
            self.block()
            return
        if self.eat("="):
            self.assignment()
        self.end()

    def property_name(self) -> None:
        if self.eat("["):
            self.assignment()
            self.need("]")
        elif self.tok.kind in ("id", "str", "num"):
            self.next()
        else:
            raise self.fail("expected a property name" if self.tok.kind != "eof" else "end of text")

    def loop(self) -> None:
        self.next()
        self.eat("await")
        self.need("(")
        if self.at("var", "let", "const"):
            self.declaration(self.tok.value, True)
        elif not self.at(";"):
            self.expression(False)
        if self.eat("of") or self.eat("in"):
            self.expression()
        else:
            self.need(";")
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at(")"):
                self.expression()
        self.need(")")
        self.statement()

    def switch(self) -> None:
        self.next()
        self.head()
        self.need("{")
        while not self.at("}"):
            if self.eat("case"):
                self.expression()
                self.need(":")
            elif self.eat("default"):
                self.need(":")
            else:
                raise self.fail("expected case" if self.tok.kind != "eof" else "end of text inside switch")
            while not self.at("case", "default", "}"):
                if self.tok.kind == "eof":
                    raise self.fail("end of text inside switch")
                self.statement()
        self.next()

    def importing(self) -> None:
        self.next()
        if self.tok.kind != "str":
            while True:
                if self.eat("*"):
                    self.need("as")
                    self.need_id()
                elif self.at("{"):
                    self.names()
                else:
                    self.need_id()
                if not self.eat(","):
                    break
            self.need("from")
        if self.tok.kind != "str":
            raise self.fail("expected a module")
        self.next()
        if self.eat("with") or self.eat("assert"):
            self.primary()
        self.end()

    def names(self) -> None:
        self.need("{")
        while not self.at("}"):
            if self.tok.kind not in ("id", "str"):
                raise self.fail("expected a name")
            self.next()
            if self.eat("as"):
                self.next()
            if not self.at("}"):
                self.need(",")
        self.next()

    def exporting(self) -> None:
        self.next()
        if self.eat("default"):
            if self.at("function") or (self.at("async") and self.peek().value == "function"):
                self.eat("async")
                self.function(False)
            elif self.at("class"):
                self.klass(False)
            else:
                self.assignment()
                self.end()
        elif self.eat("*"):
            if self.eat("as"):
                self.next()
            self.need("from")
            self.next()
            self.end()
        elif self.at("{"):
            self.names()
            if self.eat("from"):
                self.next()
            self.end()
        elif self.at("var", "let", "const", "function", "class", "async"):
            self.statement()
        else:
            raise self.fail("nothing to export")

    # expressions

    def expression(self, allow_in: bool = True) -> None:
        self.assignment(allow_in)
        while self.eat(","):
            self.assignment(allow_in)

    def assignment(self, allow_in: bool = True) -> None:
        self.deeper()
        if self.arrow():
            self.depth -= 1
            return
        if self.at("yield"):
            self.next()
            self.eat("*")
            if not (self.tok.fresh or self.at(")", "]", "}", ",", ";", ":") or self.tok.kind == "eof"):
                self.assignment(allow_in)
            self.depth -= 1
            return
        simple = self.conditional(allow_in)
        if self.tok.kind == "op" and self.tok.value in _ASSIGN:
            if not simple:
                raise self.fail("assignment to what is no target")
            self.next()
            self.assignment(allow_in)
        self.depth -= 1

    def arrow(self) -> bool:
        start = self.i
        i = self.i
        if self.t[i].value == "async" and self.t[i].kind == "id" and not self.peek().fresh and (self.peek().kind == "id" or self.peek().value == "(") and self.peek().value != "function":
            i += 1
        k = self.t[i]
        if k.kind == "id" and k.value not in _RESERVED and self.t[min(i + 1, len(self.t) - 1)].value == "=>":
            self.i = i + 2
        elif k.kind == "op" and k.value == "(":
            close = self.closing(i)
            if close < 0 or self.t[close + 1].value != "=>" or self.t[close + 1].kind != "op":
                return False
            self.i = i
            self.parameters()
            self.need("=>")
        else:
            self.i = start
            return False
        if self.at("{"):
            self.block()
        else:
            self.assignment()
        return True

    def closing(self, i: int) -> int:
        if not hasattr(self, "_pairs"):
            pairs, stack = {}, []
            for n, k in enumerate(self.t):
                if k.kind == "op":
                    if k.value in "([{":
                        stack.append(n)
                    elif k.value in ")]}" and stack:
                        pairs[stack.pop()] = n
            self._pairs = pairs
        return self._pairs.get(i, -1)

    def conditional(self, allow_in: bool) -> bool:
        simple = self.binary(0, allow_in)
        if self.eat("?"):
            self.assignment()
            self.need(":")
            self.assignment(allow_in)
            return False
        return simple

    def binary(self, least: int, allow_in: bool) -> bool:
        simple = self.unary()
        while True:
            t = self.tok
            p = _BINARY.get(t.value) if t.kind in ("op", "id") else None
            if p is None or p <= least or (t.value == "in" and not allow_in):
                return simple
            self.next()
            self.binary(p - (t.value == "**"), allow_in)
            simple = False

    def unary(self) -> bool:
        self.deeper()
        try:
            if self.at("!", "~", "+", "-", "typeof", "void", "delete"):
                self.next()
                self.unary()
                return False
            if self.at("await") and not (self.peek().kind == "op" and self.peek().value in (")", ",", ";", "=", ".")):
                self.next()
                self.unary()
                return False
            if self.at("++", "--"):
                self.next()
                if not self.unary():
                    raise self.fail("no target to change")
                return False
            simple = self.postfix()
            if self.at("++", "--") and not self.tok.fresh:
                if not simple:
                    raise self.fail("no target to change")
                self.next()
                return False
            return simple
        finally:
            self.depth -= 1

    def postfix(self) -> bool:
        if self.at("new"):
            self.next()
            if self.eat("."):
                self.need_id()
            else:
                self.member_of(self.primary_or_new(), False)
                if self.at("("):
                    self.arguments()
            simple = False
        else:
            simple = self.primary()
        return self.member_of(simple, True)

    def primary_or_new(self) -> bool:
        if self.at("new"):
            return self.postfix()
        return self.primary()

    def member_of(self, simple: bool, calls: bool) -> bool:
        while True:
            if self.eat("."):
                self.need_id("expected a property")
                simple = True
            elif self.eat("?."):
                if self.at("("):
                    self.arguments()
                elif self.eat("["):
                    self.expression()
                    self.need("]")
                else:
                    self.need_id("expected a property")
                simple = False
            elif self.at("["):
                self.next()
                self.expression()
                self.need("]")
                simple = True
            elif self.at("(") and calls:
                self.arguments()
                simple = False
            elif self.tok.kind == "tmpl":
                self.next()
                simple = False
            else:
                return simple

    def arguments(self) -> None:
        self.need("(")
        while not self.at(")"):
            self.eat("...")
            self.assignment()
            if not self.at(")"):
                self.need(",")
        self.next()

    def primary(self) -> bool:
        t = self.tok
        if t.kind in ("num", "str", "tmpl", "regex"):
            self.next()
            return False
        if t.kind == "id":
            v = t.value
            if v == "function" or (v == "async" and self.peek().value == "function" and not self.peek().fresh):
                self.eat("async")
                self.function(False)
                return False
            if v == "class":
                self.klass(False)
                return False
            if v in ("this", "null", "true", "false", "super"):
                self.next()
                return False
            if v == "import":
                self.next()
                if not self.at("(", "."):
                    raise self.fail("unexpected import")
                return False
            if v in _RESERVED:
                raise self.fail(f"unexpected {v}")
            self.next()
            return True
        if self.eat("("):
            self.expression()
            self.need(")")
            return True
        if self.eat("["):
            while not self.at("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.assignment()
                if not self.at("]"):
                    self.need(",")
            self.next()
            return True
        if self.at("{"):
            self.object()
            return True
        raise self.fail(f"unexpected {t.value}" if t.kind != "eof" else "end of text inside an expression")

    def object(self) -> None:
        self.need("{")
        while not self.at("}"):
            if self.eat("..."):
                self.assignment()
            else:
                while self.at("get", "set", "async", "*") and not (self.peek().kind == "op" and self.peek().value in (":", ",", "(", "}", "=")):
                    self.next()
                simple = self.tok.kind == "id"
                self.property_name()
                if self.at("("):
                    self.parameters()
                    self.block()
                elif self.eat(":"):
                    self.assignment()
                elif self.eat("="):
                    self.assignment()
                elif not simple:
                    raise self.fail("expected :")
            if not self.at("}"):
                self.need(",")
        self.next()


def parse(text: str) -> list[tuple[int, str]]:
    clike.INNER.clear()
    toks, errors = clike.tokens(text, "js")
    inner = list(clike.INNER)
    JavaScript(toks, errors).program()
    for sub, base in inner:
        p = JavaScript(sub, [])
        try:
            p.expression()
            if p.tok.kind != "eof":
                raise p.fail("unexpected text in a template")
        except Bad as e:
            errors.append((e.line + base - 1, e.cause))
    return errors
