"""Go: declarations and statements by recursive descent, expressions by precedence climbing."""

from __future__ import annotations

from . import clike
from .base import Bad, Parser

_BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
_ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
_KEY = clike.GO_KEYWORDS


class Go(Parser):
    level = 0  # below 0 a { after a name begins a block, not a literal

    def file(self) -> None:
        try:
            self.need("package")
            self.name()
            self.semi()
        except Bad as e:
            self.record(e)
            self.skip_to((";",))
        late = False
        while self.tok.kind != "eof":
            before = self.i
            try:
                self.depth = self.level = 0
                if self.eat(";"):
                    continue
                if self.at("import"):
                    if late:
                        raise self.fail("import after declarations")
                    self.group(self.import_spec)
                else:
                    late = True
                    self.declaration(True)
                self.semi()
            except Bad as e:
                self.record(e)
                self.skip_to((";",))
                if self.i == before:
                    self.next()

    def name(self) -> None:
        if self.tok.kind != "id" or self.tok.value in _KEY:
            raise self.fail("expected a name" if self.tok.kind != "eof" else "end of text")
        self.next()

    def semi(self) -> None:
        if self.at(")", "}") or self.tok.kind == "eof":
            return
        self.need(";")

    def group(self, one) -> None:
        self.next()
        if self.eat("("):
            while not self.at(")"):
                if self.tok.kind == "eof":
                    raise self.fail("end of text inside a group")
                one()
                self.semi()
            self.next()
        else:
            one()

    def import_spec(self) -> None:
        if self.tok.kind == "id" or self.at("."):
            self.next()
        if self.tok.kind != "str":
            raise self.fail("expected a path to import")
        self.next()

    def declaration(self, top: bool) -> None:
        if self.at("var", "const"):
            const = self.tok.value == "const"
            self.group(lambda: self.value_spec(const))
        elif self.at("type"):
            self.group(self.type_spec)
        elif top and self.at("func"):
            self.next()
            if self.at("("):
                self.parameters()
            self.name()
            if self.at("["):
                self.type_parameters()
            self.signature()
            if self.at("{"):
                self.block()
        else:
            raise self.fail(f"unexpected {self.tok.value}" if self.tok.kind != "eof" else "end of text")

    def value_spec(self, const: bool) -> None:
        self.name()
        while self.eat(","):
            self.name()
        typed = False
        if not self.at("=", ";", ")"):
            self.type()
            typed = True
        if self.eat("="):
            self.expressions()
        elif not typed and not const:
            raise self.fail("variable without type or value")

    def type_spec(self) -> None:
        self.name()
        if self.at("[") and self.peek().kind == "id" and self.peek(2).kind != "op" or (self.at("[") and self.peek().kind == "id" and self.peek(2).value in (",", "*", "interface", "~", "[")):
            self.type_parameters()
        self.eat("=")
        self.type()

    def type_parameters(self) -> None:
        self.need("[")
        while not self.at("]"):
            self.name()
            while self.eat(","):
                self.name()
            self.constraint()
            if not self.at("]"):
                self.need(",")
        self.next()

    def constraint(self) -> None:
        while True:
            self.eat("~")
            self.type()
            if not self.eat("|"):
                return

    def type(self) -> None:
        if not self.try_type():
            raise self.fail("expected a type" if self.tok.kind != "eof" else "end of text")

    def try_type(self) -> bool:
        self.deeper()
        try:
            if self.eat("*"):
                self.type()
            elif self.eat("("):
                self.type()
                self.need(")")
            elif self.eat("["):
                if not self.at("]"):
                    if not self.eat("..."):
                        held, self.level = self.level, 0
                        self.expression()
                        self.level = held
                self.need("]")
                self.type()
            elif self.at("map") and self.peek().value == "[":
                self.next()
                self.next()
                self.type()
                self.need("]")
                self.type()
            elif self.eat("chan"):
                self.eat("<-")
                self.type()
            elif self.at("<-") and self.peek().value == "chan":
                self.next()
                self.next()
                self.type()
            elif self.eat("func"):
                self.signature()
            elif self.eat("struct"):
                self.struct()
            elif self.eat("interface"):
                self.interface()
            elif self.tok.kind == "id" and self.tok.value not in _KEY:
                self.next()
                if self.eat("."):
                    self.name()
                if self.at("[") and self.peek().value != "]":
                    self.next()
                    self.type()
                    while self.eat(","):
                        self.type()
                    self.need("]")
            else:
                return False
            return True
        finally:
            self.depth -= 1

    def struct(self) -> None:
        self.need("{")
        while not self.at("}"):
            if self.tok.kind == "eof":
                raise self.fail("end of text inside a struct")
            if self.at("*"):
                self.type()
            else:
                self.name()
                if self.eat("."):
                    self.name()
                elif not self.at(";", "}") and self.tok.kind != "str":
                    while self.eat(","):
                        self.name()
                    self.type()
            if self.tok.kind == "str":
                self.next()
            self.semi()
        self.next()

    def interface(self) -> None:
        self.need("{")
        while not self.at("}"):
            if self.tok.kind == "eof":
                raise self.fail("end of text inside an interface")
            if self.tok.kind == "id" and self.peek().value == "(":
                self.name()
                self.signature()
            else:
                self.constraint()
            self.semi()
        self.next()

    def signature(self) -> None:
        self.parameters()
        if self.at("("):
            self.parameters()
        elif not self.at("{"):
            self.try_type()

    def parameters(self) -> None:
        self.need("(")
        held, self.level = self.level, 0
        while not self.at(")"):
            self.eat("...")
            self.type()
            if not self.at(",", ")"):
                self.eat("...")
                self.type()
            if not self.at(")"):
                self.need(",")
        self.level = held
        self.next()

    # statements

    def block(self) -> None:
        self.deeper()
        held, self.level = self.level, 0
        self.need("{")
        while not self.at("}"):
            if self.tok.kind == "eof":
                raise self.fail("end of text inside a block")
            self.statement()
            self.semi()
        self.next()
        self.level = held
        self.depth -= 1

    def statement(self) -> None:
        t = self.tok
        v = t.value if t.kind in ("id", "op") else ""
        if v == ";" or v == "}":
            return
        if v in ("var", "const", "type"):
            self.declaration(False)
        elif v == "{":
            self.block()
        elif v == "if":
            self.branch()
        elif v == "for":
            self.next()
            held, self.level = self.level, -1
            if not self.at("{"):
                if self.eat("range"):
                    self.expression()
                else:
                    ranged = False
                    if not self.at(";"):
                        ranged = self.simple(True)
                    if not ranged and self.at(";"):
                        self.next()
                        if not self.at(";"):
                            self.expression()
                        self.need(";")
                        if not self.at("{"):
                            self.simple()
            self.level = held
            self.block()
        elif v == "switch":
            self.switch()
        elif v == "select":
            self.next()
            self.cases(True)
        elif v in ("go", "defer"):
            self.next()
            self.expression()
        elif v == "return":
            self.next()
            if not self.at(";", "}"):
                self.expressions()
        elif v in ("break", "continue", "goto"):
            self.next()
            if self.tok.kind == "id":
                self.next()
        elif v == "fallthrough":
            self.next()
        elif t.kind == "id" and v not in _KEY and self.peek().value == ":" and self.peek().kind == "op":
            self.next()
            self.next()
            if not self.at("}"):
                self.statement()
        elif v == "func" and self.peek().kind == "id":
            raise self.fail("a named function inside a function")
        else:
            self.simple()

    def branch(self) -> None:
        self.deeper()
        while True:  # arms of a chain lie beside each other, however many
            self.need("if")
            held, self.level = self.level, -1
            if self.at("{"):
                raise self.fail("if without a condition")
            if not self.at(";"):
                self.simple()
            if self.eat(";"):
                self.simple()
            self.level = held
            self.block()
            if not self.eat("else"):
                break
            if not self.at("if"):
                self.block()
                break
        self.depth -= 1

    def switch(self) -> None:
        self.next()
        held, self.level = self.level, -1
        if not self.at("{"):
            if not self.at(";"):
                self.simple()
            if self.eat(";") and not self.at("{"):
                self.simple()
        self.level = held
        self.cases(False)

    def cases(self, select: bool) -> None:
        self.deeper()
        self.need("{")
        while not self.at("}"):
            if self.eat("default"):
                pass
            elif self.eat("case"):
                if select:
                    self.simple()
                else:
                    while True:
                        if not (self.at("[", "map", "chan", "func", "struct", "interface", "*") and self.case_type()):
                            self.expression()
                        if not self.eat(","):
                            break
            else:
                raise self.fail("expected case" if self.tok.kind != "eof" else "end of text inside switch")
            self.need(":")
            while not self.at("case", "default", "}"):
                if self.tok.kind == "eof":
                    raise self.fail("end of text inside switch")
                self.statement()
                self.semi()
        self.next()
        self.depth -= 1

    def case_type(self) -> bool:
        start = self.i
        try:
            self.type()
            if self.at(",", ":"):
                return True
        except Bad:
            pass
        self.i = start
        return False

    def simple(self, loop: bool = False) -> bool:
        """A simple statement; in the head of a loop, whether it was a range clause."""
        self.expressions()
        if self.tok.kind == "op":
            v = self.tok.value
            if v in _ASSIGN:
                self.next()
                if loop and self.eat("range"):
                    self.expression()
                    return True
                self.expressions()
            elif v in ("++", "--"):
                self.next()
            elif v == "<-":
                self.next()
                self.expression()
        return False

    # expressions

    def expressions(self) -> None:
        self.expression()
        while self.eat(","):
            self.expression()

    def expression(self, least: int = 0) -> None:
        self.deeper()
        self.unary()
        while self.tok.kind == "op":
            p = _BINARY.get(self.tok.value)
            if p is None or p <= least:
                break
            self.next()
            self.expression(p)
        self.depth -= 1

    def unary(self) -> None:
        n = 0
        while self.at("+", "-", "!", "^", "*", "&", "<-", "~"):
            n += 1
            if n > 100:
                raise self.fail("nested too deeply")
            if self.at("<-") and self.peek().value == "chan":
                break
            self.next()
        self.operand()

    def operand(self) -> None:
        t = self.tok
        literal = False
        if t.kind in ("num", "str"):
            self.next()
        elif self.eat("("):
            held, self.level = self.level, 0
            if not (self.at("*", "[", "func", "map", "chan", "struct", "interface", "<-") and self.paren_type()):
                self.expression()
                self.need(")")
            self.level = held
        elif self.at("func"):
            self.next()
            self.signature()
            if self.at("{"):
                held, self.level = self.level, 0
                self.block()
                self.level = held
        elif self.at("[", "map", "chan", "struct", "interface", "<-"):
            self.type()
            literal = True
        elif t.kind == "id" and t.value not in _KEY:
            self.next()
            literal = True
        else:
            raise self.fail(f"unexpected {t.value}" if t.kind != "eof" else "end of text inside an expression")
        typed = t.kind == "op" or t.value in ("map", "struct")
        while True:
            if self.eat("."):
                if self.eat("("):
                    if not self.eat("type"):
                        self.type()
                    self.need(")")
                    literal = False
                else:
                    self.name()
            elif self.at("["):
                self.next()
                held, self.level = self.level, 0
                if self.at("]"):
                    raise self.fail("index without a value")
                if not self.at(":"):
                    if not (self.at("*", "[", "map", "func", "chan", "interface", "struct") and self.index_type()):
                        self.expression()
                while self.eat(":") or self.eat(","):
                    if not self.at("]", ":"):
                        if not (self.at("[", "map", "func", "chan", "interface", "*") and self.index_type()):
                            self.expression()
                self.level = held
                self.need("]")
            elif self.at("("):
                self.next()
                held, self.level = self.level, 0
                while not self.at(")"):
                    if not (self.at("[", "map", "chan", "*", "func", "interface", "struct", "<-") and self.call_type()):
                        self.expression()
                    self.eat("...")
                    if not self.at(")"):
                        self.need(",")
                self.next()
                self.level = held
                literal = False
            elif self.at("{") and literal and (self.level >= 0 or typed):
                self.literal()
                literal = False
            else:
                return

    def _type_until(self, *ends: str) -> bool:
        start, depth = self.i, self.depth
        try:
            self.type()
            if self.at(*ends):
                return True
        except Bad:
            pass
        self.i, self.depth = start, depth
        return False

    def paren_type(self) -> bool:
        if self._type_until(")"):
            self.next()
            return True
        return False

    def index_type(self) -> bool:
        return self._type_until("]", ",")

    def call_type(self) -> bool:
        return self._type_until(")", ",")

    def literal(self) -> None:
        self.deeper()
        held, self.level = self.level, 0
        self.need("{")
        while not self.at("}"):
            self.element()
            if self.eat(":"):
                self.element()
            if not self.at("}"):
                self.need(",")
        self.next()
        self.level = held
        self.depth -= 1

    def element(self) -> None:
        if self.at("{"):
            self.literal()
        else:
            self.expression()


def parse(text: str) -> list[tuple[int, str]]:
    toks, errors = clike.tokens(text, "go")
    toks += [toks[-1]] * 4
    Go(toks, errors).file()
    return errors
