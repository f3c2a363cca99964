"""Java: declarations and statements by recursive descent, expressions by precedence climbing."""

from __future__ import annotations

from . import clike
from .base import Bad, Parser

_BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())
_PRIMITIVE = frozenset("int long short byte char boolean float double void".split())
_MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
_RESERVED = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
)


class Java(Parser):
    def unit(self) -> None:
        while self.tok.kind != "eof":
            before = self.i
            try:
                self.depth = 0
                self.top()
            except Bad as e:
                self.record(e)
                self.skip_to((";",))
                if self.i == before:
                    self.next()

    def top(self) -> None:
        if self.eat(";"):
            return
        if self.at("import"):
            self.next()
            self.eat("static")
            self.qualified()
            if self.eat("."):
                self.need("*")
            self.need(";")
            return
        self.modifiers()
        if self.eat("package"):
            self.qualified()
            self.need(";")
        elif not self.type_declaration():
            raise self.fail(f"unexpected {self.tok.value}" if self.tok.kind != "eof" else "end of text")

    def qualified(self) -> None:
        self.name()
        while self.at(".") and self.peek().kind == "id":
            self.next()
            self.next()

    def name(self) -> None:
        if self.tok.kind != "id" or self.tok.value in _RESERVED:
            raise self.fail("expected a name" if self.tok.kind != "eof" else "end of text")
        self.next()

    def modifiers(self) -> None:
        while True:
            if self.at("@") and self.peek().value != "interface":
                self.annotation()
            elif self.tok.kind == "id" and self.tok.value in _MODIFIERS and not (self.tok.value == "default" and self.peek().value in (":", "->")):
                if self.tok.value == "sealed" and self.peek().kind != "id":
                    return
                self.next()
            elif self.at("non") and self.peek().value == "-":
                self.next()
                self.next()
                self.next()
            else:
                return

    def annotation(self) -> None:
        self.need("@")
        self.qualified()
        if self.eat("("):
            while not self.at(")"):
                if self.tok.kind == "id" and self.peek().value == "=":
                    self.next()
                    self.next()
                self.element()
                if not self.at(")"):
                    self.need(",")
            self.next()

    def element(self) -> None:
        if self.at("@"):
            self.annotation()
        elif self.at("{"):
            self.initializer(self.element)
        else:
            self.ternary()

    def initializer(self, one) -> None:
        self.need("{")
        while not self.at("}"):
            one()
            if not self.at("}"):
                self.need(",")
        self.next()

    def type_declaration(self) -> bool:
        if self.at("class", "interface", "enum") or (self.at("record") and self.peek().kind == "id" and self.peek(2).value in ("(", "<")) or (self.at("@") and self.peek().value == "interface"):
            self.eat("@")
            kind = self.next().value
            self.name()
            if self.at("<"):
                self.type_parameters()
            if kind == "record":
                self.parameters()
            while self.at("extends", "implements", "permits"):
                self.next()
                self.type()
                while self.eat(","):
                    self.type()
            self.body(kind == "enum")
            return True
        return False

    def type_parameters(self) -> None:
        self.need("<")
        while not self.at(">"):
            self.modifiers()
            self.name()
            if self.eat("extends"):
                self.type()
                while self.eat("&"):
                    self.type()
            if not self.at(">"):
                self.need(",")
        self.next()

    def body(self, enum: bool = False) -> None:
        self.deeper()
        self.need("{")
        if enum:
            while self.tok.kind == "id" or self.at("@"):
                self.modifiers()
                self.name()
                if self.at("("):
                    self.arguments()
                if self.at("{"):
                    self.body()
                if not self.eat(","):
                    break
            if not self.at("}"):
                self.need(";")
        while not self.at("}"):
            if self.tok.kind == "eof":
                raise self.fail("end of text inside a class")
            self.member()
        self.next()
        self.depth -= 1

    def member(self) -> None:
        if self.eat(";"):
            return
        self.modifiers()
        if self.at("{"):
            self.block()
            return
        if self.type_declaration():
            return
        if self.at("<"):
            self.type_parameters()
        if self.tok.kind == "id" and self.peek().value in ("(", "{") and self.peek().kind == "op" and self.tok.value not in _RESERVED:
            self.name()  # a constructor
            if self.at("("):
                self.parameters()
            self.throws()
            self.block()
            return
        self.type(True)
        self.name()
        if self.at("("):
            self.parameters()
            self.brackets()
            self.throws()
            if self.eat("default"):
                self.element()
            if self.at("{"):
                self.block()
            else:
                self.need(";")
            return
        self.declarators()
        self.need(";")

    def throws(self) -> None:
        if self.eat("throws"):
            self.type()
            while self.eat(","):
                self.type()

    def brackets(self) -> None:
        while self.at("[") and self.peek().value == "]":
            self.next()
            self.next()

    def declarators(self) -> None:
        """After the first name."""
        while True:
            self.brackets()
            if self.eat("="):
                self.variable_value()
            if not self.eat(","):
                return
            self.name()

    def variable_value(self) -> None:
        if self.at("{"):
            self.initializer(self.variable_value)
        else:
            self.expression()

    def parameters(self) -> None:
        self.need("(")
        while not self.at(")"):
            self.modifiers()
            self.type()
            self.modifiers()
            self.eat("...")
            if self.eat("this"):
                pass
            else:
                self.name()
                self.brackets()
            if not self.at(")"):
                self.need(",")
        self.next()

    def type(self, void: bool = False) -> None:
        end = self.type_end(self.i, void)
        if end < 0:
            raise self.fail("expected a type" if self.tok.kind != "eof" else "end of text")
        self.i = end

    def type_end(self, i: int, void: bool = False, depth: int = 0) -> int:
        """Index behind a type that begins at i, or -1. A >> of nested arguments comes as single tokens."""
        t = self.t
        if depth > 60:
            return -1
        while t[i].value == "@" and t[i].kind == "op":
            i += 2
            while t[i].value == "." and t[i].kind == "op":
                i += 2
        if t[i].kind != "id":
            return -1
        if t[i].value in _PRIMITIVE:
            if t[i].value == "void" and not void and t[i + 1].value != ".":
                return -1
            i += 1
        elif t[i].value in _RESERVED:
            return -1
        else:
            while True:
                if t[i].kind != "id" or t[i].value in _RESERVED:
                    return -1
                i += 1
                if t[i].value == "<" and t[i].kind == "op":
                    i += 1
                    if t[i].value == ">":
                        i += 1
                    else:
                        while True:
                            if t[i].value == "?" and t[i].kind == "op":
                                i += 1
                                if t[i].value in ("extends", "super"):
                                    i = self.type_end(i + 1, False, depth + 1)
                            else:
                                i = self.type_end(i, False, depth + 1)
                            if i < 0:
                                return -1
                            if t[i].value == "," or t[i].value == "&":
                                i += 1
                                continue
                            if t[i].value == ">" and t[i].kind == "op":
                                i += 1
                                break
                            return -1
                if t[i].value == "." and t[i + 1].kind == "id" and t[i + 1].value not in ("class", "this", "super", "new"):
                    i += 1
                    continue
                break
        while t[i].value == "[" and t[i].kind == "op" and t[i + 1].value == "]":
            i += 2
        return i

    # statements

    def block(self) -> None:
        self.deeper()
        self.need("{")
        while not self.at("}"):
            if self.tok.kind == "eof":
                raise self.fail("end of text inside a block")
            self.statement()
        self.next()
        self.depth -= 1

    def local(self) -> bool:
        """A declaration of local variables, without its ;."""
        start = self.i
        if self.at("final", "@"):
            self.modifiers()
        end = self.type_end(self.i)
        if end < 0 or self.t[end].kind != "id" or self.t[end].value in _RESERVED or self.t[end + 1].value not in ("=", ";", ",", "[", ":", ")") or self.t[end].value == "instanceof":
            if self.t[self.i].kind == "id" and end > 0 and self.t[end].kind == "id" and self.t[end].value not in _RESERVED:
                self.i = end + 1
                raise self.fail("expected ; or =")
            self.i = start
            return False
        self.i = end
        self.name()
        self.declarators()
        return True

    def statement(self) -> None:
        self.deeper()
        t = self.tok
        v = t.value if t.kind in ("id", "op") else ""
        if v == "{":
            self.block()
        elif v == ";":
            self.next()
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
        elif v == "while":
            self.next()
            self.head()
            self.statement()
        elif v == "do":
            self.next()
            self.statement()
            self.need("while")
            self.head()
            self.need(";")
        elif v == "for":
            self.loop()
        elif v == "switch":
            self.switch(False)
        elif v == "return" or v == "throw":
            self.next()
            if not self.at(";"):
                self.expression()
            elif v == "throw":
                raise self.fail("throw without a value")
            self.need(";")
        elif v in ("break", "continue"):
            self.next()
            if self.tok.kind == "id":
                self.next()
            self.need(";")
        elif v == "yield" and not (self.peek().kind == "op" and self.peek().value in ("=", ".", "(", "++", "--")):
            self.next()
            self.expression()
            self.need(";")
        elif v == "try":
            self.tries()
        elif v == "synchronized" and self.peek().value == "(":
            self.next()
            self.head()
            self.block()
        elif v == "assert":
            self.next()
            self.expression()
            if self.eat(":"):
                self.expression()
            self.need(";")
        elif t.kind == "id" and v not in _RESERVED and self.peek().value == ":" and self.peek().kind == "op":
            self.next()
            self.next()
            self.statement()
        elif v in ("class", "interface", "enum", "abstract", "static") or (v == "final" and self.peek().value == "class") or (v == "record" and self.peek(2).value == "("):
            self.modifiers()
            if not self.type_declaration():
                raise self.fail("expected a declaration")
        elif self.local():
            self.need(";")
        else:
            if t.kind in ("str", "num"):
                raise self.fail("no statement")
            self.expression()
            self.need(";")
        self.depth -= 1

    def head(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def loop(self) -> None:
        self.next()
        self.need("(")
        if not self.at(";"):
            if not self.local():
                self.expression()
                while self.eat(","):
                    self.expression()
        if self.eat(":"):
            self.expression()
        else:
            self.need(";")
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at(")"):
                self.expression()
                while self.eat(","):
                    self.expression()
        self.need(")")
        self.statement()

    def tries(self) -> None:
        self.next()
        some = False
        if self.eat("("):
            some = True
            while not self.at(")"):
                if not self.local():
                    self.expression()
                if not self.at(")"):
                    self.need(";")
            self.next()
        self.block()
        while self.eat("catch"):
            some = True
            self.need("(")
            self.modifiers()
            self.type()
            while self.eat("|"):
                self.type()
            self.name()
            self.need(")")
            self.block()
        if self.eat("finally"):
            some = True
            self.block()
        if not some:
            raise self.fail("try without catch")

    def switch(self, value: bool) -> None:
        self.need("switch")
        self.head()
        self.need("{")
        while not self.at("}"):
            if self.eat("default"):
                pass
            elif self.eat("case"):
                while True:
                    if not self.pattern():
                        self.eat("default") or self.ternary()
                    if not self.eat(","):
                        break
                if self.eat("when"):
                    self.ternary()
            else:
                raise self.fail("expected case" if self.tok.kind != "eof" else "end of text inside switch")
            if self.eat("->"):
                if self.at("{"):
                    self.block()
                elif self.at("throw"):
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                while not self.at("case", "default", "}"):
                    if self.tok.kind == "eof":
                        raise self.fail("end of text inside switch")
                    self.statement()
        self.next()

    def pattern(self) -> bool:
        start = self.i
        if self.at("final"):
            self.modifiers()
        end = self.type_end(self.i)
        if end > 0 and self.t[end].kind == "id" and self.t[end].value not in _RESERVED and self.t[end].value != "when":
            self.i = end + 1
            return True
        if end > 0 and self.t[end].value == "(" and self.t[end - 1].kind == "id" and self.t[end - 1].value[:1].isupper():
            self.i = end + 1
            while not self.at(")"):
                if not self.pattern():
                    self.i = start
                    return False
                self.eat(",")
            self.next()
            if self.tok.kind == "id" and self.tok.value not in _RESERVED and self.tok.value != "when":
                self.next()
            return True
        self.i = start
        return False

    # expressions

    def expression(self) -> None:
        self.deeper()
        if self.lambda_():
            self.depth -= 1
            return
        simple = self.ternary()
        if self.tok.kind == "op" and (self.tok.value in _ASSIGN or (self.tok.value == ">" and self.peek().value == ">=")):
            if not simple:
                raise self.fail("assignment to what is no target")
            if self.next().value == ">":
                self.next()
            self.expression()
        self.depth -= 1

    def lambda_(self) -> bool:
        t, i = self.t, self.i
        if t[i].kind == "id" and t[i].value not in _RESERVED and t[i + 1].value == "->":
            self.i = i + 2
        elif t[i].value == "(" and t[i].kind == "op":
            level, k = 0, i
            while t[k].kind != "eof":
                if t[k].kind == "op":
                    if t[k].value == "(":
                        level += 1
                    elif t[k].value == ")":
                        level -= 1
                        if not level:
                            break
                    elif t[k].value in (";", "{"):
                        return False
                k += 1
            if t[k].kind == "eof" or t[k + 1].value != "->":
                return False
            self.next()
            while not self.at(")"):
                if self.tok.kind == "id" and self.peek().value in (",", ")"):
                    self.next()
                else:
                    self.modifiers()
                    self.type()
                    self.eat("...")
                    self.name()
                if not self.at(")"):
                    self.need(",")
            self.next()
            self.need("->")
        else:
            return False
        if self.at("{"):
            self.block()
        else:
            self.expression()
        return True

    def ternary(self) -> bool:
        simple = self.binary(0)
        if self.eat("?"):
            self.expression()
            self.need(":")
            if not self.lambda_():
                self.ternary()
            return False
        return simple

    def binary(self, least: int) -> bool:
        simple = self.unary()
        while True:
            t = self.tok
            v, width = t.value, 1
            if v == ">" and t.kind == "op" and self.peek().value == ">" and self.peek().kind == "op":
                if self.peek(2).value in (">=", ">>="):
                    return simple
                width = 3 if self.peek(2).value == ">" else 2
                v = ">>"
            elif v == ">" and self.peek().value == ">=":
                return simple
            p = _BINARY.get(v) if t.kind in ("op", "id") else None
            if p is None or p <= least:
                return simple
            for _ in range(width):
                self.next()
            if v == "instanceof":
                if self.at("final"):
                    self.modifiers()
                if not self.pattern():
                    self.type()
            else:
                self.binary(p)
            simple = False

    def unary(self) -> bool:
        self.deeper()
        try:
            if self.at("+", "-", "!", "~"):
                self.next()
                self.unary()
                return False
            if self.at("++", "--"):
                self.next()
                if not self.unary():
                    raise self.fail("no target to change")
                return False
            if self.at("(") and self.cast():
                return False
            if self.at("switch"):
                self.switch(True)
                return False
            simple = self.suffixes(self.primary())
            while self.at("++", "--"):
                if not simple:
                    raise self.fail("no target to change")
                self.next()
                simple = False
            return simple
        finally:
            self.depth -= 1

    def cast(self) -> bool:
        end = self.type_end(self.i + 1)
        if end < 0:
            return False
        while self.t[end].value == "&":
            end = self.type_end(end + 1)
            if end < 0:
                return False
        if self.t[end].value != ")" or self.t[end].kind != "op":
            return False
        after = self.t[end + 1]
        primitive = self.t[self.i + 1].value in _PRIMITIVE and end == self.i + 2
        ok = after.kind in ("str", "num") or (after.kind == "id" and after.value != "instanceof") or (after.kind == "op" and (after.value in ("(", "!", "~") or (primitive and after.value in ("+", "-", "++", "--"))))
        if not ok:
            return False
        self.i = end + 1
        if not self.lambda_():
            self.unary()
        return True

    def arguments(self) -> None:
        self.need("(")
        while not self.at(")"):
            self.expression()
            if not self.at(")"):
                self.need(",")
        self.next()

    def primary(self) -> bool:
        t = self.tok
        if t.kind in ("num", "str"):
            self.next()
            return False
        if t.kind == "id":
            v = t.value
            if v in ("true", "false", "null", "this", "super"):
                self.next()
                if v in ("this", "super") and self.at("("):
                    self.arguments()
                return False
            if v == "new":
                self.creation()
                return False
            if v in _PRIMITIVE:
                end = self.type_end(self.i, True)
                if end > 0 and (self.t[end].value == "::" or (self.t[end].value == "." and self.t[end + 1].value == "class")):
                    self.i = end
                    return False
                raise self.fail(f"unexpected {v}")
            if v in _RESERVED:
                raise self.fail(f"unexpected {v}")
            end = self.type_end(self.i)
            if end > self.i + 1 and (self.t[end].value == "::" or (self.t[end].value == "." and self.t[end + 1].value == "class")):
                self.i = end
                return False
            self.next()
            if self.at("("):
                self.arguments()
                return False
            return True
        if self.eat("("):
            self.expression()
            self.need(")")
            return True
        raise self.fail(f"unexpected {t.value}" if t.kind != "eof" else "end of text inside an expression")

    def creation(self) -> None:
        self.need("new")
        t = self.t
        i = self.i
        while t[i].value == "@":
            i += 2
        # the type without its brackets
        while True:
            if t[i].kind != "id":
                self.i = i
                raise self.fail("expected a type")
            i += 1
            if t[i].value == "<":
                close = self.type_end(i - 1)
                if close > 0:
                    while t[close - 1].value == "]":
                        close -= 2
                    i = close
            if t[i].value == "." and t[i].kind == "op":
                i += 1
                continue
            break
        self.i = i
        if self.at("["):
            sized = False
            while self.eat("["):
                if not self.at("]"):
                    self.expression()
                    sized = True
                self.need("]")
            if self.at("{") and not sized:
                self.initializer(self.variable_value)
            return
        self.arguments()
        if self.at("{"):
            self.body()

    def suffixes(self, simple: bool) -> bool:
        while True:
            if self.eat("."):
                if self.at("<"):
                    self.next()
                    while not self.at(">"):
                        self.type()
                        if not self.at(">"):
                            self.need(",")
                    self.next()
                if self.at("new"):
                    self.creation()
                    simple = False
                    continue
                if self.at("class", "this", "super"):
                    self.next()
                    simple = False
                    continue
                self.name()
                simple = True
                if self.at("("):
                    self.arguments()
                    simple = False
            elif self.eat("["):
                self.expression()
                self.need("]")
                simple = True
            elif self.eat("::"):
                if not self.eat("new"):
                    self.name()
                simple = False
            else:
                return simple


def parse(text: str) -> list[tuple[int, str]]:
    toks, errors = clike.tokens(text, "java")
    toks += [toks[-1]] * 4  # room to look ahead
    Java(toks, errors).unit()
    return errors
