"""What the parsers share: tokens, errors, panic-mode recovery."""

from __future__ import annotations

from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # id num str op tmpl regex nl indent dedent eof bad
    value: str
    line: int
    fresh: bool  # first on its line


class Bad(Exception):
    def __init__(self, line: int, cause: str):
        self.line, self.cause = line, cause


#: Deeper nesting than this counts as an error, so that no text can exhaust the stack; JSON has a stack of its own.
MAX_DEPTH = 1000


class Parser:
    """Recursive descent over tokens. A failed statement is recorded and skipped to the next safe token."""

    def __init__(self, tokens: list[Token], errors: list[tuple[int, str]]):
        self.t, self.i, self.errors, self.depth = tokens, 0, errors, 0

    @property
    def tok(self) -> Token:
        return self.t[self.i]

    def peek(self, n: int = 1) -> Token:
        return self.t[min(self.i + n, len(self.t) - 1)]

    def next(self) -> Token:
        got = self.t[self.i]
        if self.i < len(self.t) - 1:
            self.i += 1
        return got

    def fail(self, cause: str) -> Bad:
        return Bad(self.tok.line, cause)

    def at(self, *values: str) -> bool:
        k = self.t[self.i]
        return k.value in values and k.kind in ("op", "id")

    def eat(self, value: str) -> bool:
        if self.at(value):
            self.next()
            return True
        return False

    def need(self, value: str) -> Token:
        if not self.at(value):
            raise self.fail(f"expected {value}" if self.tok.kind != "eof" else f"end of text before {value}")
        return self.next()

    def need_id(self, cause: str = "expected a name") -> Token:
        if self.tok.kind != "id":
            raise self.fail(cause if self.tok.kind != "eof" else "end of text")
        return self.next()

    def deeper(self) -> None:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise self.fail("nested too deeply")

    def record(self, e: Bad) -> None:
        if not self.errors or self.errors[-1][0] != e.line:
            self.errors.append((e.line, e.cause))

    def skip_to(self, stops: tuple[str, ...], closer: str = "}") -> None:
        """Panic mode: past the next stop on this level, or up to the closer of the level."""
        level = 0
        start = self.i
        while self.tok.kind != "eof":
            v = self.tok.value if self.tok.kind == "op" else ""
            if level == 0 and v == closer and self.i > start:
                return
            if level == 0 and v in stops:
                self.next()
                return
            if v in ("{", "(", "["):
                level += 1
            elif v in ("}", ")", "]"):
                if level == 0:
                    if self.i == start:
                        self.next()
                    return
                level -= 1
                if level == 0 and v == "}":
                    self.next()
                    return
            elif level == 0 and self.i > start and self.tok.fresh and self.tok.kind == "id":
                return
            self.next()


def conflict(text: str) -> int:
    """The line of a merge conflict's marker, or 0."""
    for n, line in enumerate(text.split("\n"), 1):
        if line.startswith(("<<<<<<< ", ">>>>>>> ")) or line.rstrip() in ("<<<<<<<", ">>>>>>>"):
            return n
    return 0
