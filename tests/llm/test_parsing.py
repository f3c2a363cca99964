import pytest

from lexisift.llm import parsing as pa
from lexisift.llm.syntax.base import MAX_DEPTH

GOOD = {
    "python": "import os\n@d(1)\nasync def f(a: int, /, b=2, *c, d, **e) -> None:\n    async with x as y, z:\n        return [i async for i in y if i]\n\nclass A(B, metaclass=C):\n    x: int = 1\n\n    def g(self): return lambda *a, k=1: (yield)\n\ntry:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    del a[0], b.c\nmatch p:\n    case {'a': [1, *_], **r} if r:\n        pass\n    case A(x=1) | None:\n        pass\nprint(f'{a!r:>{w}} {b[\"k\"]}', *a, **k)\nx = y = 1 if a else (b := 2)\na[1:2, ::3] **= -1\nglobal q; type T = int\nwith (open(a) as f, open(b) as g):\n    pass\nif x:\n\ty = {**a, 'b': 1}; z = {1, *s}\n",
    "javascript": "#!/usr/bin/env node\n'use strict'\nimport a, { b as c, default as d } from './x.js'\nexport default class A extends B(1) { static #p = 1; get x() { return this.#p } static async *g() { yield* h() } static { f() } }\nconst { a: [x = 1, ...r], ...o } = y, re = /[/\\]]+/gi\nlet f = async ({ q }, ...z) => ({ ...q, [k]: 1, get v() { return 2 }, async m() {} })\nfor (const [k, v] of Object.entries(o)) if (k in v) continue; else break\nlabel: do { x?.y?.[0]?.(1) ?? `t${`n${1}`}` } while (a)\nswitch (x) { case 1: default: throw new Error }\ntry { f() } catch { } finally { }\na = b ? c : d => e\nvar x1 = 0x1fn, y2 = 1_000.5e-3\nif (a) /re/.test(b)\ntag`x`; new.target; import('x')\n!function (w) { w.a = 1 }(this)\n",
    "java": "package a.b;\nimport static java.util.Map.*;\n@A(x = {1, 2}) public final class C<T extends D & E> extends F<T> implements G, H {\n  private static final int[] a[] = {{1}, {2}}, b;\n  static { x(); }\n  C(int... a) throws X { this(); }\n  <K> Map<K, List<? super T>> m(final K k) { return (Map<K, List<? super T>>) k; }\n  int f(Object o) {\n    for (int i = 0, j = 1; i < j; i++, j--) continue;\n    for (var x : o.<String>y()) { if (x instanceof String s && !s.isEmpty()) break; }\n    int v = switch (o) { case Integer i when i > 1 -> i; case A(var p, B q) -> { yield 2; } default -> throw new E(); };\n    Runnable r = () -> { }, q = this::f; Function<int[], String> g = int[]::toString;\n    try (var in = new X(); out) { synchronized (this) { assert a : b; } } catch (final A | B e) { throw e; } finally { }\n    new Thread() { public void run() { } }.start(); a[0] >>>= 1; x = (int) -1 >> 2 > 3 ? 'c' : '\\u0041';\n    String t = \"\"\"\n      x \"y\"\n      \"\"\"; do ; while (true); do_: while (a) break do_; int[][] z = new int[3][];\n    return a < b ? c.class.x : d;\n  }\n}\nenum E { A(1) { int x; }, B; int y; }\nrecord R<T>(int a, T b) implements I { R { } }\nsealed interface S permits T { default int f() { return 1; } int X = 1; }\n@interface N { int v() default 1; }\n",
    "go": "package main\n\nimport (\n\t\"fmt\"\n\t. \"os\"\n)\n\ntype (\n\tA struct {\n\t\tB, C int `json:\"b\"`\n\t\t*D\n\t\te.F\n\t}\n\tG[T ~int | string] interface {\n\t\tM(a, b int, c ...string) (x int, err error)\n\t\tH\n\t}\n\tI = map[string][]func(int) <-chan bool\n)\n\nconst (\n\tX = iota\n\tY\n)\n\nvar a, b = 1, []int{1, 2: 3}\n\nfunc (r *A) F(x interface{}) (n int) {\n\tif v, ok := x.(int); ok && v > 1 {\n\t\treturn\n\t} else if x == (A{}) {\n\t\tgoto L\n\t}\n\tfor i := range 10 {\n\t\t_ = i\n\t}\n\tfor k, v := range m {\n\t\tm[k] = v[1:2:3]\n\t}\n\tfor ; ; {\n\t\tbreak\n\t}\n\tswitch y := x.(type) {\n\tcase []int, nil:\n\t\tfallthrough\n\tdefault:\n\t\ty++\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase v, ok := <-c:\n\t}\nL:\n\tdefer func() { recover() }()\n\tgo f(a...)\n\tz := &B{Q: []D{{1}, {2}}}\n\tw := make(chan<- int, 1)\n\treturn int(x) << 2 &^ 3\n}\n",
    "json": '{"a": [1, -2.5e+3, true, null, "\\u00e9\\n"], "b": {}}',
    "yaml": "# c\n%YAML 1.2\n---\na: 1\nb:\n- x: &k 1\n  y: *k\n- - 1\n  - \"two: three\"\n-\n  z: |\n    text: [\n     more\n  w: >-\n    x\nc: {a: [1, 2], 'b': \"c\"}\nd: plain text\n  goes on\n\"e f\": !t x\n? g\n: h\n...\n",
    "xml": '<?xml version="1.0"?>\n<!DOCTYPE a [<!ENTITY e "x">]>\n<!-- c -->\n<a x="1" y=\'&amp;\'><b/>&e;&#65;<![CDATA[<x>&]]></a>\n',
    "toml": 'a = 1\n"b c".d = [1, 2, # c\n "x",]\ne = {f = 1, g = "h"}\ni = 1979-05-27T07:32:00Z\nj = """x\n"y" """\n[k.l]\nm = \'c:\\x\'\n[[n]]\no = 0x1F\n[[n]]\no = +inf\n',
}
BAD = {
    "python": ["def f(:\n  pass\n", "x = (1,\n", "if x\n  y\n", "print 'a'\n", "  x = 1\n", "def f():\npass\n", "x = 1 +\n", "'abc\n", "f(a=1, 2)\n", "a b\n", "1 = x\n", "<<<<<<< HEAD\nx = 1\n", "for x in y:\n"],
    "javascript": ["function f( {", "const x;", "let a = ;", "if (a { b }", "a b", "`abc", "x = {a: 1,, b}", "class { }", "<<<<<<< HEAD\nx\n", "1 = 2", "try { }", "import json\nimport os\n"],
    "java": ["class A { void f( }", "class A { int x = ; }", "class A { void f() { if (a) }", "import x", "class A { void f() { int x y; } }", "# title", "class A {"],
    "go": ["package", "func f() {}", "package a\nfunc f( {\n}\n", "package a\nvar x\n", "package a\nfunc f() {\n\tx := \n}\n", "package a\nfunc f() {\n", "package a\nimport \"x\ny"],
    "json": ['{"a": 1,}', "[1 2]", "{a: 1}", '{"a": 01}', "", "[1", "// c\n{}", '{"a": NaN}', "{} {}"],
    "yaml": ["a: 1\n b: 2\n", "a: [1, 2\nb: 3\n", "a: \"x\nb: 2\n", "a: b: c\n", "- a\nb: 1\n", "a:\n\t- b\n", "a: 1\na: 2\n", "x: }\n", "<<<<<<< HEAD\na: 1\n=======\n"],
    "xml": ["<a><b></a>", "<a x=1/>", "<a>&x;</a>", "<a/><b/>", "", "<a", "<a><!-- -- --></a>", "text"],
    "toml": ["a = ", "a 1", "[a", "a = [1, 2", 'a = "x', "a = 1\na = 2", "a = 1 b = 2", "# ok\n- x"],
}


@pytest.mark.parametrize("language", sorted(GOOD))
def test_good(language):
    assert pa.PARSERS[language](GOOD[language]) == []
    if language not in ("json", "yaml"):
        assert pa.PARSERS[language](GOOD[language].replace("\n", "\r\n")) == []


@pytest.mark.parametrize("language, text", [(k, t) for k, ts in BAD.items() for t in ts])
def test_bad(language, text):
    errors = pa.errors_of(text, language)
    assert errors and errors[0][0] >= 1


@pytest.mark.parametrize("language", sorted(GOOD))
def test_truncation_never_crashes(language):
    text = GOOD[language]
    for cut in range(0, len(text), 7):
        pa.errors_of(text[:cut], language)


def test_deep_nesting_is_an_error_not_a_crash():
    n = MAX_DEPTH * 40
    for language, text in (("json", "[" * n), ("python", "(" * n), ("javascript", "[" * n), ("java", "class A { int x = " + "(" * n), ("go", "package a\nvar x = " + "(" * n), ("toml", "a = " + "[" * n), ("yaml", "a: " + "[" * n), ("xml", "<a>" * n)):
        assert pa.errors_of(text, language)


def test_all_errors_are_kept():
    errors = pa.errors_of("x = (1\n\n\ny = 2\n", "python")
    assert errors
    several = pa.PARSERS["javascript"]("let a = ;\nlet b = 1;\nlet c = ;\n")
    assert [e[0] for e in several] == [1, 3]


@pytest.mark.parametrize("language, head, arm, tail", [("javascript", "", "if (a == 1) { f() }", "else f()"), ("java", "class A { void f() { ", "if (a == 1) { f(); }", "else f(); } }"), ("go", "package a\nfunc f() { ", "if a == 1 { f() }", "else { f() } }")])
def test_long_chains_of_else_if_are_no_errors(language, head, arm, tail):
    assert pa.errors_of(f"{head}{' else '.join([arm] * 2000)} {tail}\n", language) == []


def test_json_has_no_bound_of_depth_or_errors():
    n = 20_000
    assert pa.errors_of("[" * n + "]" * n, "json") == [] and pa.errors_of('{"a":[' * n + "]}" * n, "json") == []
    # line 1 is open to the end; each of the further lines is wrong, but the one in the middle
    text = "{x}\n" + '{"a" 1},\n' * 60 + '"ok": 1,\n' + '{"a" 1},\n' * 60
    lines = [e[0] for e in pa.errors_of(text, "json")]
    assert set(range(2, 62)) | set(range(63, 123)) <= set(lines) and 62 not in lines


@pytest.mark.parametrize("language, head, tail", [("javascript", "x = ", "\n"), ("java", "class A { int x = ", "; }"), ("go", "package a\nvar x = ", "\n"), ("yaml", "a: ", "")])
def test_nesting_of_400_is_no_error(language, head, tail):
    assert pa.errors_of(f"{head}{'(['[language == 'yaml'] * 400}1{')]'[language == 'yaml'] * 400}{tail}", language) == []


def test_columns_and_rates(spark):
    rows = [(1, "r", "a.py", "x = 1\n"), (2, "r", "b.py", "x = (\n"), (3, "r", "c.txt", "("), (4, "q", "d.JSON", None), (5, "q", "e.mjs", ""), (6, None, "f.json", "{}"), (7, "r", None, "x")]
    df = pa.check(spark.createDataFrame(rows, "i int, repo string, p string, t string"), "t", "p")
    assert {r["i"]: r["syntax"] and min(r["syntax"]["n_errors"], 1) for r in df.collect()} == {1: 0, 2: 1, 3: None, 4: None, 5: 0, 6: 0, 7: None}
    assert {(r["repo"], r["language"]): (r["n_files"], r["n_invalid"], r["invalid_rate"]) for r in pa.rates(df, "repo").collect()} == {("r", "python"): (2, 1, 0.5), ("q", "javascript"): (1, 0, 0.0), (None, "json"): (1, 0, 0.0)}


SOUND = {
    "python": 'import os\n\n\nclass A:\n    def f(self, x, *, y=1):\n        if x and (y or not x):\n            return [i for i in range(x) if i % 2]\n        with open("a") as g:\n            print(f"{x!r:>{y}}", g, sep="")\n\n\nasync def h():\n    async for k in z():\n        yield k\n',
    "json": '{"a": [1, 2.5e3, -4, true, null], "b": {"c": "x\\\\n\\\\u00e9", "d": {}}, "e": []}\n',
    "toml": 'a = 1\nb = [1, 2,\n 3]\n[t.x]\nd = 2020-01-01T00:00:00Z\n"q r" = "s"\n[[u]]\nv = {w = 1, y = "z"}\n',
}


def sound(text, language):
    import json
    import tomllib

    try:
        if language == "python":
            compile(text, "f", "exec", dont_inherit=True, flags=0x400)
        else:
            (json if language == "json" else tomllib).loads(text)
        return True
    except (SyntaxError, ValueError):
        return False


def test_parsers_agree_with_the_readers_on_damaged_text(monkeypatch):
    """The parser alone, without the reader's confirmation, on texts that are cut, lack or double characters, or mix tabs in."""
    import random
    import warnings

    from lexisift.llm import parsing

    warnings.simplefilter("ignore")
    monkeypatch.setattr(parsing, "_confirmed", lambda text, language: True)
    r = random.Random(3)
    for language, text in SOUND.items():
        assert sound(text, language) and not parsing.errors_of(text, language)
        for _ in range(150):
            k, way = r.randrange(len(text)), r.randrange(4)
            bad = (text[:k], text[:k] + text[k + 1 :], text[:k] + r.choice("(){}[]:,\"'=\t ") + text[k:], text.replace("    ", "\t", r.randrange(1, 4)))[way]
            assert sound(bad, language) == (not parsing.errors_of(bad, language)), (language, bad)


def test_mixed_tabs():
    from lexisift.llm import parsing

    assert parsing.errors_of("if x:\n        a = 1\n\tb = 2\n", "python")
    assert not parsing.errors_of("if x:\n\ta = 1\n\tif y:\n\t    b = 2\n", "python")
