import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexisift.operators import spans as sp
from lexisift.operators import verdicts
from lexisift.operators.rules import Boost, Pattern, Rule, RuleBook, evaluate, matches
from lexisift.sources.rulefiles import from_environment, merged, rule_of


def spans_of(spark, texts, build):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", build(F.col("t")).alias("s"))
    return [None if r["s"] is None else [(s["start_pos"], s["end_pos"], s["matched"]) for s in r["s"]] for r in df.orderBy("i").collect()]


def test_keyword_spans(spark):
    assert [s[:2] for s in spans_of(spark, ["aaa bbb aaa ccc aaa"], lambda c: sp.keyword_spans(c, "AAA"))[0]] == [(0, 3), (8, 11), (16, 19)]
    assert spans_of(spark, [None, ""], lambda c: sp.keyword_spans(c, "a")) == [None, []]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab1é\n😀 ", max_size=30), min_size=1, max_size=20))
def test_regex_spans_agree_with_python(spark, texts):
    for pattern in (r"a+b?", r"[0-9]", r"é|😀"):
        got = spans_of(spark, texts, lambda c: sp.regex_spans(c, pattern, None))
        assert got == [[(m.start(), m.end(), m[0]) for m in re.finditer(pattern, t, re.I)] for t in texts]


def test_entropy_spans(spark):
    got = spans_of(spark, ["key aB3dEfGhIjKlMnOpQrStUvWxYz end", "aaaaaaaaaaaaaaaa"], lambda c: sp.entropy_spans(c, 4.5, 12))
    assert [s[2] for s in got[0]] == ["aB3dEfGhIjKlMnOpQrStUvWxYz"] and got[1] == []


def test_modes():
    assert sp.mode_of("near:30") == ("near", 30) and sp.mode_of("near:x") == ("near", 500) and sp.mode_of("odd") == ("and", 0)


def fired(spark, texts, *rules, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = evaluate(df, list(rules), "t", **kw).orderBy("i").collect()
    return [None if r["results"] is None else [x["rule_id"] for x in r["results"]] for r in out]


def key(w, c=0.8):
    return Pattern("keyword", w, c)


def test_rule_conditions(spark):
    rx = Rule("I-01", "secret", "P0", "block", (Pattern("regex", r"\bsecret\b", 0.9),))
    assert fired(spark, ["my secret password", "hello", None, ""], rx) == [["I-01"], [], None, []]
    assert fired(spark, ["A" * 11, "A" * 10], Rule("I-43", "long", no_pattern=True, max_length=10, action="truncate")) == [["I-43"], []]
    assert fired(spark, ["ab", "a"], Rule("I-02", "both", patterns=(key("a"), key("b")), mode="all")) == [["I-02"], []]
    assert fired(spark, ["a x", "a X"], Rule("I-03", "excluded", patterns=(key("a"),), exclusions=("x",))) == [[], ["I-03"]]
    assert fired(spark, ["a"], Rule("I-04", "sure beyond sure", patterns=(key("a", 1.5),))) == [[]]
    assert fired(spark, ["4111-1111-1111-1111", "1234-5678-9012-3456"], Rule("I-14", "card", patterns=(Pattern("regex", r"[0-9-]{19}"),), luhn_check=True)) == [["I-14"], []]


def test_first_pattern_wins_and_cap(spark):
    r = Rule("I-05", "first", patterns=(key("b"), key("a")), max_matches=2)
    df = spark.createDataFrame([(1, "a b b b")], "i int, t string")
    assert [tuple(x) for x in matches(evaluate(df, [r], "t"), "i").select("pattern_idx", "start_pos").collect()] == [(0, 2), (0, 4)]


def test_composites(spark):
    near = Pattern("composite", "near:5", 0.9, sub_patterns=(key("a"), key("b")))
    no = Pattern("composite", "not", 0.9, sub_patterns=(key("z"), key("b")))
    either = Pattern("composite", "or", 0.9, sub_patterns=(key("z", 0.0), key("b")))
    assert fired(spark, ["a b", "a" + "." * 9 + "b", "b"], Rule("I-06", "near", patterns=(near,))) == [["I-06"], [], []]
    assert fired(spark, ["b", "zb", "a"], Rule("I-07", "not", patterns=(no,))) == [["I-07"], [], []]
    assert fired(spark, ["b", "zb"], Rule("I-08", "or", patterns=(either,))) == [["I-08"], []]


def test_language_filter(spark):
    df = spark.createDataFrame([(1, "a", "en", 0.9), (2, "a", "de", 0.9), (3, "a", "de", 0.1), (4, "a", None, 0.9)], "i int, t string, l string, c double")
    out = evaluate(df, [Rule("I-09", "english", patterns=(key("a"),), languages=("en",))], "t", language="l", certainty="c")
    assert [len(r["results"]) for r in out.orderBy("i").collect()] == [1, 0, 1, 1]


def test_validation():
    for bad in ({"id": "x"}, {"severity": "P0", "action": "clean"}, {"severity": "P2", "action": "block"}, {"max_matches": 0}):
        with pytest.raises(ValueError):
            Rule(**({"id": "I-01", "name": "n"} | bad))
    for bad in (("regex", "("), ("keyword", ""), ("odd", "a"), ("composite", "and")):
        with pytest.raises(ValueError):
            Pattern(*bad)


def test_rule_book():
    book = RuleBook([Rule("I-01", "a"), Rule("I-02", "b", "P0", "warn"), Rule("I-03", "c", stages=("output",))])
    assert [r.id for r in book.for_stage("input")] == ["I-02", "I-01"]
    book.enable("I-02", False)
    assert [r.id for r in book.for_stage("input")] == ["I-01"] and book.count_by_severity() == {"P0": 1, "P1": 0, "P2": 2}
    assert book.remove("I-03") and not book.remove("I-03")
    with pytest.raises(ValueError):
        book.enable("I-99")


def judge(spark, text, *rules):
    df = spark.createDataFrame([(1, text)], "i int, t string")
    return verdicts.verdict(verdicts.correlate(evaluate(df, list(rules), "t"), list(rules)), list(rules)).first()


def test_verdicts(spark):
    block = Rule("I-01", "x", "P0", "block", (key("bad"),))
    warn = Rule("I-02", "careful", "P1", "warn", (key("hot"),), admin_alert=True)
    v = judge(spark, "bad hot", block, warn)
    assert v["blocked"] and v["overall_action"] == "block" and v["overall_severity"] == "P0" and v["n_triggered"] == 2 and v["admin_alert"]
    v = judge(spark, "hot", block, warn)
    assert not v["blocked"] and v["overall_severity"] == "P1" and v["warnings"] == ["[I-02] careful: hot"]
    v = judge(spark, "fine", block, warn)
    assert v["n_triggered"] == 0 and v["overall_severity"] == "P2" and v["overall_action"] == "warn"


def test_boost_link_reduction(spark):
    a = Rule("I-11", "phone", "P2", "warn", (key("phone"),), boost=Boost(("I-12",), "P1", 20), links=("I-12",))
    b = Rule("I-12", "id", "P1", "warn", (key("ident"),))
    c = Rule("I-45", "modifier", "P2", "warn", (key("mod"),), reductions={"I-12": "P2"})
    v = judge(spark, "phone ident mod", a, b, c)
    assert {r["rule_id"]: r["severity"] for r in v["results"]} == {"I-11": "P1", "I-12": "P2", "I-45": "P2"}
    assert [tuple(x) for x in v["links"]] == [("I-11", "I-12")] and v["overall_severity"] == "P1"
    v = judge(spark, "phone" + " " * 60 + "ident", a, b)
    assert {r["rule_id"]: r["severity"] for r in v["results"]} == {"I-11": "P2", "I-12": "P1"}


def test_redact(spark):
    df = spark.createDataFrame([("my secret my password", [(3, 9, ""), (17, 25, "")])], "t string, s array<struct<start_pos:int,end_pos:int,matched:string>>")
    assert df.select(verdicts.redact(F.col("t"), F.col("s"))).first()[0] == "my [REDACTED] my pass[REDACTED]"
    act = lambda name, blocked=False, score=0: df.select(verdicts.apply_action(name, F.col("t"), F.col("s"), F.lit(blocked), F.lit(score))).first()[0]
    assert act("block") is None and act("warn").startswith("my secret") and act("dynamic", score=51) is None and "[REDACTED]" in act("dynamic")


def test_files_of_rules_and_settings():
    r = rule_of({"id": "I-11", "name": "n", "severity": "P1", "detection": {"mode": "all", "patterns": [{"type": "keyword", "value": "a"}]}, "config": {"context_boost": {"proximity_rules": ["I-12"], "severity_override": "P0"}}})
    assert r.mode == "all" and r.boost.window == 500
    assert merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert from_environment("X", {"X_A__B": "1", "Y": "2"}) == {"a": {"b": "1"}}


def test_templates_and_evidence(spark):
    rules = [Rule("I-01", "a", "P1", "redact", (key("secret"),), redact_template="<S>", links=("I-02",)), Rule("I-02", "b", "P1", "warn", (key("hot"),))]
    df = spark.createDataFrame([(1, "my secret is hot"), (2, None)], "i int, t string")
    v = verdicts.verdict(verdicts.correlate(evaluate(df, rules, "t"), rules), rules)
    out = v.select("i", verdicts.redact(F.col("t"), F.col("redact_spans"), templates=True).alias("x")).collect()
    assert {r["i"]: r["x"] for r in out} == {1: "my <S> is [REDACTED]", 2: None}
    rows = {(r["rule_id"], r["source_layer"], r["matching_text"], r["text_before"], r["text_after"]) for r in verdicts.evidence(v, "i", "t").collect()}
    assert rows == {("I-01", "lexical", "secret", "my", "is hot"), ("I-02", "lexical", "hot", "my secret is", ""), ("I-01", "correlation", "I-02", "", "")}
