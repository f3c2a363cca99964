import pytest

from lexisift.api import Engine
from lexisift.operators.rules import Pattern, Rule


def key(w):
    return Pattern("keyword", w, 0.9)


RULES = [Rule("I-01", "secret", "P0", "block", (key("secret"),)), Rule("I-02", "hot", "P2", "warn", (key("hot"),)), Rule("O-01", "out", "P1", "warn", (key("hot"),), stages=("output",)), Rule("B-47", "score", "P1", "warn", stages=("behavior",), session_threshold=20)]


def test_detection_and_overrides(spark):
    e = Engine(RULES)
    df = spark.createDataFrame([(1, "a sec\u200bret hot"), (2, "fine"), (3, None)], "i int, content string")
    got = {r["i"]: r for r in e.detect_input(df).collect()}
    assert got[1]["blocked"] and got[1]["n_triggered"] == 2 and got[1]["raw_content"] == "a sec\u200bret hot" and not got[2]["blocked"] and got[3]["n_triggered"] == 0
    assert {r["rule_id"]: r["n_triggered"] for r in e.metrics(e.detect_input(df)).collect()} == {"I-01": 1, "I-02": 1}
    e.settings = {"overrides": {"disabled_rules": ["I-01"], "severity": {"I-02": "P1"}}}
    assert [(r.id, r.severity) for r in e.rules_for("input")] == [("I-02", "P1")]
    e.disable_rule("I-02")
    assert e.rules_for("input") == [] and e.get_rule("I-02").enabled is False
    assert [r["n_triggered"] for r in e.detect_output(df).orderBy("i").collect()] == [1, 0, 0]


def test_actions_and_audit(spark):
    e = Engine(RULES)
    judged = e.detect_input(spark.createDataFrame([(1, "hot hot")], "i int, content string"))
    assert e.act(judged, "redact").first()["processed_content"] == "[REDACTED] [REDACTED]"
    (event,) = e.audit(judged, "i", "input").collect()
    assert event["rule_id"] == "I-02" and event["match_count"] == 2 and event["content_snippet"] == "hot"


def test_behavior(spark):
    df = spark.createDataFrame([("s", 1, "secret"), ("s", 2, "fine"), ("t", 1, "hot")], "s string, n int, content string")
    got = Engine(RULES).track_behavior(df, "s", ["n"]).orderBy("s", "n").collect()
    assert [(r["score"], r["session_rules"]) for r in got] == [(20, ["B-47"]), (20, ["B-47"]), (5, [])]


def test_hooks_are_isolated(spark):
    seen = []
    e = Engine(RULES)
    e.register_hook("before_detection", lambda df: 1 / 0)
    e.register_hook("after_detection", lambda df: seen.append(df.columns))
    e.detect_input(spark.createDataFrame([(1, "x")], "i int, content string"))
    assert len(seen) == 1
    with pytest.raises(ValueError):
        e.register_hook("odd", print)


def test_review(spark, tmp_path):
    (tmp_path / "a.py").write_text("import os\nos.system('x')\n")
    e = Engine()
    got = e.review_code(spark, str(tmp_path))
    assert [(r["rule_id"], r["line_number"]) for r in got.collect()] == [("SEC-51", 2)]
    from pyspark.sql import functions as F

    from lexisift.operators import scanner

    files = scanner.read_folder(spark, str(tmp_path))
    manifest = files.withColumn("fp", scanner.fingerprint(F.col("file_path"), F.col("modified"), F.col("length"), F.col("content"))).select("file_path", "fp")
    assert e.review_code(spark, str(tmp_path), manifest).count() == 0


def test_rules_from_descriptions(tmp_path):
    e = Engine()
    assert e.load_rules_from_list([{"id": "I-09", "name": "x", "detection": {"patterns": [{"type": "keyword", "value": "a"}]}}]) == 1
    (tmp_path / "r.json").write_text('{"rules": [{"id": "I-10", "name": "y"}]}')
    assert e.load_rules(str(tmp_path / "r.json")) == 1 and e.get_rule("I-10").name == "y" and e.remove_rule("I-10")
