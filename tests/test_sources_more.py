"""Decoding of files, formats of events, states of sessions."""

import io

import pytest
from pyspark.sql import functions as F

from lexisift.operators import scanner, sessions
from lexisift.sources import sinks


def test_decoding(spark):
    rows = [("utf8", "Größe".encode()), ("mark", b"\xef\xbb\xbfabc"), ("wide", "Größe".encode("utf-16")), ("western", "Größe".encode("cp1252")), ("broken", b"a\xff\x00b"), ("empty", b""), ("none", None)]
    got = {r["k"]: r["t"] for r in spark.createDataFrame(rows, "k string, b binary").select("k", scanner.decoded(F.col("b")).alias("t")).collect()}
    assert got == {"utf8": "Größe", "mark": "abc", "wide": "Größe", "western": "Größe", "broken": "a\ufffd\x00b", "empty": "", "none": None}


def test_formats(spark):
    df = spark.createDataFrame([(1, "a\u00e9")], "n int, t string")
    out = io.StringIO()
    assert sinks.to_console(df, "jsonl", out=out) == 1 and out.getvalue() == '{"n":1,"t":"a\u00e9"}\n'
    assert "\n" in sinks.formatted(df, "json").first()[0]
    assert sinks.formatted(df, "dict").first()[0] == {"n": '{"n":1}', "t": '{"t":"a\u00e9"}'}
    with pytest.raises(ValueError):
        sinks.formatted(df, "xml")


def test_reset(spark):
    df = spark.createDataFrame([("s", 1), ("s", 5), ("t", 1), (None, 2)], "session string, at int")
    resets = spark.createDataFrame([("s", 2), ("s", 3), (None, 9)], "session string, reset_at int")
    assert sorted((r["session"] or "", r["at"]) for r in sessions.since_reset(df, resets, "session", "at").collect()) == [("", 2), ("s", 5), ("t", 1)]
