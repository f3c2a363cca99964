import math
import random

from pyspark.sql import functions as F

from lexisift.functions import text as tx


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column.alias("x")).first()["x"]


def test_normalize(spark):
    t = F.col("t")
    assert one(spark, "ＨＥＬＬＯ", tx.clean(t)) == "HELLO"
    assert one(spark, "a\u200bb\u0007c\n\td", tx.normalize(t)) == "abc\n\td"
    assert one(spark, "e\u0301", tx.normalize(t)) == "é"
    assert one(spark, None, tx.normalize(t)) is None
    assert one(spark, "", tx.normalize(t)) == ""


def _truncate(text, limit, look=200):
    if len(text) <= limit:
        return text
    cut = limit
    for pos in range(limit, limit - look, -1):
        if 0 <= pos < len(text) and text[pos] == "\n":
            cut = pos + 1
            break
    if cut == limit:
        for pos in range(limit, limit + look):
            if pos < len(text) and text[pos] == "\n":
                cut = pos
                break
    return text[:cut].rstrip() + tx.TRUNCATED


def test_truncate_matches_plain_python(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("ab \n") if r.random() < 0.05 else "x" for _ in range(r.randrange(0, 700))) for _ in range(120)] + ["x" * 300 + "\n" + "y" * 300, "x" * 299 + "\n" + "y" * 100]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.truncate_at_boundary(F.col("t"), 300, 50).alias("x"))
    for row in df.collect():
        assert row["x"] == _truncate(row["t"], 300, 50)


def test_entropy(spark):
    t = F.col("t")
    assert one(spark, "aaaa", tx.entropy(t)) == 0
    assert one(spark, "abcd", tx.entropy(t)) == 2
    assert math.isclose(one(spark, "aab", tx.entropy(t)), 0.9182958, rel_tol=1e-6)
    assert one(spark, "", tx.entropy(t)) == 0


def test_luhn_and_network(spark):
    t = F.col("t")
    for n, ok, network in (("4111-1111-1111-1111", True, "Visa"), ("5500-0000-0000-0004", True, "MasterCard"), ("3782-822463-10005", True, "American Express"), ("6011-1111-1111-1117", True, "Discover"), ("1234-5678-9012-3456", False, None)):
        assert one(spark, n, tx.luhn(t)) is ok
        assert one(spark, n, tx.card_network(t)) == network


def test_lines_and_columns(spark):
    df = spark.createDataFrame([("ab\ncd\n", 4)], "t string, p int")
    assert tuple(df.select(tx.line_of(F.col("t"), F.col("p")), tx.column_of(F.col("t"), F.col("p"))).first()) == (2, 2)
    assert tuple(df.select(tx.line_of(F.col("t"), F.lit(0)), tx.column_of(F.col("t"), F.lit(0))).first()) == (1, 1)


def test_versions_and_families(spark):
    t = F.col("t")
    assert one(spark, "1.2.3-rc1", tx.version_key(t)) == [1, 2, 3]
    assert one(spark, "latest", tx.version_key(t)) is None
    assert one(spark, "kotlin", tx.language_confidence(F.lit(1.0), t, F.lit(0.9), "java")) == 0.85
    assert one(spark, "python", tx.language_confidence(F.lit(1.0), t, F.lit(0.9), "java")) == 0.5
    assert one(spark, "python", tx.language_confidence(F.lit(1.0), t, F.lit(0.2), "java")) == 1.0


def test_adjusted_confidence_agrees_with_probes(spark):
    from lexisift.operators.probes import adjusted

    texts = ["eval(x)", "# a note\neval(x)", "def test_a():\n  eval(x)", "for example eval(x)", "eval(x)  # nosemgrep", "a safe eval(x)", "see http://x eval(x)"]
    df = spark.createDataFrame([(t, t.index("eval")) for t in texts], "t string, p int")
    for r in df.select("t", "p", tx.adjusted_confidence(F.col("t"), F.col("p"), 0.8).alias("c")).collect():
        assert math.isclose(r["c"], adjusted(r["t"], r["p"], 0.8)), r["t"]
