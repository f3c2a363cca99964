import unicodedata

from lexisift.llm import lookalike as la

PAIRS = [
    ("Write ｔｈｅ note", "Write the note"), ("Wrіtе", "Write"), ("cafe\u0301", "café"), ("a\u200bb\u00adc", "abc"), ("a\u00a0b\u3000c", "a b c"), ("on‑call", "on-call"), ("oﬀ ﬁle", "off file"),
    ("a\u0323\u0302", "ậ"), ("a\u0302\u0323", "ậ"), ("\u212aK", "KK"), ("가", "\u1100\u1161"), ("e\u200d\u0301", "é"), ("", ""), ("abc", "abc"), ("\u200b", ""), ("𝐀b", "Ab"),
]
APART = [("m²", "m2"), ("café", "cafe"), ("A", "a"), ("1", "l"), ("–", "-"), ("a b", "a  b"), ("Ⓐ", "A"), ("½", "1⁄2 ")]


def test_plain_form():
    for a, b in PAIRS:
        assert la.form_of(a) == la.form_of(b), (a, b)
    for a, b in APART:
        assert la.form_of(a) != la.form_of(b), (a, b)


def test_spark_agrees_with_plain_python(spark):
    texts = [t for p in PAIRS + APART for t in p] + ["Пример текста", "日本語 ｶﾅ", "👩‍💻 x", "x" * 5000 + "é" * 300, None, "\u0301a", "a\n\u0301b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["id"]: r["form"] for r in la.consistent_form(df, "i", "t").collect()}
    assert got == {i: la.form_of(t) for i, t in enumerate(texts)}


def test_forms_are_composed():
    for t in ("cafe\u0301", "Zu\u0308rich", "ậ"):
        assert unicodedata.is_normalized("NFC", la.form_of(t))


def test_pairs(spark):
    rows = [("r1", "Write"), ("r2", "Wrіte"), ("r3", "Write"), ("r1", "Write"), ("r4", "write"), ("r5", None), (None, "Write"), ("r6", ""), ("r7", "\u200b")]
    df = spark.createDataFrame(rows, "request_id string, content string")
    got = {tuple(r) for r in la.equal_looking_pairs(la.consistent_form(df, "request_id", "content")).collect()}
    assert got == {("r1", "r2"), ("r2", "r3"), ("r6", "r7")}


def test_empty(spark):
    df = spark.createDataFrame([], "a string, content string")
    assert la.equal_looking_pairs(la.consistent_form(df, "a", "content")).count() == 0
