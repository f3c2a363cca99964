from pyspark.sql import functions as F

from lexisift.llm import quality as q

WORDS = [("en", w) for w in "the of and to in a is that it was for on as with be by at this have from or but not are were which when".split()] + [("de", w) for w in "der die das und ist nicht ein eine in zu den mit".split()]
SENTENCES = ["The scanner compared the whole conversation with the policy draft.", "It is not clear why the rule was disabled in the report.", "A nightly scan collected a batch of records, but nobody had asked for it.", "When the session was marked, the gateway logged a warning to the queue."]


def frame(spark):
    prose = [(i, " ".join(SENTENCES[(i + k) % 4] for k in range(2 + i % 5))) for i in range(120)]
    wrapped = [(200, "The scanner compared the whole conversation with\nthe policy draft before anyone was able to look at\nit, which is why the report was not clear to\nthe team.")]
    odd = [(300, "\n".join(f"- item {k}" for k in range(20))), (301, "| a | 1 | 2 |\n" * 12), (302, "test " * 80), (303, "a=1 b=2 c=3\n" * 10), (304, "x9f!@# $%^&* ()_+ {}|\n" * 8), (305, "for (int i = 0; i < n; i++) { a[i] += b; }\n" * 6)]
    return spark.createDataFrame(prose + wrapped + odd + [(400, None), (401, ""), (402, "  \n "), (None, "The scanner is here.")], "doc_id long, text string"), spark.createDataFrame(WORDS, "lang string, word string")


def test_prose_and_other(spark):
    docs, common = frame(spark)
    scored = q.outliers(q.statistics(docs, common))
    found = {r["key"] for r in q.not_prose(scored).collect()}
    assert found == {300, 301, 302, 303, 304, 305}
    rows = scored.collect()
    assert {400, 401, 402}.isdisjoint(r["key"] for r in rows) and len(rows) == 127
    for r in rows:
        assert abs(sum(r["contributions"].values()) - r["d2"]) <= 1e-6 * max(1, abs(r["d2"]))


def test_counts(spark):
    docs = spark.createDataFrame([(1, "The cat is in.\n- a 1\n")], "doc_id long, text string")
    r = q.statistics(docs, spark.createDataFrame(WORDS, "lang string, word string")).first()
    assert (r["n_words"], r["n_lines"], r["language"]) == (5, 2, "en") and r["punctuated_lines"] == 0.5 and r["marked_lines"] == 0.5 and abs(r["mean_word_length"] - 11 / 5) < 1e-9


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    stats = q.statistics(docs, spark.createDataFrame(WORDS, "lang string, word string"))
    assert q.not_prose(q.outliers(stats)).count() == 0
    assert q.statistics(frame(spark)[0], spark.createDataFrame([], "lang string, word string")).filter(F.col("language") != "").count() == 0


def test_the_distance_decides(spark):
    """A document is told by its distance from its language's prose: with every other statistic as in prose one can be enough."""
    import pandas as pd

    from lexisift.llm import quality as q

    base = {s: 1.0 for s in q.STATS}
    rows = [{"key": k, "language": "en", "n_words": 50, **{s: v + 0.01 * ((k * 7 + j) % 11) for j, (s, v) in enumerate(base.items())}} for k in range(200)]
    odd = {**rows[0], "key": 900, "digit_ratio": 3.0}
    near = {**rows[1], "key": 901, "prose_share": 0.97}
    got = q.not_prose(q.outliers(spark.createDataFrame(pd.DataFrame([*rows, odd, near]))))
    assert [r["key"] for r in got.collect()] == [900]
    assert max(got.first()["contributions"], key=got.first()["contributions"].get) == "digit_ratio"
