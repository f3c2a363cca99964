"""Extra columns with clashing names, nulls everywhere, repeated rows."""

from pyspark.sql import functions as F

from lexisift.llm import encoding, lookalike, mixing, packing, parsing, pii, provenance, quality, secrets

CLASHES = ("n", "pos", "piece", "cp", "parts", "seg", "key", "marks", "cluster_", "form", "f", "c", "shard", "bin", "capacity", "pack_name", "open", "filled", "run", "block", "slot", "uses", "h", "texts", "lines", "words", "joined", "language", "d2", "t", "reason", "path", "hash", "repos", "covered", "rules", "field_name", "rec_id", "kind", "item", "size", "spans", "redacted", "syntax", "path_language", "repair", "secrets", "pii", "_found", "mean", "precision", "best", "stretch")


def clashing(df):
    have = set(df.columns)
    return df.withColumns({c: F.lit("clash") for c in CLASHES if c not in have})


def test_texts(spark):
    df = clashing(spark.createDataFrame([("r1", "Wrіte"), ("r2", "Write"), (None, None), ("r2", "Write")], "request_id string, content string"))
    assert {tuple(r) for r in lookalike.equal_looking_pairs(lookalike.consistent_form(df, "request_id", "content")).collect()} == {("r1", "r2")}
    ev = clashing(spark.createDataFrame([(1, "Tel. 911 555 658", None)], "delivery_id long, content_snippet string, matched_spans array<struct<start_pos:int,end_pos:int,matched:string>>"))
    assert {tuple(r) for r in pii.found(df, ev).collect()} == {("content_snippet", "1", "phone")}


def test_files(spark):
    rows = [(1, "a", "x/a.py", "x = (\ntoken = 'ghp_1pCTvDmQDLgEaXynZD4hIjP6NoisDgIUDn2f'\n# GrÃ¶ÃŸe\n"), (None, None, None, None), (2, None, None, "y"), (1, "a", "x/a.py", "x = (\ntoken = 'ghp_1pCTvDmQDLgEaXynZD4hIjP6NoisDgIUDn2f'\n# GrÃ¶ÃŸe\n")]
    df = spark.createDataFrame(rows, "file_id long, repo string, file_path string, content string")
    wide = clashing(df)
    assert encoding.repair(wide).filter("repair.n_garbled > 0").select("file_id").distinct().count() == 1
    assert parsing.check(wide, "content", "file_path").filter("syntax.n_errors > 0").select("file_id").distinct().count() == 1
    assert secrets.scan(wide, "content", "file_path").filter(F.size("secrets.spans") > 0).select("file_id").distinct().count() == 1
    assert provenance.classify(wide.drop("path")).count() == 2


def test_documents(spark):
    docs = clashing(spark.createDataFrame([(1, "One is not a text.", 7, "s", 5), (1, "One is not a text.", 7, "s", 5), (2, None, None, None, None), (None, "x", 3, "s", 1)], "doc_id long, text string, tokens long, source string, cluster long"))
    common = spark.createDataFrame([("en", "is"), ("en", "not"), ("en", "a"), (None, None)], "lang string, word string")
    stats = quality.statistics(docs, common)
    assert stats.count() == 2 and quality.outliers(stats).count() == 2
    packs = spark.createDataFrame([("p", 10)], "pack_name string, capacity_tokens int")
    assert packing.pack(docs.dropDuplicates(["doc_id"]).filter("doc_id is not null"), packs).count() == 1
    targets = spark.createDataFrame([("m", "s", 1.0, 2)], "mix_name string, source string, target_share double, max_repeats int")
    assert mixing.mix(docs.dropDuplicates(["doc_id"]), targets)[0].count() >= 0
