"""Queries over the llm operators; ORACLE has the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexisift.session import table, written

from . import encoding, lookalike, mixing, packing, parsing, pii, provenance, quality, secrets, tokens


def p1_found(spark, d):
    files = table(spark, d, "files").select("file_id", "repo", "file_path", "content")
    return provenance.classify(files).filter("reason is not null").select(F.col("file_key").alias("file_id"))


def p1_reasons(spark, d):
    """Per repository, how many files are hand-written and how many are not, by reason."""
    files = table(spark, d, "files").select("file_id", "repo", "file_path", "content")
    verdicts = provenance.classify(files).select(F.col("file_key").alias("file_id"), F.coalesce("reason", F.lit("hand-written")).alias("reason"))
    return verdicts.join(files.select("file_id", "repo").dropDuplicates(["file_id"]), "file_id").groupBy("repo", "reason").agg(F.count("*").alias("n_files"))


def p1_totals(spark, d):
    """Files with a verdict per repository: every one has one."""
    files = table(spark, d, "files").select("file_id", "repo", "file_path", "content")
    verdicts = provenance.classify(files).select(F.col("file_key").alias("file_id"))
    return verdicts.join(files.filter("file_id is not null").groupBy("file_id").agg(F.min("repo").alias("repo")), "file_id").groupBy("repo").agg(F.count("*").alias("n_files"))


def p2_found(spark, d):
    return pii.found(table(spark, d, "requests"), table(spark, d, "audit_events"))


def p2_redacted(spark, d):
    """Every distinct request with its personal data replaced, as counts by kind and the text."""
    tagged = pii.tag(table(spark, d, "requests").select("request_id", "content").distinct(), "content")
    return pii.redact(tagged, "content").select("request_id", F.size("pii").alias("n_items"), "redacted")


def p2_kept(spark, d):
    """Requests, and those whose text changed without an item or lost more than its items (none)."""
    tagged = pii.tag(table(spark, d, "requests").select("request_id", "content").distinct(), "content")
    done = pii.redact(tagged, "content")
    cut = lambda a, s: F.struct((a["n"] + s["end_pos"] - s["start_pos"]).alias("n"), (a["m"] + F.length(s["kind"]) + 2).alias("m"))
    sums = F.aggregate("pii", F.struct(F.lit(0).alias("n"), F.lit(0).alias("m")), cut)
    wrong = (F.size("pii") == 0) & (F.col("redacted") != F.col("content")) | (F.length("redacted") != F.length("content") - sums["n"] + sums["m"])
    return done.agg(F.count("*").alias("n_requests"), F.sum(F.coalesce(wrong, F.lit(False)).cast("long")).alias("n_wrong"))


def p3_classes(spark, d):
    """One row per request that looks like another: its class, and how many contents and requests the class has."""
    forms = lookalike.consistent_form(table(spark, d, "requests"), "request_id", "content")
    return lookalike.classes(forms).select(F.col("id").alias("request_id"), "class", "n_contents", "n_ids")


def p3_found(spark, d):
    forms = lookalike.consistent_form(table(spark, d, "requests"), "request_id", "content")
    return lookalike.equal_looking_pairs(forms).select(F.col("a").alias("request_id_a"), F.col("b").alias("request_id_b"))


def p3_forms(spark, d):
    return lookalike.consistent_form(table(spark, d, "requests"), "request_id", "content").select(F.col("id").alias("request_id"), "form")


def p4_found(spark, d):
    files = table(spark, d, "files").select("file_id", "content").filter("file_id is not null")
    return encoding.repair(files).filter("repair.n_garbled > 0").select("file_id").distinct()


def p4_restored(spark, d):
    files = table(spark, d, "files").select("file_id", "encoding", "content")
    fixed = encoding.repair(files).filter("repair.n_garbled > 0")
    return fixed.select("file_id", "encoding", F.col("repair.n_garbled").alias("n_garbled"), F.col("repair.n_lost").alias("n_lost"), F.col("repair.restored").alias("restored")).distinct()


def p4_kept(spark, d):
    """Files, and those that changed though all is ASCII or no word was garbled (none)."""
    fixed = encoding.repair(table(spark, d, "files").select("file_id", "content").distinct())
    changed = (F.col("repair.restored") != F.col("content")) & (~F.col("content").rlike("[^\\x00-\\x7f]") | (F.col("repair.n_garbled") == 0))
    return fixed.agg(F.count("*").alias("n_files"), F.sum(F.coalesce(changed, F.lit(False)).cast("long")).alias("n_wrong"))


def _files_with_secrets(spark, d):
    files = table(spark, d, "files").select("file_id", "repo", "file_path", "content").filter("file_id is not null and content is not null")
    return secrets.scan(files, "content", "file_path")


def p5_found(spark, d):
    hits = _files_with_secrets(spark, d).select(F.lit("files").alias("tab"), F.col("file_id").alias("rec_id"), F.explode("secrets.spans.line_no").alias("line_no"))
    findings = table(spark, d, "findings").select("finding_id", "file_path", "line_number", "matched_text").filter("finding_id is not null and matched_text is not null")
    flagged = secrets.scan(findings, "matched_text", "file_path").filter(F.size("secrets.spans") > 0)
    return hits.unionByName(flagged.select(F.lit("findings").alias("tab"), F.col("finding_id").alias("rec_id"), F.col("line_number").alias("line_no"))).distinct()


def p5_redacted(spark, d):
    """The files with secrets, blanked out in place: same length, same lines."""
    found = _files_with_secrets(spark, d).filter(F.size("secrets.spans") > 0)
    return found.select("file_id", "repo", F.size("secrets.spans").alias("n_secrets"), F.col("secrets.redacted").alias("redacted"), (F.length("secrets.redacted") == F.length("content")).alias("same_length")).distinct()


def p5_kept(spark, d):
    """Files with content, and those whose redacted text has another length or other line ends (none)."""
    found = _files_with_secrets(spark, d)
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    text, red = F.col("content"), F.col("secrets.redacted")
    return found.agg(F.count("*").alias("n_files"), F.sum(((F.length(red) != F.length(text)) | (lines(red) != lines(text))).cast("long")).alias("n_wrong"))


def _checked_files(spark, d):
    files = table(spark, d, "files").select("file_id", "repo", "file_path", "content").filter("file_id is not null")
    # results are reduced to one a file, not texts
    done = parsing.check(files, "content", "file_path").drop("content")
    return done.groupBy("file_id").agg(F.min_by(F.struct(*[c for c in done.columns if c != "file_id"]), F.struct("file_path", "repo", "syntax.n_errors")).alias("f")).select("file_id", "f.*")


def p6_found(spark, d):
    files = table(spark, d, "files").select("file_id", "file_path", "content").filter("file_id is not null")
    return parsing.check(files, "content", "file_path").filter("syntax.n_errors > 0").select("file_id").distinct()


def p6_errors(spark, d):
    """Per invalid file all errors and the first cause."""
    bad = _checked_files(spark, d).filter("syntax.n_errors > 0")
    return bad.select("file_id", "repo", F.col("path_language").alias("language"), "syntax.n_errors", "syntax.first_line", "syntax.first_cause", "syntax.errors")


def p6_rates(spark, d):
    return parsing.rates(_checked_files(spark, d), "repo")


def p6_totals(spark, d):
    """Files read per repository and language."""
    return parsing.rates(_checked_files(spark, d), "repo").select("repo", "language", "n_files")


def _sized(spark, d):
    """Documents with their tokens and the class of equal texts (but for case and white space). Of an id with several texts
    the one with the smallest hash counts; texts aren't shuffled."""
    same = F.xxhash64(F.lower(F.regexp_replace(F.trim("text"), r"\s+", " ")))
    slim = table(spark, d, "documents").filter("doc_id is not null").select("doc_id", F.struct(same.alias("cluster"), tokens.count(F.col("text")).alias("tokens"), "source").alias("s"))
    return written(slim.groupBy("doc_id").agg(F.min("s").alias("s")).select("doc_id", "s.*"), "sized")


def p8_pack(spark, d):
    return packing.pack(_sized(spark, d), table(spark, d, "pack_sizes")).select("pack_name", "bin", "doc_id", "piece", "tokens")


def p8_report(spark, d):
    return packing.report(packing.pack(_sized(spark, d), table(spark, d, "pack_sizes")))


#: Sources whose texts are not to share a container.
APART = [("model_output", "incident_report"), ("policy_page", "release_notes")]


def p8_checks(spark, d):
    """Packing with sources kept apart: what must not be (all 0), and the texts placed."""
    docs = _sized(spark, d)
    return packing.checks(packing.pack(docs, table(spark, d, "pack_sizes"), APART), docs, APART)


def p9_mix(spark, d):
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"))[0]


def p9_shares(spark, d):
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"))[1]


def p9_slots(spark, d):
    """Which block fills each slot of each output shard."""
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"))[2]


def p9_checks(spark, d):
    """Per target whether its share is met to one percent point and its repeats are within the cap. Sources without any text
    can't be met: the shares that can are those among the others."""
    shares = mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"))[1]
    there = F.when(F.col("tokens") > 0, F.col("target_share")).otherwise(0.0)
    shares = shares.withColumn("reachable_share", F.round(there / F.sum(there).over(Window.partitionBy("mix_name")), 6))
    met = (F.abs(F.col("actual_share") - F.col("reachable_share")) <= 0.01).alias("on_target")
    return shares.select("mix_name", "source", "target_share", "max_repeats", "reachable_share", met, (F.col("most_repeats") <= F.col("max_repeats")).alias("within_repeats"))


def p10_found(spark, d):
    stats = quality.statistics(table(spark, d, "documents"), table(spark, d, "common_words"))
    return quality.not_prose(quality.outliers(stats)).select(F.col("key").alias("doc_id")).distinct()


def p10_statistics(spark, d):
    stats = quality.statistics(table(spark, d, "documents"), table(spark, d, "common_words"))
    return quality.outliers(stats).withColumnRenamed("key", "doc_id")


def p10_words(spark, d):
    """Words and characters of each text."""
    stats = quality.statistics(table(spark, d, "documents"), table(spark, d, "common_words"))
    return stats.select(F.col("key").alias("doc_id"), "n_words", F.round("mean_word_length", 4).alias("mean_word_length")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_reasons, p1_totals, p2_found, p2_redacted, p2_kept, p3_found, p3_forms, p3_classes, p4_found, p4_restored, p4_kept, p5_found, p5_redacted, p5_kept, p6_found, p6_errors, p6_rates, p6_totals, p8_pack, p8_report, p8_checks, p9_mix, p9_shares, p9_slots, p9_checks,
        p10_found, p10_statistics, p10_words,
    )
}
_LANGUAGE = """CASE lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'java' THEN 'java' WHEN 'go' THEN 'go' WHEN 'json' THEN 'json'
    WHEN 'yaml' THEN 'yaml' WHEN 'yml' THEN 'yaml' WHEN 'xml' THEN 'xml' WHEN 'toml' THEN 'toml' END"""
ORACLE: dict[str, str] = {
    "p1_totals": "SELECT repo, count(*) AS n_files FROM (SELECT file_id, min(repo) AS repo FROM files WHERE file_id IS NOT NULL GROUP BY file_id) GROUP BY repo",
    "p2_kept": "SELECT count(*) AS n_requests, 0::BIGINT AS n_wrong FROM (SELECT DISTINCT request_id, content FROM requests)",
    "p4_kept": "SELECT count(*) AS n_files, 0::BIGINT AS n_wrong FROM (SELECT DISTINCT file_id, content FROM files)",
    "p5_kept": "SELECT count(*) AS n_files, 0::BIGINT AS n_wrong FROM files WHERE file_id IS NOT NULL AND content IS NOT NULL",
    "p6_totals": f"""SELECT repo, language, count(*) AS n_files FROM (SELECT file_id, min(repo) AS repo, min({_LANGUAGE}) AS language FROM files WHERE file_id IS NOT NULL GROUP BY file_id) WHERE language IS NOT NULL GROUP BY repo, language""",
    "p10_words": """SELECT DISTINCT doc_id, CAST(len(regexp_extract_all(text, '\\p{L}+')) AS INTEGER) AS n_words, round(length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / greatest(len(regexp_extract_all(text, '\\p{L}+')), 1), 4) AS mean_word_length
        FROM documents WHERE doc_id IS NOT NULL AND regexp_matches(text, '[^ \\t\\n\\r\\f\\x0b]')""",
    "p8_checks": """SELECT pack_name, CAST(capacity_tokens AS INTEGER) AS capacity, 0::BIGINT AS n_overfull, 0::BIGINT AS n_with_copies, 0::BIGINT AS n_conflicts, n_docs, 0::BIGINT AS n_split_in_vain, 0::BIGINT AS n_not_whole
        FROM pack_sizes, (SELECT count(DISTINCT doc_id) AS n_docs FROM documents WHERE length(text) > 0)""",
    "p9_checks": """WITH s AS (SELECT DISTINCT source FROM documents WHERE length(text) > 0 AND doc_id IS NOT NULL), t AS (SELECT *, CASE WHEN source IN (SELECT source FROM s WHERE source IS NOT NULL) THEN target_share ELSE 0 END AS there FROM mix_targets)
        SELECT mix_name, source, target_share, max_repeats, round(there / sum(there) OVER (PARTITION BY mix_name), 6) AS reachable_share, TRUE AS on_target, TRUE AS within_repeats FROM t""",
}
#: Why a query has no SQL.
_CHECKED = "found by its method alone; tests compare it with held-out cases or a plain version"
NO_SQL = {
    **dict.fromkeys(("p1_found", "p1_reasons", "p2_found", "p2_redacted", "p3_found", "p3_forms", "p3_classes", "p4_found", "p4_restored", "p5_found", "p5_redacted", "p6_found", "p6_errors", "p6_rates", "p10_found", "p10_statistics"), _CHECKED),
    **dict.fromkeys(("p8_pack", "p8_report", "p9_mix", "p9_shares", "p9_slots"), "sizes in tokens, drawn order; p8_checks and p9_checks hold what must be true of it"),
}
