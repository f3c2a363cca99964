"""Queries over matching, rules, verdicts and actions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexisift.functions import text as tx
from lexisift.functions.rows import exploded
from lexisift.operators import spans as sp
from lexisift.operators import verdicts
from lexisift.operators.rules import Pattern, Rule, evaluate, matches, pattern_spans
from lexisift.session import table
from lexisift.sources.rulefiles import rules_from_table

from . import packs

_REQUESTS = "(SELECT DISTINCT request_id, content FROM requests WHERE content IS NOT NULL)"
_DOCS = "(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"


def _requests(spark, d):
    return table(spark, d, "requests").select("request_id", "content").filter("content is not null").distinct()


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text").filter("text is not null")


def _long(df, key, spans: Column):
    rows = exploded(df, spans, "s", key, position="match_no")
    return rows.select(key, "match_no", "s.start_pos", "s.end_pos", "s.matched")


def _sql_spans(source: str, key: str, col: str, rx: str, limit: int | None = 10) -> str:
    """Spans in SQL: a start is the length of the gaps and matches before it."""
    most = f"least(len(ms), {limit})" if limit else "len(ms)"
    size = lambda part: f"coalesce(list_sum(list_transform({part}, lambda x: length(x))), 0)"
    return f"""
    WITH m AS (SELECT {key}, regexp_extract_all({col}, '{rx}') AS ms, regexp_split_to_array({col}, '{rx}') AS gs FROM {source} WHERE regexp_matches({col}, '{rx}')),
    n AS (SELECT {key}, ms, gs, unnest(range(1, {most} + 1)) AS i FROM m)
    SELECT {key}, CAST(i - 1 AS INTEGER) AS match_no, CAST({size('gs[1:i]')} + {size('ms[1:i-1]')} AS INTEGER) AS start_pos,
           CAST({size('gs[1:i]')} + {size('ms[1:i]')} AS INTEGER) AS end_pos, left(ms[i], 500) AS matched FROM n"""


def regex_match_count(spark, d):
    return _requests(spark, d).select("request_id", F.regexp_count("content", F.lit(sp.java(packs.EMAIL))).alias("n_matches")).filter("n_matches > 0")


def regex_spans(spark, d):
    return _long(_requests(spark, d), "request_id", sp.regex_spans(F.col("content"), packs.EMAIL, None))


def keyword_spans(spark, d):
    return _long(_docs(spark, d), "doc_id", sp.keyword_spans(F.col("text"), "policy", 10))


def entropy_candidates(spark, d):
    files = table(spark, d, "files").select("file_id", "content").filter("content is not null")
    found = exploded(files, sp.entropy_hits(F.col("content"), 4.5, 12), "s", "file_id")
    return found.select("file_id", "s.start_pos", "s.matched", F.round("s.entropy", 6).alias("entropy")).distinct()


def normalize_nfc_strip(spark, d):
    return _requests(spark, d).select("request_id", F.md5(tx.normalize(F.col("content"))).alias("normal"))


def clean_text(spark, d):
    return _requests(spark, d).select("request_id", tx.clean(F.col("content")).alias("cleaned"))


_CARDS = r"[0-9][0-9 -]{10,24}[0-9]"


def luhn_cards(spark, d):
    return _long(_requests(spark, d), "request_id", sp.regex_spans(F.col("content"), _CARDS, None)).select("request_id", "matched", tx.luhn(F.col("matched")).alias("valid")).distinct()


def card_network(spark, d):
    # invented numbers with a right last digit are rare: every digit is tried as the last
    runs = _long(_requests(spark, d), "request_id", sp.regex_spans(F.col("content"), _CARDS, None)).select(tx.digits(F.col("matched")).alias("n")).filter(F.length("n").between(12, 18)).distinct()
    tried = runs.select("n", F.explode(F.array(*[F.lit(str(k)) for k in range(10)])).alias("k")).select(F.concat("n", "k").alias("number"))
    return tried.select("number", tx.card_network(F.col("number")).alias("network")).filter("network is not null")


_LUHN_SQL = """(length(n) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(n) + 1), lambda k: CASE WHEN k % 2 = 0 THEN
    (CASE WHEN 2 * CAST(n[length(n) - k + 1] AS INTEGER) > 9 THEN 2 * CAST(n[length(n) - k + 1] AS INTEGER) - 9 ELSE 2 * CAST(n[length(n) - k + 1] AS INTEGER) END)
    ELSE CAST(n[length(n) - k + 1] AS INTEGER) END)) % 10 = 0)"""
_NETWORK_SQL = "CASE " + " ".join(f"WHEN regexp_matches(n, '{rx}') THEN '{name}'" for rx, name in tx.NETWORKS) + " END"


def _composite(spark, d, mode: str, parts: list[str], negative: list[str] = ()):
    p = Pattern("composite", mode, 0.9, sub_patterns=tuple(Pattern("keyword", w, 0.9) for w in parts) + tuple(Pattern("keyword", w, 0.0) for w in negative))
    return _docs(spark, d).select("doc_id", pattern_spans(p, F.col("text"), 10).alias("s")).filter(F.size("s") > 0).select("doc_id")


def composite_and(spark, d):
    return _composite(spark, d, "and", ["certificate warning", "policy draft"], ["dependency list"])


def composite_or(spark, d):
    return _composite(spark, d, "or", ["certificate warning", "policy draft"])


def composite_not(spark, d):
    return _composite(spark, d, "not", ["session", "certificate warning"])


def composite_near(spark, d):
    return _composite(spark, d, "near:60", ["certificate warning", "policy draft"])


def _one_rule(spark, d, rule: Rule, language: str | None = None):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang").filter("text is not null")
    return evaluate(docs, [rule], "text", language=language)


def rule_any_first_pattern(spark, d):
    rule = Rule("O-31", "First pattern", "P1", "warn", (packs.keyword("certificate warning"), packs.keyword("policy draft")))
    return exploded(_one_rule(spark, d, rule), "results", "r", "doc_id").select("doc_id", "r.pattern_idx", F.size("r.spans").alias("n_spans"))


def rule_all_mode(spark, d):
    rule = Rule("O-32", "All patterns", "P1", "warn", (packs.keyword("certificate warning"), packs.keyword("policy draft")), "all")
    return _one_rule(spark, d, rule).filter(F.size("results") > 0).select("doc_id")


def rule_max_matches(spark, d):
    rule = Rule("O-33", "Few matches", "P2", "warn", (packs.keyword("the "),), max_matches=3)
    return matches(_one_rule(spark, d, rule), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_matches"), F.max("end_pos").alias("last_end"))


def rule_exclusions(spark, d):
    rule = Rule("O-34", "With exclusion", "P2", "warn", (packs.keyword("certificate"),), exclusions=("Policy|policy",))
    return _one_rule(spark, d, rule).filter(F.size("results") > 0).select("doc_id")


def rule_min_length(spark, d):
    rule = Rule("O-35", "Long texts", "P2", "warn", (packs.keyword("certificate"),), min_length=2000)
    return _one_rule(spark, d, rule).filter(F.size("results") > 0).select("doc_id")


def rule_max_length(spark, d):
    rule = Rule("O-51", "Oversized", "P2", "warn", no_pattern=True, max_length=5000)
    return _one_rule(spark, d, rule).filter(F.size("results") > 0).select("doc_id")


def language_filter_rule(spark, d):
    rule = Rule("O-36", "English only", "P2", "warn", (packs.keyword("policy"),), languages=("en",))
    return _one_rule(spark, d, rule, "lang").filter(F.size("results") > 0).select("doc_id")


def _judged(spark, d):
    return verdicts.verdict(verdicts.correlate(evaluate(_docs(spark, d), packs.PROSE, "text"), packs.PROSE), packs.PROSE)


def verdict_per_doc(spark, d):
    return _judged(spark, d).select("doc_id", "n_triggered", "match_count", "overall_severity", "overall_action", "blocked", "admin_alert", "compliance_audit", "gdpr_audit")


def context_boost(spark, d):
    df = verdicts.correlate(evaluate(_docs(spark, d), packs.PROSE, "text"), packs.PROSE)
    return exploded(df, "results", "r", "doc_id").filter("r.rule_id = 'O-22'").select("doc_id", "r.severity")


def link_rules(spark, d):
    df = verdicts.correlate(evaluate(_docs(spark, d), packs.PROSE, "text"), packs.PROSE)
    return exploded(df, "links", "k", "doc_id").select("doc_id", "k.rule_id", "k.linked")


def severity_reduction(spark, d):
    df = verdicts.correlate(evaluate(_docs(spark, d), packs.PROSE, "text"), packs.PROSE)
    return exploded(df, "results", "r", "doc_id").filter("r.rule_id = 'O-23'").select("doc_id", "r.severity")


def severity_histogram(spark, d):
    df = verdicts.correlate(evaluate(_docs(spark, d), packs.PROSE, "text"), packs.PROSE)
    return exploded(df, "results", "r").groupBy("r.rule_id", "r.severity").agg(F.count("*").alias("n"))


def top_triggered_rules(spark, d):
    fired = exploded(evaluate(_docs(spark, d), packs.PROSE, "text"), "results", "r").groupBy("r.rule_id").agg(F.count("*").alias("n_triggered"))
    return fired.orderBy(F.desc("n_triggered"), "rule_id").limit(20)


def warnings_list(spark, d):
    return exploded(_judged(spark, d), "warnings", "warning", "doc_id").groupBy("doc_id", "warning").agg(F.count("*").alias("n"))


def action_block_warn(spark, d):
    df = _judged(spark, d)
    return df.select("doc_id", F.md5(F.when(~F.col("blocked"), F.col("text"))).alias("content_md5"))


def redact_text(spark, d):
    df = _requests(spark, d).withColumn("s", sp.regex_spans(F.col("content"), packs.EMAIL, None))
    return df.select("request_id", verdicts.redact(F.col("content"), F.col("s")).alias("redacted"))


def truncate_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(tx.truncate_at_boundary(F.col("text"), 1000)).alias("cut_md5"), F.length(tx.truncate_at_boundary(F.col("text"), 1000)).alias("cut_length"))


def dynamic_action(spark, d):
    df = table(spark, d, "requests").select("request_id", "content", "suspicion_score").filter("content is not null").distinct()
    df = df.withColumn("s", sp.regex_spans(F.col("content"), packs.EMAIL, None))
    return df.select("request_id", verdicts.apply_action("dynamic", F.col("content"), F.col("s"), F.lit(False), F.col("suspicion_score")).alias("content_after"))


def surrounding_context(spark, d):
    docs = _docs(spark, d)
    hits = exploded(docs, sp.keyword_spans(F.col("text"), "certificate warning", 10), "s", "doc_id", "text")
    before, after = tx.surrounding(F.col("text"), F.col("s.start_pos"), F.col("s.end_pos"), 40)
    return hits.select("doc_id", "s.start_pos", before.alias("before"), after.alias("after"))


def line_column(spark, d):
    docs = _docs(spark, d)
    hits = exploded(docs, sp.keyword_spans(F.col("text"), "policy", 10), "s", "doc_id", "text")
    return hits.select("doc_id", "s.start_pos", tx.line_of(F.col("text"), F.col("s.start_pos")).alias("line_number"), tx.column_of(F.col("text"), F.col("s.start_pos")).alias("column_no"))


def audit_event_rows(spark, d):
    events = verdicts.audit_events(_judged(spark, d), "doc_id", "output")
    return events.select("doc_id", "stage", "rule_id", "rule_name", "severity", "action", "content_snippet", "match_count", "action_taken", "gdpr_relevant")


def evidence_rows(spark, d):
    return verdicts.evidence(_judged(spark, d), "doc_id", "text", width=30).groupBy("rule_id", "source_layer", F.lower("matching_text").alias("matching_text")).agg(F.count("*").alias("n"))


def evidence_language(spark, d):
    """Evidence with the language that the table names."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang").filter("text is not null").distinct()
    df = verdicts.evidence(evaluate(docs, packs.PROSE, "text"), "doc_id", "text", width=30, language="lang")
    return df.filter("source_layer = 'syntactic'").groupBy("rule_id", F.col("matching_text").alias("language")).agg(F.count("*").alias("n"))


def rule_table_matches(spark, d):
    """The rules of the table, as compiled from it, over all documents."""
    found = matches(evaluate(_docs(spark, d), rules_from_table(table(spark, d, "rules")), "text"), "doc_id")
    return found.groupBy("rule_id").agg(F.count("*").alias("n_matches"), F.countDistinct("doc_id").alias("n_docs"))


def rules_by_stage(spark, d):
    r = table(spark, d, "rules").filter("enabled").select(F.explode("applicable_stages").alias("stage"), "severity")
    return r.groupBy("stage", "severity").agg(F.count("*").alias("n_rules"))


def severity_report(spark, d):
    """Events by severity and action with subtotals."""
    e = table(spark, d, "audit_events").select(F.coalesce("severity", F.lit("none")).alias("severity"), "action")
    return e.rollup("severity", "action").agg(F.count("*").alias("n_events")).select(F.coalesce("severity", F.lit("all")).alias("severity"), F.coalesce("action", F.lit("all")).alias("action"), "n_events")


_S = r"\s"
_NORMAL_SQL = r"regexp_replace(regexp_replace(nfc_normalize(content), '[\x{200B}-\x{200F}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180E}\x{3164}\x{FFA0}]', '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]|\p{Cf}', '', 'g')"
_COUNT = lambda w: f"len(regexp_extract_all(text, '(?i){w}'))"
_FIRED = f"""SELECT doc_id, text, least({_COUNT('shell commands')}, 10) AS c1, least({_COUNT('certificate warning')}, 10) AS c2, least({_COUNT(packs.CODE)}, 5) AS c3, least({_COUNT('session')}, 4) AS c4 FROM {_DOCS}"""
_BOOST = f"""SELECT DISTINCT a.doc_id FROM ({_sql_spans(_DOCS, 'doc_id', 'text', '(?i)certificate warning', 10)}) a JOIN ({_sql_spans(_DOCS, 'doc_id', 'text', '(?i)' + packs.CODE, 5)}) b ON a.doc_id = b.doc_id
    AND least(abs(a.end_pos - b.start_pos), abs(b.end_pos - a.start_pos), abs(a.start_pos - b.end_pos), abs(b.start_pos - a.end_pos)) <= 300"""
_RULES_SQL = f"""WITH f AS ({_FIRED}), boosted AS ({_BOOST}),
    r AS (SELECT doc_id, text, 'O-21' AS rule_id, 'Shell commands' AS rule_name, 'P0' AS severity, 'block' AS action, c1 AS n, c1, c2, c3, c4 FROM f WHERE c1 > 0
    UNION ALL SELECT doc_id, text, 'O-22', 'Certificate warning', CASE WHEN doc_id IN (SELECT doc_id FROM boosted) THEN 'P0' ELSE 'P1' END, 'redact', c2, c1, c2, c3, c4 FROM f WHERE c2 > 0
    UNION ALL SELECT doc_id, text, 'O-23', 'Counted things', CASE WHEN c4 > 0 THEN 'P2' ELSE 'P1' END, 'warn', c3, c1, c2, c3, c4 FROM f WHERE c3 > 0
    UNION ALL SELECT doc_id, text, 'O-24', 'Session marked', 'P2', 'warn', c4, c1, c2, c3, c4 FROM f WHERE c4 > 0)"""
_CUT = """(CASE WHEN length(text) <= 1000 THEN text ELSE regexp_replace(left(text, CASE WHEN b = 0 THEN (CASE WHEN f > 0 THEN 999 + f ELSE 1000 END) WHEN 1002 - b = 1000 AND f > 0 THEN 999 + f ELSE 1002 - b END), '\\s+$', '') || chr(10) || chr(10) || '<<TRUNCATED>>' END)"""

QUERIES = {
    f.__name__: f
    for f in (
        regex_match_count, regex_spans, keyword_spans, entropy_candidates, normalize_nfc_strip, clean_text, luhn_cards, card_network, composite_and, composite_or, composite_not, composite_near,
        rule_any_first_pattern, rule_all_mode, rule_max_matches, rule_exclusions, rule_min_length, rule_max_length, language_filter_rule, verdict_per_doc, context_boost, link_rules, severity_reduction,
        severity_histogram, top_triggered_rules, warnings_list, action_block_warn, redact_text, truncate_text, dynamic_action, surrounding_context, line_column, audit_event_rows, evidence_rows, evidence_language, rule_table_matches, rules_by_stage, severity_report,
    )
}
ORACLE = {
    "regex_match_count": f"SELECT request_id, CAST(len(regexp_extract_all(content, '(?i){packs.EMAIL}')) AS INTEGER) AS n_matches FROM {_REQUESTS} WHERE regexp_matches(content, '(?i){packs.EMAIL}')",
    "regex_spans": _sql_spans(_REQUESTS, "request_id", "content", "(?i)" + packs.EMAIL, None),
    "keyword_spans": _sql_spans(_DOCS, "doc_id", "text", "(?i)policy", 10),
    "entropy_candidates": f"""WITH s AS ({_sql_spans("(SELECT DISTINCT file_id, content FROM files WHERE content IS NOT NULL)", 'file_id', 'content', sp.ENTROPY_RUN, None).replace("left(ms[i], 500)", "ms[i]")}),
        c AS (SELECT file_id, start_pos, matched, length(matched) AS n, list_distinct(string_split(matched, '')) AS k, string_split(matched, '') AS a FROM s WHERE end_pos - start_pos >= 12),
        e AS (SELECT file_id, start_pos, matched, len(k) AS kinds, -list_sum(list_transform(k, lambda x: (len(list_filter(a, lambda y: y = x)) / n) * log2(len(list_filter(a, lambda y: y = x)) / n))) AS h FROM c)
        SELECT DISTINCT file_id, start_pos, left(matched, 500) AS matched, round(h, 6) AS entropy FROM e WHERE kinds >= 3 AND h >= 4.5""",
    "normalize_nfc_strip": f"SELECT request_id, md5({_NORMAL_SQL}) AS normal FROM {_REQUESTS}",
    "luhn_cards": f"WITH s AS ({_sql_spans(_REQUESTS, 'request_id', 'content', _CARDS, None)}), t AS (SELECT request_id, matched, regexp_replace(matched, '[^0-9]', '', 'g') AS n FROM s) SELECT DISTINCT request_id, matched, {_LUHN_SQL} AS valid FROM t",
    "card_network": f"WITH s AS ({_sql_spans(_REQUESTS, 'request_id', 'content', _CARDS, None)}), u AS (SELECT DISTINCT regexp_replace(matched, '[^0-9]', '', 'g') AS r FROM s), t AS (SELECT r || CAST(k AS VARCHAR) AS n FROM u, range(10) g(k) WHERE length(r) BETWEEN 12 AND 18) SELECT n AS number, {_NETWORK_SQL} AS network FROM t WHERE {_LUHN_SQL} AND {_NETWORK_SQL} IS NOT NULL",
    "composite_and": f"SELECT doc_id FROM {_DOCS} WHERE contains(lower(text), 'certificate warning') AND contains(lower(text), 'policy draft') AND NOT contains(lower(text), 'dependency list')",
    "composite_or": f"SELECT doc_id FROM {_DOCS} WHERE contains(lower(text), 'certificate warning') OR contains(lower(text), 'policy draft')",
    "composite_not": f"SELECT doc_id FROM {_DOCS} WHERE NOT contains(lower(text), 'session') AND contains(lower(text), 'certificate warning')",
    "composite_near": f"""WITH a AS ({_sql_spans(_DOCS, 'doc_id', 'text', '(?i)certificate warning', 10)}), b AS ({_sql_spans(_DOCS, 'doc_id', 'text', '(?i)policy draft', 10)}),
        both_ AS (SELECT doc_id FROM a INTERSECT SELECT doc_id FROM b), s AS (SELECT doc_id, 1 AS part, match_no, start_pos, end_pos FROM a UNION ALL SELECT doc_id, 2, match_no, start_pos, end_pos FROM b)
        SELECT DISTINCT x.doc_id FROM s x JOIN s y ON x.doc_id = y.doc_id AND (x.part, x.match_no) < (y.part, y.match_no) WHERE least(abs(x.end_pos - y.start_pos), abs(y.end_pos - x.start_pos)) <= 60 AND x.doc_id IN (SELECT doc_id FROM both_)""",
    "rule_any_first_pattern": f"""SELECT doc_id, CAST(CASE WHEN contains(lower(text), 'certificate warning') THEN 0 ELSE 1 END AS INTEGER) AS pattern_idx,
        CAST(least(10, CASE WHEN contains(lower(text), 'certificate warning') THEN {_COUNT('certificate warning')} ELSE {_COUNT('policy draft')} END) AS INTEGER) AS n_spans FROM {_DOCS} WHERE contains(lower(text), 'certificate warning') OR contains(lower(text), 'policy draft')""",
    "rule_all_mode": f"SELECT doc_id FROM {_DOCS} WHERE contains(lower(text), 'certificate warning') AND contains(lower(text), 'policy draft')",
    "rule_max_matches": f"SELECT doc_id, count(*) AS n_matches, max(end_pos) AS last_end FROM ({_sql_spans(_DOCS, 'doc_id', 'text', '(?i)the ', 3)}) GROUP BY doc_id",
    "rule_exclusions": f"SELECT doc_id FROM {_DOCS} WHERE contains(lower(text), 'certificate') AND NOT regexp_matches(text, 'Policy|policy')",
    "rule_min_length": f"SELECT doc_id FROM {_DOCS} WHERE contains(lower(text), 'certificate') AND length(text) >= 2000",
    "rule_max_length": f"SELECT doc_id FROM {_DOCS} WHERE length(text) > 5000",
    "language_filter_rule": "SELECT doc_id FROM documents WHERE text IS NOT NULL AND contains(lower(text), 'policy') AND (lang IS NULL OR lang = 'en')",
    "verdict_per_doc": f"""WITH f AS ({_FIRED}), boosted AS ({_BOOST}) SELECT doc_id, CAST((c1 > 0)::INT + (c2 > 0)::INT + (c3 > 0)::INT + (c4 > 0)::INT AS INTEGER) AS n_triggered, CAST(c1 + c2 + c3 + c4 AS INTEGER) AS match_count,
        CASE WHEN c1 > 0 OR doc_id IN (SELECT doc_id FROM boosted) THEN 'P0' WHEN c2 > 0 OR c3 > 0 THEN 'P1' ELSE 'P2' END AS overall_severity, CASE WHEN c1 > 0 THEN 'block' ELSE 'warn' END AS overall_action,
        c1 > 0 AS blocked, c1 > 0 AS admin_alert, c4 > 0 AS compliance_audit, c2 > 0 AS gdpr_audit FROM f""",
    "context_boost": f"{_RULES_SQL} SELECT doc_id, severity FROM r WHERE rule_id = 'O-22'",
    "link_rules": f"WITH f AS ({_FIRED}) SELECT doc_id, 'O-23' AS rule_id, 'O-22' AS linked FROM f WHERE c2 > 0 AND c3 > 0",
    "severity_reduction": f"{_RULES_SQL} SELECT doc_id, severity FROM r WHERE rule_id = 'O-23'",
    "severity_histogram": f"{_RULES_SQL} SELECT rule_id, severity, count(*) AS n FROM r GROUP BY rule_id, severity",
    "top_triggered_rules": f"{_RULES_SQL} SELECT rule_id, count(*) AS n_triggered FROM r GROUP BY rule_id ORDER BY n_triggered DESC, rule_id LIMIT 20",
    "warnings_list": f"""WITH a AS ({_sql_spans(_DOCS, 'doc_id', 'text', '(?i)' + packs.CODE, 5)}), b AS ({_sql_spans(_DOCS, 'doc_id', 'text', '(?i)session', 4)})
        SELECT doc_id, warning, count(*) AS n FROM (SELECT doc_id, '[O-23] Counted things: ' || matched AS warning FROM a UNION ALL SELECT doc_id, '[O-24] Session marked: ' || matched FROM b) GROUP BY doc_id, warning""",
    "action_block_warn": f"SELECT doc_id, CASE WHEN NOT contains(lower(text), 'shell commands') THEN md5(text) END AS content_md5 FROM {_DOCS}",
    "redact_text": f"SELECT request_id, regexp_replace(content, '(?i){packs.EMAIL}', '[REDACTED]', 'g') AS redacted FROM {_REQUESTS}",
    "truncate_text": f"""WITH t AS (SELECT doc_id, text, instr(reverse(substring(text, 802, 200)), chr(10)) AS b0, instr(substring(text, 1001, 200), chr(10)) AS f FROM {_DOCS}), u AS (SELECT doc_id, text, f, b0 AS b FROM t), v AS (SELECT doc_id, {_CUT} AS cut FROM u)
        SELECT doc_id, md5(cut) AS cut_md5, CAST(length(cut) AS INTEGER) AS cut_length FROM v""",
    "dynamic_action": f"SELECT DISTINCT request_id, CASE WHEN suspicion_score > 50 THEN NULL ELSE regexp_replace(content, '(?i){packs.EMAIL}', '[REDACTED]', 'g') END AS content_after FROM requests WHERE content IS NOT NULL",
    "surrounding_context": f"WITH s AS ({_sql_spans(_DOCS, 'doc_id', 'text', '(?i)certificate warning', 10)}) SELECT s.doc_id, s.start_pos, trim(substring(d.text, greatest(0, s.start_pos - 40) + 1, s.start_pos - greatest(0, s.start_pos - 40)), ' ' || chr(9) || chr(10) || chr(13)) AS \"before\", trim(substring(d.text, s.end_pos + 1, 40), ' ' || chr(9) || chr(10) || chr(13)) AS after FROM s JOIN {_DOCS} d USING (doc_id)",
    "line_column": f"WITH s AS ({_sql_spans(_DOCS, 'doc_id', 'text', '(?i)policy', 10)}), p AS (SELECT s.doc_id, s.start_pos, left(d.text, s.start_pos) AS pre FROM s JOIN {_DOCS} d USING (doc_id)) SELECT doc_id, start_pos, CAST(length(pre) - length(replace(pre, chr(10), '')) + 1 AS INTEGER) AS line_number, CAST(CASE WHEN instr(reverse(pre), chr(10)) > 0 THEN instr(reverse(pre), chr(10)) ELSE start_pos + 1 END AS INTEGER) AS column_no FROM p",
    "audit_event_rows": f"""{_RULES_SQL} SELECT doc_id, 'output' AS stage, rule_id, rule_name, severity, action,
        CASE rule_id WHEN 'O-21' THEN regexp_extract(text, '(?i)shell commands') WHEN 'O-22' THEN regexp_extract(text, '(?i)certificate warning') WHEN 'O-23' THEN regexp_extract(text, '(?i){packs.CODE}') ELSE regexp_extract(text, '(?i)session') END AS content_snippet,
        CAST(n AS INTEGER) AS match_count, CASE WHEN c1 > 0 THEN 'block' ELSE 'warn' END AS action_taken, FALSE AS gdpr_relevant FROM r""",
    "evidence_rows": f"""WITH s AS (SELECT doc_id, 'O-21' AS rule_id, matched FROM ({_sql_spans(_DOCS, 'doc_id', 'text', '(?i)shell commands', 10)}) UNION ALL SELECT doc_id, 'O-22', matched FROM ({_sql_spans(_DOCS, 'doc_id', 'text', '(?i)certificate warning', 10)})
        UNION ALL SELECT doc_id, 'O-23', matched FROM ({_sql_spans(_DOCS, 'doc_id', 'text', '(?i)' + packs.CODE, 5)}) UNION ALL SELECT doc_id, 'O-24', matched FROM ({_sql_spans(_DOCS, 'doc_id', 'text', '(?i)session', 4)})),
        f AS ({_FIRED}) SELECT rule_id, 'lexical' AS source_layer, lower(matched) AS matching_text, count(*) AS n FROM s GROUP BY rule_id, lower(matched) UNION ALL SELECT 'O-23', 'correlation', 'o-22', count(*) FROM f WHERE c2 > 0 AND c3 > 0 HAVING count(*) > 0""",
    "evidence_language": f"""WITH f AS (SELECT DISTINCT d.doc_id, d.lang, f.c1, f.c2, f.c3, f.c4 FROM documents d JOIN ({_FIRED}) f ON d.doc_id = f.doc_id WHERE d.lang IS NOT NULL AND d.text IS NOT NULL)
        SELECT 'O-21' AS rule_id, lang AS language, count(*) AS n FROM f WHERE c1 > 0 GROUP BY lang UNION ALL SELECT 'O-22', lang, count(*) FROM f WHERE c2 > 0 GROUP BY lang UNION ALL SELECT 'O-23', lang, count(*) FROM f WHERE c3 > 0 GROUP BY lang
        UNION ALL SELECT 'O-24', lang, count(*) FROM f WHERE c4 > 0 GROUP BY lang""",
    "rule_table_matches": f"""WITH r AS (SELECT rule_id, max_matches, lower(patterns[1].pattern) AS p FROM rules WHERE enabled),
        m AS (SELECT rule_id, doc_id, least(max_matches, CAST((length(text) - length(replace(lower(text), p, ''))) / length(p) AS INTEGER)) AS n FROM r, {_DOCS} WHERE contains(lower(text), p))
        SELECT rule_id, CAST(sum(n) AS BIGINT) AS n_matches, count(DISTINCT doc_id) AS n_docs FROM m GROUP BY rule_id""",
    "rules_by_stage": "SELECT stage, severity, count(*) AS n_rules FROM (SELECT unnest(applicable_stages) AS stage, severity FROM rules WHERE enabled) GROUP BY stage, severity",
    "severity_report": "SELECT coalesce(severity, 'all') AS severity, coalesce(action, 'all') AS action, count(*) AS n_events FROM (SELECT coalesce(severity, 'none') AS severity, action FROM audit_events) GROUP BY ROLLUP (severity, action)",
}
NO_SQL = {"clean_text": "compatibility forms: clean_cases"}
