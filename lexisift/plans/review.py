"""Queries over sessions, chunked output, files and findings, analysers and lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexisift.functions.rows import exploded
from lexisift.operators import analyzers, lookups, output_probes, scanner, sessions
from lexisift.operators.probes import probe
from lexisift.operators.rules import evaluate
from lexisift.session import table
from lexisift.streaming import chunks

from . import packs


def _messages(spark, d):
    r = table(spark, d, "requests").filter("session_id is not null and content is not null")
    return r.select("request_id", "session_id", "request_timestamp", "content").distinct()


def _tracked(spark, d):
    fired = evaluate(_messages(spark, d), packs.SESSION, "content")
    return sessions.track(fired, "session_id", ["request_timestamp", "request_id"], packs.WATCHERS)


def session_score(spark, d):
    return _tracked(spark, d).select("request_id", "session_id", "history_count", "score_before", "score", "is_polluted")


def session_rules(spark, d):
    return exploded(_tracked(spark, d), "session_rules", "rule_id", "request_id")


def session_states(spark, d):
    return sessions.states(_tracked(spark, d), "session_id")


def session_reset(spark, d):
    """States of sessions that were reset at the middle of the year."""
    m = _messages(spark, d)
    resets = m.select("session_id", F.lit("2025-07-01 00:00:00").cast("timestamp").alias("reset_at")).distinct()
    fired = evaluate(sessions.since_reset(m, resets, "session_id", "request_timestamp"), packs.SESSION, "content")
    return sessions.states(sessions.track(fired, "session_id", ["request_timestamp", "request_id"], packs.WATCHERS), "session_id")


def prune_sessions(spark, d):
    return sessions.idle(_messages(spark, d), "session_id", "request_timestamp", F.lit("2025-12-01 00:00:00").cast("timestamp"), 24 * 60).withColumn("last_activity", F.unix_micros("last_activity"))


def stream_cumulative_length(spark, d):
    m = _messages(spark, d).withColumn("at", F.struct("request_timestamp", "request_id"))
    return chunks.cumulative_length(m, "session_id", "at", "content", 2000).select("request_id", "session_id", "cumulative_length", "over_limit")


def stream_assembled(spark, d):
    m = _messages(spark, d).withColumn("at", F.struct("request_timestamp", "request_id"))
    return chunks.assembled(m, "session_id", "at", "content").select("session_id", F.md5("content").alias("content_md5"))


def _boundary(spark, d, mode: str):
    docs = table(spark, d, "documents").select("doc_id", "text").filter("text is not null")
    return exploded(docs, chunks.boundaries(F.col("text"), mode), "position", "doc_id")


def boundary_line(spark, d):
    return _boundary(spark, d, "line")


def boundary_paragraph(spark, d):
    return _boundary(spark, d, "paragraph")


def boundary_word(spark, d):
    return _boundary(spark, d, "word").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("position").alias("last"))


def boundary_sentence(spark, d):
    return _boundary(spark, d, "sentence")


def fast_rules(spark, d):
    """The first phase over output chunks: only rules without entropy or composite patterns."""
    fast = [r for r in packs.FLAGSHIP if all(p.type in ("regex", "keyword") for p in r.patterns)]
    fired = evaluate(_messages(spark, d), fast, "content")
    return exploded(fired, "results", "r", "request_id").groupBy("r.rule_id").agg(F.count("*").alias("n"))


def _files(spark, d):
    """Files with text. Repeated rows are kept: their results are made one, which spares a shuffle of texts."""
    return table(spark, d, "files").filter("content is not null and not coalesce(is_binary, false)")


def _rows(files):
    """Files with a number for the row, for what orders the lines of one row."""
    return files.withColumn("_row", F.monotonically_increasing_id())


def scan_admitted(spark, d):
    f = table(spark, d, "files").select("file_id", "file_path", "file_size").distinct()
    return f.filter(scanner.admitted(F.col("file_path"), F.col("file_size"))).select("file_id")


def scan_targets(spark, d):
    f = table(spark, d, "files").select("file_id", "file_path").distinct()
    return f.filter(scanner.targeted(F.col("file_path"), ["**/*.py", "web/**/*.js", "*.yml"])).select("file_id")


def scan_findings(spark, d):
    return scanner.scan(_files(spark, d)).drop("message")


def scan_commands(spark, d):
    """One of the scan's probes, which SQL can follow."""
    found = scanner.scan(_files(spark, d), probes=[p for p in scanner.code_probes.PROBES if p.rule_id == "SEC-51" and "subprocess" in p.pattern])
    return found.select("file_id", "rule_id", "line_number", "column_no", "matched_text").distinct()


_DOCKER = [("IAC-01", "dockerfile", r"FROM:.*:latest", 0.7), ("IAC-01", "dockerfile", r"USER:\s*root", 0.8)]


def scan_dockerfile(spark, d):
    f = _files(spark, d).filter(F.lower("file_path").rlike(r"(^|/)dockerfile[^/]*$")).select("file_id", "content")
    return scanner.config_hits(_rows(f), "content", _DOCKER, ["file_id", "_row"]).select("file_id", "rule_id", "start_pos", "end_pos", "matched").distinct()


def scan_keyvalue(spark, d):
    f = _files(spark, d).filter(F.col("file_path").rlike(r"\.(?:yaml|yml)$")).select("file_id", "content")
    return scanner.config_hits(_rows(f), "content", [("SEC-37", "keyvalue", "replicas:^[1-3]$", 0.6)], ["file_id", "_row"]).select("file_id", "rule_id", "start_pos", "matched").distinct()


def scan_yaml_paths(spark, d):
    f = _files(spark, d).filter(F.col("file_path").rlike(r"\.(?:yaml|yml)$")).select("file_id", "content")
    return scanner.yaml_hits(f, "content", [("IAC-04", "label_0.replicas:^[1-9]$", 0.6), ("IAC-04", "policy_0.env.- name:MODE$", 0.5)], ["file_id"]).distinct()


def scan_null_dereference(spark, d):
    return scanner.null_dereferences(_rows(_files(spark, d).select("file_id", "file_path", "content")), "file_path", "content", ["file_id", "_row"]).drop("_row").distinct()


def scan_structural(spark, d):
    f = _files(spark, d).select("file_id", F.explode(scanner.structural_hits(F.col("file_path"), F.col("content"))).alias("h"))
    return f.select("file_id", "h.rule_id", "h.matched").distinct()


def findings_dedupe(spark, d):
    """Of findings of a rule at one place the first stays."""
    f = table(spark, d, "findings")
    w = Window.partitionBy("file_id", "rule_id", "line_number", "column_no").orderBy("finding_id")
    return f.withColumn("n", F.row_number().over(w)).filter("n = 1").select("finding_id")


def findings_by_severity(spark, d):
    return scanner.by_severity(table(spark, d, "findings"))


def incremental_manifest_diff(spark, d):
    """Files that are new or changed against a manifest of those last modified before mid-year."""
    f = table(spark, d, "files").select("file_id", "repo", "file_path", "modified_at", "file_size", F.coalesce("content", F.lit("")).alias("content")).distinct()
    f = f.withColumn("fp", scanner.fingerprint(F.concat_ws("/", "repo", "file_path"), F.lit(""), F.col("file_size"), F.col("content")))
    manifest = f.filter("modified_at < timestamp'2025-07-01 00:00:00'")
    return scanner.changed(f, manifest, ["repo", "file_path", "fp"]).select("file_id")


def output_probe_hits(spark, d):
    f = probe(_files(spark, d).select("file_id", "content"), "content", output_probes.PROBES, adjust=True)
    return exploded(f, "hits", "h", "file_id").select("file_id", "h.rule_id", "h.start_pos", "h.end_pos", "h.matched", "h.confidence").distinct()


def output_probe_summary(spark, d):
    return output_probe_hits(spark, d).groupBy("rule_id").agg(F.count("*").alias("n_hits"), F.countDistinct("file_id").alias("n_files"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


def language_detect(spark, d):
    f = analyzers.detect_language(_files(spark, d).select("file_id", "content"), "content")
    return f.select("file_id", "detected.language", "detected.confidence").distinct()


def data_flow_taint(spark, d):
    f = analyzers.data_flow(_files(spark, d).select("file_id", "content", F.lower("language").alias("language")), "content", "language")
    return exploded(f, "flows", "x", "file_id").select("file_id", "x.sink", "x.position", "x.flow", "x.confidence").distinct()


def code_blocks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text").filter("text is not null")
    return analyzers.code_blocks(docs, "doc_id", "text")


def code_block_merge(spark, d):
    """Islands over the spans of audit events of one request."""
    e = table(spark, d, "audit_events").filter("request_id is not null").select("request_id", F.explode("matched_spans").alias("s"))
    blocks = e.select("request_id", "s.start_pos", "s.end_pos", F.lit(None).cast("string").alias("language")).distinct()
    return analyzers.merge_islands(blocks, "request_id").drop("language")


def domain_reputation(spark, d):
    r = table(spark, d, "requests").select("request_id", F.explode(F.regexp_extract_all("content", F.lit(r"@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"), F.lit(1))).alias("domain")).distinct()
    return r.select("request_id", "domain", lookups.domain_risk(F.col("domain"), (*lookups.TRUSTED, "example.com")).alias("risk"))


def _dependencies(spark, d):
    f = _files(spark, d).filter(F.col("file_path").rlike(r"lock\.json$"))
    return f.select(F.explode(F.regexp_extract_all("content", F.lit(r'"(?:node_modules/)?(?:@[a-z-]+/)?([a-z][a-z-]+)": ?\{'), F.lit(1))).alias("package")).distinct()


def package_registry(spark, d):
    known = spark.createDataFrame([("npm", x) for x in ("ledger", "budget", "policy", "ticket")], "ecosystem string, package string")
    return lookups.registered(_dependencies(spark, d).withColumn("ecosystem", F.lit("npm")), known)


def cve_lookup(spark, d):
    f = _files(spark, d).filter(F.col("file_path").rlike(r"lock\.json$"))
    pairs = f.select(F.regexp_extract_all("content", F.lit(r'"version": ?"([0-9.]+)"'), F.lit(1)).alias("v")).select(F.explode("v").alias("version"), F.lit("ui-kit").alias("package")).distinct()
    advisories = spark.createDataFrame([("A-1", "kit", "<3.0"), ("A-2", "ui-kit-extra", ">=20.0,<23"), ("A-3", "other", "<9")], "advisory string, package string, versions string")
    return lookups.vulnerable(pairs, advisories)


_M = "(SELECT DISTINCT request_id, session_id, request_timestamp, content FROM requests WHERE session_id IS NOT NULL AND content IS NOT NULL)"
_TRACK = f"""WITH m AS (SELECT *, regexp_matches(content, '(?i){packs.EMAIL}') AS e, regexp_matches(content, '{packs.ADDRESS}') AS a, contains(lower(content), 'deployment') AS p FROM {_M}),
    s AS (SELECT request_id, session_id, request_timestamp, a, 10 * e::INT + 20 * a::INT + 5 * p::INT AS points FROM m),
    t AS (SELECT request_id, session_id, a, points, sum(points) OVER w AS score, row_number() OVER w AS history_count, bool_or(a) OVER w AS seen FROM s WINDOW w AS (PARTITION BY session_id ORDER BY request_timestamp, request_id ROWS UNBOUNDED PRECEDING))"""
_D = "(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"
_F = "(SELECT DISTINCT file_id, file_path, content FROM files WHERE content IS NOT NULL AND NOT coalesce(is_binary, FALSE))"


def _positions(mode: str) -> str:
    from .detection import _sql_spans

    if mode == "sentence":  # without looking around: the stop and the first letter are part of the match
        rx = r"[.?!][\s\x{85}\p{Z}\x0b\x1c-\x1f]+[A-Z\"''(\[{]"
        return f"SELECT doc_id, CAST(start_pos + 2 AS INTEGER) AS position FROM ({_sql_spans(_D, 'doc_id', 'text', rx, None)}) WHERE start_pos + 2 >= 50"
    rx, at = {"line": (r"\n", "start_pos"), "paragraph": (r"\n\s*\n", "end_pos"), "word": (r"[\s\x{85}\p{Z}\x0b\x1c-\x1f]", "start_pos")}[mode]
    return f"SELECT doc_id, {at} AS position FROM ({_sql_spans(_D, 'doc_id', 'text', rx, None)}) WHERE {at} >= 50"


def _luhn() -> str:
    from .detection import _LUHN_SQL

    return _LUHN_SQL


_LINES = "SELECT file_id, no, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY file_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start_pos FROM (SELECT file_id, unnest(string_split(content, chr(10))) AS line, unnest(range(0, len(string_split(content, chr(10))))) AS no FROM {src})"
QUERIES = {
    f.__name__: f
    for f in (
        session_score, session_rules, session_states, session_reset, prune_sessions, stream_cumulative_length, stream_assembled, boundary_line, boundary_paragraph, boundary_word, boundary_sentence, fast_rules, scan_admitted, scan_targets, scan_findings,
        scan_commands, scan_dockerfile, scan_keyvalue, scan_yaml_paths, scan_null_dereference, scan_structural, findings_dedupe, findings_by_severity, incremental_manifest_diff, output_probe_hits, output_probe_summary,
        language_detect, data_flow_taint, code_blocks, code_block_merge, domain_reputation, package_registry, cve_lookup,
    )
}
ORACLE = {
    "session_score": f"{_TRACK} SELECT request_id, session_id, CAST(history_count AS INTEGER) AS history_count, CAST(score - points AS BIGINT) AS score_before, CAST(score AS BIGINT) AS score, score > 50 AS is_polluted FROM t",
    "session_rules": f"{_TRACK} SELECT request_id, 'B-47' AS rule_id FROM t WHERE score >= 15 UNION ALL SELECT request_id, 'B-42' FROM t WHERE score > 50 AND seen",
    "session_states": f"{_TRACK} SELECT session_id, CAST(count(*) AS INTEGER) AS history_count, CAST(max(score) AS BIGINT) AS score, max(score) > 50 AS is_polluted FROM t GROUP BY session_id",
    "session_reset": _TRACK.replace(f"FROM {_M})", f"FROM {_M} WHERE request_timestamp >= TIMESTAMPTZ '2025-07-01 00:00:00+00')") + " SELECT session_id, CAST(count(*) AS INTEGER) AS history_count, CAST(max(score) AS BIGINT) AS score, max(score) > 50 AS is_polluted FROM t GROUP BY session_id",
    "prune_sessions": f"SELECT session_id, epoch_us(max(request_timestamp)) AS last_activity, count(*) AS n_messages FROM {_M} GROUP BY session_id HAVING max(request_timestamp) < TIMESTAMPTZ '2025-12-01 00:00:00+00' - INTERVAL 1440 HOURS",
    "stream_cumulative_length": f"SELECT request_id, session_id, CAST(sum(length(content)) OVER w AS BIGINT) AS cumulative_length, sum(length(content)) OVER w > 2000 AS over_limit FROM {_M} WINDOW w AS (PARTITION BY session_id ORDER BY request_timestamp, request_id ROWS UNBOUNDED PRECEDING)",
    "stream_assembled": f"SELECT session_id, md5(string_agg(content, '' ORDER BY request_timestamp, request_id)) AS content_md5 FROM {_M} GROUP BY session_id",
    "boundary_line": _positions("line"),
    "boundary_paragraph": _positions("paragraph"),
    "boundary_word": f"SELECT doc_id, count(*) AS n, max(position) AS last FROM ({_positions('word')}) GROUP BY doc_id",
    "boundary_sentence": _positions("sentence"),
    "fast_rules": f"""WITH m AS (SELECT request_id, content FROM {_M}), c AS (SELECT request_id, unnest(regexp_extract_all(content, '{packs.DIGITS}')[:10]) AS x FROM m), t AS (SELECT request_id, regexp_replace(x, '[^0-9]', '', 'g') AS n FROM c)
        SELECT 'I-14' AS rule_id, count(DISTINCT request_id) AS n FROM t WHERE {_luhn()} HAVING count(*) > 0 UNION ALL SELECT 'I-13', count(*) FROM m WHERE regexp_matches(content, '(?i){packs.EMAIL}') HAVING count(*) > 0
        UNION ALL SELECT 'I-10', count(*) FROM m WHERE regexp_matches(content, '{packs.ADDRESS}') HAVING count(*) > 0 UNION ALL SELECT 'I-11', count(*) FROM m WHERE regexp_matches(content, '\\+[0-9]{{1,3}}[ .-][0-9 .()-]{{6,16}}[0-9]') HAVING count(*) > 0
        UNION ALL SELECT 'I-20', count(*) FROM m WHERE contains(lower(content), 'certificate') OR contains(lower(content), 'token') HAVING count(*) > 0""",
    "scan_null_dereference": f"""WITH l AS ({_LINES.format(src="(SELECT file_id, content FROM " + _F + " WHERE regexp_matches(file_path, '(?i)\\.(java|go|cs|kt|swift)$'))")}), p AS (SELECT *, lead(line) OVER (PARTITION BY file_id ORDER BY no) AS below FROM l)
        SELECT file_id, 'SEC-54' AS rule_id, CAST(no + 1 AS INTEGER) AS line_number, left(trim(line, ' ' || chr(9) || chr(13)), 200) AS matched, 0.4::DOUBLE AS confidence FROM p
        WHERE regexp_matches(line, '(\\.find(ById|One|First)?|\\.getOrNull|Optional\\.ofNullable|FirstOrDefault|getFirst)\\s*\\([^)]*\\)') AND regexp_matches(below, '\\.\\s*\\w+\\s*\\(')
        AND NOT regexp_matches(line || chr(10) || below, '\\bisPresent\\b|\\bifNull\\b|orElse\\b|orElseThrow\\b|!= null|!= nil|!= None|\\bisNotNull\\b')""",
    "scan_structural": f"""WITH f AS (SELECT file_id, file_path, content, lower(regexp_extract(file_path, '[^/]*$')) AS name, regexp_matches(file_path, '(?i)\\.ya?ml$') AS yaml FROM {_F}),
        k AS (SELECT *, regexp_matches(content, '(?m)^\\s*securityContext:') AS a, regexp_matches(content, '(?m)^\\s*podSecurityContext:') AS b, regexp_matches(content, '(?m)^\\s*readOnlyRootFilesystem:') AS c FROM f)
        SELECT file_id, 'IAC-18' AS rule_id, 'Dockerfile without HEALTHCHECK' AS matched FROM k WHERE starts_with(name, 'dockerfile') AND NOT regexp_matches(content, '(?im)^\\s*HEALTHCHECK')
        UNION ALL SELECT file_id, 'IAC-20', 'Workload without NetworkPolicy' FROM k WHERE yaml AND regexp_matches(content, '(?m)^(#.*)?\\s*kind:\\s*(Deployment|Pod|StatefulSet|DaemonSet|Service)') AND NOT regexp_matches(content, '(?m)^kind:\\s*NetworkPolicy\\b')
        UNION ALL SELECT file_id, 'IAC-21', 'Chart without ' || concat_ws(', ', CASE WHEN NOT a THEN 'securityContext' END, CASE WHEN NOT b THEN 'podSecurityContext' END, CASE WHEN NOT c THEN 'readOnlyRootFilesystem' END) FROM k WHERE yaml AND regexp_matches(name, 'values|chart') AND (NOT a OR NOT c)""",
    "scan_admitted": f"""SELECT DISTINCT file_id FROM files WHERE NOT list_has_any(string_split(file_path, '/')[1:-2], [{', '.join(repr(x) for x in scanner.SKIPPED_DIRS)}])
        AND len(list_filter(string_split(file_path, '/')[1:-2], lambda x: starts_with(x, '.') AND length(x) > 1)) = 0
        AND (lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) NOT IN ({', '.join(repr(x) for x in scanner.SKIPPED_EXTENSIONS)}) OR regexp_matches(file_path, '(?i)(^|/)dockerfile[^/]*$')) AND file_size <= 1048576""",
    "scan_targets": "SELECT DISTINCT file_id FROM files WHERE regexp_matches(file_path, '(^|/)[^/]*\\.py$') OR regexp_matches(file_path, '(^|/)web/(.*/)?[^/]*\\.js$') OR regexp_matches(file_path, '(^|/)[^/]*\\.yml$')",
    "scan_commands": f"""WITH l AS ({_LINES.format(src="(SELECT file_id, content FROM " + _F + " WHERE regexp_matches(lower(file_path), '\\.(py|js|ts|java|go|cs|php|rb|rs)$'))")})
        SELECT DISTINCT file_id, 'SEC-51' AS rule_id, CAST(no + 1 AS INTEGER) AS line_number, CAST(instr(line, regexp_extract(line, 'subprocess\\.(?:call|Popen|run|check_output|check_call)\\s*\\(')) AS INTEGER) AS column_no,
        regexp_extract(line, 'subprocess\\.(?:call|Popen|run|check_output|check_call)\\s*\\(') AS matched_text FROM l WHERE regexp_matches(line, 'subprocess\\.(?:call|Popen|run|check_output|check_call)\\s*\\(')""",
    "scan_dockerfile": f"""WITH l AS ({_LINES.format(src="(SELECT file_id, content FROM " + _F + " WHERE regexp_matches(file_path, '(?i)(^|/)dockerfile[^/]*$'))")})
        SELECT file_id, 'IAC-01' AS rule_id, start_pos, CAST(start_pos + length(line) AS INTEGER) AS end_pos, left(trim(line, ' ' || chr(9) || chr(13)), 200) AS matched FROM l WHERE starts_with(upper(trim(line, ' ' || chr(9) || chr(13))), 'FROM') AND regexp_matches(trim(line, ' ' || chr(9) || chr(13))[5:], '(?i).*:latest')
        UNION ALL SELECT file_id, 'IAC-01', start_pos, CAST(start_pos + length(line) AS INTEGER), left(trim(line, ' ' || chr(9) || chr(13)), 200) FROM l WHERE starts_with(upper(trim(line, ' ' || chr(9) || chr(13))), 'USER') AND regexp_matches(trim(trim(line, ' ' || chr(9) || chr(13))[5:]), '(?i)\\s*root')""",
    "scan_keyvalue": f"""WITH l AS ({_LINES.format(src="(SELECT file_id, content FROM " + _F + " WHERE regexp_matches(file_path, '\\.(yaml|yml)$'))")}), k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS s FROM l)
        SELECT file_id, 'SEC-37' AS rule_id, start_pos, s AS matched FROM k WHERE NOT regexp_matches(s, '^[#;]') AND NOT contains(s, '=') AND lower(trim(split_part(s, ':', 1))) = 'replicas' AND regexp_matches(trim(s[instr(s, ':') + 1:]), '^[1-3]$')""",
    "findings_dedupe": "SELECT min(finding_id) AS finding_id FROM findings GROUP BY file_id, rule_id, line_number, column_no",
    "findings_by_severity": "SELECT severity, count(*) AS n_findings FROM findings GROUP BY severity",
    "incremental_manifest_diff": "SELECT DISTINCT file_id FROM files f WHERE NOT EXISTS (SELECT 1 FROM files m WHERE m.modified_at < TIMESTAMPTZ '2025-07-01 00:00:00+00' AND m.repo = f.repo AND m.file_path = f.file_path AND coalesce(m.content, '') = coalesce(f.content, '') AND m.file_size = f.file_size)",
    "code_block_merge": """WITH b AS (SELECT DISTINCT request_id, s.start_pos AS start_pos, s.end_pos AS end_pos FROM (SELECT request_id, unnest(matched_spans) AS s FROM audit_events WHERE request_id IS NOT NULL)),
        m AS (SELECT *, max(end_pos) OVER (PARTITION BY request_id ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM b),
        i AS (SELECT *, sum(CASE WHEN upto IS NULL OR start_pos > upto + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS island FROM m)
        SELECT request_id, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM i GROUP BY request_id, island""",
    "domain_reputation": f"""WITH r AS (SELECT DISTINCT request_id, unnest(regexp_extract_all(content, '@([A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{{2,}})', 1)) AS domain FROM requests), s AS (SELECT request_id, domain, lower(trim(domain)) AS d FROM r)
        SELECT request_id, domain, CASE WHEN {' OR '.join(f"contains(d, '{x}')" for x in lookups.SHORTENERS)} THEN 'url_shortener' WHEN {' OR '.join(f"d = '{x}' OR ends_with(d, '.{x}')" for x in (*lookups.TRUSTED, 'example.com'))} THEN 'none'
        WHEN regexp_matches(d, '\\.({'|'.join(lookups.ENDINGS)})($|/)') THEN 'suspicious_tld' WHEN regexp_matches(d, '{lookups.WORDS}') THEN 'phishing_keyword' ELSE 'unknown' END AS risk FROM s""",
    "package_registry": f"""SELECT DISTINCT package, 'npm' AS ecosystem, package IN ('ledger', 'budget', 'policy', 'ticket') AS known FROM (SELECT unnest(regexp_extract_all(content, '"(?:node_modules/)?(?:@[a-z-]+/)?([a-z][a-z-]+)": ?\\{{', 1)) AS package FROM {_F} WHERE regexp_matches(file_path, 'lock\\.json$'))""",
    "cve_lookup": f"""WITH v AS (SELECT DISTINCT 'ui-kit' AS package, unnest(regexp_extract_all(content, '"version": ?"([0-9.]+)"', 1)) AS version FROM {_F} WHERE regexp_matches(file_path, 'lock\\.json$')), n AS (SELECT *, list_transform(string_split(version, '.'), lambda x: CAST(x AS INTEGER)) AS k FROM v)
        SELECT package, version, 'A-1' AS advisory FROM n WHERE k[1] < 3 UNION ALL SELECT package, version, 'A-2' FROM n WHERE k[1] >= 20 AND k[1] < 23""",
}
#: Why a query has no SQL; its operator is checked on rows that are known one by one.
NO_SQL = {
    "scan_findings": "patterns with look-ahead and windows around a hit: code_cases",
    "scan_yaml_paths": "paths by indentation: yaml_cases",
    "output_probe_hits": "patterns with look-ahead, confidence by what is around: output_cases, around_cases",
    "output_probe_summary": "sums of output_probe_hits",
    "language_detect": "weights of tokens: language_cases",
    "data_flow_taint": "arguments of calls with nested brackets: flow_cases",
    "code_blocks": "nested fences: block_cases",
}
