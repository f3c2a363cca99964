"""Code review over tables or folders of files: which files are read, what is looked for, findings with line and column.

Findings carry offsets until the end; line and column are taken from the file's text within its row, so texts aren't shuffled.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexisift.functions.rows import exploded
from lexisift.functions.text import column_of, line_of

from . import code_pack, code_probes
from .probes import HITS, Probe, probe
from .spans import java

#: What a scan passes over (fixed values).
SKIPPED_DIRS = (".git", "__pycache__", "node_modules", ".venv", "venv", ".tox", ".eggs", "eggs", ".mypy_cache", ".ruff_cache", ".pytest_cache", ".svn", ".hg", "dist", "build", ".next", "target", "bin", "obj", ".terraform", ".serverless")
SKIPPED_EXTENSIONS = ("pyc", "pyo", "so", "dll", "dylib", "exe", "o", "a", "lib", "obj", "png", "jpg", "jpeg", "gif", "ico", "svg", "ttf", "woff", "woff2", "eot", "mp3", "mp4", "wav", "zip", "tar", "gz", "bz2", "7z", "rar", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx")
MAX_BYTES = 1 << 20


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def admitted(path: Column, size: Column) -> Column:
    """Neither below a skipped or hidden folder, nor of a skipped kind (but for Dockerfiles), nor too large."""
    inside = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    hidden = F.exists(inside, lambda x: x.isin(list(SKIPPED_DIRS)) | (x.startswith(".") & (F.length(x) > 1)))
    return ~hidden & (~extension(path).isin(list(SKIPPED_EXTENSIONS)) | path.rlike(r"(?i)(^|/)dockerfile[^/]*$")) & (size <= MAX_BYTES)


def glob_pattern(glob: str) -> str:
    """A path pattern as a regular expression; matched from the right unless it begins at the root."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + r"(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and "]" in glob[i + 1 :]:
            j = glob.index("]", i + 1)
            out, i = out + "[" + glob[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return ("^" if glob.startswith("/") else "(?:^|/)") + out + "$"


def targeted(path: Column, globs: list[str]) -> Column:
    """Whether a path matches one of the patterns; none given means every path."""
    return F.lit(True) if not globs else path.rlike("|".join(f"(?:{glob_pattern(g)})" for g in globs))


def decoded(c: Column) -> Column:
    """The text of bytes: by their byte order mark, else UTF-8, else the western single-byte encoding where the bytes are no UTF-8
    but have no control characters either; else UTF-8 with what is malformed replaced."""
    plain = c.cast("string")
    valid = F.call_function("is_valid_utf8", plain)
    head = F.hex(F.substring(c, 1, 3))
    western = F.decode(c, "iso-8859-1")
    return (
        F.when(head == "EFBBBF", F.call_function("make_valid_utf8", F.substring(c, F.lit(4), F.length(c)).cast("string")))
        .when(head.startswith("FFFE") | head.startswith("FEFF"), F.decode(c, "UTF-16"))
        .when(valid, plain)
        .when(~western.rlike(r"[\x00-\x08\x0e-\x1f\x7f-\x9f\ufffd]"), western)
        .otherwise(F.call_function("make_valid_utf8", plain))
    )


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, content, length, modified) of the files below a folder, decoded."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/*", "/")
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), F.concat(F.lit("^\\Q"), base, F.lit("\\E/")), F.lit(""))
    files = raw.select(path.alias("file_path"), "content", "length", F.col("modificationTime").alias("modified"))
    return files.filter(admitted(F.col("file_path"), F.col("length"))).withColumn("content", decoded(F.col("content")))


def fingerprint(path: Column, modified: Column, size: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", path, modified.cast("string"), size.cast("string"), F.sha2(content, 256)), 256)


def changed(files: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Files whose path and fingerprint the manifest doesn't have."""
    return files.join(manifest.select(*keys), keys, "left_anti")


# Configuration patterns


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _split(pattern: str) -> tuple[str, str]:
    key, _, value = pattern.partition(":")
    return key.strip(), value


def config_hits(files: DataFrame, text: str, patterns: list[tuple[str, str, str, float]], key: list[str]) -> DataFrame:
    """patterns: (rule_id, kind, pattern, confidence) with kind dockerfile or keyvalue -> (key.., rule_id, start_pos, end_pos,
    matched, confidence). Lines are rows, so a file of any length is spread."""
    # line starts by a running sum over the exploded lines of a file
    rows = files.select(*key, F.posexplode(F.split(text, "\n", -1)).alias("no", "line"))
    w = Window.partitionBy(*key).orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)).cast("int"))
    line = _trim(F.col("line"))
    hits = []
    for rule, kind, pattern, confidence in patterns:
        if ":" not in pattern:
            continue
        name, value = _split(pattern)
        rx = java(value)
        if kind == "dockerfile":
            ok = F.upper(line).startswith(name.upper()) & _trim(F.substring(line, F.lit(len(name) + 1), F.length(line))).rlike(rx)
        elif kind == "keyvalue":
            parts = F.when(F.contains(line, F.lit("=")), F.split(line, "=", 2)).otherwise(F.split(line, ":", 2))
            k, v = _trim(parts[0]), _trim(F.get(parts, 1))
            v = F.regexp_replace(F.regexp_replace(v, "^\"+|\"+$", ""), "^'+|'+$", "")
            ok = ~line.rlike("^[#;]") & line.rlike("[=:]") & (F.upper(k) == name.upper()) & v.rlike(rx)
        else:
            raise ValueError(f"unknown kind {kind}")
        hits.append(F.when(ok, F.struct(F.lit(rule).alias("rule_id"), F.lit(confidence).alias("confidence"))))
    found = rows.withColumn("h", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull()))) if hits else rows.withColumn("h", F.lit(None)).filter("false")
    return found.select(*key, "h.rule_id", F.col("start").alias("start_pos"), (F.col("start") + F.length("line")).alias("end_pos"), F.substring(line, 1, 200).alias("matched"), "h.confidence")


def yaml_paths(text: str | None) -> list[tuple[str, str, int, int]]:
    """(path, value, start, end) of each line of a YAML text that has a key, by indentation; an item's dash is part of its key."""
    out, path, levels, at = [], [], [], 0
    for raw in (text or "").split("\n"):
        start, at = at, at + len(raw) + 1
        body = raw.strip()
        if not body or body.startswith(("#", "---")) or ":" not in body:
            continue
        level = len(raw) - len(raw.lstrip())
        key, _, value = raw.rstrip().lstrip().partition(":")
        while levels and level <= levels[-1]:
            levels.pop()
            if path:
                path.pop()
            if levels and level <= levels[-1] and path:  # a closed parent takes one more level along
                path.pop()
        levels.append(level)
        path.append(key.strip())
        out.append((".".join(path), value.strip().strip('"').strip("'"), start, start + len(raw)))
    return out


def yaml_hits(files: DataFrame, text: str, patterns: list[tuple[str, str, float]], key: list[str]) -> DataFrame:
    """patterns: (rule_id, 'a.b:regex', confidence) -> the hits as in config_hits."""
    def series(texts: pd.Series) -> pd.Series:
        return texts.map(yaml_paths)

    rows = files.select(*key, F.explode(F.pandas_udf(series, "array<struct<path:string,value:string,start_pos:int,end_pos:int>>")(F.col(text))).alias("y"), text)
    hits = []
    for rule, pattern, confidence in patterns:
        name, value = _split(pattern)
        wanted = ".".join(k.strip() for k in name.split("."))
        hits.append(F.when((F.col("y.path") == wanted) & F.col("y.value").rlike(java(value)), F.struct(F.lit(rule).alias("rule_id"), F.lit(confidence).alias("confidence"))))
    found = rows.withColumn("h", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())))
    return found.select(*key, "h.rule_id", "y.start_pos", "y.end_pos", F.substring(_trim(F.substring(text, F.col("y.start_pos") + 1, F.col("y.end_pos") - F.col("y.start_pos"))), 1, 200).alias("matched"), "h.confidence")


# Structural checks: what a file lacks


def structural_hits(path: Column, c: Column) -> Column:
    """Hits of what is missing: a Dockerfile's health check, a workload's network policy, a chart's security context, a
    package's pinned source."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    ext = extension(path)
    yaml = ext.isin("yaml", "yml")

    def entry(rule: str, message: Column, confidence: float, at: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule_id"), at.cast("int").alias("start_pos"), (at + 60).cast("int").alias("end_pos"), message.alias("matched"), F.lit(confidence).alias("confidence"), F.lit("absent").alias("tag"))

    def first(pattern: str) -> Column:
        return F.when(c.rlike(pattern), F.length(F.element_at(F.split(c, pattern, 2), 1))).otherwise(F.lit(0))

    docker = F.when(name.startswith("dockerfile") & ~c.rlike(r"(?im)^\s*HEALTHCHECK"), entry("IAC-18", F.lit("Dockerfile without HEALTHCHECK"), 0.7, F.greatest(F.lit(0), F.instr(c, "\nCMD") - 21)))
    workload = c.rlike(r"(?m)^(?:#.*)?\s*kind:\s*(?:Deployment|Pod|StatefulSet|DaemonSet|Service)")
    network = F.when(yaml & workload & ~c.rlike(r"(?m)^kind:\s*NetworkPolicy\b"), entry("IAC-20", F.lit("Workload without NetworkPolicy"), 0.65, first(r"(?m)^kind:\s*(?:Deployment|Pod|Service|StatefulSet|DaemonSet)\b")))
    keys = ("securityContext", "podSecurityContext", "readOnlyRootFilesystem")
    lacks = {k: ~c.rlike(rf"(?m)^\s*{k}:") for k in keys}
    missing = F.concat_ws(", ", *[F.when(v, F.lit(k)) for k, v in lacks.items()])
    helm = F.when(yaml & name.rlike("values|chart") & (lacks[keys[0]] | lacks[keys[2]]), entry("IAC-21", F.concat(F.lit("Chart without "), missing), 0.7, first(r"(?m)^\s*(?:image:|tag:)")))
    return F.filter(F.array(docker, network, helm), lambda x: x.isNotNull())


def functions_without_network(text: str | None) -> list[tuple[str, int, int, str, float, str]]:
    """Serverless functions of a template that name no network, each at the line of its type."""
    if not text or ("AWS::Lambda::Function" not in text and "AWSTemplateFormatVersion" not in text):
        return []
    out, at = [], 0
    open_: tuple[int, int, str, int] | None = None  # start, line number, line, indentation

    def close() -> None:
        if open_ is not None:
            out.append(("IAC-19", open_[0], open_[0] + len(open_[2]), f"Function without VpcConfig: {open_[2].strip()[:80]}", 0.7, "absent"))

    for number, line in enumerate(text.split("\n")):
        body, start, at = line.strip(), at, at + len(line) + 1
        if body.startswith("#"):
            continue
        if "AWS::Lambda::Function" in body:
            close()
            open_ = (start, number, line, len(line) - len(line.lstrip()))
        elif open_ is not None and body:
            if body.startswith("VpcConfig"):
                open_ = None
            elif len(line) - len(line.lstrip()) <= open_[3] and ":" in body and not body.startswith("-") and number > open_[1] + 2:
                close()
                open_ = None
    close()
    return out


def template_hits(files: DataFrame, path: str, text: str, key: list[str]) -> DataFrame:
    """Hits of functions_without_network in YAML files."""

    def series(texts: pd.Series) -> pd.Series:
        return texts.map(functions_without_network)

    own = files.filter(extension(F.col(path)).isin("yaml", "yml"))
    hits = F.pandas_udf(series, HITS)(F.col(text))
    return exploded(own.select(*key, hits.alias("_h")), "_h", "h", *key).select(*key, "h.rule_id", "h.start_pos", "h.end_pos", "h.matched", "h.confidence")


def dependency_hits(files: DataFrame, path: str, text: str, key: list[str], known: list[str] = ()) -> DataFrame:
    """Packages that another source could take over: loose or local versions, and unknown names in requirement lists."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    both = F.from_json(text, "struct<dependencies:map<string,string>,devDependencies:map<string,string>>")
    json = files.filter(name.isin("package.json", "package-lock.json")).select(*key, F.explode(F.map_concat(F.coalesce(both["dependencies"], F.create_map().cast("map<string,string>")), F.coalesce(both["devDependencies"], F.create_map().cast("map<string,string>")))).alias("pkg", "version"))
    loose = json.filter("version in ('*', '') or version like 'file:%' or version like 'http:%'").select(*key, F.lit("SEC-39").alias("rule_id"), F.concat_ws("@", "pkg", "version").alias("matched"), F.lit(0.5).alias("confidence"))
    lists = files.filter(name.isin("requirements.txt", "Pipfile")).select(*key, F.explode(F.regexp_extract_all(text, F.lit(r"(?m)^([a-zA-Z_][a-zA-Z0-9_.-]*)[=~<>!]"), F.lit(1))).alias("pkg"))
    odd = lists.filter(~F.lower("pkg").isin(list(known) or [""]) & ~F.col("pkg").startswith("_")).select(*key, F.lit("SEC-39").alias("rule_id"), F.lower("pkg").alias("matched"), F.lit(0.35).alias("confidence"))
    return loose.unionByName(odd)


def null_dereferences(files: DataFrame, path: str, text: str, key: list[str]) -> DataFrame:
    """A lookup that may give nothing, used on the next line unchecked."""
    rows = files.filter(extension(F.col(path)).isin("java", "go", "cs", "kt", "swift")).select(*key, F.posexplode(F.split(text, "\n", -1)).alias("no", "line"))
    nxt = F.lead("line").over(Window.partitionBy(*key).orderBy("no"))
    lookup = r"(?:\.find(?:ById|One|First)?|\.getOrNull|Optional\.ofNullable|FirstOrDefault|getFirst)\s*\([^)]*\)"
    checked = r"\bisPresent\b|\bifNull\b|orElse\b|orElseThrow\b|!= null|!= nil|!= None|\bisNotNull\b"
    pairs = rows.withColumn("next", nxt).filter(F.col("line").rlike(lookup) & F.col("next").rlike(r"\.\s*\w+\s*\(") & ~F.concat_ws("\n", "line", "next").rlike(checked))
    return pairs.select(*key, F.lit("SEC-54").alias("rule_id"), (F.col("no") + 1).alias("line_number"), F.substring(_trim(F.col("line")), 1, 200).alias("matched"), F.lit(0.4).alias("confidence"))


_LOOKUP = re.compile(r"(?:\.find(?:ById|One|First)?|\.getOrNull|Optional\.ofNullable|FirstOrDefault|getFirst)\s*\([^)]*\)")
_CALL = re.compile(r"\.\s*\w+\s*\(")
_CHECKED = re.compile(r"\bisPresent\b|\bifNull\b|orElse\b|orElseThrow\b|!= null|!= nil|!= None|\bisNotNull\b")
#: Packages that requirement lists commonly name (fixed values).
COMMON = frozenset(("django", "flask", "requests", "numpy", "pandas", "pytest", "fastapi", "sqlalchemy", "celery", "redis", "psycopg2", "boto3", "scipy", "scikit-learn", "pillow", "lxml", "click"))
_REQUIRED = re.compile(r"^([a-zA-Z_][a-zA-Z0-9_.-]*)[=~<>!]", re.M)


def special_hits(text: str, path: str) -> list[tuple]:
    """Hits that no single pattern tells: lookups used unchecked, packages another source could take over, serverless functions
    without a network."""
    name = path.rpartition("/")[2]
    ext = name.rpartition(".")[2].lower() if "." in name else ""
    out: list[tuple] = []
    if ext in ("java", "go", "cs", "kt", "swift") and _LOOKUP.search(text):
        at, lines = 0, text.split("\n")
        for line, below in zip(lines, lines[1:]):
            if _LOOKUP.search(line) and _CALL.search(below) and not _CHECKED.search(line + "\n" + below):
                out.append(("SEC-54", at, at, line.strip()[:200], 0.4, "unchecked"))
            at += len(line) + 1
    if ext in ("yaml", "yml"):
        out += functions_without_network(text)
    if name in ("package.json", "package-lock.json"):
        try:
            data = json.loads(text)
            both = {**(data.get("dependencies") or {}), **(data.get("devDependencies") or {})}
        except (ValueError, AttributeError, TypeError):
            both = {}
        for package, version in both.items():
            if isinstance(version, str) and (version in ("*", "") or version.startswith(("file:", "http:"))):
                at = max(0, text.find(f'"{package}"'))
                out.append(("SEC-39", at, at + len(package) + 2, f"{package}@{version}"[:200], 0.5, "loose"))
    if name in ("requirements.txt", "Pipfile"):
        out += [("SEC-39", m.start(), m.end(), m[1].lower()[:200], 0.35, "unknown") for m in _REQUIRED.finditer(text) if m[1].lower() not in COMMON and not m[1].startswith("_")]
    return out


def scan(files: DataFrame, path: str = "file_path", text: str = "content", key: str = "file_id", probes: list[Probe] | None = None) -> DataFrame:
    """Findings of the probes, the special and the structural checks: one row each, the first of equal spans of a rule, with line
    and column. Line and column are found in the row of the file; its text isn't carried along with the findings."""
    e = files.filter(F.col(text).isNotNull()).withColumn("_ext", extension(F.col(path)))
    every_check = probes is None
    hit = probe(e, text, [*code_probes.PROBES, *code_pack.PROBES] if every_check else probes, "_ext", path=path, more=special_hits if every_check else None)
    every = F.concat("hits", structural_hits(F.col(path), F.col(text))) if every_check else F.col("hits")
    placed = F.transform("_every", lambda h: F.struct(h.alias("h"), line_of(F.col(text), h["start_pos"]).alias("line"), column_of(F.col(text), h["start_pos"]).alias("column")))
    rows = exploded(hit.withColumn("_every", every).withColumn("_placed", placed), "_placed", "k", key, F.col(path).alias("file_path"), position="_no")
    # of the hits of one rule with equal spans the first stays
    first = Window.partitionBy(key, "file_path", "k.h.rule_id", "k.h.start_pos", "k.h.end_pos").orderBy("_no")
    rows = rows.withColumn("_turn", F.row_number().over(first)).filter("_turn = 1")
    h = F.col("k.h")
    names = F.create_map(*[F.lit(x) for kv in (code_pack.NAMES | code_probes.NAMES | {"IAC-18": "Health check missing", "IAC-19": "Network of a function missing", "IAC-20": "Network policy missing", "IAC-21": "Security context missing"}).items() for x in kv])
    name = F.coalesce(names[h["rule_id"]], h["rule_id"])
    message = F.concat(F.lit("["), h["rule_id"], F.lit("] "), name, F.lit(": "), F.substring(h["matched"], 1, 80))
    return rows.select(
        key, h["rule_id"].alias("rule_id"), name.alias("rule_name"), F.lit("P2").alias("severity"), "file_path", F.col("k.line").alias("line_number"), F.col("k.column").alias("column_no"),
        h["matched"].alias("matched_text"), h["confidence"].alias("confidence"), message.alias("message"),
    )


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n_findings"))
