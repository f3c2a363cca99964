"""Files that were not written by hand by the owners of the repository: generated, minified, vendored, data as code.

Every file's token sequence gets a Re-Pair grammar. Names count without their numbers, strings and numbers as such, so the
repeating parts of generated code become few rules with long expansions; a hand-written file reuses short rules at most.
Literals that stay incompressible mark blobs. Whole files, and runs of phrases, that occur in several repositories mark copies:
phrases end where the tokens themselves say so, hence also a file that repeats nothing inside, or was edited here and there,
shares them. A comment at the head, such as a licence, is not part of them. What the grammar says is weighed with what the path
and the comment at the head, of any length, say: a marker counts only there, a folder only as a whole name, and the owner's own
notices not at all.

Null or empty content is no case (unless the path names a lock file), and binary files have empty content. Equal file_ids are
taken together. Long files are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexisift.session import written

from .grammar import Grammars, _mix

_TOKEN = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|[^\W\d]\w*|\d[\w.]*|[^\w\s]")
_DIGITS = re.compile(r"\d+")
#: Files whose grammars are made together, and the tokens that end a batch early.
BATCH, BATCH_TOKENS = 256, 300_000

MARKER = (
    r"(?i)^\s*(?:#|//|/\*+|\*|--|<!--|;|%|\"\"\"|')?[\s*]*(?:"
    r"(?:code|file|source)?\s*(?:auto-?generated|generated (?:automatically|by|from|with|using|code|file))\b.*"
    r"|(?:this|the) (?:file|code|module|class) (?:was|is|has been)?\s*(?:automatically |auto-?|machine-?)(?:generated|written|created|produced).*"
    r"|code generated .*do not edit.*|<auto-?generated.*|@generated\b.*|autogenerated\b.*|machine-(?:written|generated|made).*|automatically (?:generated|created).*"
    r"|compiled (?:by|with) \S+ .*\bfrom\b.*|edits here are lost.*|output of .*regenerate.*|created by .*(?:hand|manual) edits are overwritten.*|do not (?:edit|modify)(?: (?:by hand|manually|this file).*|[.!: -].*generated.*|[.!]?\s*)$"
    r"|automatisch (?:erzeugt|generiert|erstellt).*|(?:généré|g[ée]n[ée]r[ée]e?) automatiquement.*|fichier généré.*|(?:generado|creado) automáticamente.*|archivo generado.*|diese datei wurde .*(?:erzeugt|generiert).*|dieser code wurde .*(?:erzeugt|generiert).*"
    r")"
)
_MARKER = re.compile(MARKER)
_COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|--|<!--|;)")
#: A notice of another project at the head: its name with a version, and where it comes from or under what licence.
_NOTICE = re.compile(r"(?is)^\W*(?:/\*!?|#|//|--|<!--)?[\s*!#/-]*@?(?:license\s+)?([A-Za-z][\w.@/-]+)\s+v?\d+\.\d+(?:\.\d+)?[^\n]*\n(?:[^\n]*\n){0,4}?[^\n]*(?:upstream|https?://|\(c\)|©|copyright|licen[sc]e|contributors|released under|distributed under)")
LOCK_FILES = r"(?i)(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.ya?ml|poetry\.lock|pipfile\.lock|cargo\.lock|composer\.lock|gemfile\.lock|go\.sum|gradle\.lockfile|[\w-]*[.-]?lock\.json|uv\.lock|pdm\.lock|bun\.lockb?|flake\.lock|mix\.lock)$"
VENDOR_DIRS = r"(?i)(?:^|/)(?:vendor|vendored|third[_-]?party|3rdparty|node_modules|bower_components|external|externals|deps|godeps|pods|jspm_packages)/[^/]+"
GENERATED_PATH = r"(?i)(?:_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h)|\.gen(?:erated)?\.\w+|\.g\.\w+|\.designer\.\w+|_generated\.\w+)$|(?:^|/)(?:gen|generated|generated-sources|generated-src|autogen|stubs)/"
MINIFIED_PATH = r"(?i)(?:[.-](?:min|bundle|chunk|prod)\.m?(?:js|css)|\.[0-9a-f]{7,20}\.m?(?:js|css))$"
DELIVERY_DIRS = r"(?i)(?:^|/)(?:dist|build|static|public|assets|out|_next|www)/"
CODE = r"(?i)\.(?:py|js|mjs|cjs|jsx|ts|tsx|java|go|c|cc|cpp|h|hpp|cs|rb|php|rs|kt|scala|swift)$"

FEATURES = (
    "file_key long, n_chars long, n_tokens long, grammar_ratio double, long_share double, covered_share double, longest_rule long, max_uses long, root_hash long, "
    "literal_share double, literal_noise double, number_share double, chars_per_line double, longest_line long, short_name_share double, space_share double, "
    "marker boolean, notice boolean, n_phrased long, phrases array<struct<hash:long,start:int,stop:int>>"
)
#: Tokens that a file must have, without the comment at its head, to be looked for in other repositories.
SHARED_LENGTH = 24
#: A phrase begins at a token that marks the smallest hash of GRAM tokens within REACH on both sides; RUN phrases in a row are
#: looked for together (about 85 tokens), as shorter runs are the common stock of hand-written code.
GRAM, REACH, RUN = 4, 8, 5
_START = re.compile(r"\A(?:﻿|#![^\n]*\n|\s|\"\"\")+")
_HEAD = re.compile(r"\A(?:\s|#(?!\[|include|define|if|pragma|import)[^\n]*|//[^\n]*|/\*.*?\*/|<!--.*?-->|--[^\n]*)+", re.S)


def _stable(token: str) -> int:
    return zlib.crc32(token.encode()) | (zlib.adler32(token.encode()) << 32)


def _normal(t: str) -> str:
    c = t[0]
    if c in "\"'`":
        return '"'
    if c.isdigit():
        return "0"
    return _DIGITS.sub("0", t) if c.isalpha() or c == "_" else t


def _surface(text: str, toks: list[str]) -> tuple:
    literals = [t for t in toks if t[0] in "\"'`" and len(t) > 8]
    numbers = sum(t[0].isdigit() for t in toks)
    # strings without spaces only: messages are prose
    noise = "".join(t[1:-1] for t in literals if " " not in t)
    size = sum(map(len, literals))
    lines = [x for x in text.split("\n") if x.strip()]
    names = [t for t in toks if t[0].isalpha() or t[0] == "_"]
    head = _HEAD.match(text)
    head = (head[0] if head else "").split("\n")
    marked = any(_MARKER.match(x) and (_COMMENT.match(x) or k) for k, x in enumerate(head)) or bool(text.startswith('"""') and _MARKER.match(text.split("\n", 1)[0]))
    start = _START.sub("", text, 1)
    m = _NOTICE.match(start)
    return (
        len(noise) / max(1, len(text)) if noise else 0.0,
        len(zlib.compress(noise.encode(), 6)) / len(noise.encode()) if len(noise) > 64 else 0.0,
        numbers / max(1, len(toks)),
        len(text) / max(1, len(lines)),
        max(map(len, lines), default=0),
        sum(len(t) <= 3 for t in names) / max(1, len(names)),
        sum(map(text.count, " \n\t")) / max(1, len(text)),
        marked,
        bool(m) and _COMMENT.match(start) is not None,
    )


def _phrases(hashes: np.ndarray, sizes: np.ndarray) -> list[list]:
    """Per file the runs of phrases: (hash, start, stop), in order; a shorter file is one run."""
    out: list[list] = [[] for _ in sizes]
    if not len(hashes):
        return out
    files = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(files)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grams = hashes
    for d in range(1, GRAM):
        ahead = np.zeros_like(hashes)
        ahead[:-d] = np.where(files[d:] == files[:-d], hashes[d:], 0)
        grams = _mix(grams, ahead)
    cut = np.ones(len(files), bool)
    for d in range(1, REACH + 1):
        same = files[d:] == files[:-d]
        cut[d:] &= ~same | (grams[d:] < grams[:-d])
        cut[:-d] &= ~same | (grams[:-d] < grams[d:])
    at = np.flatnonzero(cut | (place == 0))
    stop = np.append(at[1:], len(files))
    inside = np.arange(len(files)) - np.repeat(at, stop - at)
    whole = np.add.reduceat(_mix(hashes, inside.astype(np.uint64)), at)
    owner, n = files[at], len(at)
    run, last, width = whole.copy(), np.arange(n), np.ones(n, np.int64)
    for d in range(1, RUN):
        more = np.flatnonzero(owner[d:] == owner[:-d])
        run[more] = _mix(run[more], whole[more + d])
        last[more], width[more] = more + d, d + 1
    for i in np.flatnonzero((width == RUN) | (place[at] == 0)):
        out[owner[i]].append((int(run[i].astype(np.int64)), int(place[at[i]]), int(place[stop[last[i]] - 1]) + 1))
    return out


def _features(batch: list[tuple[int, str]]) -> pd.DataFrame:
    ids: dict[str, int] = {}
    seen: dict[str, int] = {}
    hashes: list[int] = []
    normal, verbatim = [], []  # by the token as it stands
    sequences, surface, bodies = [], [], []
    for _, text in batch:
        toks = _TOKEN.findall(text)
        s = []
        for t in toks:
            k = seen.get(t)
            if k is None:
                k = seen[t] = len(seen)
                n = _normal(t)
                i = ids.get(n)
                if i is None:
                    i = ids[n] = len(ids)
                    hashes.append(_stable(n))
                normal.append(i)
                verbatim.append(_stable(t))
            s.append(k)
        sequences.append(np.array(s, np.int64))
        surface.append(_surface(text, toks))
        head = _HEAD.match(text)
        body = sequences[-1][len(_TOKEN.findall(head[0])) :] if head else sequences[-1]
        bodies.append(body if len(body) >= SHARED_LENGTH else body[:0])
    normal, verbatim = np.array(normal, np.int64), np.array(verbatim, np.uint64)
    sequences = [normal[s] for s in sequences]
    g = Grammars(sequences, np.array(hashes, np.uint64))
    n = len(batch)
    size = np.maximum(g.sizes, 1)
    longest, uses = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.maximum.at(longest, g.rule_file, g.rule_length)
    np.maximum.at(uses, g.rule_file, g.rule_uses)
    out = pd.DataFrame({"file_key": [k for k, _ in batch], "n_chars": [len(t) for _, t in batch], "n_tokens": g.sizes, "grammar_ratio": (g.left + 2 * g.rules) / size, "long_share": g.long_covered / size, "covered_share": g.covered / size, "longest_rule": longest, "max_uses": uses, "root_hash": g.root})
    for name, column in zip(("literal_share", "literal_noise", "number_share", "chars_per_line", "longest_line", "short_name_share", "space_share", "marker", "notice"), zip(*surface)):
        out[name] = column
    out["n_phrased"] = [len(b) for b in bodies]
    out["phrases"] = _phrases(verbatim[np.concatenate(bodies)], out["n_phrased"].to_numpy())
    return out


def _map(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part: list[tuple[int, str]] = []
    size = 0
    for df in batches:
        for key, text in zip(df["file_key"], df["content"]):
            part.append((key, text))
            size += len(text) // 4
            if len(part) >= BATCH or size >= BATCH_TOKENS:
                yield _features(part)
                part, size = [], 0
    if part:
        yield _features(part)


def features(files: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """Grammar and surface of each file with text."""
    rows = files.select(F.col(key).cast("long").alias("file_key"), F.col(text).alias("content")).filter("file_key is not null and content is not null and content <> ''")
    return rows.mapInPandas(_map, FEATURES)


def shared(feats: DataFrame, files: DataFrame, key: str, repo: str) -> DataFrame:
    """(file_key, shared_share, copies): share of the tokens in runs of phrases that other repositories have too, and the
    number of other repositories with a file of the same tokens but for names' numbers and literals. The counts come from all
    files; a run's rows are reduced to whether they lie in several repositories before they meet."""
    where = files.select(F.col(key).cast("long").alias("file_key"), F.coalesce(F.col(repo), F.lit("")).alias("repo")).dropDuplicates(["file_key"])
    base = feats.select("file_key", "n_tokens", "n_phrased", "root_hash", "phrases").join(where, "file_key")
    runs = base.select("file_key", "repo", F.explode("phrases").alias("r")).select("file_key", "repo", "r.hash", "r.start", "r.stop")
    common = runs.groupBy("hash").agg(F.min("repo").alias("a"), F.max("repo").alias("b")).filter("a < b").select("hash")
    # runs overlap: each counts from where the one before it ends
    before = F.coalesce(F.lag("stop").over(Window.partitionBy("file_key").orderBy("start")), F.lit(0))
    by_file = runs.drop("repo").distinct().join(common, "hash").withColumn("covered", F.col("stop") - F.greatest("start", before)).groupBy("file_key").agg(F.sum("covered").alias("covered"))
    roots = base.filter("n_tokens >= 150")
    twice = roots.select("root_hash", "repo").distinct().groupBy("root_hash").agg(F.count("*").alias("repos")).filter("repos >= 2")
    copies = roots.select("file_key", "root_hash").join(twice, "root_hash").select("file_key", (F.col("repos") - 1).alias("copies"))
    return (
        base.select("file_key", "n_phrased").join(by_file, "file_key", "left").join(copies, "file_key", "left")
        .select("file_key", F.round(F.coalesce(F.col("covered") / F.col("n_phrased"), F.lit(0.0)), 6).alias("shared_share"), F.coalesce("copies", F.lit(0)).alias("copies"))
    )


def verdict(path: Column) -> Column:
    """Why a file is no hand-written source of its owners, or null."""
    c = F.col
    code = path.rlike(CODE)
    generated_path, vendor_dir, minified_path = path.rlike(GENERATED_PATH), path.rlike(VENDOR_DIRS), path.rlike(MINIFIED_PATH)
    repeats = (c("grammar_ratio") < 0.34) & (c("long_share") > 0.6) & (c("longest_rule") >= 32) & (c("max_uses") <= 12)
    blob = code & (((c("literal_share") > 0.5) & (c("literal_noise") > 0.6)) | ((c("number_share") > 0.4) & (c("n_tokens") > 24)))
    dense = code & (c("space_share") < 0.12) & (c("n_tokens") > 40) & (((c("chars_per_line") > 160) & (c("short_name_share") > 0.35)) | (c("longest_line") > 400) & (c("short_name_share") > 0.5))
    copied = code & ((c("copies") >= 1) | (c("shared_share") > 0.5))
    # what the tokens tell comes first; path and comment settle what they leave open
    return (
        F.when(path.rlike(LOCK_FILES), "lock file")
        .when(dense, "minified")
        .when(blob, "data")
        .when(code & repeats, "generated")
        .when(copied, "copied")
        .when(minified_path, "minified")
        .when(c("marker") | (generated_path & ((c("grammar_ratio") < 0.6) | (c("n_tokens") < 160))), "generated")
        .when(vendor_dir | c("notice"), "vendored")
    )


def classify(files: DataFrame, key: str = "file_id", path: str = "file_path", text: str = "content", repo: str = "repo") -> DataFrame:
    """(file_key, reason, features): reason is null for hand-written files."""
    feats = written(features(files, key, text), "grammars")  # used several times, costly to make
    near = shared(feats, files, key, repo)
    paths = files.select(F.col(key).cast("long").alias("file_key"), F.coalesce(F.col(path), F.lit("")).alias("path")).filter("file_key is not null").dropDuplicates(["file_key"])
    unique = feats.drop("phrases", "n_phrased").dropDuplicates(["file_key"])
    joined = paths.join(unique, "file_key", "left").join(near.dropDuplicates(["file_key"]), "file_key", "left")
    return joined.withColumn("reason", F.when(F.col("n_tokens").isNotNull() | F.col("path").rlike(LOCK_FILES), verdict(F.col("path"))))
