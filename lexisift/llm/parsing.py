"""Source files that do not parse.

Each text goes through the recursive-descent parser of the language that its path names. All errors are kept with line and
cause; a parser goes on behind an error at the next safe token. Where the platform itself reads a format (Python, TOML, XML),
its verdict follows as an exact check on what the parser flagged.

Null text and kinds of files without a parser get a null verdict. An empty text is valid Python, JavaScript, YAML, TOML and
Java (an empty unit), and invalid JSON, XML and Go. Texts are read whole.
"""

from __future__ import annotations

import re
import sys
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .syntax import data, golang, java, javascript, python
from .syntax.base import MAX_DEPTH, conflict

PARSERS = {"python": python.parse, "javascript": javascript.parse, "java": java.parse, "go": golang.parse, "json": data.json, "yaml": data.yaml, "xml": data.xml, "toml": data.toml}
EXTENSIONS = {"py": "python", "js": "javascript", "mjs": "javascript", "java": "java", "go": "go", "json": "json", "yaml": "yaml", "yml": "yaml", "xml": "xml", "toml": "toml"}
RESULT = "struct<n_errors:int,first_line:int,first_cause:string,errors:array<struct<line:int,cause:string>>>"


def _confirmed(text: str, language: str) -> bool:
    """Whether the platform's own reader refuses the text too."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            if language == "python":
                compile(text, "f", "exec", dont_inherit=True, flags=0x400)
            elif language == "toml":
                import tomllib

                tomllib.loads(text.replace("\r\n", "\n"))
            elif language == "xml":
                import xml.parsers.expat

                xml.parsers.expat.ParserCreate("utf-8").Parse(re.sub(r"^<\?xml[^>]*\?>", "", text).encode("utf-8", "replace"), True)
            else:
                return True
    except (RecursionError, MemoryError):
        return True
    except Exception:
        return True
    return False


def errors_of(text: str | None, language: str | None) -> list[tuple[int, str]] | None:
    if text is None or language not in PARSERS:
        return None
    text = text.removeprefix("﻿")
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 40 * MAX_DEPTH))
    try:
        errors = sorted(set(PARSERS[language](text)))
    except RecursionError:
        errors = [(1, "nested too deeply")]
    finally:
        sys.setrecursionlimit(limit)
    mark = conflict(text)
    if mark and errors:
        errors = [(mark, "merge conflict"), *(e for e in errors if e[0] != mark)]
    if errors and not _confirmed(text, language):
        return []
    return errors


def language_of(path: Column) -> Column:
    """The language that the extension names, else null."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    m = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return m[ext]


def _series(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, langs in batches:
        rows = []
        for x, lang in zip(texts, langs):
            e = errors_of(x, lang)
            rows.append((None, None, None, None) if e is None else (len(e), e[0][0] if e else None, e[0][1] if e else None, e))
        yield pd.DataFrame(rows, columns=["n_errors", "first_line", "first_cause", "errors"]).astype({"n_errors": "Int32", "first_line": "Int32"})


def check(df: DataFrame, text: str, path: str, into: str = "syntax") -> DataFrame:
    """df with the language by path and its syntax errors; n_errors is null for files of other kinds."""
    lang = language_of(F.col(path))
    return df.withColumn("path_language", lang).withColumn(into, F.when(F.col("path_language").isNotNull() & F.col(text).isNotNull(), F.pandas_udf(_series, RESULT).asNondeterministic()(F.col(text), F.col("path_language"))))


def rates(checked: DataFrame, repo: str, syntax: str = "syntax") -> DataFrame:
    """Files, invalid files and their share by repository and language."""
    known = checked.filter(F.col(f"{syntax}.n_errors").isNotNull())
    bad = F.sum(F.when(F.col(f"{syntax}.n_errors") > 0, 1).otherwise(0))
    return known.groupBy(F.col(repo).alias("repo"), F.col("path_language").alias("language")).agg(F.count("*").alias("n_files"), bad.alias("n_invalid"), F.round(bad / F.count("*"), 6).alias("invalid_rate"))
