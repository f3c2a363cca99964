"""Scalar text functions as columns. Patterns run under (?dU): Unicode classes, only \\n ends a line."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Invisible code points that normalisation deletes (fixed values).
INVISIBLE = r"[\u200B-\u200F\u2060-\u2064\u2066-\u206F\uFEFF\u00AD\u034F\u061C\u115F\u1160\u17B4\u17B5\u180E\u3164\uFFA0]"
TRUNCATED = "\n\n<<TRUNCATED>>"


def unicode_form(c: Column, form: str = "NFC") -> Column:
    """Unicode normalisation. ASCII text is its own form and stays in the JVM."""
    form = form.upper()
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown form {form}")

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    ascii_only = c.isNull() | ~c.rlike(r"[^\x00-\x7f]")
    return F.when(ascii_only, c).otherwise(F.pandas_udf(run, "string")(F.when(~ascii_only, c)))


def strip_invisible(c: Column) -> Column:
    return F.regexp_replace(c, INVISIBLE, "")


def strip_control(c: Column, keep_newlines: bool = True) -> Column:
    """Deletes control and format characters, keeping line ends and tabs if asked to."""
    return F.regexp_replace(c, r"[\p{Cc}\p{Cf}&&[^\n\t\r]]" if keep_newlines else r"[\p{Cc}\p{Cf}]", "")


def normalize(c: Column, form: str | None = "NFC", invisible: bool = True, control: bool = True) -> Column:
    if form:
        c = unicode_form(c, form)
    if invisible:
        c = strip_invisible(c)
    return strip_control(c) if control else c


def clean(c: Column) -> Column:
    return normalize(c, "NFKC")


def truncate_at_boundary(c: Column, limit: int, look: int = 200) -> Column:
    """Text longer than limit is cut behind the last line end among the positions limit, limit-1, ... (look of them); if the
    cut falls on limit itself, or there is none, at the first line end from limit on (look positions), else at limit."""
    low = max(limit - look + 1, 0)
    back = F.reverse(F.substring(c, low + 1, limit - low + 1))
    found = F.instr(back, "\n")
    cut = F.when(found > 0, limit - found + 2).otherwise(limit)
    ahead = F.instr(F.substring(c, limit + 1, look), "\n")
    cut = F.when((cut == limit) & (ahead > 0), limit + ahead - 1).otherwise(cut)
    shortened = F.concat(F.regexp_replace(F.substring(c, F.lit(1), cut), r"(?U)\s+$", ""), F.lit(TRUNCATED))
    return F.when(F.length(c) <= limit, c).otherwise(shortened)


def surrounding(c: Column, start: Column, end: Column, width: int = 200) -> tuple[Column, Column]:
    """Text before and behind a span, trimmed."""
    trim = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    low = F.greatest(F.lit(0), start - width)
    return trim(F.substring(c, low + 1, start - low)), trim(F.substring(c, end + 1, F.lit(width)))


def line_of(c: Column, start: Column) -> Column:
    """1-based line of an offset."""
    before = F.substring(c, F.lit(1), start)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def column_of(c: Column, start: Column) -> Column:
    """1-based column of an offset."""
    before = F.substring(c, F.lit(1), start)
    last = F.instr(F.reverse(before), "\n")
    return F.when(last > 0, last).otherwise(start + 1).cast("int")


def entropy(c: Column) -> Column:
    """Shannon entropy over characters, in bits; 0 for empty text."""
    chars = F.split(c, "")
    n = F.length(c)
    share = lambda x: F.size(F.filter(chars, lambda y: y == x)) / n
    return F.when(n > 0, F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, x: a - share(x) * F.log2(share(x)))).otherwise(F.lit(0.0))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    """Checksum of 12 to 19 digits; other characters don't count."""
    d = digits(c)
    return F.length(d).between(12, 19) & F.call_function("luhn_check", d)


#: First digits of card numbers, in order of precedence (fixed values).
NETWORKS = (
    (r"^4[0-9]", "Visa"),
    (r"^5[1-5][0-9]", "MasterCard"),
    (r"^2[2-7][0-9]", "MasterCard"),
    (r"^3[47][0-9]", "American Express"),
    (r"^(?:6011|65[0-9])", "Discover"),
    (r"^622[0-9]", "Discover"),
    (r"^64[4-9][0-9]", "Discover"),
    (r"^(?:36|38|300[0-5])", "Diners Club"),
    (r"^35[2-8][0-9]", "JCB"),
    (r"^62[0-9]", "China UnionPay"),
    (r"^(?:50|5[6-9]|6[0-9])", "Maestro"),
)


def card_network(c: Column) -> Column:
    d = digits(c)
    out = F.lit(None).cast("string")
    for pattern, name in reversed(NETWORKS):
        out = F.when(d.rlike(pattern), name).otherwise(out)
    return F.when(luhn(c), out)


def version_key(c: Column) -> Column:
    """A version as numbers; null where a part is none. Arrays of numbers compare like versions."""
    bare = F.regexp_replace(F.trim(c), r"[-_].*$", "")
    return F.when(bare.rlike(r"^\d+(\.\d+)*$"), F.transform(F.split(bare, r"\."), lambda x: x.cast("int")))


def severity_rank(c: Column) -> Column:
    return F.when(c == "P0", 0).when(c == "P1", 1).when(c == "P2", 2).otherwise(99)


def adjusted_confidence(c: Column, start: Column, base: float | Column) -> Column:
    """Confidence of a hit by what stands around it: 0 under a suppression note, less in comments, tests and examples."""
    base = F.lit(base) if isinstance(base, (int, float)) else base
    low = F.greatest(F.lit(0), start - 200)
    window = F.lower(F.substring(c, low + 1, start + 100 - low))
    less = lambda by: F.greatest(base - by, F.lit(0.1))
    return (
        F.when(window.rlike(r"(?dU)#\s*(?:nosemgrep|skip|no.check|ignore)\b"), F.lit(0.0))
        .when(window.rlike(r"(?dUm)#.*$|//.*$|/\*.*\*/$|<!--.*-->$"), less(0.2))
        .when(window.rlike(r"def test_|@pytest"), less(0.1))
        .when(window.rlike(r"(?dU)\b(?:example|sample|illustrative|demo)\b"), less(0.15))
        .when(window.rlike(r"(?dU)\b(?:safe|harmless|benign|playground|mock)\b"), less(0.15))
        .otherwise(base)
    )


#: Languages that pass for one another (fixed values).
FAMILIES = (
    {"cpp", "csharp", "java", "kotlin", "javascript", "typescript", "go"},
    {"python", "ruby", "php", "javascript", "typescript", "bash", "powershell"},
    {"python", "javascript", "typescript", "kotlin", "swift", "rust"},
    {"python", "ruby"},
    {"java", "kotlin"},
    {"csharp"},
    {"typescript", "javascript", "php", "python"},
    {"rust", "cpp", "go"},
    {"python", "sql", "r"},
)


def language_confidence(confidence: Column, found: Column, certainty: Column, wanted: str) -> Column:
    """Full for the wanted language, .85 for its family, half for others; unchanged while the language is uncertain."""
    family = sorted(set().union(*(f for f in FAMILIES if wanted in f)) or {wanted})
    return F.when(found.isNull() | (certainty < 0.3), confidence).when(found == wanted, confidence).when(found.isin(family), confidence * 0.85).otherwise(confidence * 0.5)
