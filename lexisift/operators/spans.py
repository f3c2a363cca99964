"""Matchers: columns that give the spans of a pattern in a text, without leaving the JVM.

A span is struct<start_pos, end_pos, matched> with code-point offsets, the end exclusive. Regular expressions run as Java's
under (?dU), with i and m where asked for; they must not match empty text. Nulls have no spans (null).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start_pos:int,end_pos:int,matched:string>>"
ENTROPY_RUN = r"[A-Za-z0-9+/=_\-:.~@#$%&!?]{8,}"
_RUNS = re.compile(ENTROPY_RUN)
#: A span keeps this much of what it matched.
KEPT = 500


def java(pattern: str, ignore_case: bool = True, multiline: bool = False) -> str:
    """The pattern for Java: what is valid elsewhere but not there is rewritten."""
    pattern = re.sub(r"\\?\$\{(?=[\\(])", r"\\$\\{", pattern)
    return f"(?dU{'i' if ignore_case else ''}{'u' if ignore_case else ''}{'m' if multiline else ''}){pattern}"


def let(value: Column, body) -> Column:
    """body(value) with the value made once, however often the body and its inner functions refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def none() -> Column:
    return F.array().cast(SPANS)


#: Spans that one pass gathers. Appending to an array copies it, so longer lists are made in runs of this length.
RUN = 64


def _walk(pairs: Column, start: Column) -> Column:
    """Spans of (gap, match) pairs that follow one another from start on."""

    def step(acc: Column, p: Column) -> Column:
        a = acc["at"] + F.length(p["g"])
        b = a + F.length(p["m"])
        span = F.struct(a.cast("int").alias("start_pos"), b.cast("int").alias("end_pos"), F.substring(p["m"], 1, KEPT).alias("matched"))
        return F.struct(b.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    return F.aggregate(pairs, F.struct(start.cast("int").alias("at"), none().alias("spans")), step, lambda acc: acc["spans"])


def _walk_in_runs(pairs: Column) -> Column:
    return let(pairs, _runs)


def _runs(pairs: Column) -> Column:
    size = F.size(pairs)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((size - 1) / RUN).cast("int"))), lambda k: F.slice(pairs, k * RUN + 1, F.lit(RUN)))
    length = lambda ps: F.aggregate(ps, F.lit(0), lambda n, p: n + F.length(p["g"]) + F.length(p["m"]))
    return let(runs, lambda rs: F.flatten(F.transform(F.arrays_zip(rs.alias("r"), _starts(F.transform(rs, length)).alias("s")), lambda x: _walk(x["r"], x["s"]))))


def _starts(lengths: Column) -> Column:
    """Where each run begins: the lengths before it."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(lengths, begin, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"])


def regex_spans(c: Column, pattern: str, limit: int | None = 10, ignore_case: bool = True, multiline: bool = False) -> Column:
    """Spans from the texts matched and the gaps between them: a start is what lies before it."""
    rx = java(pattern, ignore_case, multiline)
    found = F.regexp_extract_all(c, F.lit(rx), F.lit(0))
    gaps = F.split(c, rx, -1)
    if limit is not None:
        found, gaps = F.slice(found, 1, limit), F.slice(gaps, 1, limit)
    pairs = F.filter(F.arrays_zip(gaps.alias("g"), found.alias("m")), lambda p: p["m"].isNotNull())
    walked = _walk(pairs, F.lit(0)) if limit is not None and limit <= RUN else _walk_in_runs(pairs)
    return F.when(c.isNull(), F.lit(None).cast(SPANS)).when(c.rlike(rx), walked).otherwise(none())


def keyword_spans(c: Column, keyword: str, limit: int | None = 10) -> Column:
    """Occurrences of a keyword in any case, not overlapping, from left to right."""
    if not keyword:
        raise ValueError("empty keyword")
    found = F.when(F.contains(F.lower(c), F.lit(keyword.lower())), regex_spans(c, rf"\Q{keyword}\E", limit))
    return F.when(c.isNull(), F.lit(None).cast(SPANS)).otherwise(F.coalesce(found, none()))


def _entropy(run: str) -> float:
    n = len(run)
    return -sum(k / n * math.log2(k / n) for k in Counter(run).values())


def entropy_hits(c: Column, threshold: float, min_length: int = 12) -> Column:
    """Runs of token characters, at least min_length long and of three kinds, with at least that entropy, which is that of the
    whole run; what is kept of it is cut. Counting characters in the JVM would take a pass per kind, so this is an Arrow
    function; texts without such a run stay in the JVM."""

    def series(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [(m.start(), m.end(), m[0][:KEPT], e) for m in _RUNS.finditer(t) if m.end() - m.start() >= min_length and len(set(m[0])) >= 3 and (e := _entropy(m[0])) >= threshold])

    some = c.rlike(ENTROPY_RUN[:-4] + f"{{{max(8, min_length)},}}")
    found = F.pandas_udf(series, "array<struct<start_pos:int,end_pos:int,matched:string,entropy:double>>")(F.when(some, c))
    return F.when(c.isNull(), F.lit(None)).otherwise(F.coalesce(found, F.array().cast("array<struct<start_pos:int,end_pos:int,matched:string,entropy:double>>")))


def entropy_spans(c: Column, threshold: float, min_length: int = 12, limit: int | None = 10) -> Column:
    """The hits as spans."""
    runs = F.transform(entropy_hits(c, threshold, min_length), lambda s: F.struct(s["start_pos"].alias("start_pos"), s["end_pos"].alias("end_pos"), s["matched"].alias("matched")))
    return runs if limit is None else F.slice(runs, 1, limit)


def hit(spans: Column) -> Column:
    return F.size(spans) > 0


def all_of(parts: list[Column], negative: list[Column] = (), limit: int = 10) -> Column:
    """Spans of all parts if each has some and no negative part has any."""

    def joined(st: Column) -> Column:
        ok = F.lit(True)
        for i in range(len(parts)):
            ok = ok & hit(st[f"p{i}"])
        for i in range(len(negative)):
            ok = ok & ~hit(st[f"n{i}"])
        return F.when(ok, F.slice(F.concat(*[st[f"p{i}"] for i in range(len(parts))]), 1, limit)).otherwise(none())

    fields = [p.alias(f"p{i}") for i, p in enumerate(parts)] + [n.alias(f"n{i}") for i, n in enumerate(negative)]
    return let(F.struct(*fields), joined)


def first_of(parts: list[tuple[Column, bool]]) -> Column:
    """In order: the first positive part with spans; a negative part with spans before it ends the search."""
    out = none()
    for spans, positive in reversed(parts):
        out = F.when(hit(spans), spans if positive else none()).otherwise(out)
    return out


def unless(first: Column, rest: list[Column]) -> Column:
    """The first of the rest with spans, if the first part has none; fewer than two parts never match."""
    if not rest:
        return none()
    return F.when(~hit(first), first_of([(r, True) for r in rest])).otherwise(none())


def _bare(s: Column) -> Column:
    return F.struct(s["start_pos"].alias("start_pos"), s["end_pos"].alias("end_pos"), F.lit("").alias("matched"))


def near(parts: list[Column], distance: int, negative: list[Column] = ()) -> Column:
    """The first two spans (in order of parts) that lie within distance, if all parts match; as one span each."""
    every = all_of(parts, negative, 1000)
    close = lambda a, b: F.least(F.abs(a["end_pos"] - b["start_pos"]), F.abs(b["end_pos"] - a["start_pos"])) <= distance

    def first(indexed: Column) -> Column:
        pairs = F.flatten(F.transform(indexed, lambda a: F.transform(F.filter(indexed, lambda b: (b["i"] > a["i"]) & close(a["s"], b["s"])), lambda b: F.array(_bare(a["s"]), _bare(b["s"])))))
        return F.coalesce(F.get(pairs, F.lit(0)), none())

    return let(F.transform(every, lambda s, i: F.struct(i.alias("i"), s.alias("s"))), first)


def mode_of(text: str) -> tuple[str, int]:
    """and, or, not, near:N (500 where N is missing or wrong); anything else is and."""
    t = text.strip().lower()
    if t.startswith("near"):
        n = t.partition(":")[2].strip()
        return "near", int(n) if n.isdigit() and int(n) >= 1 else 500
    return (t, 0) if t in ("or", "not") else ("and", 0)
