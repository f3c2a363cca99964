"""Personal information in free text: a character BiLSTM-CRF proposes spans, formats confirm them, placeholders replace them.

Texts are cut into overlapping windows; the network scores every character of every window; where windows overlap the score
farther from its window's edge is taken, so each character has one score, and the CRF decodes the whole text at once. A
proposed span is widened to the whole item where its format shows more of it, and dropped where it has no such format.

Null text has no spans and stays null; empty text stays empty; a text of any length is decoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pii_rules as rules
from .bilstm_crf import Tagger, encode_all

MODEL = str(Path(__file__).parent / "models" / "pii_tagger.npz")
TAGS = ("O", *(f"{p}-{k}" for k in rules.KINDS for p in "BI"))
WINDOW, STRIDE = 768, 704
#: Characters gathered before they are decoded: fewer and fuller blocks.
FLUSH = 1_500_000
#: Windows scored at once, and how many before only those of about one length join them.
CHUNK, FEW = 512, 96
SPANS = "array<struct<start_pos:int,end_pos:int,kind:string,matched:string>>"


@lru_cache(2)
def _tagger(path: str) -> Tagger:
    with np.load(path) as f:
        return Tagger({k: f[k].astype(np.float32) for k in f.files})


def _blocks(lengths: list[int], limit: int = 400_000) -> Iterator[list[int]]:
    """Numbers of texts, short ones first, in blocks of at most CHUNK texts and limit characters."""
    order = sorted(range(len(lengths)), key=lengths.__getitem__)
    a = 0
    while a < len(order):
        b = a + 1
        most = lengths[order[a]] * 5 // 4 + 16  # of about one length
        while b < len(order) and b - a < CHUNK and (lengths[order[b]] <= most or b - a < FEW) and (b - a + 1) * lengths[order[b]] <= limit:
            b += 1
        yield order[a:b]
        a = b


def _emit(t: Tagger, ids: list[np.ndarray]) -> np.ndarray:
    block = np.zeros((len(ids), max(map(len, ids))), np.uint8)
    for row, x in enumerate(ids):
        block[row, : len(x)] = x
    return t.emissions(np.ascontiguousarray(block.T))


def _spans(t: Tagger, ids: list[np.ndarray]) -> list[list[tuple[int, int, str]]]:
    """Spans of each text, decoded whole. The scores of a text longer than a window are stitched from its windows."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in ids]

    def put(own: list[int], path: np.ndarray) -> None:
        row, at = np.nonzero(path)
        tag = path[row, at].astype(np.int64)
        kind = (tag - 1) // 2
        goes_on = np.zeros(len(row), bool)  # an inside tag behind a tag of its kind
        goes_on[1:] = (tag[1:] % 2 == 0) & (row[1:] == row[:-1]) & (at[1:] == at[:-1] + 1) & (kind[1:] == kind[:-1])
        first = np.flatnonzero(~goes_on)
        last = np.append(first[1:], len(row)) - 1
        for a, b in zip(first.tolist(), last.tolist()):
            out[own[row[a]]].append((int(at[a]), int(at[b]) + 1, rules.KINDS[kind[a]]))

    short = [k for k, x in enumerate(ids) if len(x) <= WINDOW]
    for part in _blocks([len(ids[k]) for k in short]):
        own = [short[k] for k in part]
        put(own, t.decode(_emit(t, [ids[k] for k in own]), np.array([len(ids[k]) for k in own])))
    long = [k for k, x in enumerate(ids) if len(x) > WINDOW]
    half = (WINDOW - STRIDE) // 2
    for part in _blocks([len(ids[k]) for k in long]):
        own = [long[k] for k in part]
        lengths = np.array([len(ids[k]) for k in own])
        scores = np.zeros((int(lengths[-1]), t.tags, len(own)), np.float32)
        cuts = [(row, at, min(WINDOW, int(n) - at)) for row, n in enumerate(lengths) for at in range(0, max(1, int(n) - WINDOW + STRIDE), STRIDE)]
        for some in _blocks([c[2] for c in cuts]):
            em = _emit(t, [ids[own[cuts[k][0]]][cuts[k][1] : cuts[k][1] + cuts[k][2]] for k in some])
            for col, k in enumerate(some):
                row, at, size = cuts[k]
                lo = half if at else 0
                hi = size if at + size == lengths[row] else STRIDE + half
                scores[at + lo : at + hi, :, row] = em[lo:hi, :, col]
        put(own, t.decode(scores, lengths))
    return out


#: Formats tried on the lines of a proposal: numbers of either sort may be taken for the other.
_LOOKED_FOR = {"email": ("email",), "address": ("address",), "phone": ("email", "id_number", "phone"), "id_number": ("email", "id_number", "phone")}


#: What a proposal may lack of its item before and behind it, not counting the rest of a word: a label, a part of a name.
AROUND = 60
_WORD_END = re.compile(r"\s|$")


def _around(text: str, a: int, b: int) -> tuple[int, int]:
    """The proposal's line, or of a longer one what lies around the proposal, in whole words."""
    lo, hi = max(a - AROUND, text.rfind("\n", 0, a) + 1), min(b + AROUND, len(text))
    while lo > 0 and not text[lo - 1].isspace():
        lo -= 1
    hi = _WORD_END.search(text, hi).start()
    stop = text.find("\n", b, hi)
    return lo, hi if stop < 0 else stop


def _confirm(text: str, proposed: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The proposed items: widened to the whole item and typed by the format that stands there, else as they are if they have
    what any item of their kind has; names by shape."""
    if not proposed:
        return []
    out: list[tuple[int, int, str]] = []
    taken: set = set()
    for a, b, kind in proposed:
        if kind == "name":
            continue
        lo, hi = _around(text, a, b)
        met = False
        for x, y, real in rules.exact(text[lo:hi], _LOOKED_FOR[kind]):
            x, y = x + lo, y + lo
            if x < b and y > a:
                met = True
                if (x, y) not in taken:
                    taken.add((x, y))
                    out.append((x, y, real))
        if not met and rules.plausible(text[a:b], kind):
            taken.add((a, b))
            out.append((a, b, kind))
    for a, b, kind in proposed:
        if kind != "name" and not (kind == "address" and b - a > 5 and not any(c.isdigit() for c in text[a:b])):
            continue  # names and addresses are made of the same words: one without a number is tried as a name
        a, b = _whole_words(text, a, b)
        if not rules.name_ok(text[a:b]):  # one half of a name may be all that was proposed
            more = re.search(r"(?:^|(?<=[\s:=(—,;]))[^\W\d_]{3,}\s+$", text[max(0, a - 24) : a])
            if more and more[0].strip().lower() not in rules.NOT_NAME and rules.name_ok(text[a - len(more[0]) : b]):
                a -= len(more[0])
        if any(a < y and b > x for x, y, _ in out):
            continue
        if rules.name_ok(text[a:b]) and not (a and text[a - 1] in "@./_-") and not text[b : b + 1] in ("@", "_"):
            out.append((a, b, "name"))
    return sorted(out)


def _whole_words(text: str, a: int, b: int) -> tuple[int, int]:
    while a > 0 and (text[a - 1].isalpha() or (text[a - 1] in "-’'" and a > 1 and text[a - 2].isalpha())) and text[a].isalpha():
        a -= 1
    while b < len(text) and text[b - 1].isalpha() and (text[b].isalpha() or (text[b] in "-" and b + 1 < len(text) and text[b + 1].isalpha())):
        b += 1
    while a < b and not text[a].isalnum():
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    if b < len(text) and text[b] == "." and b - a >= 2 and text[b - 2 : b - 1] in (" ", "") and text[b - 1].isupper():
        b += 1
    while (m := re.match(r"[^\W\d_]+[\s,]+", text[a:b])) and m[0].strip(" ,\n\t").lower() in rules.NOT_NAME:
        a += m.end()
    while (m := re.search(r"[\s,]+[^\W\d_]+$", text[a:b])) and m[0].strip(" ,\n\t").lower() in rules.NOT_NAME:
        b = a + m.start()
    lead = re.search(rf"(?:^|(?<=[\s:(,;.]))({rules.TITLE}\.?\s+)$", text[max(0, a - 16) : a])
    if lead:
        a -= len(lead[1])
    return a, b


#: Characters of decoded texts that a worker remembers.
REMEMBERED = 8_000_000


def find_spans(texts: list[str | None], model: str = MODEL, known: dict | None = None) -> list[list[tuple[int, int, str]]]:
    """Spans of each text; texts that repeat, here or among the known ones, are decoded once."""
    t = _tagger(model)
    found: dict[str, list] = {} if known is None else known
    if sum(map(len, found)) > REMEMBERED:
        found.clear()
    distinct = list(dict.fromkeys(x for x in texts if x and x not in found and not x.isspace()))
    size = 0
    part: list[str] = []

    def flush() -> None:
        for x, spans in zip(part, _spans(t, encode_all(part))):
            found[x] = _confirm(x, spans)

    for x in distinct:
        part.append(x)
        size += len(x)
        if size >= FLUSH:
            flush()
            part, size = [], 0
    if part:
        flush()
    return [found.get(x, []) if x else [] for x in texts]


def _spans_series(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict = {}
    for texts in batches:
        values = texts.tolist()
        yield pd.Series([None if x is None else [(a, b, k, x[a:b]) for a, b, k in s] for x, s in zip(values, find_spans(values, known=known))])


def tag(df: DataFrame, text: str, into: str = "pii") -> DataFrame:
    """df with the spans of personal data in text (null for null text)."""
    # not deterministic, as the planner sees it: else a filter on the spans would have them made once more
    return df.withColumn(into, F.pandas_udf(_spans_series, SPANS).asNondeterministic()(F.col(text)))


def redact(df: DataFrame, text: str, spans: str = "pii", into: str = "redacted") -> DataFrame:
    """The text with each span replaced by its kind in angle brackets; the rest is unchanged."""
    start = lambda s: s["start_pos"]
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    c = F.col(text)
    step = lambda acc, s: F.struct(s["end_pos"].alias("at"), F.concat(acc["out"], F.substring(c, acc["at"] + 1, start(s) - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out"))
    return df.withColumn(into, F.aggregate(F.col(spans), begin, step, lambda acc: F.concat(acc["out"], F.substring(c, acc["at"] + 1, F.length(c)))))


def fields(requests: DataFrame, events: DataFrame) -> DataFrame:
    """(field_name, rec_id, text) of the three fields; the spans of an event are one row each."""
    return (
        requests.select(F.lit("content").alias("field_name"), F.col("request_id").alias("rec_id"), F.col("content").alias("text"))
        .unionByName(events.select(F.lit("content_snippet").alias("field_name"), F.col("delivery_id").cast("string").alias("rec_id"), F.col("content_snippet").alias("text")))
        .unionByName(events.select(F.lit("matched").alias("field_name"), F.col("delivery_id").cast("string").alias("rec_id"), F.explode("matched_spans.matched").alias("text")))
        .filter("rec_id is not null and text is not null")
    )


#: A snippet of this length was cut: an item that touches its end may be incomplete.
SNIPPET = 200


def found(requests: DataFrame, events: DataFrame) -> DataFrame:
    """(field_name, rec_id, kind) of the fields that hold a complete item of the kind."""
    tagged = tag(fields(requests, events), "text")
    items = tagged.select("field_name", "rec_id", F.length("text").alias("size"), F.explode("pii").alias("item"))
    cut = (F.col("field_name") == "content_snippet") & (F.col("size") >= SNIPPET) & (F.col("item.end_pos") >= F.col("size"))
    return items.filter(~cut).select("field_name", "rec_id", "item.kind").distinct()
