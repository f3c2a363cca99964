"""Fits the tagger of personal data: ``python -m lexisift.llm.pii_train REQUESTS.parquet OUT.npz [STEPS [WIDTH [PROCESSES]]]``.

Half of the windows are made from ``pii_frames``: items and names of many shapes in sentences of four languages, between words
of the texts. The others are texts labelled by the formats of ``pii_rules`` and, for names, by the words around them, with names
and digits replaced by others, other letter cases, and cut-outs as they occur in matched spans. The sample of texts is
bounded by MAX_TEXTS (a documented bound: only training reads a sample; every text is decoded).
"""

from __future__ import annotations

import random
import re
import sys

import numpy as np

from . import pii_frames as frames
from . import pii_rules as rules
from .bilstm_crf import encode, train

MAX_TEXTS = 20_000
WINDOW = 96
TAGS = ("O", *(f"{p}-{k}" for k in rules.KINDS for p in "BI"))
_B = {k: 1 + 2 * i for i, k in enumerate(rules.KINDS)}

_N = rf"(?P<n>(?:{rules.TITLE}\.?\s+)?{rules._W}(?:,?\s+(?:{rules._W}|[^\W\d_]\.)){{0,3}})"
CUES = [
    re.compile(re.sub(r"\bN\b", lambda _: _N, p), re.I)
    for p in (
        r"\b(?:Hi|Hello|Dear|Bonjour|Hola|Hallo) N, ",
        r"My name is N and I ",
        r"polite reply to N\.(?=\s|$)",
        r"filed by N last week",
        r"cc N, who owns",
        r"Signed, N(?=\s*[\n.;—/]|\s*$|\s+(?:The|A|An|Because|If|We|It|At|In|Our|Since|One|Nobody|As)\s)",
        r"paragraph about N from the",
        r"In the meeting N said",
        r"(?:(?<=[.?!\n] )|^)N approved the exception",
        r"account belongs to N, not",
        r"assignee=N(?=\s*$|\s*[\n.;—/])",
        r"Mein Name ist N und ich",
        r"eine Antwort an N\.(?=\s|$)",
        r"Beschwerde kam von N\.(?=\s|$)",
        r"Gezeichnet N(?=\s*[\n.;—/]|\s*$)",
        r"Laut N war die",
        r"(?:(?<=[.?!\n] )|^)N hat die Ausnahme",
        r"Selon N, le contrôle",
        r"Je m’appelle N et je",
        r"plainte vient de N\.(?=\s|$)",
        r"une réponse à N\.(?=\s|$)",
        r"Signé : N(?=\s*[\n.;—/]|\s*$)",
        r"(?:(?<=[.?!\n] )|^)N a validé l’exception",
        r"Según N, el control",
        r"Me llamo N y necesito",
        r"queja la presentó N\.(?=\s|$)",
        r"respuesta para N\.(?=\s|$)",
        r"Firmado: N(?=\s*[\n.;—/]|\s*$)",
        r"(?:(?<=[.?!\n] )|^)N aprobó la excepción",
    )
]
def label(text: str) -> list[tuple[int, int, str]]:
    spans = rules.exact(text)
    for cue in CUES:
        for m in cue.finditer(text):
            a, b = m.span("n")
            if rules.name_ok(text[a:b]) and all(b <= x or a >= y for x, y, _ in spans):
                spans.append((a, b, "name"))
    return sorted(spans)


def vary(text: str, spans, r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    out, done, at = [], [], 0
    size = 0
    for a, b, kind in spans:
        part, piece = text[at:a], text[a:b]
        if kind == "name" and r.random() < 0.6:
            piece = frames.name(r)
        elif kind in ("phone", "id_number") and r.random() < 0.5:
            piece = re.sub(r"\d", lambda _: r.choice("0123456789"), piece)
        out += [part, piece]
        size += len(part)
        done.append((size, size + len(piece), kind))
        size += len(piece)
        at = b
    out.append(text[at:])
    return "".join(out), done


def windows(texts: list[str]):
    labelled = [(t, label(t)) for t in texts if t]
    has = [x for x in labelled if x[1]]
    none = [x for x in labelled if not x[1]]

    def made(r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
        """Pieces of frames, alone or between words of a text."""
        out, spans, at = [], [], 0
        for _ in range(r.choice((1, 1, 2, 3))):
            text, own = frames.piece(r)
            if own and r.random() < 0.3:  # as in a matched span: the item alone, or a few characters around it
                x, y, kind = own[0]
                lo, hi = max(0, x - r.choice((0, 0, 0, 6, 12))), min(len(text), y + r.choice((0, 0, 0, 1, 5)))
                text, own = text[lo:hi], [(x - lo, y - lo, kind)]
            if r.random() < 0.6:
                words = r.choice(none)[0].split(" ")
                k = r.randrange(len(words))
                around = " ".join(words[k : k + r.randrange(1, 8)])
                text, own = (around + " " + text, [(x + len(around) + 1, y + len(around) + 1, s) for x, y, s in own]) if r.random() < 0.5 else (text + " " + around, own)
            if out:
                out.append(r.choice((" ", " ", "\n", ". ")))
                at += len(out[-1])
            spans += [(x + at, y + at, s) for x, y, s in own]
            out.append(text)
            at += len(text)
            if r.random() < 0.35:
                break
        return "".join(out), spans

    def drawn(r: random.Random) -> tuple[str, list[tuple[int, int, str]], int]:
        """A text, its spans and where the window begins."""
        if r.random() < 0.5:
            text, spans = made(r)
            return text, spans, r.randrange(max(1, len(text) - WINDOW + 1))
        text, spans = vary(*r.choice(has if r.random() < 0.65 else none), r)
        way = r.random()
        if spans and way < 0.70:
            a, b, _ = r.choice(spans)
            if way < 0.30:  # as in a matched span: the item alone, or with little around it
                lo, hi = max(0, a - r.choice((0, 0, 8, 20))), min(len(text), b + r.choice((0, 0, 0, 6)))
                return text[lo:hi], [(x - lo, y - lo, s) for x, y, s in spans if lo <= x and y <= hi], 0
            return text, spans, max(0, a - r.randrange(WINDOW - 8))
        if way > 0.9:  # a few words of prose
            lo = r.randrange(max(1, len(text)))
            hi = lo + r.randrange(5, 60)
            return text[lo:hi], [(x - lo, y - lo, s) for x, y, s in spans if lo <= x and y <= hi], 0
        return text, spans, r.randrange(max(1, len(text) - WINDOW + 1))

    def make(rng: np.random.Generator, batch: int):
        r = random.Random(int(rng.integers(1 << 60)))
        ids = np.zeros((batch, WINDOW), np.int16)
        gold = np.zeros((batch, WINDOW), np.int64)
        for k in range(batch):
            text, spans, lo = drawn(r)
            got = encode(text[lo : lo + WINDOW])
            ids[k, : len(got)] = got
            for a, b, kind in spans:
                a, b = max(a - lo, 0), min(b - lo, WINDOW)
                if a < b:
                    gold[k, a:b] = _B[kind] + 1
                    gold[k, a] = _B[kind]
        return ids, gold

    return make


def main(source: str, target: str, steps: int = 9000, hidden: int = 24, workers: int = 6) -> None:
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(source, columns=["content"])["content"].to_pylist() if t]
    random.Random(5).shuffle(texts)
    model = train(windows(texts[:MAX_TEXTS]), hidden, len(TAGS), steps, 192, 17, workers=workers, log=lambda k, x: print(k, round(x, 5), flush=True))
    np.savez_compressed(target, **{k: v.astype(np.float16) for k, v in model.w.items()})


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], *map(int, sys.argv[3:]))
