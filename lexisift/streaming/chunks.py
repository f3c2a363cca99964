"""Output that comes in chunks: boundaries where a stream may be flushed, running length, segments, and the stateful buffer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexisift.operators.spans import regex_spans

LEAST_CHARS = 50
MODES = ("sentence", "paragraph", "line", "word")
#: A stream's buffer may not grow beyond this.
MAX_BUFFER = 1_000_000


def boundaries(c: Column, mode: str = "sentence", least: int = LEAST_CHARS) -> Column:
    """Positions at which text may be flushed, from least on."""
    if mode == "sentence":
        at = F.transform(regex_spans(c, r"(?<=[.?!])\s+(?=[A-Z\"'(\\\[{])", None, ignore_case=False), lambda s: s["start_pos"] + 1)
    elif mode == "paragraph":
        at = F.transform(regex_spans(c, r"\n\s*\n", None, ignore_case=False), lambda s: s["end_pos"])
    elif mode in ("line", "word"):
        stop = (lambda x: x == "\n") if mode == "line" else (lambda x: x.rlike(r"(?U)^\s$"))
        at = F.filter(F.transform(F.split(c, ""), lambda x, i: F.when(stop(x), i)), lambda i: i.isNotNull())
    else:
        raise ValueError(f"unknown mode {mode}")
    return F.filter(at, lambda x: x >= least)


def last_boundary(c: Column, most: Column, mode: str = "sentence", least: int = LEAST_CHARS) -> Column:
    return F.when(most >= least, F.array_max(F.filter(boundaries(c, mode, least), lambda x: x <= most)))


def cumulative_length(df: DataFrame, stream: str, order: str, text: str, limit: int) -> DataFrame:
    """df with the stream's length up to each chunk and whether it has passed the limit by then."""
    w = Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("cumulative_length", F.sum(F.coalesce(F.length(text), F.lit(0))).over(w)).withColumn("over_limit", F.col("cumulative_length") > limit)


def assembled(df: DataFrame, stream: str, order: str, text: str) -> DataFrame:
    """The whole text of each stream."""
    parts = F.sort_array(F.collect_list(F.struct(order, text)))
    return df.groupBy(stream).agg(F.array_join(F.transform(parts, lambda p: F.coalesce(p[text], F.lit(""))), "").alias(text))


def flush_segments(chunks: DataFrame, stream: str, order: str, text: str, final: str, mode: str = "paragraph") -> DataFrame:
    """chunks, streaming -> (stream, segment, text): what is ready at each boundary; only the unflushed tail is kept as state.

    A chunk marked final flushes the rest. A buffer beyond MAX_BUFFER is flushed where it stands, so nothing is lost.
    """
    import re

    rx = {"sentence": r"(?<=[.?!])\s+(?=[A-Z\"'(\\\[{])", "paragraph": r"\n\s*\n", "line": r"\n", "word": r"\s"}[mode]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, number = state.get if state.exists else ("", 0)
        out = []
        done = False
        for part in parts:
            for _, row in part.sort_values(order).iterrows():
                tail += row[text] or ""
                done = done or bool(row[final])
                cuts = [m.end() for m in re.finditer(rx, tail) if m.end() >= LEAST_CHARS]
                if cuts:
                    out.append((key[0], number, tail[: cuts[-1]]))
                    number, tail = number + 1, tail[cuts[-1] :]
                while len(tail) > MAX_BUFFER:
                    out.append((key[0], number, tail[:MAX_BUFFER]))
                    number, tail = number + 1, tail[MAX_BUFFER:]
        if done and tail:
            out.append((key[0], number, tail))
            number, tail = number + 1, ""
        if done:
            state.remove() if state.exists else None
        else:
            state.update((tail, number))
        yield pd.DataFrame(out, columns=["stream", "segment", "text"])

    return chunks.groupBy(stream).applyInPandasWithState(run, "stream string, segment int, text string", "tail string, number int", "append", GroupStateTimeout.NoTimeout)
