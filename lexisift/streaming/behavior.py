"""Scores of sessions over a stream of messages: the running state that ``operators.sessions`` computes over a table.

A session's state is its score and number of messages. It ends when the watermark has passed its last message by the idle
time; a message after that begins the session anew, as a pruned session does. Within a batch a session's messages are taken
in order of time; messages behind the watermark are dropped by the engine, which counts them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexisift.operators.rules import Rule, evaluate
from lexisift.operators.sessions import POLLUTED, points

SCORES = "session_id string, message_id string, time timestamp, history_count long, score_before long, score long, is_polluted boolean"


def _advance(idle_ms: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        score, count, last = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(parts)).sort_values(["time", "message_id"], kind="stable")
        added = rows["points"].astype("int64").cumsum()
        out = pd.DataFrame({"session_id": key[0], "message_id": rows["message_id"], "time": rows["time"]})
        out["history_count"] = count + pd.RangeIndex(1, len(rows) + 1)
        out["score"] = score + added
        out["score_before"] = out["score"] - rows["points"]
        out["is_polluted"] = out["score"] > POLLUTED
        last = max(last, int(rows["time"].max().value // 1_000_000))
        state.update((int(out["score"].iloc[-1]), count + len(rows), last))
        state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield out[[c.split()[0] for c in SCORES.split(", ")]]

    return run


def session_scores(messages: DataFrame, rules: list[Rule], session: str, message: str, time: str, text: str, watermark: str = "1 hour", idle_hours: float = 24) -> DataFrame:
    """messages, streaming -> one row per message with its session's score. Messages without a session take no part."""
    fired = evaluate(messages.filter(F.col(session).isNotNull() & F.col(time).isNotNull()), rules, text)
    slim = fired.select(F.col(session).alias("session_id"), F.col(message).cast("string").alias("message_id"), F.col(time).alias("time"), points("results").alias("points"))
    return slim.withWatermark("time", watermark).groupBy("session_id").applyInPandasWithState(_advance(int(idle_hours * 3_600_000)), SCORES, "score long, count long, last long", "append", GroupStateTimeout.EventTimeTimeout)
