"""Behaviour over a session: running scores, thresholds, pollution, idle sessions.

The window runs over a session's turns in order; a session with very many turns is sorted on disk, not gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import Rule

#: What a fired rule adds to its session's score (fixed values).
POINTS = {"P0": 20, "P1": 10, "P2": 5}
POLLUTED = 50


def points(results: str | Column = "results") -> Column:
    r = F.col(results) if isinstance(results, str) else results
    one = lambda x: F.when(x["severity"] == "P0", POINTS["P0"]).when(x["severity"] == "P1", POINTS["P1"]).otherwise(POINTS["P2"])
    return F.coalesce(F.aggregate(r, F.lit(0), lambda a, x: a + one(x)), F.lit(0))


def track(df: DataFrame, session: str, order: list[str], rules: list[Rule], results: str = "results") -> DataFrame:
    """df with history_count, score_before, score, is_polluted and the session rules that fire on each message."""
    w = Window.partitionBy(session).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("points", points(results))
    df = df.withColumn("score", F.sum("points").over(upto)).withColumn("score_before", F.col("score") - F.col("points"))
    df = df.withColumn("history_count", F.row_number().over(w)).withColumn("is_polluted", F.col("score") > POLLUTED)
    injected = [F.when(F.col("score") >= (r.session_threshold or 5), F.lit(r.id)) for r in rules if r.session_threshold is not None]
    watched = sorted({d for r in rules for d in r.pollution_of})
    if watched:
        seen = F.filter(F.transform(results, lambda x: x["rule_id"]), lambda x: x.isin(watched))
        df = df.withColumn("seen", F.array_distinct(F.flatten(F.collect_set(F.coalesce(seen, F.array().cast("array<string>"))).over(upto))))
        injected += [F.when(F.col("is_polluted") & F.arrays_overlap("seen", F.array(*map(F.lit, r.pollution_of))), F.lit(r.id)) for r in rules if r.pollution_of]
    fired = F.filter(F.array(*injected), lambda x: x.isNotNull()) if injected else F.array().cast("array<string>")
    return df.withColumn("session_rules", fired).drop("seen")


def idle(df: DataFrame, session: str, time: str, now: Column, hours: float = 24) -> DataFrame:
    """Sessions whose last activity lies more than hours before now."""
    last = df.filter(F.col(session).isNotNull()).groupBy(session).agg(F.max(time).alias("last_activity"), F.count("*").alias("n_messages"))
    return last.filter(F.col("last_activity") < now - F.expr(f"INTERVAL {hours} HOURS"))


def states(tracked: DataFrame, session: str) -> DataFrame:
    """The last state of each session of ``track``: messages, score, pollution."""
    return tracked.groupBy(session).agg(F.max("history_count").alias("history_count"), F.max("score").alias("score"), F.max("is_polluted").alias("is_polluted"))


def since_reset(df: DataFrame, resets: DataFrame, session: str, time: str) -> DataFrame:
    """df without what came before its session's last reset. resets: (session, reset_at); a session without one stays whole."""
    last = resets.filter(F.col(session).isNotNull()).groupBy(session).agg(F.max("reset_at").alias("reset_at"))
    joined = df.join(last, session, "left")
    return joined.filter(F.col("reset_at").isNull() | (F.col(time) >= F.col("reset_at"))).drop("reset_at")
