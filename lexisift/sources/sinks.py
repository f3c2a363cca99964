"""Sinks of audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def formatted(events: DataFrame, form: str = "jsonl") -> DataFrame:
    """events as values of one column: ``dict`` (a map of JSON texts), ``json`` (indented) or ``jsonl``."""
    if form == "jsonl":
        return json_lines(events)
    if form == "json":
        return events.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"))
    if form == "dict":
        return events.select(F.map_from_arrays(F.array(*map(F.lit, events.columns)), F.array(*[F.to_json(F.struct(c)) for c in events.columns])).alias("value"))
    raise ValueError(f"unknown format {form}")


def to_console(events: DataFrame, form: str = "jsonl", limit: int = 1000, out=None) -> int:
    """Prints the first events, one value after the other, and says how many; a stream is for ``stream_to_console``."""
    import sys

    rows = formatted(events, form).limit(limit).collect()
    for r in rows:
        print(r["value"], file=out or sys.stdout)
    return len(rows)


def stream_to_console(events: DataFrame):
    """Starts a query that prints what arrives."""
    return events.writeStream.format("console").option("truncate", False).outputMode("append").start()


def stamped(events: DataFrame, now: Column | None = None) -> DataFrame:
    """events with an identifier and a time of their own."""
    return events.withColumn("event_id", F.uuid()).withColumn("event_timestamp", now if now is not None else F.current_timestamp())


def append_files(events: DataFrame, path: str, form: str = "json") -> None:
    events.write.mode("append").format(form).save(path)


def stream_to_files(events: DataFrame, path: str, checkpoint: str, form: str = "parquet"):
    """Starts a query that appends the events of a stream; nothing is dropped, and its checkpoint makes each event appear once."""
    return events.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
