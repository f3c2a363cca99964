"""Queries over deliveries of messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexisift.session import table, work_dir
from lexisift.streaming.dedup import Deduplicator


def p7_found(spark, d):
    return Deduplicator(spark).run(f"{d}/audit_events.parquet", only_surplus=True).select(F.col("id").alias("delivery_id"))


def p7_expired(spark, d):
    """The same over many micro-batches in the order of receipt, with a horizon so short that identifiers expire."""
    home = work_dir(spark, "received")
    table(spark, d, "audit_events").select("event_id", "delivery_id", "event_timestamp", "received_at").repartitionByRange(6, "received_at").write.parquet(home)
    return Deduplicator(spark, horizon="1 hour", files_per_batch=1).run(home, only_surplus=True).select(F.col("id").alias("delivery_id"))


def p7_once(spark, d):
    """Exactly one row per event: every delivery that isn't surplus, those without an identifier included."""
    surplus = Deduplicator(spark).run(f"{d}/audit_events.parquet", only_surplus=True).select(F.col("id").alias("delivery_id"))
    events = table(spark, d, "audit_events")
    kept = events.join(surplus, "delivery_id", "left_anti")
    return kept.groupBy("stage").agg(F.count("*").alias("n_events"), F.sum(F.when(F.coalesce(F.trim("event_id"), F.lit("")) == "", 1).otherwise(0)).alias("n_without_id"))


_KEY = r"lower(regexp_replace(regexp_replace(event_id, '(?i)^\s*\{?\s*(urn:)?(uuid:)?', ''), '[\s{}\-]', '', 'g'))"
_SURPLUS = f"SELECT delivery_id FROM (SELECT delivery_id, min(delivery_id) OVER (PARTITION BY {_KEY}) AS least, {_KEY} AS k FROM audit_events) WHERE k <> '' AND k IS NOT NULL AND delivery_id > least"
QUERIES = {"p7_found": p7_found, "p7_once": p7_once, "p7_expired": p7_expired}
ORACLE = {
    "p7_found": _SURPLUS,
    "p7_expired": _SURPLUS,
    "p7_once": f"SELECT stage, count(*) AS n_events, CAST(sum(CASE WHEN coalesce(trim(event_id), '') = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_without_id FROM audit_events WHERE delivery_id NOT IN ({_SURPLUS}) GROUP BY stage",
}
