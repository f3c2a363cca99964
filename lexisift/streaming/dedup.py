"""Messages delivered at least once: exactly one copy of each.

Keyed state of seen identifiers, in Spark's state store, with expiry by event-time watermark. State and output advance
together: the stream's checkpoint holds the state of each micro-batch, and each batch writes its decisions under its own
number, so a batch that is run again replaces what it wrote. Every delivery with an identifier gets a decision.

What the state can't know is looked up in the decisions written so far: deliveries that the watermark shut out, and
identifiers that came again after they had expired. Whether there are any is read from what was written, never from the
progress of a running query: a row short of the source's tells of shut-out deliveries, a marker of expired identifiers. Without
either nothing is looked up.

Identifiers are kept in buckets, a bucket being one entry of the state store: sorted arrays of identifier, smallest delivery
and latest event time, merged with a batch's rows at once rather than key by key. There are as many buckets as the source's
rows ask for (``PER_BUCKET`` each); a home folder keeps the number of its first run. Expired identifiers leave whenever
their bucket is touched or times out.

Before the shuffle each Arrow batch is reduced to the smallest delivery of each identifier, so that an identifier with a
third of all rows sends a few rows per batch to its task.

Rows without an identifier (null, empty or blank) are kept and never compared. A missing event time counts as the time of
receipt or, without that, as the oldest. Of repeated rows with one delivery number one is kept. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexisift.session import work_dir

EARLY = "1970-01-01 00:00:00"
LOCAL = "h bigint, l bigint, id bigint, ts bigint, surplus boolean"
#: kind: FIRST word on a delivery, LATER word on one that was kept before, or that identifiers EXPIRED.
DECISIONS = "h bigint, l bigint, id bigint, surplus boolean, kind tinyint"
FIRST, LATER, EXPIRED = 0, 1, 2
#: Identifiers of a bucket, and the fewest buckets.
PER_BUCKET, FEWEST = 256, 64


def uuid_key(c: Column) -> Column:
    """A UUID however written: case, braces, urn prefix, hyphens and white space count as nothing; else the trimmed text."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(c, r"(?i)^\s*\{?\s*(urn:)?(uuid:)?", ""), r"[\s{}\-]", ""))
    trimmed = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), bare).when(F.length(trimmed) > 0, F.concat(F.lit("="), trimmed))


def halves(key: Column) -> tuple[Column, Column]:
    """A UUID's 128 bits as two numbers; of any other identifier, the bits of its MD5."""
    bits = F.when(key.startswith("="), F.md5(key)).otherwise(key)
    return F.conv(F.substring(bits, 1, 16), 16, -10).cast("bigint"), F.conv(F.substring(bits, 17, 16), 16, -10).cast("bigint")


def _first_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per identifier the smallest delivery of the batch stays a candidate, the others are surplus."""
    for b in batches:
        h, l, i = (b.column(k).to_numpy(zero_copy_only=False) for k in ("h", "l", "id"))
        order = np.lexsort((i, l, h))
        first = np.ones(len(order), bool)
        first[1:] = (h[order][1:] != h[order][:-1]) | (l[order][1:] != l[order][:-1])
        surplus = np.empty(len(order), bool)
        surplus[order] = ~first
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("h", "l", "id", "ts")), pa.array(surplus)], names=["h", "l", "id", "ts", "surplus"])


_ENTRY = np.dtype([("h", "<i8"), ("l", "<i8"), ("id", "<i8"), ("last", "<i8")])


def _decide(slot: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: the bucket's identifiers with the smallest delivery seen and the latest event time."""
    if slot[0] < 0:
        for part in parts:
            yield part[["h", "l", "id", "surplus"]].assign(kind=np.int8(FIRST))
        return
    kept = np.frombuffer(state.get[0], _ENTRY) if state.exists else np.empty(0, _ENTRY)
    if not state.hasTimedOut:
        for part in parts:
            new = np.empty(len(part), _ENTRY)
            new["h"], new["l"], new["id"], new["last"] = part["h"], part["l"], part["id"], part["ts"]
            both = np.concatenate([kept, new])
            old = np.arange(len(both)) < len(kept)
            order = np.lexsort((both["id"], both["l"], both["h"]))
            both, old = both[order], old[order]
            first = np.ones(len(both), bool)
            first[1:] = (both["h"][1:] != both["h"][:-1]) | (both["l"][1:] != both["l"][:-1])
            group = np.cumsum(first) - 1
            keeper = both["id"][first][group]
            surplus = both["id"] > keeper
            said = surplus | ~old  # what was kept before and is kept still needs no word
            yield pd.DataFrame({"h": both["h"][said], "l": both["l"][said], "id": both["id"][said], "surplus": surplus[said], "kind": np.where(old[said], LATER, FIRST).astype(np.int8)})
            last = np.maximum.reduceat(both["last"], np.flatnonzero(first)) if len(both) else both["last"]
            kept = both[first].copy()
            kept["last"] = last
    alive = kept["last"] >= state.getCurrentWatermarkMs()
    if not alive.all():
        kept = kept[alive]
        yield pd.DataFrame({"h": [0], "l": [0], "id": [0], "surplus": [False], "kind": np.array([EXPIRED], np.int8)})
    if len(kept):
        state.update((kept.tobytes(),))
        state.setTimeoutTimestamp(max(int(kept["last"].min()), state.getCurrentWatermarkMs()) + 1)
    elif state.exists:
        state.remove()


def decisions(rows: DataFrame, horizon: str, buckets: int) -> DataFrame:
    """rows (h, l, id, ts), streaming -> decisions (h, l, id, surplus) on every delivery that the watermark lets in.

    A delivery that its own Arrow batch settles passes under a slot that keeps no state, so the rows of a hot identifier
    spread. A delivery may be decided on twice: once kept, it becomes surplus when a smaller one comes later.
    """
    local = rows.mapInArrow(_first_of_batch, LOCAL).withColumn("when", F.timestamp_millis("ts")).withWatermark("when", horizon)
    slot = F.when(F.col("surplus"), -1 - F.pmod("id", F.lit(buckets))).otherwise(F.pmod(F.xxhash64("h", "l"), F.lit(buckets)))
    return local.withColumn("slot", slot).groupBy("slot").applyInPandasWithState(_decide, DECISIONS, "blob binary", "append", GroupStateTimeout.EventTimeTimeout)


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


class Deduplicator:
    """Runs the stream over a folder of parquet files until all that is there is read; a later run goes on from there.

    buckets: null for as many as the source's rows ask for. A home that has its number keeps it.
    """

    def __init__(self, spark: SparkSession, home: str | None = None, horizon: str = "7 days", files_per_batch: int | None = None, buckets: int | None = None):
        self.spark, self.home, self.horizon, self.files = spark, home or work_dir(spark, "dedup"), horizon, files_per_batch
        self.buckets = buckets

    def _rows(self, df: DataFrame, key: str, order: str, ts: str, received: str | None) -> DataFrame:
        when = F.coalesce(F.col(ts), F.col(received) if received else F.lit(None), F.lit(EARLY).cast("timestamp"))
        keyed = df.select(uuid_key(F.col(key)).alias("key"), F.col(order).cast("bigint").alias("id"), F.unix_millis(when.cast("timestamp")).alias("ts"))
        h, l = halves(F.col("key"))
        return keyed.filter("key is not null and id is not null").select(h.alias("h"), l.alias("l"), "id", "ts")

    def _number_of_buckets(self, source: DataFrame) -> int:
        """What the home has written, else the parameter, else by the rows of the source."""
        path = f"{self.home}/buckets"
        try:
            return self.spark.read.parquet(path).first()[0]
        except AnalysisException:
            n = self.buckets or max(FEWEST, 1 << (max(source.count(), 1) // PER_BUCKET).bit_length())
            self.spark.createDataFrame([(n,)], "buckets bigint").coalesce(1).write.parquet(path)
            return n

    def run(self, path: str, key: str = "event_id", order: str = "delivery_id", ts: str = "event_timestamp", received: str | None = "received_at", only_surplus: bool = False) -> DataFrame:
        """(id, surplus) of every delivery with an identifier, or of the surplus ones alone, which spares a shuffle."""
        spark = self.spark
        source = spark.read.parquet(path)
        buckets = self._number_of_buckets(source)
        reader = spark.readStream.schema(source.schema)
        if self.files:
            reader = reader.option("maxFilesPerTrigger", self.files)
        folder = path
        if not _is_folder(spark, path):  # a stream reads folders: a single file is picked by its name
            folder, _, name = path.rpartition("/")
            reader = reader.option("pathGlobFilter", name)
        stream = self._rows(reader.parquet(folder), key, order, ts, received)
        out = f"{self.home}/decisions"
        set_before = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled")}
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
        try:
            query = (
                decisions(stream, self.horizon, buckets)
                .writeStream.option("checkpointLocation", f"{self.home}/checkpoint")
                .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
        finally:
            for k, v in set_before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        return self.result(source, key, order, ts, received, only_surplus)

    def result(self, source: DataFrame, key: str, order: str, ts: str, received: str | None, only_surplus: bool = False) -> DataFrame:
        spark = self.spark
        try:
            said = spark.read.option("basePath", f"{self.home}/decisions").schema(DECISIONS).parquet(f"{self.home}/decisions/batch=*")
        except AnalysisException:  # no batch was run: the source has no rows
            said = spark.createDataFrame([], DECISIONS)
        firsts, expired = said.agg(F.count(F.when(F.col("kind") == FIRST, 1)), F.max(F.col("kind") == EXPIRED)).first()
        said = said.filter(F.col("kind") != EXPIRED)
        shut_out = source.filter(F.col(key).rlike(r"\S") & F.col(order).isNotNull()).count() != firsts
        words = said.select("id", "surplus")
        if expired or shut_out:
            late = self._rows(source, key, order, ts, received).select("h", "l", "id")
            late = late.join(said.select("id"), "id", "left_anti") if shut_out else late.filter("false")
            words = words.unionByName(settle(late, said))
        if only_surplus:
            return words.filter("surplus").distinct()
        return words.groupBy("id").agg(F.max("surplus").alias("surplus"))


def settle(late: DataFrame, said: DataFrame) -> DataFrame:
    """Words (id, surplus) on the late deliveries (h, l, id), and on those that were kept though an identifier was kept before:
    the identifiers are looked up among all that were kept. Surplus ones need no lookup."""
    kept = late.select("h", "l", "id").unionByName(said.filter("not surplus").select("h", "l", "id"))
    # the few that were kept twice; their rows are reduced before they meet
    twice = kept.groupBy("h", "l").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("h", "l", "least")
    again = kept.join(twice, ["h", "l"]).filter("id > least").select("id", F.lit(True).alias("surplus"))
    return again.unionByName(late.select("id", F.lit(False).alias("surplus")))
