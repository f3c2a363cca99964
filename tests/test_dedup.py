import random
import uuid

from pyspark.sql import functions as F

from lexisift.streaming.dedup import DECISIONS, Deduplicator, settle, uuid_key

SCHEMA = "delivery_id long, event_id string, event_timestamp timestamp, received_at timestamp"


def test_keys(spark):
    u = "10d355dc-8a77-46e6-bbea-d8706b3673ed"
    forms = [u, u.upper(), "{" + u + "}", "urn:uuid:" + u, u.replace("-", ""), f" {u}\n", None, "", "  ", "x-1"]
    got = [r[0] for r in spark.createDataFrame([(f,) for f in forms], "e string").select(uuid_key(F.col("e"))).collect()]
    assert len(set(got[:6])) == 1 and got[6:9] == [None, None, None] and got[9] == "=x-1"


def rows(n, seed=1):
    r = random.Random(seed)
    ids = [str(uuid.UUID(int=r.getrandbits(128))) for _ in range(n // 3)]
    hot = ids[0]
    out = []
    for i in range(n):
        e = hot if r.random() < 0.3 else r.choice([*ids, None, ""])
        if e and r.random() < 0.2:
            e = e.upper()
        out.append((i, e, f"2025-01-01 00:{r.randrange(60):02}:00", "2025-01-02 00:00:00"))
    return out


def expected(data):
    seen, surplus = {}, set()
    for i, e, *_ in sorted(data):
        if e:
            if e.lower() in seen:
                surplus.add(i)
            seen.setdefault(e.lower(), i)
    return surplus


def frame(spark, data):
    return spark.createDataFrame(data, "delivery_id long, event_id string, a string, b string").select("delivery_id", "event_id", F.col("a").cast("timestamp").alias("event_timestamp"), F.col("b").cast("timestamp").alias("received_at"))


def test_one_batch(spark, tmp_path):
    data = rows(400)
    frame(spark, data).write.parquet(str(tmp_path / "in"))
    got = Deduplicator(spark, str(tmp_path / "home"), buckets=8).run(str(tmp_path / "in"))
    assert {r["id"] for r in got.filter("surplus").collect()} == expected(data)


def test_batches_out_of_order_and_resumed(spark, tmp_path):
    data = rows(300, 2)
    path = str(tmp_path / "in")
    for part in (data[200:], data[:100]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(path)
    home = str(tmp_path / "home")
    Deduplicator(spark, home, files_per_batch=1, buckets=4).run(path)
    frame(spark, data[100:200]).coalesce(1).write.mode("append").parquet(path)
    got = Deduplicator(spark, home, files_per_batch=1, buckets=4).run(path)
    assert {r["id"] for r in got.filter("surplus").collect()} == expected(data)


def test_late_deliveries_are_looked_up(spark, tmp_path):
    a, b = (str(uuid.UUID(int=k)) for k in (1, 2))
    path = str(tmp_path / "in")
    late = "2025-01-01 00:00:00"
    for part in ([(5, a, late, late)], [(6, b, "2025-06-01 00:00:00", late)], [(7, a, late, late), (3, a, late, late), (8, str(uuid.UUID(int=3)), late, late)]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(path)
    d = Deduplicator(spark, str(tmp_path / "home"), "1 day", files_per_batch=1, buckets=2)
    got = d.run(path)
    assert {r["id"] for r in got.filter("surplus").collect()} == {5, 7}
    assert {r["id"] for r in got.collect()} == {3, 5, 6, 7, 8}


def test_empty_and_clashing_columns(spark, tmp_path):
    path = str(tmp_path / "in")
    frame(spark, []).withColumn("slot", F.lit(1)).withColumn("surplus", F.lit("x")).withColumn("key", F.lit(2)).write.parquet(path)
    assert Deduplicator(spark, str(tmp_path / "home")).run(path).count() == 0


def test_settle(spark):
    said = spark.createDataFrame([(1, 1, 10, False, 0), (2, 2, 11, False, 0), (1, 1, 12, True, 0)], DECISIONS)
    late = spark.createDataFrame([(1, 1, 5)], "h long, l long, id long")
    got = said.select("id", "surplus").unionByName(settle(late, said)).groupBy("id").agg(F.max("surplus").alias("s")).collect()
    assert {r["id"]: r["s"] for r in got} == {5: False, 10: True, 11: False, 12: True}


def test_identifier_delivered_again_after_it_expired(spark, tmp_path):
    a, b, c = (str(uuid.UUID(int=k)) for k in (1, 2, 3))
    path = str(tmp_path / "in")
    day = lambda n: f"2025-0{1 + n // 28}-{1 + n % 28:02} 00:00:00"
    for n, (i, e, at, got) in enumerate([(1, a, day(0), day(0)), (2, b, day(30), day(30)), (3, c, day(31), day(31)), (4, a, None, day(32)), (5, a, day(33), day(33))]):
        frame(spark, [(i, e, at, got)]).coalesce(1).write.mode("append").parquet(path)
    d = Deduplicator(spark, str(tmp_path / "home"), "7 days", files_per_batch=1, buckets=1)
    assert {r["id"]: r["surplus"] for r in d.run(path).collect()} == {1: False, 2: False, 3: False, 4: True, 5: True}
    # a second object on the same home knows no progress of the first, and needs none
    again = Deduplicator(spark, str(tmp_path / "home"), "7 days")
    assert {r["id"] for r in again.run(path, only_surplus=True).collect()} == {4, 5}


def test_drops_older_than_the_kept_progress(spark, tmp_path):
    """Shut-out deliveries count though the query forgets its early batches (here all but the last)."""
    a = str(uuid.UUID(int=1))
    path = str(tmp_path / "in")
    late, now = "2025-01-01 00:00:00", "2025-06-01 00:00:00"
    data = [(2, a, late, late), (3, str(uuid.UUID(int=2)), now, now), (4, str(uuid.UUID(int=3)), now, now), (1, a, late, late), *((10 + k, str(uuid.UUID(int=10 + k)), now, now) for k in range(3))]
    for row in data:
        frame(spark, [row]).coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1")
    try:
        got = Deduplicator(spark, str(tmp_path / "home"), "1 day", files_per_batch=1, buckets=2).run(path)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert {r["id"]: r["surplus"] for r in got.collect()} == {1: False, 2: True, 3: False, 4: False, 10: False, 11: False, 12: False}
