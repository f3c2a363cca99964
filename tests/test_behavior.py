from pyspark.sql import functions as F

from lexisift.operators import sessions
from lexisift.operators.rules import Pattern, Rule, evaluate
from lexisift.streaming.behavior import session_scores

RULES = [Rule("I-01", "bad", "P0", "warn", (Pattern("keyword", "bad", 0.9),)), Rule("I-02", "odd", "P2", "warn", (Pattern("keyword", "odd", 0.9),))]
SCHEMA = "s string, m string, at timestamp, t string"


def write(spark, rows, path):
    spark.createDataFrame(rows, "s string, m string, at string, t string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, tmp, name, **kw):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    q = session_scores(stream, RULES, "s", "m", "at", "t", **kw).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return {r["message_id"]: (r["history_count"], r["score_before"], r["score"], r["is_polluted"]) for r in spark.table(name).collect()}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"s{k % 3}", f"m{k:02}", f"2025-01-01 00:{k:02}:00", ("bad", "odd", "fine")[k % 5 % 3]) for k in range(30)] + [(None, "x", "2025-01-01 00:00:00", "bad")]
    path = str(tmp_path / "in")
    for part in (rows[:12], rows[12:]):
        write(spark, part, path)
    got = run(spark, path, tmp_path, "scores")
    df = spark.read.parquet(path).filter("s is not null")
    want = sessions.track(evaluate(df, RULES, "t"), "s", ["at", "m"], [])
    assert got == {r["m"]: (r["history_count"], r["score_before"], r["score"], r["is_polluted"]) for r in want.collect()}


def test_idle_sessions_begin_anew(spark, tmp_path):
    path = str(tmp_path / "in")
    for rows in ([("a", "1", "2025-01-01 00:00:00", "bad")], [("b", "2", "2025-01-09 00:00:00", "fine")], [("b", "3", "2025-01-10 00:00:00", "fine")], [("a", "4", "2025-01-10 00:00:00", "odd")]):
        write(spark, rows, path)
    got = run(spark, path, tmp_path, "idle", watermark="1 day", idle_hours=24)
    assert got["1"][2] == 20 and got["4"] == (1, 0, 5, False)
