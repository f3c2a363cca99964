import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexisift.llm import mixing as mx


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 500), st.integers(-(2**63), 2**63 - 1))
def test_permutation(n, key):
    got = mx.permuted(np.arange(n), np.full(n, n), np.full(n, key))
    assert sorted(got.tolist()) == list(range(n))


def frame(spark):
    rows = [(i, 5 + i % 40, "big") for i in range(600)] + [(1000 + i, 300, "mid") for i in range(60)] + [(2000 + i, 90, "small") for i in range(20)] + [(3000, 50, None), (3001, 0, "big"), (3002, 40, "other")]
    return spark.createDataFrame(rows, "doc_id long, tokens long, source string")


def test_blocks_cover_every_token_once(spark):
    docs = frame(spark).filter("source is not null")
    cut = mx.blocks(docs, 64)
    want = {r["doc_id"]: r["tokens"] for r in docs.filter("tokens > 0").collect()}
    assert {r["doc_id"]: r["n"] for r in cut.groupBy("doc_id").agg(F.sum("part").alias("n")).collect()} == want
    sizes = cut.groupBy("source", "block").agg(F.sum("part").alias("n")).collect()
    assert max(r["n"] for r in sizes) == 64 and sum(r["n"] < 64 for r in sizes) <= 4


def test_mix(spark):
    targets = spark.createDataFrame([("m", "big", 0.4, 3), ("m", "mid", 0.4, 2), ("m", "small", 0.2, 4), ("n", "big", 0.5, 2), ("n", "nowhere", 0.5, 2), ("m", "absent", 0.0, 2), (None, "big", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    chosen, shares, slots = mx.mix(frame(spark), targets, 16, 64)
    got = {(r["mix_name"], r["source"]): r for r in shares.collect()}
    assert set(got) == {("m", "big"), ("m", "mid"), ("m", "small"), ("m", "absent"), ("n", "big"), ("n", "nowhere")}
    for (m, _), r in got.items():
        assert r["most_repeats"] <= r["max_repeats"] and (m == "n" or abs(r["actual_share"] - r["target_share"]) < 0.01)
    assert got["n", "nowhere"]["tokens"] == 0 and got["n", "big"]["actual_share"] == 1
    assert chosen.filter("doc_id in (3000, 3001, 3002)").count() == 0
    # every slot of every shard once; no block more often than the cap
    rows = slots.collect()
    by = {}
    for r in rows:
        by.setdefault((r["mix_name"], r["out_shard"]), []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert all(len(by[m, k]) == 64 for m, k in by if (m, k + 1) in by)
    again = mx.mix(frame(spark), targets, 16, 64)[1]
    assert {(r["mix_name"], r["source"]): r["tokens"] for r in again.collect()} == {k: r["tokens"] for k, r in got.items()}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=5).filter(sum), st.integers(1, 50), st.integers(0, 9))
def test_shards_share_out_the_totals(counts, size, seed):
    s = mx.Shards("m", np.array(counts), size, seed)
    at = np.zeros(len(counts), np.int64)
    for k in range(s.number):
        first, n = s.of(k)
        assert (first == at).all() and n.sum() == min(size, sum(counts) - k * size)
        at += n
    assert at.tolist() == counts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 1), st.integers(1, 400)), min_size=1, max_size=6))
def test_quotas(parts):
    share = np.array([p[0] for p in parts])
    share /= share.sum()
    most = np.array([p[1] for p in parts])
    total = int((most / share).min())
    got = mx.quotas(total, share, most)
    assert (got <= most).all() and (abs(got - total * share) <= 1 + 1e-6).all() and got.sum() <= total


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, tokens long, source string")
    targets = spark.createDataFrame([("m", "big", 1.0, 3)], "mix_name string, source string, target_share double, max_repeats int")
    chosen, shares, slots = mx.mix(docs, targets)
    assert chosen.count() == 0 and slots.count() == 0 and [r["tokens"] for r in shares.collect()] == [0]
