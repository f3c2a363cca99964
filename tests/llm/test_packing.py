import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lexisift.llm import packing as pk


def brute(sizes, clusters, sources, capacity, conflicts):
    """Best fit by looking at every bin."""
    bins, out = [], [-1] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        ok = [b for b in range(len(bins)) if bins[b][0] >= sizes[k] and clusters[k] not in bins[b][1] and not bins[b][2] & conflicts.get(sources[k], set())]
        if ok:
            b = min(ok, key=lambda b: (bins[b][0], b))
        else:
            bins.append([capacity, set(), set()])
            b = len(bins) - 1
        bins[b][0] -= sizes[k]
        if clusters[k] >= 0:
            bins[b][1].add(clusters[k])
        bins[b][2].add(sources[k])
        out[k] = b
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(-1, 4), st.integers(0, 3)), max_size=40))
def test_best_fit_is_the_brute_one(items):
    sizes, clusters, sources = ([x[k] for x in items] for k in range(3))
    got = pk.best_fit(sizes, clusters, sources, 20, {0: 0b10, 1: 0b01})
    assert got == brute(sizes, clusters, sources, 20, {0: {1}, 1: {0}})


def test_pack(spark):
    r = random.Random(4)
    rows = [(i, r.randrange(0, 300), r.choice(["a", "b", None]), i % 50 if i < 100 else 1000 + i) for i in range(400)] + [(1000, 2500, "a", 9999), (0, 17, "a", 0)]
    docs = spark.createDataFrame(rows[:-1] + [rows[0]], "doc_id long, tokens long, source string, cluster long").dropDuplicates(["doc_id"])
    packs = spark.createDataFrame([("small", 300), ("big", 1000), ("none", 0), (None, 5)], "pack_name string, capacity_tokens int")
    got = pk.pack(docs, packs, shard_items=120).collect()
    total = sum(t for _, t, *_ in rows[:-1])
    for name, capacity in (("small", 300), ("big", 1000)):
        own = [g for g in got if g["pack_name"] == name]
        assert sum(g["tokens"] for g in own) == total
        fill, seen = {}, set()
        for g in own:
            fill[g["bin"]] = fill.get(g["bin"], 0) + g["tokens"]
            assert (g["bin"], g["cluster"]) not in seen
            seen.add((g["bin"], g["cluster"]))
        assert max(fill.values()) <= capacity and total / (len(fill) * capacity) > 0.9
        assert {g["doc_id"] for g in own if g["piece"] > 0} == {1000}
    assert {g["pack_name"] for g in got} == {"small", "big"}
    assert {r["pack_name"]: r["n_tokens"] for r in pk.report(pk.pack(docs, packs, shard_items=120)).collect()} == {"small": total, "big": total}


def test_conflicting_sources_and_hot_cluster(spark):
    docs = spark.createDataFrame([(i, 10, "ab"[i % 2], 7 if i < 30 else i) for i in range(90)], "doc_id long, tokens long, source string, cluster long")
    packs = spark.createDataFrame([("p", 100)], "pack_name string, capacity_tokens int")
    got = pk.pack(docs, packs, [("a", "b")]).collect()
    by = {}
    for g in got:
        by.setdefault(g["bin"], []).append(g)
    assert len(got) == 90 and all(len({g["source"] for g in b}) == 1 and sum(g["cluster"] == 7 for g in b) <= 1 for b in by.values())


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, tokens long, source string, cluster long")
    packs = spark.createDataFrame([("p", 100)], "pack_name string, capacity_tokens int")
    assert pk.pack(docs, packs).count() == 0
