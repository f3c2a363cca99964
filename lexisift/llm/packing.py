"""Filling containers of fixed capacity with texts of varying length.

Texts are spread over shards by hash, enough of them that a shard's bins fit one task; each shard is packed by best fit in
order of falling size. Bins are kept by residual; the search begins at the tightest residual that holds the item and goes on
to the successor while the bin conflicts: it already holds a text of the same duplicate cluster, or a source that may not
meet the item's. Both are bitmaps of the bin. Bins left less than NEARLY full are packed again, over few shards.

A text longer than the capacity is cut into pieces of the capacity and a rest; no other text is split. Null and empty texts
take no space and get no container. Repeated rows of one id are one item. A null source is a source of its own.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.session import written

#: Items of a shard, on average.
SHARD_ITEMS = 20_000
#: Bins less full than this go through the second round.
NEARLY = 0.97
PLACED = "pack_name string, capacity int, shard long, bin long, doc_id long, piece int, tokens long, source string, cluster long"


def best_fit(sizes: list[int], clusters: list[int], sources: list[int], capacity: int, conflicts: dict[int, int]) -> list[int]:
    """Bin of each item. clusters and sources are small numbers, -1 for none; conflicts: source -> bits of sources it avoids."""
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    out = [-1] * len(sizes)
    bins: list[tuple[int, int]] = []  # residual, bin
    held_clusters: list[int] = []
    held_sources: list[int] = []
    for k in order:
        size = sizes[k]
        c = 1 << clusters[k] if clusters[k] >= 0 else 0
        s = 1 << sources[k] if sources[k] >= 0 else 0
        avoid = conflicts.get(sources[k], 0)
        at = bisect_left(bins, (size, -1))
        while at < len(bins) and (held_clusters[bins[at][1]] & c or held_sources[bins[at][1]] & avoid):
            at += 1
        if at < len(bins):
            residual, b = bins.pop(at)
        else:
            residual, b = capacity, len(held_clusters)
            held_clusters.append(0)
            held_sources.append(0)
        out[k] = b
        held_clusters[b] |= c
        held_sources[b] |= s
        if residual > size:
            insort(bins, (residual - size, b))
    return out


def _pack(conflicts: list[tuple[str, str]]):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        counts = pdf["cluster"].value_counts()
        bit = {c: i for i, c in enumerate(counts.index[counts > 1])}
        names = {s: i for i, s in enumerate(sorted(set(pdf["source"].dropna())))}
        masks: dict[int, int] = {}
        for a, b in conflicts:
            for x, y in ((a, b), (b, a)):
                if x in names and y in names:
                    masks[names[x]] = masks.get(names[x], 0) | 1 << names[y]
        placed = best_fit(pdf["tokens"].tolist(), [bit.get(c, -1) for c in pdf["cluster"]], [names.get(s, -1) for s in pdf["source"]], int(pdf["capacity"].iloc[0]), masks)
        return pdf.assign(bin=placed)[[c.split()[0] for c in PLACED.split(", ")]]

    return run


def pieces(docs: DataFrame, packs: DataFrame) -> DataFrame:
    """One row per item and pack; only what exceeds a capacity is cut. The packs are settings: their rows become an expression."""
    settings = packs.select("pack_name", F.col("capacity_tokens").cast("int").alias("capacity")).filter("capacity > 0 and pack_name is not null").distinct().collect()
    kind = "array<struct<pack_name:string,capacity:int>>"
    each = F.array(*[F.struct(F.lit(r[0]).alias("pack_name"), F.lit(r[1]).alias("capacity")) for r in sorted(settings)]).cast(kind) if settings else F.array().cast(kind)
    both = docs.filter("tokens > 0").select("doc_id", "tokens", "source", "cluster", F.explode(each).alias("_p")).select("doc_id", "tokens", "source", "cluster", "_p.*")
    n = F.ceil(F.col("tokens") / F.col("capacity")).cast("int")
    cut = both.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    return cut.withColumn("tokens", F.least(F.col("capacity").cast("long"), F.col("tokens") - F.col("piece") * F.col("capacity").cast("long")))


def _sharded(items: DataFrame, shard_items: int, salt: int) -> DataFrame:
    """items with a shard by hash, so many per pack that each has about shard_items."""
    n = {r["pack_name"]: -(-r["count"] // shard_items) for r in items.groupBy("pack_name").count().collect()}
    shards = F.lit(1)
    for name, k in n.items():
        shards = F.when(F.col("pack_name") == name, k).otherwise(shards)
    return items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(salt)), shards).cast("long"))


def pack(docs: DataFrame, packs: DataFrame, conflicts: list[tuple[str, str]] = (), shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(pack_name, capacity, bin, doc_id, piece, tokens, source, cluster): bin names the container."""
    run = _pack(list(conflicts))
    columns = [c.split()[0] for c in PLACED.split(", ")]
    first = written(_sharded(pieces(docs, packs), shard_items, 0).groupBy("pack_name", "shard").applyInPandas(run, PLACED), "pack")
    filled = first.groupBy("pack_name", "shard", "bin").agg(F.sum("tokens").alias("filled"))
    marked = first.join(filled, ["pack_name", "shard", "bin"]).withColumn("open", F.col("filled") < NEARLY * F.col("capacity"))
    # open bins are the few at the end of each shard; should conflicts leave many, their items get as many shards as they need
    again = _sharded(marked.filter("open").drop("shard", "bin", "filled", "open"), shard_items, 7).withColumn("shard", -1 - F.col("shard"))
    second = again.groupBy("pack_name", "shard").applyInPandas(run, PLACED)
    everything = marked.filter("not open").select(*columns).unionByName(second)
    return everything.withColumn("bin", F.concat_ws("-", "shard", "bin")).drop("shard")


def _bins(placed: DataFrame, conflicts: list[tuple[str, str]] = ()) -> DataFrame:
    own = F.collect_set("source")
    met = F.lit(0)
    for a, b in conflicts:
        met = met + F.when(F.array_contains(own, a) & F.array_contains(own, b), 1).otherwise(0)
    return placed.groupBy("pack_name", "capacity", "bin").agg(
        F.sum("tokens").alias("filled"), F.count("*").alias("items"), F.countDistinct("cluster", "piece").alias("kinds"), F.countDistinct("source").alias("sources"), met.alias("conflicts")
    )


def report(placed: DataFrame, conflicts: list[tuple[str, str]] = ()) -> DataFrame:
    """Per pack: containers, the fewest that could do, share of space used, texts that had to be split, containers with two
    texts of one duplicate class or with sources that conflict (none)."""
    texts = placed.groupBy("pack_name", "doc_id").agg(F.count("*").alias("n")).groupBy("pack_name").agg(F.count("*").alias("n_docs"), F.sum((F.col("n") > 1).cast("long")).alias("n_split"))
    bins = _bins(placed, conflicts).groupBy("pack_name", "capacity").agg(
        F.count("*").alias("n_containers"),
        F.ceil(F.sum("filled") / F.first("capacity")).alias("least_containers"),
        F.sum("items").alias("n_items"),
        F.sum("filled").alias("n_tokens"),
        F.round(F.sum("filled") / (F.count("*") * F.first("capacity")), 6).alias("used_share"),
        F.max("filled").alias("fullest"),
        F.round(F.avg("sources"), 3).alias("mean_sources"),
        F.sum((F.col("items") > F.col("kinds")).cast("long")).alias("n_with_copies"),
        F.sum((F.col("conflicts") > 0).cast("long")).alias("n_with_conflicts"),
    )
    return bins.join(texts, "pack_name")


def checks(placed: DataFrame, docs: DataFrame, conflicts: list[tuple[str, str]] = ()) -> DataFrame:
    """Per pack the counts of what must not be: containers beyond the capacity, with copies or with sources that conflict, texts
    split though they fit, texts not whole; and the texts placed."""
    bins = _bins(placed, conflicts).groupBy("pack_name", "capacity").agg(
        F.sum((F.col("filled") > F.col("capacity")).cast("long")).alias("n_overfull"), F.sum((F.col("items") > F.col("kinds")).cast("long")).alias("n_with_copies"), F.sum("conflicts").cast("long").alias("n_conflicts")
    )
    whole = placed.groupBy("pack_name", "capacity", "doc_id").agg(F.sum("tokens").alias("placed"), F.count("*").alias("n")).join(docs.select("doc_id", F.col("tokens").alias("own")), "doc_id")
    texts = whole.groupBy("pack_name").agg(F.count("*").alias("n_docs"), F.sum(((F.col("n") > 1) & (F.col("own") <= F.col("capacity"))).cast("long")).alias("n_split_in_vain"), F.sum((F.col("placed") != F.col("own")).cast("long")).alias("n_not_whole"))
    return bins.join(texts, "pack_name")
