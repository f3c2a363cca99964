"""Mixing sources to target weights.

Each source's texts, in a pseudorandom order, are one stream of tokens cut into blocks of fixed length. A mix has as many slots
as its scarcest source allows; each source's slots are its share of them, to the next block. Output shards draw how many of
their slots go to each source from a multinomial law, given those totals: the slots are halved again and again, each half
drawing its counts without replacement, so every shard finds its counts and where they begin by itself, from the seed alone.
A source's slots are numbered through all shards and mapped to its blocks by a keyed permutation, a new one for each pass over
the source, so no block comes again before all have come, nor more often than the mix allows. Slots and blocks meet by number.

Texts of sources without a target, null sources and null or empty texts take no part; a target whose source has no text is
reported with nothing. Repeated rows of one id are one text. A text longer than a block lies in several. The last block of a
source is shorter than the others.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexisift.session import written

#: Tokens of a block; of sources too small for LEAST_BLOCKS of them, blocks are shorter.
BLOCK, LEAST_BLOCKS = 1024, 256
#: Slots of an output shard.
SLOTS = 4096
#: Texts that one task numbers, on average.
RUN = 100_000


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed bijection of 0..size-1: a Feistel network over the next even power of two, walked until inside."""
    index, size, key = index.astype(np.uint64), size.astype(np.uint64), key.astype(np.uint64)
    if not len(index):
        return index.astype(np.int64)
    half = (np.maximum(np.ceil(np.log2(np.maximum(size.astype(float), 2))), 2).astype(np.uint64) + np.uint64(1)) // np.uint64(2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.copy()
    todo = np.ones(len(out), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            h, m, k = half[todo], mask[todo], key[todo]
            left, right = out[todo] >> h, out[todo] & m
            for turn in range(4):
                x = (right + np.uint64(turn + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) ^ k
                x ^= x >> np.uint64(29)
                x *= np.uint64(0x94D049BB133111EB)
                x ^= x >> np.uint64(32)
                left, right = right, left ^ (x & m)
            out[todo] = (left << h) | right
            todo = out >= size
    return out.astype(np.int64)


def blocks(docs: DataFrame, length: int = BLOCK, seed: int = 0) -> DataFrame:
    """docs (doc_id, tokens, source) -> (source, block, doc_id, part): the tokens of a text that lie in a block.

    The places are prefix sums in two levels: a source's texts are spread over runs, so none passes through one task.
    """
    rows = docs.filter("tokens > 0 and source is not null").select("doc_id", "tokens", "source", F.xxhash64("doc_id", F.lit(seed)).alias("h"))
    runs = rows.count() // RUN + 1
    rows = rows.withColumn("run", F.pmod("h", F.lit(runs)))
    placed = rows.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source", "run").orderBy("h", "doc_id")))
    totals = rows.groupBy("source", "run").agg(F.sum("tokens").alias("total"))
    before = totals.withColumn("base", F.sum("total").over(Window.partitionBy("source").orderBy("run")) - F.col("total")).select("source", "run", "base")
    at = placed.join(before, ["source", "run"]).select("source", "doc_id", (F.col("base") + F.col("upto") - F.col("tokens")).alias("a"), (F.col("base") + F.col("upto")).alias("b"))
    size = F.lit(length).cast("long")
    cut = at.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / size), F.floor((F.col("b") - 1) / size))))
    return cut.select("source", "block", "doc_id", (F.least("b", (F.col("block") + 1) * size) - F.greatest("a", F.col("block") * size)).alias("part"))


def quotas(total: int, shares: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Slots of each source: its share of total, rounded by the largest remainders, within most."""
    exact = total * shares
    out = np.minimum(np.floor(exact + 1e-9).astype(np.int64), most)
    for k in np.argsort(out - exact, kind="stable"):
        if out.sum() >= total:
            break
        if out[k] < most[k]:
            out[k] += 1
    return out


#: numpy draws without replacement from fewer than this; larger halves take their shares, rounded.
DRAWN = 1_000_000_000


class Shards:
    """The counts of every shard of a mix, each found by itself."""

    def __init__(self, name: str, counts: np.ndarray, per_shard: int, seed: int):
        self.name, self.counts, self.size, self.seed = zlib.crc32(name.encode()), counts, per_shard, seed
        self.total = int(counts.sum())
        self.number = -(-self.total // per_shard)
        self._left = lru_cache(4096)(self._draw)

    def _draw(self, lo: int, hi: int, counts: tuple) -> tuple:
        """Of the slots of shards lo..hi, with so many of each source, those that go to the first half."""
        wanted = min((lo + hi) // 2 * self.size, self.total) - lo * self.size
        all_ = np.array(counts, np.int64)
        if all_.sum() >= DRAWN:
            return tuple(quotas(wanted, all_ / all_.sum(), all_).tolist())
        return tuple(np.random.default_rng([self.seed, self.name, lo, hi]).multivariate_hypergeometric(all_, wanted, method="marginals").tolist())

    def of(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, n) of each source: where the shard's slots of it begin, and how many they are."""
        lo, hi, counts, first = 0, self.number, self.counts.copy(), np.zeros(len(self.counts), np.int64)
        while hi - lo > 1:
            left = np.array(self._left(lo, hi, tuple(counts.tolist())), np.int64)
            if shard < (lo + hi) // 2:
                hi, counts = (lo + hi) // 2, left
            else:
                first += left
                lo, counts = (lo + hi) // 2, counts - left
        return first, counts


def slots(sizes: DataFrame, targets: DataFrame, per_shard: int = SLOTS, seed: int = 0) -> DataFrame:
    """sizes (source, n_blocks) and targets -> (mix_name, out_shard, slot, source, block): every slot of every shard of every
    mix. slot is the place in the shard; a shard's slots are ordered by source."""
    t = targets.select("mix_name", "source", "target_share", "max_repeats").filter("mix_name is not null and source is not null and target_share > 0 and max_repeats > 0")
    t = t.groupBy("mix_name", "source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("max_repeats"))
    met = t.join(sizes, "source").select("mix_name", F.struct("source", "share", "n_blocks", (F.col("n_blocks") * F.col("max_repeats")).alias("most")).alias("s"))
    # a mix's sources in one row: no more than the targets name
    mixes = met.groupBy("mix_name").agg(F.sort_array(F.collect_list("s")).alias("s"), F.sum("s.share").alias("sum"))
    mixes = mixes.withColumn("total", F.array_min(F.transform("s", lambda x: F.floor(x["most"] * F.col("sum") / x["share"] + 1e-9))))
    shards = mixes.filter("total > 0").withColumn("out_shard", F.explode(F.expr(f"sequence(0L, (total - 1) div {per_shard})")))

    def draw(batches):
        known: dict = {}
        for df in batches:
            rows = []
            for r in df.itertuples():
                if r.mix_name not in known:
                    share = np.array([x["share"] for x in r.s], float)
                    counts = quotas(int(r.total), share / share.sum(), np.array([x["most"] for x in r.s], np.int64))
                    known[r.mix_name] = Shards(r.mix_name, counts, per_shard, seed)
                first, n = known[r.mix_name].of(int(r.out_shard))
                place = np.cumsum(n) - n
                rows += [(r.mix_name, int(r.out_shard), int(p), x["source"], int(a), int(k), int(x["n_blocks"])) for x, a, k, p in zip(r.s, first, n, place) if k]
            yield pd.DataFrame(rows, columns=["mix_name", "out_shard", "place", "source", "first", "n", "n_blocks"])

    counts = shards.select("mix_name", "s", "total", "out_shard").mapInPandas(draw, "mix_name string, out_shard long, place long, source string, first long, n long, n_blocks long")
    each = counts.repartition("mix_name", "out_shard").withColumn("k", F.explode(F.expr("sequence(0L, n - 1)")))

    def permute(index: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permuted(index.to_numpy() % n.to_numpy(), n.to_numpy(), key.to_numpy()))

    index = F.col("first") + F.col("k")
    turn = F.xxhash64("mix_name", "source", F.floor(index / F.col("n_blocks")), F.lit(seed))
    return each.select("mix_name", "out_shard", (F.col("place") + F.col("k")).alias("slot"), "source", F.pandas_udf(permute, "bigint")(index, "n_blocks", turn).alias("block"))


def block_length(docs: DataFrame, targets: DataFrame) -> int:
    """BLOCK, or as much less as the smallest source of a target asks for."""
    of = docs.filter("tokens > 0").join(targets.select("source").distinct(), "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("n"))
    least = of.agg(F.min("n")).first()[0]
    return max(1, min(BLOCK, (least or 0) // LEAST_BLOCKS))


def mix(docs: DataFrame, targets: DataFrame, length: int | None = None, per_shard: int = SLOTS, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chosen, shares, slots): texts with their repeats and tokens per mix; target and actual share of each target; and which
    block fills each slot of each output shard. Null length: by ``block_length``."""
    cut = written(blocks(docs, length or block_length(docs, targets), seed), "blocks")
    sizes = cut.groupBy("source").agg((F.max("block") + 1).alias("n_blocks"))
    filled = slots(sizes, targets, per_shard, seed)
    uses = filled.groupBy("mix_name", "source", "block").agg(F.count("*").alias("uses"))
    # a block is used at most max_repeats times: the join has a row per block's text, not per slot
    met = uses.join(cut, ["source", "block"])
    chosen = met.groupBy("mix_name", "source", "doc_id").agg(F.max("uses").alias("repeats"), F.sum(F.col("uses") * F.col("part")).alias("tokens"))
    by_source = chosen.groupBy("mix_name", "source").agg(F.sum("tokens").alias("tokens"), F.max("repeats").alias("most_repeats"), F.count("*").alias("n_docs"))
    wanted = targets.select("mix_name", "source", "target_share", "max_repeats").filter("mix_name is not null and source is not null").distinct()
    joined = wanted.join(by_source, ["mix_name", "source"], "left").fillna(0, ["tokens", "most_repeats", "n_docs"])
    share = F.round(F.coalesce(F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy("mix_name"))), F.lit(0.0)), 6)
    return chosen, joined.withColumn("actual_share", share), filled
