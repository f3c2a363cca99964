"""Statistics of each document's text, and which documents are not running prose.

The statistics are computed in the JVM. A language's prose has a mean and a covariance, estimated robustly: from the half of
the documents nearest to the medians, then by concentration steps, then from all documents within the cutoff. The squared
Mahalanobis distance tells how far a document lies from the prose of its language; each statistic's share of it is kept.

Null and blank texts have no statistics. Languages are told by their common words; texts without any tell nothing of
prose and are measured against all languages' prose. Texts are taken whole; repeated documents count as often as they occur.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.session import written

#: The statistics of the distance, and the least standard deviation that each is granted (its resolution).
STATS = {
    "log_words": 0.8,
    "mean_word_length": 0.6,
    "symbol_ratio": 0.02,
    "digit_ratio": 0.03,
    "upper_ratio": 0.04,
    "punctuated_lines": 0.25,
    "common_share": 0.06,
    "distinct_share": 0.08,
    "log_words_per_line": 0.6,
    "prose_share": 0.08,
    "marked_lines": 0.12,
}
#: 0.999 quantile of chi-square with as many degrees of freedom as statistics (11), and its median.
CUTOFF, MEDIAN = 31.264, 10.341
#: Common words per table beyond which they aren't sent to every executor as an expression.
MAX_COMMON_WORDS = 10_000

_WORD = r"[\p{L}]+"
_SYMBOL = r"[(){}<>=/\\|_*#@&%$^~`+\[\]│•>«»\"]"
_MARK = r"^\s*(?:[-*•–▪◦·+>]|\(?[0-9ivxIVX]{1,4}[.)]|\(?[a-zA-Z][.)]|\[[ xX]\]|[|│<{}#\[])"
_ENDED = r"[.!?:…][\"”»’')]*\s*$"
#: A long line that doesn't end a sentence goes on in the next one.
_WRAP = r"(?m)^([^\r\n]{48,}[^\r\n.!?:;…|│>}{,\]])\r?\n(?=[\p{L}(«\"“])"


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def _among(words: list[str]):
    return lambda x: x.isin(words)


def statistics(docs: DataFrame, common: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counts and STATS, language by common words) of each document with text."""
    words = [(r["lang"], r["word"].lower()) for r in common.select("lang", "word").filter("lang is not null and word is not null").distinct().limit(MAX_COMMON_WORDS + 1).collect()]
    if len(words) > MAX_COMMON_WORDS:
        raise ValueError(f"more than {MAX_COMMON_WORDS} common words")
    langs = sorted({lang for lang, _ in words})
    union = sorted({w for _, w in words})
    t = F.col("t")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("t")).filter("key is not null").filter(t.rlike(r"\S"))
    rows = rows.withColumn("joined", F.regexp_replace("t", _WRAP, "$1 "))
    whole = F.filter(F.split("joined", r"\r?\n"), lambda x: x.rlike(r"\S"))
    # what several statistics need of a line is made once: its words, the common ones, how it begins and ends
    rows = rows.withColumn("lines", F.transform(whole, lambda x: F.struct(x.alias("x"), F.regexp_extract_all(F.lower(x), F.lit(_WORD), F.lit(0)).alias("w"), x.rlike(_ENDED).alias("ended"), x.rlike(_MARK).alias("marked"))))
    among = _among(union) if union else lambda x: F.lit(False)
    rows = rows.withColumn("lines", F.transform("lines", lambda r: F.struct(r["x"].alias("x"), r["w"].alias("w"), r["ended"].alias("ended"), r["marked"].alias("marked"), F.filter(r["w"], among).alias("c"))))
    rows = rows.withColumn("words", F.flatten(F.transform("lines", lambda r: r["w"]))).withColumn("known", F.flatten(F.transform("lines", lambda r: r["c"])))
    own = {lang: [w for g, w in words if g == lang] for lang in langs}
    hits = [F.size(F.filter("known", _among(own[lang]))).alias(f"n_{lang}") for lang in langs]

    def prose(line: Column) -> Column:
        """Whether a line reads as a sentence or more."""
        x, w, ended = line["x"], line["w"], line["ended"]
        n = F.size(w)
        share = F.size(line["c"]) / F.greatest(n, F.lit(1))
        return (
            (n >= 4) & (share >= 0.12) & (share <= 0.8) & (ended | (F.length(x) >= 45)) & (~line["marked"] | ((n >= 8) & ended))
            & ((F.size(F.array_distinct(w)) >= 0.4 * n) | (n >= 60))
            & (_count(x, _SYMBOL) <= 0.06 * F.length(x)) & (_count(x, r"\d") <= 0.12 * F.length(x)) & ~x.rlike(r"\.{4,}|\s{4,}\S+\s{4,}")
        )

    n_lines, n_words = F.size("lines"), F.size("words")
    chars = F.length("joined")
    line_chars = F.aggregate("lines", F.lit(0), lambda a, r: a + F.length(r["x"]))
    prose_chars = F.aggregate("lines", F.lit(0), lambda a, r: a + F.when(prose(r), F.length(r["x"])).otherwise(0))
    letters = F.length(F.regexp_replace("joined", r"[^\p{L}]", ""))
    best = F.array_max(F.array(*[F.struct(F.col(f"n_{lang}").alias("n"), F.lit(lang).alias("lang")) for lang in langs])) if langs else F.struct(F.lit(0).alias("n"), F.lit("").alias("lang"))
    counted = rows.select("key", "joined", "lines", "words", *hits)
    out = counted.select(
        "key",
        n_words.alias("n_words"),
        n_lines.alias("n_lines"),
        chars.alias("n_chars"),
        best.alias("best"),
        F.log(1 + n_words).alias("log_words"),
        (letters / F.greatest(n_words, F.lit(1))).alias("mean_word_length"),
        (_count(F.col("joined"), r"[^\p{L}\p{N}\s.,;:!?'’…()-]") / chars).alias("symbol_ratio"),
        (_count(F.col("joined"), r"\d") / chars).alias("digit_ratio"),
        (_count(F.col("joined"), r"\p{Lu}") / F.greatest(letters, F.lit(1))).alias("upper_ratio"),
        (F.size(F.filter("lines", lambda r: r["ended"])) / n_lines).alias("punctuated_lines"),
        (F.log(1 + F.size(F.array_distinct("words"))) / F.greatest(F.log(1 + n_words), F.lit(0.5))).alias("distinct_share"),
        F.log(1 + n_words / n_lines).alias("log_words_per_line"),
        (prose_chars / F.greatest(line_chars, F.lit(1))).alias("prose_share"),
        (F.size(F.filter("lines", lambda r: r["marked"])) / n_lines).alias("marked_lines"),
    )
    return out.select("*", F.when(F.col("best.n") > 0, F.col("best.lang")).otherwise("").alias("language"), (F.col("best.n") / F.greatest("n_words", F.lit(1))).alias("common_share")).drop("best")


def _vector() -> Column:
    return F.array(*[F.col(s).cast("double") for s in STATS])


def _moments(df: DataFrame) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """Per language the number of documents, their mean and covariance: sums that partitions add up before they meet."""
    names = list(STATS)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    got = df.filter("language <> ''").groupBy("language").agg(F.count("*").alias("n"), *[F.sum(s).alias(s) for s in names], *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs]).collect()
    out = {}
    total_n, total_m, total_p = 0, np.zeros(len(names)), np.zeros((len(names),) * 2)
    for r in got:
        m = np.array([r[s] for s in names], float)
        p = np.zeros((len(names),) * 2)
        for i, j in pairs:
            p[i, j] = p[j, i] = r[f"p{i}_{j}"]
        out[r["language"]] = (r["n"], m / r["n"], p / r["n"] - np.outer(m, m) / r["n"] ** 2)
        total_n, total_m, total_p = total_n + r["n"], total_m + m, total_p + p
    if total_n:
        out[None] = (total_n, total_m / total_n, total_p / total_n - np.outer(total_m, total_m) / total_n**2)
    return out


#: A language with fewer documents than this is measured against the prose of all.
LEAST = 60


def _parameters(df: DataFrame, moments: dict, scale: float = 1.0) -> DataFrame:
    spark = df.sparkSession
    floor = np.diag([v * v for v in STATS.values()])
    rows = []
    for lang in {*moments} - {None} | {""}:
        n, mean, cov = moments.get(lang, (0, None, None))
        if n < LEAST:
            n, mean, cov = moments[None]
        rows.append((lang, [float(x) for x in mean], [[float(x) for x in line] for line in np.linalg.inv(cov * scale + floor)]))
    return spark.createDataFrame(rows, "language string, mean array<double>, precision array<array<double>>")


def _distances(stats: DataFrame, params: DataFrame) -> DataFrame:
    """stats with the parts of the squared distance; a language unknown to params takes the pooled ones."""
    pooled = params.filter("language = ''").select(F.col("mean").alias("pm"), F.col("precision").alias("pp"))
    joined = stats.join(F.broadcast(params), "language", "left").join(F.broadcast(pooled))
    joined = joined.withColumn("mean", F.coalesce("mean", "pm")).withColumn("precision", F.coalesce("precision", "pp")).drop("pm", "pp")
    y = joined.withColumn("y", F.zip_with(_vector(), "mean", lambda a, b: a - b))
    dot = lambda row: F.aggregate(F.zip_with(row, F.col("y"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    parts = y.withColumn("parts", F.zip_with("y", F.transform("precision", dot), lambda a, b: a * b))
    return parts.withColumn("d2", F.aggregate("parts", F.lit(0.0), lambda s, x: s + x)).drop("y", "mean", "precision")


def _half(scored: DataFrame) -> DataFrame:
    """Of each language the half nearest to its centre."""
    middle = scored.groupBy("language").agg(F.percentile_approx("d2", 0.5, 1000).alias("middle"))
    return scored.join(F.broadcast(middle), "language").filter("d2 <= middle")


def outliers(stats: DataFrame, steps: int = 2) -> DataFrame:
    """stats with d2, the squared robust distance from the prose of its language, and contributions by statistic."""
    stats = written(stats, "quality")
    names = list(STATS)
    medians = stats.groupBy("language").agg(*[F.percentile_approx(s, 0.5, 1000).alias(f"m_{s}") for s in names])
    away = stats.join(F.broadcast(medians), "language")
    start = away.withColumn("d2", sum((((F.col(s) - F.col(f"m_{s}")) / F.lit(STATS[s])) ** 2 for s in names), F.lit(0.0))).select(*stats.columns, "d2")
    near = _half(start)
    for _ in range(steps):
        moments = _moments(near)
        if not moments:
            return stats.withColumn("d2", F.lit(None).cast("double")).withColumn("contributions", F.lit(None).cast("map<string,double>"))
        near = _half(_distances(stats, _parameters(stats, moments)))
    moments = _moments(near)
    # the half's spread is too small for all prose: documents within the widened cutoff settle it
    inner = _distances(stats, _parameters(stats, moments, 2.0)).filter(F.col("d2") <= CUTOFF)
    final = _distances(stats, _parameters(stats, _moments(inner)))
    return final.withColumn("contributions", F.map_from_arrays(F.array(*map(F.lit, names)), "parts")).drop("parts")


def not_prose(scored: DataFrame) -> DataFrame:
    """Documents far from their language's prose."""
    return scored.filter(F.col("d2") > CUTOFF)
