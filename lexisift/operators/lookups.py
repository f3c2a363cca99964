"""Lookups in reference data that the caller brings: vulnerable versions, reputation of domains, packages of registries.

Tables of fixed, small size go in as expressions or broadcasts; a table of vulnerabilities is joined by its own size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.functions.text import version_key

# Shorteners (found anywhere in a domain), endings of little repute, words of phishing.
SHORTENERS = ("bit.ly", "tinyurl.com", "shorturl.at", "goo.gl", "ow.ly", "is.gd", "tiny.cc", "buff.ly", "rb.gy", "t.co", "short.link", "shr.lc")
ENDINGS = ("xyz", "top", "club", "online", "site", "live", "work", "info", "biz", "gq", "ml", "cf", "ga", "tk", "zip", "review", "trade", "webcam", "men", "download", "loan", "win", "bid", "date", "racing", "science")
WORDS = "login|signin|verify|authenticate|account|secure|banking|wallet|update|confirm"
TRUSTED = ("github.com", "gitlab.com", "google.com", "microsoft.com", "apple.com", "python.org", "pypi.org", "npmjs.com", "mozilla.org", "wikipedia.org", "w3.org", "ietf.org", "apache.org", "debian.org", "kernel.org")


def domain_risk(domain: Column, trusted: tuple[str, ...] = TRUSTED) -> Column:
    """url_shortener, none, suspicious_tld, phishing_keyword or unknown, in this order."""
    d = F.lower(F.trim(domain))
    safe = F.lit(False)
    for s in trusted:
        safe = safe | (d == s) | d.endswith("." + s)
    short = F.lit(False)
    for s in SHORTENERS:
        short = short | F.contains(d, F.lit(s))
    return F.when(d.isNull(), None).when(short, "url_shortener").when(safe, "none").when(d.rlike(rf"\.(?:{'|'.join(ENDINGS)})(?:$|/)"), "suspicious_tld").when(d.rlike(WORDS), "phishing_keyword").otherwise("unknown")


def affected(version: Column, spec: Column) -> Column:
    """Whether a version lies in a range such as ``>=1.2,<2.0``; an unreadable version counts as affected."""
    own = version_key(version)
    parts = F.filter(F.split(F.regexp_replace(spec, r"\s", ""), ","), lambda x: x != "")

    def holds(p: Column) -> Column:
        other = version_key(F.regexp_replace(p, r"^[<>=!]+", ""))
        op = F.regexp_extract(p, r"^([<>=!]+)", 1)
        return F.when(other.isNull(), True).when(op == "<", own < other).when(op == "<=", own <= other).when(op == ">", own > other).when(op == ">=", own >= other).when(op == "!=", own != other).otherwise(own == other)

    return own.isNull() | F.forall(parts, holds)


def vulnerable(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """packages (package, version) x advisories (advisory, package, versions): names equal or one inside the other.

    Names meet by their grams of up to three characters, so no pair is formed that shares none; the exact test follows.
    """
    # a name of fewer than three characters is its own gram, so grams of every length up to three are made of the longer name
    grams = lambda c: F.array_distinct(F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, n)))))
    p = packages.select(F.lower("package").alias("p"), "package", "version").distinct()
    a = advisories.select("advisory", F.lower("package").alias("a"), "versions").distinct()
    # the shorter name's first gram is in the longer one, whichever it is
    left = p.withColumn("g", F.explode(grams(F.col("p")))).join(a.withColumn("g", F.substring("a", 1, 3)), "g").filter("contains(p, a)")
    right = p.withColumn("g", F.substring("p", 1, 3)).join(a.withColumn("g", F.explode(grams(F.col("a")))), "g").filter("contains(a, p)")
    pairs = left.unionByName(right).drop("g").distinct()
    return pairs.filter(affected(F.col("version"), F.col("versions"))).select("package", "version", "advisory")


def registered(packages: DataFrame, registry: DataFrame) -> DataFrame:
    """packages (ecosystem, package) with ``known``: whether the registry (ecosystem, package) has it."""
    r = registry.select(F.lower("ecosystem").alias("ecosystem"), F.lower("package").alias("package")).distinct().withColumn("known", F.lit(True))
    p = packages.withColumn("ecosystem", F.lower("ecosystem")).withColumn("package", F.lower("package"))
    return p.join(r, ["ecosystem", "package"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
