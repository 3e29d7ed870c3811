"""Operator 1: URL filters by association rules. All of it runs on DataFrame and Spark ML operators in the JVM."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, stash

#: The item that marks a labelled URL as bad.
BAD = "\u0001bad"
#: Fixed rules of the production list: (host, path, verdict).
LISTED = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or where there is no ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """Distinct labels of the host and segments of the path, marked as such."""
    parts = lambda mark, text, by: F.transform(F.filter(F.split(text, by), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    return F.array_distinct(F.concat(parts("h:", host(url), r"\."), parts("p:", path(url), "/")))


def listed(h: Column, p: Column, rules=LISTED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fixed rule that fits: its host or a subdomain, and a path that starts as its does."""
    rule = verdict = None
    for rh, rp, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((h == rh) | h.endswith(f".{rh}")) & p.startswith(rp)
        rule = F.when(fits, rh + rp) if rule is None else rule.when(fits, rh + rp)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def labelled(urls: DataFrame, rules=LISTED, url: str = "url") -> DataFrame:
    """(url, bad): rows that a fixed rule decides, 1 where it blocks and 0 where it allows. What is mined from them carries
    the list's decisions over to URLs that it doesn't name."""
    _, verdict = listed(host(F.col(url)), path(F.col(url)), rules)
    return urls.select(F.col(url).alias("url"), (verdict == "block").cast("int").alias("bad")).filter("bad is not null")


def mine(labelled: DataFrame, min_support: float = 0.002, min_rows: int = 10, min_confidence: float = 0.8, error: float = 0.01) -> DataFrame:
    """(items, anchor, confidence) of the rules items -> bad that FP-growth finds in labelled (url, bad: 0 or 1).

    Rules go that are below the support (a share of the labelled rows, and a number of them) or the confidence; whose bad
    rows could have come from the base rate by chance (the Chernoff bound of the exact binomial tail, with the error divided
    by the number of rules); or to which a rule with fewer items and as much confidence already applies. The anchor is the
    rarest item, under which the index lists the rule. Rows with another bad than 0 or 1 teach nothing; null or empty URLs
    have no items; each row counts, repeated ones too. The support bounds the number of frequent items and so of rules.
    Without bad rows, or with bad rows alone, there are no rules."""
    baskets = stash(labelled.filter("bad in (0, 1)").select("bad", F.concat(tokens(F.col("url")), F.when(F.col("bad") == 1, F.array(F.lit(BAD))).otherwise(F.array())).alias("items")).filter("size(items) > 0"), "url-baskets")
    n, bad = baskets.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if n < min_rows or bad in (0, n):
        return baskets.sparkSession.createDataFrame([], "items array<string>, anchor string, confidence double")
    model = FPGrowth(minSupport=max(min_support, min_rows / n), minConfidence=min_confidence).fit(baskets.select("items"))
    found = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD)))
    rules = stash(found.select(F.array_sort("antecedent").alias("items"), "confidence", F.round(F.col("support") * n).alias("hits")), "url-candidates")
    c, base = F.col("confidence"), bad / n
    gain = c * F.log(c / base) + F.when(c < 1, (1 - c) * F.log((1 - c) / (1 - base))).otherwise(0.0)
    sure = (c > base) & (F.round(F.col("hits") / c) * gain >= F.lit(math.log(max(1, rules.count()) / error)))
    rules = stash(rules.filter(sure).select("items", "confidence"), "url-rules")
    wider = rules.select(F.explode("items").alias("i"), "items", "confidence")
    shorter = rules.select(F.col("items").alias("few"), F.col("confidence").alias("fc"), F.col("items")[0].alias("i"))
    spare = wider.join(shorter, "i").filter("size(few) < size(items) and size(array_except(few, items)) = 0 and fc >= confidence").select("items").distinct()
    rarity = model.freqItemsets.filter("size(items) = 1").select(F.col("items")[0].alias("i"), "freq")
    anchors = rules.select("items", F.explode("items").alias("i")).join(rarity, "i").groupBy("items").agg(F.min(F.struct("freq", "i"))["i"].alias("anchor"))
    return stash(rules.join(spare, "items", "left_anti").join(anchors, "items").select("items", "anchor", "confidence"), "url-index")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, confidence) of the distinct URLs to which a rule applies: their tokens look up the rules listed under them."""
    known = urls.select("url").distinct().select("url", tokens(F.col("url")).alias("have"))
    found = known.select("url", "have", F.explode("have").alias("anchor")).join(rules, "anchor").filter(F.size(F.array_except("items", "have")) == 0)
    return found.groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, mined: DataFrame, rules=LISTED, url: str = "url") -> DataFrame:
    """pages with host, path, rule, confidence and verdict: the fixed rule's, else block where a mined rule applies, else
    allow. Every row keeps its place, with null, repeated or malformed URLs too; columns of the new names are replaced."""
    new = ("host", "path", "rule", "confidence", "verdict", "__url")
    keep = [c for c in pages.columns if c not in new]
    found = matches(pages.filter(F.col(url).isNotNull()).select(F.col(url).alias("url")), mined).select(F.col("url").alias("__url"), "confidence")
    out = pages.select(*keep).join(found, F.col(url) == F.col("__url"), "left").drop("__url")
    rule, verdict = listed(host(F.col(url)), path(F.col(url)), rules)
    by_method = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return out.withColumns({"host": host(F.col(url)), "path": path(F.col(url)), "rule": rule, "verdict": F.coalesce(verdict, by_method)})
