"""URL filters: rules first, then empirical-Bayes reputation of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beta_strength, cut, packed

#: (action, host, path): the rules of the registered query.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ://."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Action and text of the longest rule that fits (block before allow at equal length), or nulls.

    rules is a bounded parameter of the caller, part of the expression.
    """
    fits = lambda h, p: ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    pick = lambda value: F.coalesce(*[F.when(fits(r[1], r[2]), F.lit(value(r))) for r in ordered], F.lit(None).cast("string"))
    return pick(lambda r: r[0]), pick(lambda r: r[1] + r[2])


def host_reputation(outcomes: DataFrame, hosts: DataFrame, z: float = 1.645, limit: float = 0.3) -> DataFrame:
    """Posterior bad rate of every host: hosts(host), outcomes(host, bad) -> host, n_labelled, rate, bound, blocked.

    Levels are suffix (last label), registered domain (last two labels) and host. Each level has a beta prior whose
    mean is the posterior mean one level up (the suffix level: the overall rate) and whose strength is fitted by moments
    to the groups of that level. blocked: rate - z * standard deviation of the host's beta posterior is above limit (a
    normal bound). Hosts without labels fall back to their domain. Null outcomes are no outcome.
    """
    counts = outcomes.where(F.col("bad").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("f"))
    known = hosts.select("host").distinct().join(counts, "host", "left").na.fill(0, ["n", "f"])
    known = cut(known.select("host", "n", "f", F.substring_index("host", ".", -2).alias("domain"), F.substring_index("host", ".", -1).alias("suffix")))
    domains = known.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
    suffixes = known.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
    with_prior = lambda df: df.join(F.broadcast(beta_strength(df, "n", "f")))  # noqa: E731  (one row)
    a = lambda mean: F.col("f") + F.col(mean) * F.col("strength")
    s = with_prior(suffixes).select("suffix", (a("mean") / (F.col("n") + F.col("strength"))).alias("above"))
    d = with_prior(domains).join(s, "suffix").select("domain", (a("above") / (F.col("n") + F.col("strength"))).alias("above"))
    h = with_prior(known).join(d, "domain").select("host", "n", (a("above") / (F.col("n") + F.col("strength"))).alias("rate"), (F.col("n") + F.col("strength")).alias("size"))
    bound = F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("size") + 1))
    return h.select("host", F.col("n").alias("n_labelled"), "rate", bound.alias("bound"), (bound > limit).alias("blocked"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, url: str = "url", z: float = 1.645, limit: float = 0.3) -> DataFrame:
    """Verdict of every page: row (whole input row), host, path, rule, verdict, rate, bound.

    A fitting rule decides; else the host's reputation. Null and malformed urls have an empty host, judged as a host of
    its own; equal urls get equal verdicts; without outcomes nothing is blocked by reputation; no pages give no rows.
    """
    host, path = host_and_path(F.col(f"row_{url}"))
    seen = packed(pages, url).select("row", host.alias("host"), path.alias("path"))
    known = host_reputation(outcomes, seen, z, limit)
    action, rule = matching_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return seen.join(known, "host", "left").select("row", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "rate", "bound")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled outcomes of pages: the number in a url's path names the labelled document it shows; bad is toxic or of
    quality 0. Repeated labels of a document count once, as the worst."""
    host, path = host_and_path(F.col("url"))
    number = F.expr("try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') AS long)")
    shown = pages.select(host.alias("host"), path.alias("path")).select("host", number.alias("doc_id")).where("doc_id IS NOT NULL")
    bad = ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")
    return shown.join(labels.groupBy("doc_id").agg(F.max(bad).alias("bad")), "doc_id").select("host", "bad")


def op1_url_filters(pages: DataFrame, labels: DataFrame) -> DataFrame:
    pages = pages.select("page_id", "url")
    return judge_urls(pages, page_outcomes(pages, labels)).select("row.page_id", "host", "path", "rule", "verdict", F.round("rate", 6).alias("rate"))
