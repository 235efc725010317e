"""Quality rules at host level: text rules per document, failure rates per host shrunk by an empirical beta prior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beta_strength, cut, packed, words

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"


def repeated_words(hashes: Column) -> Column:
    """How many words stand in a window of WINDOW words that the text holds twice or more.

    hashes: 64-bit hashes of the windows in order of their start. Texts without a repeat end at the hash set; others
    sort (hash, start) pairs, so the work is n log n however repetitive a text is.
    """
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: (
        (F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))), lambda x: x["i"]))
    steps = lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1), x + WINDOW) - x))
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    heavy = F.aggregate(let(let(pairs, starts), steps), F.lit(0), lambda a, x: a + x)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(heavy).cast("long")


def text_rules(df: DataFrame, text: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; null counts as an empty text.

    Only DataFrame functions. Windows are compared by 64-bit hashes of their words' hashes.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = df.withColumn("_w", words(F.col(text))).withColumn("_l", lines)
    out = out.select("*", F.size("_w").cast("long").alias("n_words"), F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
                     F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                     (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
                     F.transform("_w", lambda w: F.xxhash64(w)).alias("_h")).drop("_w", "_l")
    window = lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(WINDOW)])
    starts = F.when(F.col("n_words") > WINDOW, F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")))
    out = out.withColumn("_g", F.transform(F.coalesce(starts, F.array().cast("array<int>")), window)).drop("_h")
    out = out.withColumn("n_repeat_words", repeated_words(F.col("_g"))).drop("_g")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def host_verdicts(judged: DataFrame, host: str, failed: str, limit: float = 0.5) -> DataFrame:
    """Per host (null is a host of its own): host, host_docs, host_rate and host_rejected.

    host_rate is the posterior mean (12 decimals, so that reruns agree) of the failure rate under a beta prior fitted to all hosts; a host is rejected
    above limit. A hot host is combined before the shuffle.
    """
    hosts = judged.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col(failed).cast("long")).alias("host_failed"))
    hosts = cut(hosts)
    prior = beta_strength(hosts, "host_docs", "host_failed")
    rate = F.round((F.col("host_failed") + F.col("mean") * F.col("strength")) / (F.col("host_docs") + F.col("strength")), 12)
    return hosts.join(F.broadcast(prior)).select("host", "host_docs", rate.alias("host_rate"), (rate > limit).alias("host_rejected"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", limit: float = 0.5, carry: tuple = ("*",)) -> DataFrame:
    """Host-level quality rules. Returns row (the columns to carry), the rule columns, host_rate, host_rejected, kept.

    A text fails below 10 words or with over 20 % of its words in repeated windows; a document is kept if it passes and
    its host is not rejected. Null and empty texts have no words and fail; a null host is one host; equal rows get equal
    verdicts; an empty table gives no rows. Measured rows are written once, so the text rules run once.
    """
    judged = cut(text_rules(packed(docs, text, host, carry=carry), f"row_{text}").drop(f"row_{text}"))
    hosts = host_verdicts(judged, f"row_{host}", "base_failed", limit)
    out = judged.join(hosts, judged[f"row_{host}"].eqNullSafe(hosts["host"]), "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False)))


def filter_documents(docs: DataFrame, text: str = "text", host: str = "source", limit: float = 0.5) -> DataFrame:
    """The documents that judge() keeps, with their own columns."""
    return judge(docs, text, host, limit).where("kept").select("row.*")


def op9_quality_rules(docs: DataFrame) -> DataFrame:
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate"]
    return judge(docs, carry=("doc_id",)).select("row.doc_id", *columns)
