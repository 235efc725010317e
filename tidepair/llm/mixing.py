"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, n_words, numbered, packed

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3.0


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, epochs: float = MAX_EPOCHS) -> DataFrame:
    """Targets of sources: (source, source_size) -> source, source_size, weight, target.

    Sources take the weights in turn by code point, null last. The total is dealt by weight; sources above epochs
    times their size are clamped there, and what they leave is dealt again among the others, until none is above.
    A round only brings three sums to the driver. With epochs >= 1 the total always fits; below, all sources end
    clamped. Sources of size 0 get target 0.
    """
    ranked = numbered(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_rank").drop("_null")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * epochs).alias("cap")))
    capped, level = F.col("source_size") == 0, 0.0
    left = -1
    while True:  # a round clamps at least one more source, or ends
        clamped = F.sum(F.when(capped, F.col("cap")).otherwise(0.0))
        free = F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))
        total, spent, open_, n = ranked.agg(F.sum("source_size").cast("double"), clamped, free, F.count(F.when(~capped, 1))).first()
        if not n or n == left:
            break
        left, level = n, (total - spent) / open_
        capped = (F.col("source_size") == 0) | (F.col("cap") < F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", "weight", F.when(capped, F.col("cap")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple = WEIGHTS,
        epochs: float = MAX_EPOCHS, seed: int = 11, digits: int = 2, carry: tuple = ("*",)) -> DataFrame:
    """Repetitions of every document: row (the columns to carry), size, source_size, target, repeats, taken.

    A source that shall give r times its size repeats all its documents floor(r) times and, once more, those documents
    that come first in a seeded order, up to the rest. The seeded order is the md5 of seed, key and text, so reruns agree.
    Its running sums are made over (source, turn, size) alone, within (source, leading hex digits), and shifted by bucket
    totals: a hot source is no single group. They give each source the last turn that is repeated once more, which whole
    rows are then compared with; rows are only moved if there are too many sources to send to all tasks.
    Copies of a row share their turn, and go together. Null texts have size 0 and are taken 0 words; a null source is a source; an empty
    table gives no rows.
    """
    known = lambda c: F.coalesce(F.col(f"row_{c}").cast("string"), F.lit(""))
    turn = F.md5(F.concat(F.lit(f"{seed}:"), known(key), F.lit(":"), known(text)))
    whole = packed(docs, text, source, key, carry=carry).select("row", F.col(f"row_{source}").alias("_source"), n_words(F.col(f"row_{text}")).alias("size"), turn.alias("_turn"))
    sized = cut(whole.select("_source", "size", "_turn", F.substring("_turn", 1, digits).alias("_bucket")))
    sizes = cut(sized.groupBy("_source", "_bucket").agg(F.sum("size").alias("_part")))
    targets = cut(source_targets(sizes.groupBy(F.col("_source").alias("source")).agg(F.sum("_part").alias("source_size")), weights, epochs))
    before = F.sum("_part").over(W.partitionBy("_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("_start"))
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    rest = (rate - F.floor(rate)) * F.col("source_size")
    plan = starts.join(targets, F.col("_s").eqNullSafe(F.col("source"))).select("_s", "_b", "_start", rest.alias("_rest"))
    inside = F.sum("size").over(W.partitionBy("_source", "_bucket").orderBy("_turn").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    turns = sized.withColumn("_inside", inside).join(plan, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    again = turns.where(F.col("_start") + F.col("_inside") + F.col("size") / 2 < F.col("_rest"))
    until = again.groupBy(F.col("_source").alias("_t")).agg(F.max("_turn").alias("_until"))
    sources = cut(targets.join(until, F.col("source").eqNullSafe(F.col("_t")), "left").select("source", "source_size", "target", "_until"))
    out = whole.join(sources, F.col("_source").eqNullSafe(F.col("source")))
    extra = F.coalesce((F.col("_turn") <= F.col("_until")).cast("long"), F.lit(0))
    out = out.withColumn("repeats", F.floor(rate) + extra)
    return out.select("row", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as mix() says, with its own columns."""
    return mix(docs, **options).where("repeats > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("row.*")


def op5_mixing(docs: DataFrame) -> DataFrame:
    return mix(docs, carry=("doc_id",)).select("row.doc_id", "size", "source_size", "target", "taken")
