"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepair.plans.session import shared_folder, ship_package

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: Tables that cut() has written in this process.
CUTS: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows once, well compressed, to the shared folder and read them back."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    CUTS.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of cut() whose readers are done."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


#: Bytes that Spark puts into one Arrow batch for Python: a few whole texts rather than thousands.
BATCH_BYTES = "16m"


def ready(spark: SparkSession) -> None:
    """What Python helpers need on the executors: the package, and small batches."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP, -1), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def parts(spark: SparkSession, least: int = 1) -> int:
    """Partitions for an explicit repartition: those of the session."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def packed(df: DataFrame, *needs: str, carry: tuple = ("*",)) -> DataFrame:
    """The columns to carry as column row, beside copies of needed columns: names that an operator adds can't clash."""
    return df.select(F.struct(*carry).alias("row"), *[F.col(c).alias(f"row_{c}") for c in needs])


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number rows from 0 in the order of some columns: range partitions, a row number in each, and the totals of
    earlier partitions. Only one row a partition meets in one task."""
    dealt = cut(df.repartitionByRange(parts(df.sparkSession), *order).withColumn("_part", F.spark_partition_id()))
    before = dealt.groupBy("_part").count().select(
        "_part", F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_at", inside).join(before, "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def beta_strength(groups: DataFrame, n: str, hits: str) -> DataFrame:
    """One row (mean, strength) of the beta prior behind groups of n trials with some hits, by moments.

    The share of variance between groups is what weighted squared deviations exceed binomial noise by; it is kept
    within [0.001, 0.9], so that one group, equal groups or no group at all still give a defined prior (mean 0 with no
    trials).
    """
    total = groups.agg(F.sum(n).cast("double").alias("t"), F.sum(hits).cast("double").alias("h"))
    total = total.select("t", F.coalesce(F.col("h") / F.nullif(F.col("t"), F.lit(0.0)), F.lit(0.0)).alias("mean"))
    g = groups.where(F.col(n) > 0).select(F.col(n).cast("double").alias("n"), F.col(hits).cast("double").alias("f")).join(F.broadcast(total))
    w, off = F.col("n") / F.col("t"), F.col("f") / F.col("n") - F.col("mean")
    # terms of 15 digits add up exactly: the same in every order of partitions and in every engine
    exact = lambda term, name: F.sum(term.cast("decimal(38,15)")).cast("double").alias(name)
    s = g.agg(exact(w * (off * off), "dev"), exact(w * (1 - w), "w1"), exact(w * (1 - w) / F.col("n"), "w2"))
    noise = F.col("mean") * (1 - F.col("mean"))
    share = (F.col("dev") - noise * F.col("w2")) / F.nullif(noise * (F.col("w1") - F.col("w2")), F.lit(0.0))
    share = F.greatest(F.lit(0.001), F.least(F.lit(0.9), F.coalesce(share, F.lit(0.001))))
    return total.join(F.broadcast(s)).select("mean", (1 / share - 1).alias("strength"))
