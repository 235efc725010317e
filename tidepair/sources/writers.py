"""Writers: sharded pairs, metric subtrees, filtered datasets, and their manifests."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepair.operators.edges import METRICS, confidence_score
from tidepair.operators.joins import semi_join_or
from tidepair.plans.ordered import attach_one, quantiles, row_rank


def assign_shards(pairs: DataFrame, order, shard_size: int = 25000) -> DataFrame:
    """row_no (1-based, in order) and shard_idx = (row_no - 1) div shard_size."""
    out = row_rank(pairs, [], order, "row_no")
    return out.withColumn("shard_idx", F.floor((F.col("row_no") - 1) / shard_size))


def shard_manifest(sharded: DataFrame, values: DataFrame, n_genes: int) -> DataFrame:
    """Per shard: pairs, genes, non-zeros of both sides, first and last row.

    values(pair_id, gene_id, source_value, target_value) is the gathered expression.
    """
    base = sharded.groupBy("shard_idx").agg(F.count(F.lit(1)).alias("n_pairs"), (F.min("row_no") - 1).alias("start_row"),
                                            F.max("row_no").alias("end_row"))
    nnz = values.join(sharded.select("pair_id", "shard_idx"), "pair_id").groupBy("shard_idx").agg(
        F.count_if(F.col("source_value") != 0).alias("source_nnz"), F.count_if(F.col("target_value") != 0).alias("target_nnz"))
    return base.join(nnz, "shard_idx", "left").na.fill(0, ["source_nnz", "target_nnz"]).withColumn("n_genes", F.lit(n_genes).cast("bigint"))


def write_pair_shards(sharded: DataFrame, values: DataFrame, n_genes: int, path: str) -> DataFrame:
    """Pairs, values (float32) and manifest as Parquet partitioned by shard; returns the manifest read back."""
    spark = sharded.sparkSession
    sharded.write.mode("overwrite").partitionBy("shard_idx").parquet(path + "/pairs")
    stored = spark.read.parquet(path + "/pairs")
    with_shard = values.join(stored.select("pair_id", "shard_idx"), "pair_id").withColumn(
        "source_value", F.col("source_value").cast("float")).withColumn("target_value", F.col("target_value").cast("float"))
    # one writer task per shard and few files: rows of a shard meet by key, wide shards are split by pair hash
    with_shard.repartition("shard_idx", F.pmod(F.hash("pair_id"), F.lit(4))).write.mode("overwrite").partitionBy(
        "shard_idx").parquet(path + "/values")
    shard_manifest(stored, spark.read.parquet(path + "/values").drop("shard_idx"), n_genes).coalesce(1).write.mode("overwrite").option(
        "sep", "\t").option("header", True).csv(path + "/manifest")
    schema = "shard_idx long, n_pairs long, start_row long, end_row long, source_nnz long, target_nnz long, n_genes long"
    return spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path + "/manifest")


def pool_roles(source: DataFrame, target: DataFrame, source_genes: DataFrame, target_genes: DataFrame) -> DataFrame:
    """Source rows and target rows as one pool with a role; both sides must share the gene order."""
    cols = ["gene_index", "gene_id"]
    a, b = source_genes.select(*cols), target_genes.select(*cols)
    if a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count():
        raise ValueError("gene order differs between shards")
    return source.withColumn("role", F.lit("source")).unionByName(target.withColumn("role", F.lit("target")))


def edges_by_metric(scored: DataFrame, axis: str = "source", metrics=None) -> DataFrame:
    """Every edge once per confidence metric: one pass, metrics stacked next to the row."""
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), confidence_score(m, axis).alias("confidence"))
                                  for m in metrics or METRICS]))
    return scored.select("grp", "ord", "source_id", "target_id", stacked.alias("_m")).select("grp", "ord", "source_id", "target_id", "_m.*")


def write_edges_by_metric(scored: DataFrame, path: str, axis: str = "source", metrics=None, mode: str = "overwrite") -> DataFrame:
    """One subtree per metric and group; returns the table read back."""
    edges_by_metric(scored, axis, metrics).write.mode(mode).partitionBy("metric", "grp").parquet(path)
    return scored.sparkSession.read.parquet(path)


def global_pair_summary(pairs: DataFrame) -> DataFrame:
    """One row: pairs, patients, (patient, dataset), labels transitions, cells and the probability spread."""
    base = pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("patient_id").alias("n_patients"),
        F.count_distinct("patient_id", "dataset_id").alias("n_patient_datasets"),
        F.count_distinct("source_label", "target_label").alias("n_transitions"),
        F.count_distinct("source_cell").alias("n_source_cells"), F.count_distinct("target_cell").alias("n_target_cells"),
        F.avg("probability").alias("probability_mean"), F.min("probability").alias("probability_min"), F.max("probability").alias("probability_max"))
    return attach_one(base, quantiles(pairs, [], "probability", {"probability_median": 0.5}))


def rewrite_filtered_dataset(sharded: DataFrame, kept: DataFrame, pair_table: DataFrame, path: str):
    """Filtered shards, their manifest (empty shards vanish) and the semi-joined pair table, written and read back."""
    spark = sharded.sparkSession
    kept.write.mode("overwrite").partitionBy("shard_idx").parquet(path + "/pairs")
    stored = spark.read.parquet(path + "/pairs")
    semi_join_or(pair_table, stored.select("pair_id"), stored.select("source_cell", "target_cell")).write.mode(
        "overwrite").option("sep", "\t").option("header", True).csv(path + "/pair_table")
    before = sharded.groupBy("shard_idx").agg(F.count(F.lit(1)).alias("n_before"))
    manifest = stored.groupBy("shard_idx").agg(F.count(F.lit(1)).alias("n_pairs")).join(before, "shard_idx")
    table = spark.read.option("sep", "\t").option("header", True).schema(
        ", ".join(f"`{c}` {d}" for c, d in _written_order(pair_table))).csv(path + "/pair_table")
    return manifest, table


def _written_order(pair_table: DataFrame):
    """Join columns come first in the written table (see semi_join_or)."""
    types = dict(pair_table.dtypes)
    first = ["source_cell", "target_cell", "pair_id"]
    return [(c, types[c]) for c in first + [c for c in pair_table.columns if c not in first]]
