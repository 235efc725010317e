"""Equi-join operators: expression gathers, gene alignment, clinical and cohort lookups."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepair.functions.clean import cancer_code, clean, drug_target, strip_concat_suffix, strip_ensembl_version, trimmed
from tidepair.plans.ordered import attach_one, top_rows


def _must(c: Column, message: str) -> Column:
    return F.when(c.isNotNull(), c).otherwise(F.raise_error(message))


def must_be_unique(df: DataFrame, keys) -> DataFrame:
    """Many-to-one guard: fails the job when a key repeats (one map-side combined aggregation)."""
    others = [c for c in df.columns if c not in keys]
    n = F.when(F.count(F.lit(1)) == 1, F.any_value(F.struct(*others))).otherwise(F.raise_error("join key is not unique"))
    return df.groupBy(*keys).agg(n.alias("_row")).select(*keys, "_row.*")


def gather_pair_expression(pairs: DataFrame, expr: DataFrame, cells: DataFrame) -> DataFrame:
    """Long (pair, gene, source value, target value); a pair naming an unknown cell fails the job.

    `cells` lists every cell of the matrices, also those without a stored value.
    """
    known = cells.select("cell_id", F.lit(True).alias("_known"))
    sides = []
    for side in ("source", "target"):
        rows = pairs.select("pair_id", F.col(side + "_cell").alias("cell_id")).join(known, "cell_id", "left")
        rows = rows.withColumn("_known", _must(F.col("_known"), side + " cell missing from its matrix"))
        values = rows.join(expr, "cell_id", "left").where(F.col("_known")).where(F.col("gene_id").isNotNull())
        sides.append(values.select("pair_id", "gene_id", F.lit(side).alias("side"), "value"))
    at = lambda s: F.coalesce(F.max(F.when(F.col("side") == s, F.col("value"))), F.lit(0.0))
    return sides[0].unionByName(sides[1]).groupBy("pair_id", "gene_id").agg(
        at("source").alias("source_value"), at("target").alias("target_value"))


def resolve_cell_id(wanted: DataFrame, cells: DataFrame, order: str) -> DataFrame:
    """wanted(cell_ref) -> cell_id: raw id, else suffix-stripped id, against obs name, raw barcode, barcode.

    The first cell with an alias wins; earlier alias columns take precedence.
    """
    alias = F.explode(F.array(*[F.struct(F.lit(i).alias("pri"), F.col(c).alias("alias"))
                                for i, c in enumerate(("obs_name", "raw_barcode", "barcode"))]))
    table = cells.select("cell_id", order, alias.alias("_a")).select("cell_id", order, "_a.*").where(F.col("alias").isNotNull())
    table = top_rows(table, ["alias"], ["pri", order], 1, "_k").select("alias", "cell_id")
    out = wanted.withColumn("_s", strip_concat_suffix("cell_ref"))
    out = out.join(table.select(F.col("alias").alias("cell_ref"), F.col("cell_id").alias("_raw")), "cell_ref", "left")
    out = out.join(table.select(F.col("alias").alias("_s"), F.col("cell_id").alias("_str")), "_s", "left")
    return out.withColumn("cell_id", F.coalesce("_raw", "_str")).drop("_s", "_raw", "_str")


def align_genes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Genes of `a` (in its order) that also occur in `b`; an empty intersection is an error."""
    out = a.join(b.select("gene_id").distinct(), "gene_id", "left_semi")
    if out.limit(1).count() == 0:
        raise ValueError("no common genes")
    return out


def semi_join_or(pairs: DataFrame, kept_ids: DataFrame, kept_cells: DataFrame) -> DataFrame:
    """Rows whose pair_id is kept OR whose (source, target) is kept: two hash joins, no OR condition."""
    ids = kept_ids.select("pair_id", F.lit(1).alias("_a")).distinct()
    cells = kept_cells.select("source_cell", "target_cell", F.lit(1).alias("_b")).distinct()
    out = pairs.join(ids, "pair_id", "left").join(cells, ["source_cell", "target_cell"], "left")
    return out.where(F.col("_a").isNotNull() | F.col("_b").isNotNull()).drop("_a", "_b")


def resolve_gene(rows: DataFrame, model: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """rows(gene_id, gene_symbol) -> model gene by exact id, ranked symbol reference, then unique symbol.

    model(gene_index, gene_id, gene_symbol); reference(ord, input_symbol, ensembl_gene_id).
    """
    rows = rows.withColumn("_id", strip_ensembl_version(F.col("gene_id"))).withColumn(
        "_sym", F.upper(clean(F.col("gene_symbol"))))
    ids = model.select(F.col("gene_id").alias("_id"), F.col("gene_index").alias("_exact"))
    symbol = F.upper(clean(F.col("gene_symbol")))
    unique = model.select(symbol.alias("_sym"), "gene_index").where(F.col("_sym") != "").groupBy("_sym").agg(
        F.min("gene_index").alias("_unique"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 1).drop("_n")
    out = rows.join(ids, "_id", "left").join(unique, "_sym", "left")
    if reference is not None:
        ref = reference.select("ord", F.upper(clean(F.col("input_symbol"))).alias("_sym"),
                               strip_ensembl_version(F.col("ensembl_gene_id")).alias("_id")).where(F.col("_sym") != "")
        ref = top_rows(ref.join(ids, "_id"), ["_sym"], ["ord"], 1, "_k").select("_sym", F.col("_exact").alias("_ranked"))
        out = out.join(ref, "_sym", "left")
    else:
        out = out.withColumn("_ranked", F.lit(None).cast("long"))
    method = (F.when(F.col("_exact").isNotNull(), "exact_ensembl").when(F.col("_ranked").isNotNull(), "ranked_symbol_reference")
              .when(F.col("_unique").isNotNull(), "unique_checkpoint_symbol").otherwise("unresolved"))
    return out.withColumn("model_gene_index", F.coalesce("_exact", "_ranked", "_unique")).withColumn(
        "mapping_method", method).drop("_id", "_sym", "_exact", "_ranked", "_unique")


METHODS = ["exact_ensembl", "ranked_symbol_reference", "unique_checkpoint_symbol", "unresolved"]


def gene_alignment_report(resolved: DataFrame, model: DataFrame, keep=()) -> DataFrame:
    names = model.select(F.col("gene_index").alias("model_gene_index"), F.col("gene_id").alias("model_gene_id"))
    return resolved.join(names, "model_gene_index", "left").select(
        *keep, clean(F.col("gene_id")).alias("source_gene_id"), clean(F.col("gene_symbol")).alias("source_gene_symbol"),
        "model_gene_index", F.coalesce("model_gene_id", F.lit("NA")).alias("model_gene_id"), "mapping_method")


def gene_alignment_summary(resolved: DataFrame, model: DataFrame, dataset: str = "dataset_id") -> DataFrame:
    """Per dataset: rows, mapped rows, distinct model genes, coverage, rows per method."""
    out = resolved.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("source_genes"), F.count("model_gene_index").alias("mapped_rows"),
        F.count_distinct("model_gene_index").alias("unique_model_genes"),
        *[F.count_if(F.col("mapping_method") == m).alias("mapping_" + m) for m in METHODS])
    out = attach_one(out, model.agg(F.count(F.lit(1)).alias("model_genes")))
    return out.withColumn("coverage", F.col("unique_model_genes") / F.col("model_genes"))


def align_expression(counts: DataFrame, resolved: DataFrame, keys) -> DataFrame:
    """Long counts (sample_id, source row key, value) summed onto model genes; unmapped rows drop out."""
    mapped = resolved.where(F.col("model_gene_index").isNotNull()).select(*keys, "model_gene_index")
    return counts.join(mapped, list(keys)).groupBy("sample_id", "model_gene_index").agg(F.sum("value").alias("value"))


def spatial_align(counts: DataFrame, resolved: DataFrame, model: DataFrame, keys):
    """(aligned counts, model genes with a `measured` flag: some source row maps to the gene)."""
    seen = resolved.select(F.col("model_gene_index").alias("gene_index"), F.lit(True).alias("measured")).distinct()
    mask = model.join(seen, "gene_index", "left").withColumn("measured", F.coalesce("measured", F.lit(False)))
    return align_expression(counts, resolved, keys), mask


def vocab_align(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Symbol -> vocabulary token (lowest token id per upper-case symbol); duplicate symbols are summed.

    Long output holds only stored values: a gene absent from a dataset is a zero of the outer union.
    """
    table = top_rows(vocab.withColumn("_sym", F.upper(trimmed(F.col("token")))).where(F.col("_sym") != ""),
                     ["_sym"], ["token_id"], 1, "_k").select("_sym", "token", "token_id")
    rows = counts.withColumn("_sym", F.upper(trimmed(F.col("gene_symbol"))))
    return rows.join(table, "_sym").groupBy("dataset_id", "sample_id", "token", "token_id").agg(F.sum("value").alias("value"))


def collapse_duplicate_symbols(long: DataFrame) -> DataFrame:
    """Mean of duplicate symbols per sample; blank symbols drop out."""
    named = long.withColumn("symbol", trimmed(F.col("symbol"))).where(F.col("symbol") != "")
    return named.groupBy("sample_id", "symbol").agg(F.avg("value").alias("value"))


def pair_star_join(pairs: DataFrame, patients: DataFrame, samples: DataFrame, studies: DataFrame) -> DataFrame:
    """Pair metadata from the star of patients, post samples and studies."""
    out = (pairs.join(must_be_unique(patients, ["patient_id"]), "patient_id")
           .join(must_be_unique(samples, ["sample_id"]).withColumnRenamed("sample_id", "post_sample_id"), "post_sample_id")
           .join(must_be_unique(studies, ["dataset_id"]), "dataset_id"))
    response = clean(F.col("response_group"))
    na = lambda c: F.when(clean(F.col(c)) == "", "NA").otherwise(clean(F.col(c)))
    return out.select(
        "pair_id", "patient_id", "dataset_id", clean(F.col("source_dataset_id")).alias("source_dataset_id"),
        F.concat_ws("__", clean(F.col("source_dataset_id")), clean(F.col("source_patient_id"))).alias("biological_patient_id"),
        "pre_sample_id", "post_sample_id", na("response_group").alias("response_group"),
        F.when(response == "Response", "1").when(response == "Non-response", "0").otherwise("NA").alias("response_binary"),
        na("cancer_subtype").alias("cancer_subtype"), cancer_code(na("cancer_subtype")).alias("cancer_code"),
        na("therapeutic_regimen").alias("therapeutic_regimen"), drug_target(na("therapeutic_regimen")).alias("drug_target"))


def file_sample_join(files: DataFrame, samples: DataFrame, keys) -> DataFrame:
    """Left many-to-one join of files to sample metadata on all shared keys."""
    return files.join(must_be_unique(samples, keys), list(keys), "left")


def selected_patient_semi(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Restrict to listed patients; a listed stranger is an error."""
    if chosen.join(rows, "patient_id", "left_anti").limit(1).count():
        raise ValueError("selected patient not present")
    return rows.join(chosen.select("patient_id").distinct(), "patient_id", "left_semi")


def features_with_outcomes(features: DataFrame, outcomes: DataFrame, keys=("patient_id", "dataset_id")) -> DataFrame:
    return features.join(must_be_unique(outcomes, list(keys)), list(keys))


def scores_with_predictions(scores: DataFrame, base: DataFrame, keys) -> DataFrame:
    """Left join on identity keys; the patient side owns the label."""
    return scores.drop("label").join(must_be_unique(base, list(keys)), list(keys), "left")


def gene_mask_join(expr: DataFrame, cells: DataFrame, measured: DataFrame) -> DataFrame:
    """Expression rows with a flag whether the cell's dataset measured the gene; unknown datasets fail."""
    datasets = measured.select("dataset_id").distinct().withColumn("_known", F.lit(True))
    rows = expr.join(cells.select("cell_id", "dataset_id"), "cell_id").join(datasets, "dataset_id", "left")
    rows = rows.withColumn("_known", _must(F.col("_known"), "dataset without a gene mask"))
    mask = measured.select("dataset_id", "gene_id", F.lit(True).alias("measured")).distinct()
    return rows.join(mask, ["dataset_id", "gene_id"], "left").withColumn(
        "measured", F.coalesce("measured", F.lit(False)) & F.col("_known")).drop("_known")
