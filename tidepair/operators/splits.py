"""Expression transforms, filters, sampling, folds and batches."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepair.functions.clean import source_study
from tidepair.functions.pvalues import blake_fold
from tidepair.plans.ordered import attach_one, quantiles, row_rank, running, top_rows, with_totals
from tidepair.plans.session import cut


def unknown_fails(ok: Column, value: Column, message: str) -> Column:
    """`value` where ok, else fail the job with `message` (checked inside the tasks)."""
    return F.when(ok, value).otherwise(F.raise_error(message))


def shuffle_key(seed, *cols) -> Column:
    """Deterministic pseudo-random text key of a row identity."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def unit_draw(seed, *cols) -> Column:
    """Deterministic uniform [0,1) with 52 bits of a row identity."""
    return F.conv(F.substring(shuffle_key(seed, *cols), 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))


def log1p_10k(expr: DataFrame) -> DataFrame:
    """log1p(x * 1e4 / max(sum, 1)) per cell; a cell has at most one row per panel gene."""
    total = F.sum("value").over(Window.partitionBy("cell_id"))
    return expr.withColumn("value", F.log1p(F.col("value") * 1e4 / F.greatest(total, F.lit(1.0))))


def bin_n(expr: DataFrame, n_bins: int) -> DataFrame:
    """Equal-count bins 1..N over the non-zero values of a cell (ties split by gene order); zeros stay 0."""
    if n_bins < 2:
        raise ValueError("needs at least 2 bins")
    positive = expr.where(F.col("value") != 0)
    cell = Window.partitionBy("cell_id")  # bounded by the gene panel
    rank0 = (F.row_number().over(cell.orderBy("value", "gene_index")) - 1).cast("bigint")
    return positive.withColumn("bin", F.floor(rank0 * n_bins / F.count(F.lit(1)).over(cell)) + 1)


def bulk_transform(aligned: DataFrame, library: DataFrame, kind: str) -> DataFrame:
    """cpm / log1p_cpm / log1p_10k / none with a supplied library size per sample."""
    if kind == "none":
        return aligned
    scale = {"cpm": 1e6, "log1p_cpm": 1e6, "log1p_10k": 1e4}[kind]
    value = F.col("value") / F.greatest(F.col("library"), F.lit(1.0)) * scale
    out = aligned.join(library, "sample_id")
    return out.withColumn("value", F.log1p(value) if kind.startswith("log1p") else value).drop("library")


def stable_fold(df: DataFrame, group: str, folds: int, seed: int = 0) -> DataFrame:
    """group -> fold from a keyed hash of the group's own name, computed once per distinct group."""
    names = df.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias(group)).distinct()
    return names.withColumn("fold", blake_fold(folds, seed)(group))


def stable_fold_sha(df: DataFrame, group: str, folds: int, seed: int = 0) -> DataFrame:
    """The same idea with built-in SHA-256 (60 bits), for engines that must agree in SQL."""
    names = df.where(F.col(group).isNotNull()).select(group).distinct()
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string")), 256)
    return names.withColumn("fold", F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % folds)


def fold_split(rows: DataFrame, folds: DataFrame, group: str, held_out: int) -> DataFrame:
    """split = train / val; a group without a fold fails the job, and so does a split with an empty side."""
    known = folds.withColumn("_known", F.lit(True))
    out = rows.join(known, group, "left")
    held = F.coalesce(F.col("fold") == held_out, F.lit(False))
    sides = out.agg(F.count_if(held).alias("_val"), F.count_if(~held).alias("_train"))
    split = unknown_fails(F.col("_known"), F.when(held, "val").otherwise("train"), "group without a fold")
    both = attach_one(out, sides)
    return both.withColumn("split", unknown_fails((F.col("_val") > 0) & (F.col("_train") > 0), split, "an empty side of the split")).drop("_known", "_val", "_train")


def shard_fold_split(shards: DataFrame, folds: int, held_out: int, seed: int = 0) -> DataFrame:
    """Shards in seeded order; every k-th from `held_out` is validation."""
    ranked = row_rank(shards.withColumn("_k", shuffle_key(seed, "shard")), [], ["_k", "shard"], "_pos")
    val = (F.col("_pos") - 1) % folds == held_out
    return ranked.withColumn("split", F.when(val, "val").otherwise("train")).drop("_k", "_pos")


def technology_filter(rows: DataFrame, lookup: DataFrame, keep) -> DataFrame:
    """Keep rows of the given technologies; an unknown dataset fails the job."""
    out = rows.join(lookup, "dataset_id", "left")
    tech = unknown_fails(F.col("technology").isNotNull(), F.col("technology"), "dataset without technology")
    return out.withColumn("technology", tech).where(F.col("technology").isin(list(keep)))


def batch_category(kind: str) -> Column:
    if kind == "source_study":
        return source_study(F.col("patient_id"))
    if kind not in ("technology", "dataset_id", "patient_id"):
        raise ValueError("unknown batch key: " + kind)
    return F.col(kind).cast("string")


def drop_unseen_categories(val: DataFrame, train: DataFrame, key: str):
    """(kept rows, report of dropped categories and counts)."""
    seen = train.select(key).distinct()
    return (val.join(seen, key, "left_semi"),
            val.join(seen, key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("n_dropped")))


def gene_panel_project(expr: DataFrame, genes: DataFrame, panel: DataFrame) -> DataFrame:
    """Restrict to a panel(gene_id, panel_index) and carry its order; a panel gene missing in `genes` fails."""
    if panel.join(genes, "gene_id", "left_anti").limit(1).count():
        raise ValueError("panel gene missing from the gene table")
    return expr.join(panel, "gene_id").drop("gene_index").withColumnRenamed("panel_index", "gene_index")


def min_cells_detected(train: DataFrame, minimum: int) -> DataFrame:
    """Genes non-zero in at least `minimum` training cells (rows are unique per cell and gene)."""
    return (train.where(F.col("value") > 0).groupBy("gene_id").agg(F.count(F.lit(1)).alias("n_cells"))
            .where(F.col("n_cells") >= minimum))


def gene_panel_by_coverage(measured: DataFrame, qs=(0.5, 0.9, 1.0)) -> DataFrame:
    """Per coverage share q: panel size and the spread over datasets of the measured share of the panel."""
    # genes counted by dataset and by how many datasets have them: a few rows, from one pass, that all figures follow from
    held = measured.distinct().withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy("gene_id")))
    counts = cut(held.groupBy("_m", "dataset_id", F.col("gene_id").isNull().alias("_none")).agg(F.count(F.lit(1)).alias("_k")))
    wanted = F.filter(F.array(*[F.lit(float(q)) for q in qs]), lambda q: F.col("_m") >= q * F.col("_n"))
    panel = attach_one(counts, counts.agg(F.count_distinct("dataset_id").alias("_n"))).withColumn("q", F.explode(wanted))
    genes = panel.groupBy("q", "_m").agg((F.sum("_k") / F.col("_m")).cast("bigint").alias("_g"))  # a gene has _m rows
    sizes = genes.groupBy("q").agg(F.sum("_g").alias("n_genes"))
    share = (panel.where(~F.col("_none")).groupBy("q", "dataset_id").agg(F.sum("_k").alias("_k"))
             .join(sizes, "q").withColumn("density", F.col("_k") / F.col("n_genes")))
    spread = share.groupBy("q").agg(F.min("density").alias("density_min"), F.max("density").alias("density_max"))
    return sizes.join(spread, "q").join(quantiles(share, ["q"], "density", {"density_median": 0.5}), "q")


def subsample_cells(cells: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly n rows (all if fewer), chosen by a seeded hash of the identity."""
    ranked = row_rank(cells.withColumn("_k", shuffle_key(seed, key)), [], ["_k", key], "_pos")
    return ranked.where(F.col("_pos") <= n).drop("_k", "_pos")


def limit_per_group(rows: DataFrame, group: str, order, groups: int, per_group: int) -> DataFrame:
    """First m groups in order, then the first n rows of each."""
    first = rows.select(group).distinct().orderBy(group).limit(groups)
    return top_rows(rows.join(first, group, "left_semi"), [group], order, per_group, "_pos").drop("_pos")


def select_primary_profile(files: DataFrame, include_ffpe=False, include_nonprimary=False) -> DataFrame:
    """One tumour profile per patient: first by dataset, patient, sample, file."""
    rows = files.where(F.col("tissue_type") == "Tumor")
    if not include_nonprimary:
        rows = rows.where(F.col("tumor_descriptor") == "Primary")
    if not include_ffpe:
        rows = rows.where(~F.coalesce(F.col("preservation") == "FFPE", F.lit(False)))
    order = ["dataset_id", "patient_id", "sample_id", "file_id"]
    return top_rows(rows, ["patient_id"], order, 1, "_pos").drop("_pos")


def epoch_shuffle(pairs: DataFrame, seed: int, epoch: int) -> DataFrame:
    """Position of every pair in one epoch: shards shuffled, rows shuffled inside each shard."""
    keyed = pairs.withColumn("_s", shuffle_key(f"{seed}:{epoch}:shard", "shard")).withColumn(
        "_r", shuffle_key(f"{seed}:{epoch}:row", "pair_id"))
    return row_rank(keyed, [], ["_s", "_r", "pair_id"], "position").drop("_s", "_r")


def probability_sampling(pairs: DataFrame, shard: str, order: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """n draws with replacement per shard, proportional to max(weight, 0); all-zero shards draw uniformly.

    Weights are counted in whole units, 2**-30 of the power of two below the shard's greatest weight (positive ones at
    least one), so running totals are exact: an interval begins where the one before ends, and every draw meets exactly
    one, in whatever order sums are formed. Intervals are laid on as many equal cells as the shard has rows, so the draw
    lookup is an equi join on (shard, cell): an interval meets about two cells, a draw one.
    """
    w = F.greatest(F.coalesce(F.nanvl(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    rows = with_totals(pairs.withColumn("_w", w), [shard], _mass=F.sum("_w"), _top=F.max("_w"), _rows=F.count(F.lit(1)))
    unit = F.pow(F.lit(2.0), 30 - F.floor(F.log2("_top")))
    units = F.when(F.col("_w") > 0, F.greatest(F.floor(F.col("_w") * unit + 0.5), F.lit(1))).otherwise(F.lit(0))
    rows = rows.withColumn("_w", F.when(F.col("_mass") <= 1e-8, F.lit(1)).otherwise(units).cast("bigint")).drop("_mass", "_top")
    rows = with_totals(rows, [shard], _mass=F.sum("_w"))
    rows = running(rows, [shard], [order], {"_hi": "_w"}).withColumn("_lo", F.col("_hi") - F.col("_w"))
    rows = rows.where(F.col("_w") > 0)
    cell = lambda x: F.floor(x / F.col("_mass") * F.col("_rows"))
    laid = rows.withColumn("_cell", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi")))))
    totals = rows.groupBy(shard).agg(F.max("_mass").alias("_mass"), F.max("_rows").alias("_rows"))
    draws = totals.select(shard, "_mass", "_rows", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw"))
    at = F.least(F.floor(unit_draw(seed, shard, "draw") * F.col("_mass")), F.col("_mass") - 1)
    draws = draws.withColumn("_at", at).withColumn("_cell", cell(F.col("_at")))
    found = draws.select(shard, "draw", "_at", "_cell").join(laid.drop("_mass", "_rows"), [shard, "_cell"])
    return found.where((F.col("_lo") <= F.col("_at")) & (F.col("_at") < F.col("_hi"))).drop(
        "_at", "_cell", "_lo", "_hi", "_w")


def make_batches(pairs: DataFrame, order, size: int, weight: str | None = None, delta: str | None = None) -> DataFrame:
    """batch and slot of every row in order; weight = probability or 1, delta defaults to 1."""
    out = row_rank(pairs, [], order, "_pos")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    d = F.coalesce(F.nanvl(F.col(delta).cast("double"), F.lit(1.0)), F.lit(1.0)) if delta else F.lit(1.0)
    return (out.withColumn("batch", F.floor((F.col("_pos") - 1) / size)).withColumn("slot", (F.col("_pos") - 1) % size)
            .withColumn("weight", w).withColumn("delta", d).drop("_pos"))


def spatial_eligibility(stats: DataFrame, schema: DataFrame, min_genes: int, include_noninteger=False) -> DataFrame:
    """Reason per sample; a later failing check replaces an earlier one."""
    true = lambda c: F.coalesce(F.lower(c) == "true", F.lit(False))
    out = stats.where(F.col("n_genes").try_cast("double") > min_genes).join(schema, "file", "left")
    reason = F.when(~true("spatial_shape_valid"), "invalid_spatial_shape").when(
        ~true("spatial_present"), "missing_spatial").otherwise("eligible")
    if not include_noninteger:
        reason = F.when(~true("x_integer"), "noninteger_expression").otherwise(reason)
    return out.withColumn("eligible_reason", reason)


def response_subset(rows: DataFrame, ici_only: bool) -> DataFrame:
    """Labelled rows, optionally only checkpoint-inhibitor targets."""
    out = rows.where(F.col("response_binary").isNotNull())
    return out.where(F.col("drug_target").isin("PD1", "PDL1", "CTLA4")) if ici_only else out


def profile_matrix(expr: DataFrame, value: str = "value") -> DataFrame:
    """nnz, dimensions and quantiles of the stored values."""
    base = expr.agg(F.count_if(F.col(value) != 0).alias("nnz"), F.count_distinct("gene_id").alias("n_features"),
                    F.count_distinct("cell_id").alias("n_cells"))
    qs = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99, "q100": 1.0}
    return attach_one(base, quantiles(expr, [], value, qs))


def is_count_like(expr: DataFrame, value: str = "value") -> DataFrame:
    """More than 99.9 % non-negative and more than 99.9 % integers, over all finite values."""
    v = F.when(~F.isnan(F.col(value)) & (F.abs(value) != float("inf")), F.col(value))
    share = lambda c: F.avg(F.when(v.isNotNull(), c.cast("double")))
    return expr.agg(share(v >= 0).alias("non_negative"), share(F.abs(v - F.round(v)) < 1e-6).alias("integerish")).withColumn(
        "count_like", (F.col("non_negative") > 0.999) & (F.col("integerish") > 0.999))


# fixed values: patterns that mark a clinical column
CLINICAL_PATTERNS = [
    "os", "overall", "survival", "vital", "death", "dead", "deceased", "pfs", "progression", "progress",
    "recurrence", "recur", "relapse", "dfs", "rfs", "efs", "dss", "pfi", "response", "responder",
    "non.?responder", "recist", "orr", "bor", "pcr", "rcb", "pathologic", "pathological", "treatment",
    "therapy", "treated", "pretreatment", "pre.?treatment", "posttreatment", "post.?treatment", "baseline",
    "timepoint", "time_point", "follow.?up", "followup", "days", "months", "patient", "donor", "case",
    "sample", "subject",
]


def profile_columns(meta: DataFrame, preview: int = 12) -> DataFrame:
    """Per clinical column: non-null count, distinct count, first distinct non-blank values (sorted)."""
    import re

    names = [c for c in meta.columns if any(re.search(p, c, re.I) for p in CLINICAL_PATTERNS)]
    long = meta.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in names])).alias("e")).select("e.*")
    counts = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.groupBy("column").agg(F.sum(F.when(F.col("v").isNotNull(), F.col("_n")).otherwise(0)).alias("non_na"),
                                        F.count("v").alias("unique_n"))
    shown = top_rows(counts.where(F.col("v") != ""), ["column"], ["v"], preview, "_pos")
    shown = shown.groupBy("column").agg(F.array_join(F.sort_array(F.collect_list("v")), "|").alias("preview_values"))
    return base.join(shown, "column", "left").na.fill("", ["preview_values"])
