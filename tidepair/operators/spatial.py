"""Spatial manifests, autocorrelation, gene tables, module scores and response association."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepair.functions.clean import clean, response_binary, slug
from tidepair.operators.neighbors import knn_join
from tidepair.operators.splits import spatial_eligibility
from tidepair.operators.stats import mann_whitney, spearman
from tidepair.plans.ordered import attach_one, bh_fdr, quantiles, row_rank, top_rows, with_totals

# fixed values: gene panels with their mechanism labels
MACROPHAGE_PANEL = {
    "STAB1": "bexmarilimab target/macrophage scavenger receptor", "TFRC": "macrophage activation/iron uptake",
    "CD68": "macrophage compartment", "APOE": "lipid-associated macrophage program", "APOC1": "lipid-associated macrophage program",
    "LPL": "lipid remodeling", "TREM2": "suppressive/lipid-associated macrophage program", "IL4I1": "immunoregulatory macrophage program",
    "IFNG": "IFN-gamma response", "CXCL9": "IFN-gamma-induced chemokine", "CXCL10": "IFN-gamma-induced chemokine",
    "CCL5": "T-cell recruitment/effector program", "CD3D": "TCR complex", "CD3E": "TCR complex", "CD3G": "TCR complex",
    "CD247": "TCR zeta chain", "CD28": "T-cell costimulation", "GZMB": "cytotoxic effector program", "HLA-DRA": "antigen presentation",
    "HLA-DPA1": "antigen presentation", "B2M": "MHC class I antigen presentation", "PECAM1": "vascular compartment",
    "EPCAM": "epithelial/tumor compartment", "KRT8": "epithelial/tumor compartment", "KRT18": "epithelial/tumor compartment",
}
RESISTANCE_PANEL = {
    "IFITM3": "candidate osimertinib-resistance mediator", "MET": "IFITM3-interacting bypass receptor", "EGFR": "osimertinib target pathway",
    "AKT1": "PI3K-AKT survival signaling", "AKT2": "PI3K-AKT survival signaling", "AKT3": "PI3K-AKT survival signaling",
    "PIK3CA": "PI3K-AKT survival signaling", "PIK3R1": "PI3K-AKT survival signaling", "TNF": "TME inflammatory cytokine",
    "IL6": "TME inflammatory cytokine", "IFNG": "TME inflammatory cytokine", "STAT1": "interferon-response signaling",
    "STAT3": "IL6-response signaling", "MKI67": "tumor proliferation", "TOP2A": "tumor proliferation", "BCL2L1": "cell-survival program",
    "MCL1": "cell-survival program", "CXCL9": "interferon-induced chemokine", "CXCL10": "interferon-induced chemokine",
    "EPCAM": "epithelial/tumor compartment", "KRT8": "epithelial/tumor compartment", "KRT18": "epithelial/tumor compartment",
}
FUSION_TARGET_PANEL = {g: "EWS::FLI1 GGAA-microsatellite target" for g in (
    "NR0B1", "IL1RAP", "EZH2", "CAV1", "AKAP7", "CACNB2", "RCOR1", "FCGRT", "FEZF1", "FOCAD")}
# fixed values: label words that mark a tumour spot
TUMOR_WORDS = ["tumor", "malignant", "epithelial", "cancer"]


def panel_table(spark, panel: dict) -> DataFrame:
    return spark.createDataFrame(list(panel.items()), "symbol string, mechanism string")


def spatial_manifest(stats: DataFrame, schema: DataFrame, min_genes: int):
    """(baseline samples with slug ids, one-row summary): eligible files at a baseline time point.

    stats: file, gse_id, patient_id, stem, n_genes, timepoint, response_group.
    """
    ok = spatial_eligibility(stats, schema, min_genes).where(F.col("eligible_reason") == "eligible")
    base = ok.where(F.lower(clean(F.col("timepoint"))).rlike("pre|baseline"))
    rows = base.select(slug(F.concat_ws("__", "gse_id", "patient_id", "stem")).alias("sample_id"), "gse_id", "patient_id", "file",
                       F.when(clean(F.col("response_group")) == "", "NA").otherwise(clean(F.col("response_group"))).alias("response_group"))
    summary = attach_one(rows.agg(F.count(F.lit(1)).alias("baseline_samples"), F.count_distinct("patient_id").alias("patients"),
                                  F.array_join(F.sort_array(F.collect_set("gse_id")), ";").alias("datasets")),
                         ok.agg(F.count(F.lit(1)).alias("eligible_samples")))
    return rows, summary


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def spatial_neighbors(spots: DataFrame, keys, k: int = 8, query_col: str | None = None) -> DataFrame:
    """k nearest spots of the same sample (finite coordinates only)."""
    rows = spots.where(_finite("x") & _finite("y")).withColumn("_xy", F.array("x", "y"))
    return knn_join(rows, keys, "spot_id", "_xy", k, query_col)


def morans_i(values: DataFrame, spots: DataFrame, sample: str, feature=(), k: int = 8) -> DataFrame:
    """Moran's I per sample (and feature) over k-nearest binary weights; null below 4 spots or if constant.

    values(sample, feature.., spot_id, value). Without features, spots whose value is not finite do not
    take part in the neighbourhood; with features all values must be finite and share one neighbour list.
    """
    keys, feature = [sample], list(feature)
    group = keys + feature
    rows = values.where(_finite("value"))
    usable = spots
    if not feature:
        usable = spots.join(rows.select(*keys, "spot_id"), keys + ["spot_id"], "left_semi")
    near = spatial_neighbors(usable, keys, k).select(*keys, "spot_id", "neighbor")
    rows = rows.join(usable.where(_finite("x") & _finite("y")).select(*keys, "spot_id"), keys + ["spot_id"], "left_semi")
    rows = with_totals(rows, group, _mu=F.avg("value"), _sd=F.stddev_pop("value"))
    rows = rows.withColumn("_z", F.col("value") - F.col("_mu"))
    base = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n_spots"), F.sum(F.col("_z") * F.col("_z")).alias("_zz"), F.max("_sd").alias("_sd"))
    left = rows.select(*group, "spot_id", F.col("_z").alias("_zi"))
    right = rows.select(*group, F.col("spot_id").alias("neighbor"), F.col("_z").alias("_zj"))
    cross = left.join(near, keys + ["spot_id"]).join(right, group + ["neighbor"]).groupBy(*group).agg(
        F.sum(F.col("_zi") * F.col("_zj")).alias("_num"), F.count(F.lit(1)).alias("_links"))
    out = base.join(cross, group, "left")
    value = F.when((F.col("n_spots") >= 4) & (F.col("_sd") > 0), F.col("n_spots") / F.col("_links") * F.col("_num") / F.nullif(F.col("_zz"), F.lit(0.0)))
    return out.withColumn("morans_i", value).drop("_zz", "_sd", "_num", "_links")


def segment_label(spots: DataFrame, sample: str, columns=("segment_type", "region_type")) -> DataFrame:
    """First column with any real label in the sample; blanks become 'all'."""
    text = lambda c: F.when(clean(F.col(c)) == "", "all").otherwise(clean(F.col(c)))
    some = {f"_has{i}": F.max((text(c) != "all").cast("int")) for i, c in enumerate(columns)}
    rows = with_totals(spots, [sample], **some)
    out = F.lit("all")
    for i, c in reversed(list(enumerate(columns))):
        out = F.when(F.col(f"_has{i}") == 1, text(c)).otherwise(out)
    return rows.withColumn("segment", out).drop(*some)


def sample_shift_metrics(spots: DataFrame, genes: DataFrame, sample: str) -> DataFrame:
    """Shift spread per sample (spots: sample, shift) and measured gene deltas (genes: sample, measured, delta)."""
    shift = spots.groupBy(sample).agg(F.count(F.lit(1)).alias("observations"), F.avg("shift").alias("shift_mean")).join(
        quantiles(spots, [sample], "shift", {"shift_median": 0.5, "shift_q90": 0.9}), sample)
    d, m = F.col("delta"), F.col("measured")
    gene = genes.groupBy(sample).agg(
        F.count_if(m).alias("measured_genes"), F.avg(m.cast("double")).alias("coverage"),
        F.avg(F.when(m, F.abs(d))).alias("delta_l1_mean"), F.sqrt(F.sum(F.when(m, d * d))).alias("delta_l2"),
        F.count_if(m & (d > 0)).alias("up_genes"), F.count_if(m & (d < 0)).alias("down_genes"))
    return shift.join(gene, sample)


def negative_share(predictions: DataFrame, sample: str) -> DataFrame:
    return predictions.groupBy(sample).agg(F.avg((F.col("pred") < 0).cast("double")).alias("negative_share"))


def gene_table(long: DataFrame, spots: DataFrame, keys) -> DataFrame:
    """Means of pre and predicted per key and gene (zeros implicit: divide by spots), delta and |delta|.

    long(keys.., gene_id, pre, pred) holds stored values; spots(keys..) counts the denominators.
    """
    keys = list(keys)
    n = spots.groupBy(*keys).agg(F.count(F.lit(1)).alias("observations"))
    out = long.groupBy(*keys, "gene_id").agg(F.sum("pre").alias("_a"), F.sum("pred").alias("_b")).join(n, keys)
    out = out.withColumn("pretreatment_mean", F.col("_a") / F.col("observations")).withColumn(
        "predicted_mean", F.col("_b") / F.col("observations")).drop("_a", "_b")
    return out.withColumn("predicted_delta", F.col("predicted_mean") - F.col("pretreatment_mean")).withColumn(
        "abs_delta", F.abs("predicted_delta"))


def hotspot_genes(table: DataFrame, sample: str, panel: DataFrame, n: int = 50) -> DataFrame:
    """Top n measured genes by |delta| per sample, joined with the measured panel genes."""
    measured = table.where("measured")
    top = top_rows(measured, [sample], [F.round("abs_delta", 9).desc(), F.col("gene_id")], n, "_k").select(sample, "gene_id")
    extra = measured.join(panel.select(F.upper("symbol").alias("symbol")).distinct(), "symbol", "left_semi").select(sample, "gene_id")
    return top.unionByName(extra).distinct()


def matched_controls(table: DataFrame, signature: DataFrame, keys, bins: int = 24, per_gene: int = 100) -> DataFrame:
    """Control genes matched on abundance: equal-count bins of the measured genes; every signature gene takes
    the non-signature genes of its bin, at most `per_gene` at even positions when there are more.

    table(keys.., gene_id, gene_index, mean); signature(gene_id). Distinct control genes per key.
    """
    keys = list(keys)
    ranked = row_rank(table.where(F.col("mean").isNotNull()), keys, ["mean", "gene_index"], "_r")
    ranked = with_totals(ranked, keys, _n=F.count(F.lit(1)))
    ranked = ranked.withColumn("bin", F.least(F.floor((F.col("_r") - 1) * bins / F.col("_n")), F.lit(bins - 1)))
    sig = signature.select("gene_id", F.lit(True).alias("_sig")).distinct()
    ranked = ranked.join(sig, "gene_id", "left")
    used = ranked.where("_sig").select(*keys, "bin").distinct()
    cand = ranked.where(F.col("_sig").isNull()).join(used, keys + ["bin"], "left_semi")
    cand = row_rank(cand, keys + ["bin"], ["_r"], "_c")
    cand = with_totals(cand, keys + ["bin"], _l=F.count(F.lit(1)))
    # position p is taken when some j in 0..per_gene-1 has floor(j * (L-1) / (per_gene-1)) = p
    p, span = F.col("_c") - 1, F.col("_l") - 1
    j = F.ceil(p * (per_gene - 1) / F.greatest(span, F.lit(1)))
    even = (j <= per_gene - 1) & (F.floor(j * span / (per_gene - 1)) == p)
    return cand.where((F.col("_l") <= per_gene) | even).select(*keys, "gene_id", "bin")


def module_score(long: DataFrame, signature: DataFrame, controls: DataFrame, spots: DataFrame, sample: str) -> DataFrame:
    """Per spot mean(signature) - mean(controls), before and predicted, with delta; zeros implicit.

    long(sample, spot_id, gene_id, pre, pred); signature(sample, gene_id); controls(sample, gene_id).
    """
    tag = signature.select(sample, "gene_id", F.lit("s").alias("_g")).unionByName(controls.select(sample, "gene_id", F.lit("c").alias("_g")))
    n = tag.groupBy(sample).agg(F.count_if(F.col("_g") == "s").alias("_ns"), F.count_if(F.col("_g") == "c").alias("_nc"))
    side = lambda g, c: F.sum(F.when(F.col("_g") == g, F.col(c)).otherwise(0.0))
    sums = long.join(tag, [sample, "gene_id"]).groupBy(sample, "spot_id").agg(
        *[side(g, c).alias(f"_{g}{c}") for g in "sc" for c in ("pre", "pred")])
    out = spots.select(sample, "spot_id").join(n.where((F.col("_ns") > 0) & (F.col("_nc") > 0)), sample).join(
        sums, [sample, "spot_id"], "left").na.fill(0.0)
    for c in ("pre", "pred"):
        out = out.withColumn("module_" + c, F.try_divide(F.col("_s" + c), F.col("_ns")) - F.try_divide(F.col("_c" + c), F.col("_nc")))
    return out.select(sample, "spot_id", "module_pre", "module_pred", (F.col("module_pred") - F.col("module_pre")).alias("module_delta"))


def module_by_sample(scores: DataFrame, sample: str) -> DataFrame:
    return scores.groupBy(sample).agg(F.avg("module_pre").alias("module_pre_mean"), F.avg("module_pred").alias("module_pred_mean"),
                                      F.avg("module_delta").alias("module_delta_mean")).withColumn(
        "reversal", F.col("module_delta_mean") < 0)


def module_summary(by_sample: DataFrame, patient: str) -> DataFrame:
    base = by_sample.agg(F.count_distinct(patient).alias("patients"), F.avg("module_delta_mean").alias("mean_change"),
                         F.count_if("reversal").alias("with_reversal"))
    return attach_one(base, quantiles(by_sample, [], "module_delta_mean", {"median_change": 0.5}))


def neighbor_spearman(spots: DataFrame, sample: str, target: str, other: str, k: int = 8) -> DataFrame:
    """Spearman of a spot's `target` value with the mean `other` value of its neighbours.

    Tumour-labelled spots if a sample has at least 4 of them, else all spots; neighbours come from all spots.
    """
    words = F.lower("segment_type").rlike("|".join(TUMOR_WORDS))
    rows = with_totals(spots.withColumn("_t", F.coalesce(words, F.lit(False))), [sample], _nt=F.count_if("_t"), _all=F.count(F.lit(1)))
    rows = rows.where(F.col("_all") >= 4).withColumn("_ask", (F.col("_nt") < 4) | F.col("_t"))
    near = spatial_neighbors(rows, [sample], k, "_ask")
    value = rows.select(sample, F.col("spot_id").alias("neighbor"), F.col(other).alias("_v"))
    mean = near.join(value, [sample, "neighbor"]).groupBy(sample, "spot_id").agg(F.avg("_v").alias("neighbor_mean"), F.count(F.lit(1)).alias("n_near"))
    own = rows.where("_ask").select(sample, "spot_id", F.col(target).alias("_own"), "_nt").join(mean, [sample, "spot_id"])
    scope = own.groupBy(sample).agg(F.when(F.max("_nt") >= 4, "tumor_annotated").otherwise("all_observations").alias("target_scope"),
                                    F.max("n_near").alias("neighbors_per_target"))
    return spearman(own, [sample], "_own", "neighbor_mean").join(scope, sample)


def metric_summaries(metrics: DataFrame, key_sets, columns) -> DataFrame:
    """Mean, median and count of metric columns for several key sets (key_set, key as 'a|b')."""
    sets = F.explode(F.array(*[F.struct(F.lit("+".join(ks)).alias("key_set"), F.concat_ws("|", *[
        F.coalesce(F.col(k).cast("string"), F.lit("")) for k in ks]).alias("key")) for ks in key_sets]))
    rows = metrics.select(sets.alias("_s"), *columns).select("_s.*", *columns).unpivot(["key_set", "key"], list(columns), "metric", "value")
    group = ["key_set", "key", "metric"]
    base = rows.groupBy(*group).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    return base.join(quantiles(rows, group, "value", {"median": 0.5}), group, "left")


def response_association(long: DataFrame, keys, fdr_keys=(), drop_small: bool = False) -> DataFrame:
    """Per key: sizes, group means, difference, Mann-Whitney (at least 2 a side) and BH q.

    long(keys.., response_group text, value).
    """
    keys = list(keys)
    rows = long.withColumn("_y", response_binary(F.col("response_group")).cast("int")).where(F.col("_y").isNotNull() & _finite("value"))
    side = lambda y: F.avg(F.when(F.col("_y") == y, F.col("value")))
    means = rows.groupBy(*keys).agg(side(1).alias("mean_responders"), side(0).alias("mean_nonresponders"))
    mw = mann_whitney(rows, keys, "value", "_y").withColumnRenamed("n_1", "responders").withColumnRenamed("n_0", "nonresponders")
    out = means.join(mw, keys)
    enough = (F.col("responders") >= 2) & (F.col("nonresponders") >= 2)
    out = out.withColumn("difference", F.col("mean_responders") - F.col("mean_nonresponders"))
    out = out.withColumn("u_stat", F.when(enough, F.col("u_stat"))).withColumn("p_value", F.when(enough, F.col("p_value"))).drop("tie_sum")
    return bh_fdr(out.where(enough) if drop_small else out, fdr_keys, "p_value", "fdr")


def panel_by_sample(genes: DataFrame, panel: DataFrame) -> DataFrame:
    """Measured panel genes of every sample with their mechanism."""
    return genes.withColumn("symbol", F.upper("gene_symbol")).join(F.broadcast(panel), "symbol")  # panel: a few dozen genes


def panel_summary(rows: DataFrame, keys=("symbol", "mechanism")) -> DataFrame:
    keys = list(keys)
    base = rows.groupBy(*keys).agg(
        F.count_distinct("sample_id").alias("samples"), F.count_distinct("patient_id").alias("patients"),
        F.avg("pretreatment_mean").alias("pretreatment_mean"), F.avg("predicted_mean").alias("predicted_mean"),
        F.avg("predicted_delta").alias("mean_delta"), F.avg((F.col("predicted_delta") > 0).cast("double")).alias("share_up"),
        F.avg((F.col("predicted_delta") < 0).cast("double")).alias("share_down"))
    return base.join(quantiles(rows, keys, "predicted_delta", {"median_delta": 0.5}), keys)


def gene_change_consistency(genes: DataFrame, key: str = "gene_id") -> DataFrame:
    d = F.col("predicted_delta")
    base = genes.groupBy(key).agg(
        F.count("predicted_delta").alias("samples"), F.avg(d).alias("mean_delta"), F.stddev_samp(d).alias("sd_delta"),
        F.avg((d > 0).cast("double")).alias("share_up"), F.avg((d < 0).cast("double")).alias("share_down"), F.avg(F.abs(d)).alias("mean_abs_delta"))
    return base.join(quantiles(genes, [key], "predicted_delta", {"median_delta": 0.5}), key).withColumn(
        "consistency", F.greatest("share_up", "share_down"))


def hotspot_summary(hotspots: DataFrame) -> DataFrame:
    base = hotspots.groupBy("gene_id").agg(F.count_distinct("sample_id").alias("samples"), F.avg("mean_delta").alias("mean_delta"),
                                           F.avg("morans_i").alias("mean_morans_i"))
    return base.join(quantiles(hotspots, ["gene_id"], "morans_i", {"median_morans_i": 0.5}), "gene_id", "left")


def segment_gene_changes(table: DataFrame) -> DataFrame:
    return table.groupBy("segment", "gene_id").agg(
        F.count_distinct("sample_id").alias("samples"), F.avg("pretreatment_mean").alias("pretreatment_mean"),
        F.avg("predicted_mean").alias("predicted_mean"), F.avg("predicted_delta").alias("mean_delta"))


def common_measured_genes(measured: DataFrame, minimum: int = 100) -> DataFrame:
    """Genes measured in every sample; fewer than `minimum` is an error."""
    rows = measured.select("sample_id", "gene_id").distinct()
    n = rows.agg(F.count_distinct("sample_id").alias("_n"))
    out = attach_one(rows.groupBy("gene_id").agg(F.count(F.lit(1)).alias("_k")), n).where(F.col("_k") == F.col("_n")).select("gene_id")
    if out.limit(minimum).count() < minimum:
        raise ValueError("too few common genes")
    return out


def score_delta(scores: DataFrame, ids, columns) -> DataFrame:
    """post - pre of every score column per sample: scores(ids.., timepoint pre/post, columns..)."""
    long = scores.unpivot(list(ids) + ["timepoint"], list(columns), "score", "value")
    at = lambda t: F.max(F.when(F.col("timepoint") == t, F.col("value")))
    out = long.groupBy(*ids, "score").agg(at("pre").alias("pre"), at("post").alias("post"))
    return out.where(F.col("pre").isNotNull() & F.col("post").isNotNull()).withColumn("delta", F.col("post") - F.col("pre"))


def score_delta_summary(deltas: DataFrame) -> DataFrame:
    base = deltas.groupBy("score").agg(F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("sd"), F.count(F.lit(1)).alias("n"))
    return base.join(quantiles(deltas, ["score"], "delta", {"median": 0.5}), "score")
