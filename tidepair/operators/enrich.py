"""Gene-set enrichment: list splits, rankings, running-sum scores, over-representation and term reports."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepair.functions.clean import clean, clean_term, library_label, parse_overlap
from tidepair.functions.pvalues import hypergeom_greater
from tidepair.operators.splits import shuffle_key
from tidepair.plans.ordered import attach_one, bh_fdr, is_hot, quantiles, row_rank, running, top_rows
from tidepair.plans.session import cut, cut_counted, hot_rows

# fixed values: cut-offs and report sizes
FDR_CUTOFF = 0.05
PLOT_FDR = 0.25
TOP_TERMS = 12
EPS = 1e-6
#: Genes of permutations that one task lists, or keeps of several permutations.
PERMUTED_AT_ONCE = 2_000_000


def split_deg(table: DataFrame, keys, order: str = "ord") -> DataFrame:
    """direction (all / up / down) x first occurrence per symbol, for significant genes with a usable symbol."""
    keys = list(keys)
    sig = table.where((F.col("fdr") <= FDR_CUTOFF) & ~F.isnan("fdr") & (F.col("symbol") != ""))
    side = F.when(F.col("delta") > 0, "up_after_treatment").when(F.col("delta") < 0, "down_after_treatment")
    rows = sig.withColumn("direction", F.explode(F.array_compact(F.array(F.lit("all_degs"), side))))
    return top_rows(rows, keys + ["direction", "symbol"], [order], 1, "_k").select(*keys, "direction", "symbol", order)


def rank_genes_max_abs(table: DataFrame, keys, score: str = "score", order: str = "ord") -> DataFrame:
    """Per symbol the score of largest absolute value (first on a tie)."""
    rows = table.where((F.col("symbol") != "") & F.col(score).isNotNull() & ~F.isnan(score)).withColumn("_a", F.abs(score))
    return top_rows(rows, list(keys) + ["symbol"], [F.desc("_a"), F.col(order)], 1, "_k").drop("_a", "_k")


def rank_genes_mean(table: DataFrame, keys, value: str) -> DataFrame:
    """Mean value per symbol; non-finite means drop out."""
    out = table.groupBy(*keys, "symbol").agg(F.avg(value).alias("score"))
    return out.where(~F.isnan("score") & (F.abs("score") != float("inf")))


def positions(ranked: DataFrame, gene: str = "gene_id", score: str = "score", bound: int | None = None) -> DataFrame:
    """0-based position by score descending; a repeated gene keeps its last position. `bound`: number of rows, if known."""
    pos = row_rank(ranked, [], [(score, False), (gene, True)], "_p", bound).withColumn("pos", F.col("_p") - 1).drop("_p")
    return top_rows(pos, [gene], [F.desc("pos")], 1, "_k").select(F.col(gene).alias("gene_id"), F.col(score).alias("score"), "pos")


def running_es(hits: DataFrame, keys, n_genes: DataFrame, bound: int | None = None) -> DataFrame:
    """Enrichment score from hit rows only (keys, pos, weight).

    The running sum peaks right after a hit and dips right before one; between hits it only falls. `bound`: proven number
    of hits of the largest key; totals and running sums then come from one shuffle and one sort.
    """
    keys = list(keys)
    one = F.lit(1).cast("bigint")
    if bound is not None and not is_hot(hits, keys, bound):
        w = Window.partitionBy(*keys).orderBy("pos")
        every, upto = (w.rowsBetween(Window.unboundedPreceding, end) for end in (Window.unboundedFollowing, Window.currentRow))
        rows = (hits.withColumn("n_hit", F.count(one).over(every)).withColumn("_w", F.sum("weight").over(every))
                .withColumn("_i", F.count(one).over(upto)).withColumn("_cw", F.sum("weight").over(upto)))
        flat = F.col("_w") > 0
        rows = rows.select(*keys, "pos", "n_hit", "_i", F.when(flat, F.col("weight")).otherwise(1.0).alias("_x"),
                           F.when(flat, F.col("_cw")).otherwise(F.col("_i").cast("double")).alias("_cw"),
                           F.when(flat, F.col("_w")).otherwise(F.col("n_hit").cast("double")).alias("_w"))
        rows = attach_one(rows, n_genes)
    else:
        size = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_hit"), F.sum("weight").alias("_w"))
        rows = hits.join(size, keys).withColumn("_x", F.when(F.col("_w") > 0, F.col("weight")).otherwise(1.0))
        rows = rows.withColumn("_w", F.when(F.col("_w") > 0, F.col("_w")).otherwise(F.col("n_hit").cast("double")))
        rows = running(attach_one(rows, n_genes), keys, ["pos"], {"_cw": "_x", "_i": one})
    miss = F.col("n_genes") - F.col("n_hit")
    fall = (F.col("pos") - (F.col("_i") - 1)) / F.nullif(miss, F.lit(0))
    after, before = F.col("_cw") / F.col("_w") - fall, (F.col("_cw") - F.col("_x")) / F.col("_w") - fall
    out = rows.groupBy(*keys).agg(F.max("n_hit").alias("n_hit"), F.greatest(F.max(after), F.lit(0.0)).alias("_hi"),
                                  F.least(F.min(before), F.lit(0.0)).alias("_lo"), F.max("n_genes").alias("n_genes"))
    up = F.round(F.abs("_hi"), 12) >= F.round(F.abs("_lo"), 12)
    es = F.when(F.col("n_genes") == F.col("n_hit"), 0.0).otherwise(F.when(up, F.col("_hi")).otherwise(F.col("_lo")))
    return out.withColumn("es", es).drop("_hi", "_lo", "n_genes")


def _placed(ranked: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Positions, written once in as many parts as tasks should read them; the number of ranked genes, as a frame and a number."""
    ranked, n = cut_counted(ranked)
    pos = positions(ranked, bound=n).repartition(ranked.sparkSession.sparkContext.defaultParallelism, "gene_id")
    return cut(pos), ranked.agg(F.count(F.lit(1)).alias("n_genes")), n


def _set_scores(pos: DataFrame, n_genes: DataFrame, n: int, sets: DataFrame, min_overlap: int) -> DataFrame:
    hits = sets.distinct().join(pos, "gene_id").select("set_name", "pos", F.abs("score").alias("weight"))
    return running_es(hits, ["set_name"], n_genes, n).where(F.col("n_hit") >= min_overlap)


def gsea_es(ranked: DataFrame, sets: DataFrame, min_overlap: int = 1) -> DataFrame:
    """Preranked ES per set(set_name, gene_id), weight |score|."""
    return _set_scores(*_placed(ranked), sets, min_overlap)


def _prefix_scores(order, pos, weight, sizes, n: int):
    """Enrichment score of the first s genes of an order (their places in it, positions and weights), for every s of sizes."""
    by = np.argsort(pos)
    order, pos, weight, out = order[by], pos[by], weight[by], {}
    for size in sorted(sizes, reverse=True):
        keep = order < size
        order, pos, weight = order[keep], pos[keep], weight[keep]
        total = weight.sum()
        step, total = (weight, total) if total > 0 else (np.ones(size), float(size))
        upto = np.cumsum(step)
        fall = (pos - np.arange(size)) / max(n - size, 1)
        high, low = max((upto / total - fall).max(), 0.0), min(((upto - step) / total - fall).min(), 0.0)
        out[size] = 0.0 if size == n else high if round(abs(high), 12) >= round(abs(low), 12) else low
    return out


def _null_in_place(pos: DataFrame, n: int, sizes, permutations: int, seed: int) -> DataFrame:
    """Null scores (n_hit, _null) of every size and permutation, a permutation within one task.

    Each task reads all genes past its permutations and keeps those that can be among the first of an order: their keys are
    evenly spread, so a bound on the key leaves little more than the largest set needs. Nothing is shuffled.
    """
    most, spark = max(sizes), pos.sparkSession
    share = (most + 12 * most ** 0.5 + 100) / n
    lot = max(1, min(-(-permutations // (4 * spark.sparkContext.defaultParallelism)), PERMUTED_AT_ONCE // most))
    perms = spark.range(1, permutations + 1, 1, -(-permutations // lot)).withColumnRenamed("id", "perm")
    key = shuffle_key(seed, "perm", "gene_id")
    low = key < F.lit(format(int(share * 2 ** 128), "032x")) if share < 1 else F.lit(True)
    drawn = pos.coalesce(1).hint("shuffle_replicate_nl").crossJoin(perms).where(low).select(
        "perm", "pos", F.abs("score").alias("weight"), F.unhex(key).alias("key"))

    def key_words(keys):
        words = np.frombuffer(keys.buffers()[2], ">u8", 2 * len(keys), 16 * keys.offset).astype("u8").reshape(-1, 2)
        return words[:, 0], words[:, 1]

    def score(batches):
        kept = [[*[np.asarray(b.column(c)) for c in ("perm", "pos", "weight")], *key_words(b.column("key"))] for b in batches if b.num_rows]
        if not kept:
            return
        perm, place, weight, high, low = (np.concatenate(x) for x in zip(*kept, strict=True))
        by = np.lexsort((low, high, perm))
        perm, place, weight = perm[by], place[by], weight[by]
        for one in np.unique(perm):
            start, end = np.searchsorted(perm, [one, one + 1])
            if end - start < most:
                raise RuntimeError(f"permutation {one}: {end - start} genes up to the bound on the key, {most} wanted")
            first = slice(start, start + most)
            found = _prefix_scores(np.arange(most), place[first], weight[first], sizes, n)
            yield pa.RecordBatch.from_pydict({"n_hit": pa.array(found.keys(), "int64"), "_null": pa.array(found.values(), "float64")})

    return drawn.mapInArrow(score, "n_hit long, _null double")


def gsea_nes(ranked: DataFrame, sets: DataFrame, permutations: int = 1000, min_overlap: int = 1, seed: int = 0) -> DataFrame:
    """ES with a permutation null: NES, p, BH q and the first 50 hit genes.

    The null depends on the set size only: one seeded gene order per permutation serves every
    size by its prefix, so the null costs permutations x (sum of distinct sizes), not x sets. Positions and observed
    scores are written once; tasks keep no more of a permutation than the largest set needs. Where that is too much for a
    task, orders are ranked and summed in parts.
    """
    pos, n_genes, n = _placed(ranked)
    spark = ranked.sparkSession
    observed, n_sets = cut_counted(_set_scores(pos, n_genes, n, sets, min_overlap))
    sizes = observed.select("n_hit").distinct()
    listed = [r[0] for r in sizes.collect()]  # at most the number of genes
    most = max(listed, default=0)
    if 0 < most <= hot_rows(spark):
        null = _null_in_place(pos, n, listed, permutations, seed)
    else:
        dealt = pos.repartition(max(spark.sparkContext.defaultParallelism, -(-n * permutations // PERMUTED_AT_ONCE)))
        perms = dealt.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations)))).withColumn(
            "_k", shuffle_key(seed, "perm", "gene_id"))
        # first `most` genes of every permutation's order
        order = row_rank(perms, ["perm"], [("_k", True), ("gene_id", True)], "_r", n).where(F.col("_r") <= most)
        every = sizes.agg(F.sort_array(F.collect_set("n_hit")).alias("_sizes"))  # distinct sizes, at most the gene panel
        null = attach_one(order, every).select(
            "perm", "pos", F.abs("score").alias("weight"), F.explode(F.filter("_sizes", lambda s: s >= F.col("_r"))).alias("size"))
        null = running_es(null, ["size", "perm"], n_genes, most).select(F.col("size").alias("n_hit"), F.col("es").alias("_null"))
    rows = observed.join(null, "n_hit")
    same = F.when(F.col("es") >= 0, F.col("_null") >= 0).otherwise(F.col("_null") < 0)
    beyond = F.when(F.col("es") >= 0, F.round("_null", 12) >= F.round("es", 12)).otherwise(F.round("_null", 12) <= F.round("es", 12))
    out = rows.groupBy("set_name", "n_hit", "es").agg(
        F.coalesce(F.abs(F.avg(F.when(same, F.col("_null")))), F.lit(1.0)).alias("_d"),
        ((F.count_if(beyond) + 1) / F.lit(float(permutations + 1))).alias("p_value"))
    lead = top_rows(sets.distinct().join(pos, "gene_id"), ["set_name"], ["pos"], 50, "_k")
    lead = lead.groupBy("set_name").agg(F.sort_array(F.collect_list(F.struct("pos", "gene_id"))).alias("_g")).select(
        "set_name", F.array_join(F.transform("_g", lambda x: x["gene_id"]), ";").alias("leading_edge_genes"))
    out = out.withColumn("nes", F.col("es") / (F.col("_d") + EPS)).drop("_d").join(lead, "set_name")
    return bh_fdr(cut(out), [], "p_value", "fdr", n_sets)


def ora(genes: DataFrame, keys, sets: DataFrame, background: DataFrame, min_genes: int = 5) -> DataFrame:
    """Over-representation of gene lists (keys, gene_id) in sets: overlap, odds ratio, one-sided p, BH per list."""
    keys = list(keys)
    genes = genes.distinct()
    n = background.agg(F.count(F.lit(1)).alias("n_background"))
    lists = genes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_list")).where(F.col("n_list") >= min_genes)
    size = sets.distinct().groupBy("set_name").agg(F.count(F.lit(1)).alias("n_set"))
    hit = genes.join(sets.distinct(), "gene_id").groupBy(*keys, "set_name").agg(F.count(F.lit(1)).alias("n_overlap"))
    out = attach_one(hit.join(lists, keys).join(size, "set_name"), n)
    a = F.col("n_overlap")
    b, c = F.col("n_list") - a, F.col("n_set") - a
    d = F.col("n_background") - F.col("n_list") - c
    out = out.withColumn("odds_ratio", F.when(b * c > 0, a * d / (b * c))).withColumn(
        "overlap", F.concat_ws("/", "n_overlap", "n_set")).withColumn("p_value", hypergeom_greater(a, b, c, d))
    return bh_fdr(out, keys, "p_value", "fdr")


def enrichment_contexts(rows: DataFrame, min_patients: int = 3) -> DataFrame:
    """Rows repeated under global, dataset, response and segment contexts with enough patients."""
    real = lambda c: F.when(~F.lower(clean(F.col(c))).isin("", "na", "mixed"), clean(F.col(c)))
    seg = F.when(clean(F.col("segment_type")) == "", "all").otherwise(clean(F.col("segment_type")))
    pair = lambda t, c: F.struct(F.lit(t).alias("context_type"), c.alias("context"))
    options = F.array(pair("global", F.lit("all_baselines")), pair("dataset", real("dataset_id")),
                      pair("response", real("response_group")), pair("segment", seg))
    out = rows.withColumn("_c", F.explode(F.filter(options, lambda x: x["context"].isNotNull()))).select("*", "_c.*").drop("_c")
    enough = out.groupBy("context_type", "context").agg(F.count_distinct("patient_id").alias("_n")).where(
        (F.col("_n") >= min_patients) | (F.col("context_type") == "global"))
    return out.join(enough.select("context_type", "context"), ["context_type", "context"], "left_semi")


def pathway_coverage_filter(ranked: DataFrame, keys, sets: DataFrame, coverage: float = 0.2, low: int = 15, high: int = 500) -> DataFrame:
    """Sets kept per context by coverage and overlap size; plus the context's median coverage."""
    keys = list(keys)
    size = sets.distinct().groupBy("set_name").agg(F.count(F.lit(1)).alias("n_set"))
    hit = ranked.select(*keys, "gene_id").distinct().join(sets.distinct(), "gene_id").groupBy(*keys, "set_name").agg(
        F.count(F.lit(1)).alias("n_overlap")).join(size, "set_name")
    kept = hit.withColumn("coverage", F.col("n_overlap") / F.col("n_set")).where(
        (F.col("coverage") >= coverage) & F.col("n_overlap").between(low, high))
    return kept.join(quantiles(kept, keys, "coverage", {"median_coverage": 0.5}), keys)


def directional_terms(terms: DataFrame, keys, n: int = TOP_TERMS) -> DataFrame:
    """Terms with 0 < q <= .25, signed -log10 q by direction, top n by |score| per context."""
    rows = terms.where((F.col("fdr") > 0) & (F.col("fdr") <= PLOT_FDR) & (F.col("term") != "")
                       & F.col("direction").isin("up_after_treatment", "down_after_treatment"))
    size = -F.log10(F.greatest(F.col("fdr"), F.lit(1e-300)))
    rows = rows.withColumn("score", F.when(F.col("direction") == "up_after_treatment", size).otherwise(-size))
    rows = rows.withColumn("plot_term", F.concat(clean_term(F.col("term")), F.lit(" ["), library_label(F.col("library")), F.lit("]")))
    order = [F.round(F.abs("score"), 9).desc(), F.col("direction"), F.col("library"), F.col("term")]
    return top_rows(rows, keys, order, n, "term_rank")


def combine_terms(terms: DataFrame) -> DataFrame:
    """Result rows with parsed overlap and -log10 p / q; rows without a positive q drop out."""
    k, n = parse_overlap(F.col("overlap"))
    name = clean_term(F.col("term"), 100)
    neg = lambda c: -F.log10(F.greatest(F.col(c), F.lit(1e-300)))
    return terms.where((F.col("fdr") > 0) & (F.col("term") != "")).select(
        "*", name.alias("clean_term"), F.concat(name, F.lit(" ["), library_label(F.col("library"), False), F.lit("]")).alias("term_label"),
        k.alias("overlap_count"), n.alias("overlap_total"), F.when(F.col("p_value") > 0, neg("p_value")).alias("neg_log10_p"),
        neg("fdr").alias("neg_log10_fdr"))


def choose_terms(combined: DataFrame, per_category: int = 10, total: int = 20, p_cutoff: float = 0.05) -> DataFrame:
    """Per category the strongest terms by -log10 p then overlap; distinct terms by best score."""
    score = F.round(F.coalesce(F.col("neg_log10_p"), F.lit(0.0)), 9)
    rows = combined.withColumn("_s", score)
    order = [F.desc("_s"), F.desc("overlap_count"), F.col("term_label"), F.col("direction")]
    picked = top_rows(rows.where(F.col("p_value") <= p_cutoff), ["category"], order, per_category, "_k").select("term_label").distinct()
    best = rows.groupBy("term_label").agg(F.max("_s").alias("best_score")).join(picked, "term_label", "left_semi")
    return top_rows(best, [], [F.desc("best_score"), F.col("term_label")], total, "term_rank")
