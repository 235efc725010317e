"""Confidence of probabilistic source -> target edges within each pair-file group."""

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidepair.functions.clean import finite, strip_concat_suffix, to_number
from tidepair.plans.session import broadcast_rows, cut, cut_counted, hot_rows
from tidepair.plans.ordered import attach_one, group_bound, is_hot, join_on, quantiles, row_rank, running, with_totals

EPS = 1e-8
# fixed values: weights of the concentration score and of the combined confidence
CONCENTRATION = {"entropy_confidence": 0.40, "margin": 0.30, "max": 0.30}
COMBINED = {"entropy_confidence": 0.30, "top12_margin": 0.20, "cost_confidence": 0.20,
            "stability_confidence": 0.30}
# fixed value: lowest normalised probability a matrix edge keeps
EDGE_MIN_PROBABILITY = 1e-4
# fixed values: selectable metrics
METRICS = ["probability", "row_probability", "max_coupling", "entropy_confidence", "top12_margin",
           "top12_ratio_log", "effective_target_confidence", "retained_mass", "combined_concentration"]
# fixed values: (lower bound, label) ladders per metric
BANDS = {
    "entropy_confidence": [(0.75, "High confidence"), (0.50, "Moderate confidence"),
                           (0.25, "Low confidence"), (None, "Very low confidence")],
    "top12_margin": [(0.30, "Clear dominant match"), (0.15, "Moderate separation"),
                     (0.05, "Weak separation"), (None, "Highly ambiguous")],
    "stability": [(0.80, "Highly stable"), (0.60, "Moderately stable"), (0.40, "Uncertain"), (None, "Unstable")],
    "retained_mass": [(0.90, "Strongly matched"), (0.70, "Moderately matched"),
                      (0.50, "Weakly matched"), (None, "Potentially unmatched")],
    "cost_confidence": [(0.70, "Low-cost match"), (0.40, "Moderate-cost match"), (None, "High-cost match")],
    "combined_confidence": [(0.75, "High confidence"), (0.50, "Moderate confidence"),
                            (0.25, "Low confidence"), (None, "Very low confidence")],
}


def prepare(edges: DataFrame) -> DataFrame:
    """Suffix-stripped ids and a clean probability (bad -> 0, clipped at 0)."""
    text = dict(edges.dtypes)["probability"] == "string"
    p = to_number(F.col("probability")) if text else finite(F.col("probability"))
    return edges.select(
        "grp", "ord", strip_concat_suffix("source_cell").alias("source_id"),
        strip_concat_suffix("target_cell").alias("target_id"),
        F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(0.0)).alias("probability"))


def prepare_counted(edges: DataFrame) -> tuple[DataFrame, int]:
    """prepare(), written once, and its number of rows: a bound on every group, so that small tables need no counting."""
    return cut_counted(prepare(edges))


def _whole(keys) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.desc("probability"), "ord")


def normalize(edges: DataFrame, side: str, bound: int | None = None) -> DataFrame:
    """Adds <side>_mass and <side>_p = p / (mass + eps): one window, or an aggregate and a join if a cell is hot.

    `bound`: proven number of rows of the largest cell, if known.
    """
    keys, mass = ["grp", side + "_id"], side + "_mass"
    if is_hot(edges, keys, bound):
        out = with_totals(edges, keys, **{mass: F.sum("probability")})
    else:
        out = edges.withColumn(mass, F.sum("probability").over(Window.partitionBy(*keys)))
    return out.withColumn(side + "_p", F.col("probability") / (F.col(mass) + F.lit(EPS)))


def ranked_side(edges: DataFrame, side: str, bound: int | None = None) -> DataFrame:
    """normalize(), and <side>_rank: 1-based rank of the probability inside the cell, ties by input order."""
    keys = ["grp", side + "_id"]
    if is_hot(edges, keys, bound):
        out = normalize(edges, side, hot_rows(edges.sparkSession) + 1)
        return row_rank(out, keys, [(side + "_p", False), ("ord", True)], side + "_rank", edges.select(*keys))
    w = _whole(keys)
    mass = F.sum("probability").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = edges.withColumn(side + "_mass", mass).withColumn(side + "_rank", F.row_number().over(w).cast("bigint"))
    return out.withColumn(side + "_p", F.col("probability") / (F.col(side + "_mass") + F.lit(EPS)))


def measured_side(edges: DataFrame, sizes: DataFrame, side: str, bound: int | None = None) -> DataFrame:
    """ranked_side(), and the metrics of each edge's cell beside the edge: <side>_max, second, margin, ratio, ratio_log,
    entropy, entropy_confidence, effective_n, effective_fraction, effective_confidence.

    Mass, rank, best, second and entropy come from one shuffle and one sort by cell. A hot cell's edges are spread over
    tasks instead, its values aggregated and joined. A group without known size counts as one of two cells.
    """
    keys, p, name = ["grp", side + "_id"], F.col(side + "_p"), lambda m: f"{side}_{m}"
    out = ranked_side(edges, side, bound)
    terms = p * F.log(p + F.lit(EPS))
    if is_hot(edges, keys, bound):
        rank = F.col(side + "_rank")
        cells = out.groupBy(*keys).agg(F.max(F.when(rank == 1, p)).alias(name("max")), F.max(F.when(rank == 2, p)).alias("_second"),
                                       (-F.sum(terms)).alias(name("entropy")))
        out = join_on(out, cells, keys)
    else:
        w = _whole(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out = (out.withColumn(name("max"), F.first(p).over(w)).withColumn("_second", F.nth_value(p, 2).over(w))
               .withColumn(name("entropy"), -F.sum(terms).over(w)))
    other = "n_target" if side == "source" else "n_source"
    out = join_on(out, sizes.select("grp", F.col(other).alias("_n")), ["grp"], "left")
    n = F.greatest(F.coalesce("_n", F.lit(0)), F.lit(2)).cast("double")
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    col = lambda m: F.col(name(m))
    return (out.withColumn(name("second"), F.coalesce("_second", F.lit(0.0)))
            .withColumn(name("margin"), col("max") - col("second"))
            .withColumn(name("ratio"), col("max") / (col("second") + F.lit(EPS)))
            .withColumn(name("ratio_log"), F.log(col("ratio") + F.lit(EPS)))
            .withColumn(name("entropy_confidence"), clip(1 - col("entropy") / F.log(n)))
            .withColumn(name("effective_n"), F.exp(name("entropy")))
            .withColumn(name("effective_fraction"), col("effective_n") / n)
            .withColumn(name("effective_confidence"), clip(1 - (col("effective_n") - 1) / F.greatest(n - 1, F.lit(1.0))))
            .drop("_n", "_second"))


def cells_of(measured: DataFrame, side: str) -> DataFrame:
    """One row per (group, cell): its best edge carries the cell's metrics. Prefixes are dropped."""
    start = side + "_"
    plain = [c for c in measured.columns if c.startswith(start) and c not in (start + "id", start + "p", start + "rank")]
    return measured.where(F.col(start + "rank") == 1).select("grp", start + "id", *[F.col(c).alias(c[len(start):]) for c in plain])


def concentration(cells: DataFrame, side: str, bound: int | None = None, weight: str | None = None) -> DataFrame:
    """combined = weighted average-tie percentile ranks over the group's cells.

    Values are compared at 12 decimals so that summation order cannot break ties. `bound`: proven number of cells of the
    largest group. `weight`: column with the number of equal cells that a row stands for. The three ranks of a group come
    from one shuffle; a hot group's distinct values are counted and joined instead.
    """
    cells = cells.withColumn("_w", F.col(weight) if weight else F.lit(1).cast("bigint"))
    for m in CONCENTRATION:
        cells = cells.withColumn("_" + m, F.round(m, 12))
    hot, names = is_hot(cells, ["grp"], bound), {}
    group = Window.partitionBy("grp")
    if hot:
        cells = with_totals(cells, ["grp"], _all=F.sum("_w"))
    else:
        cells = cells.withColumn("_all", F.sum("_w").over(group))
    for m in CONCENTRATION:
        v = "_" + m
        if hot:
            steps = running(cells.groupBy("grp", v).agg(F.sum("_w").alias("_ties")), ["grp"], [v], {"_upto": "_ties"})
            cells = join_on(cells, steps, ["grp", v])
        else:
            upto = group.orderBy(v).rangeBetween(Window.unboundedPreceding, Window.currentRow)
            cells = cells.withColumn("_upto", F.sum("_w").over(upto)).withColumn("_ties", F.sum("_w").over(Window.partitionBy("grp", v)))
        share = (F.col("_upto") - (F.col("_ties") - 1) / F.lit(2.0)) / F.col("_all")
        names[m] = m.removesuffix("_confidence") + "_rank"
        cells = cells.withColumn(names[m], F.when(F.col("_all") <= 1, 1.0).otherwise(share)).drop("_upto", "_ties")
    combined = sum((F.lit(w) * F.col(names[m]) for m, w in CONCENTRATION.items()), F.lit(0.0))
    return cells.withColumn("combined", combined).drop("_w", "_all", *["_" + m for m in CONCENTRATION])


def measure_edges(edges: DataFrame, sizes: DataFrame) -> tuple[DataFrame, int]:
    """Prepared edges with the metrics of both sides' cells (prefix source_ / target_) and the flags of best edges, written
    once, and their number. One scan and one shuffle a side, whatever is asked of them afterwards."""
    base, n = prepare_counted(edges)
    sizes, groups = cut_counted(sizes)
    sizes = F.broadcast(sizes) if groups <= broadcast_rows(edges.sparkSession) else sizes
    out = measured_side(measured_side(base, sizes, "source", n), sizes, "target", n)
    out = (out.withColumn("is_top1_target", (F.col("source_rank") == 1).cast("int"))
           .withColumn("is_top1_source", (F.col("target_rank") == 1).cast("int"))
           .withColumn("is_mutual_top1", F.col("is_top1_target") * F.col("is_top1_source")))
    return cut(out), n


def add_concentration(measured: DataFrame, sides=("source", "target"), bound: int | None = None) -> DataFrame:
    """Adds <side>_combined (and both_combined): ranks of the cells, joined to their edges. Null ids are cells too."""
    out = measured
    for side in sides:
        key = side + "_id"
        cells = cells_of(measured, side).select("grp", key, *CONCENTRATION)
        ranks = concentration(cells, side, bound).select("grp", key, F.col("combined").alias(side + "_combined"))
        out = join_on(out, ranks, ["grp", key])
    if len(sides) == 2:
        out = out.withColumn("both_combined", 0.5 * (F.col("source_combined") + F.col("target_combined")))
    return out


def score_edges(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """All edge metrics of both sides (prefix source_ / target_).

    Each side's cells are written once with their metrics and ranks; edges stay narrow and meet their two cells, so only the
    metrics that are asked for afterwards ride along, and the edge ranks and flags cost nothing where they are not.
    """
    base, n = prepare_counted(edges)
    sizes, groups = cut_counted(sizes)
    sizes = F.broadcast(sizes) if groups <= broadcast_rows(edges.sparkSession) else sizes
    out, cells = base, {}
    for side in ("source", "target"):
        key = side + "_id"
        bound = group_bound(base, ["grp", key], n)
        own, n_cells = cut_counted(cells_of(measured_side(base, sizes, side, bound), side))
        ranks = concentration(own.select("grp", key, *CONCENTRATION), side, n_cells).select("grp", key, "combined")
        cells[side] = join_on(own, ranks, ["grp", key])
        out = ranked_side(out, side, bound).drop(side + "_mass", side + "_p")
    for side, frame in cells.items():
        key = side + "_id"
        out = join_on(out, frame.select("grp", key, *[F.col(c).alias(f"{side}_{c}") for c in frame.columns if c not in ("grp", key)]), ["grp", key])
        out = out.withColumn(side + "_p", F.col("probability") / (F.col(side + "_mass") + F.lit(EPS)))
    return (out.withColumn("is_top1_target", (F.col("source_rank") == 1).cast("int"))
            .withColumn("is_top1_source", (F.col("target_rank") == 1).cast("int"))
            .withColumn("is_mutual_top1", F.col("is_top1_target") * F.col("is_top1_source"))
            .withColumn("both_combined", 0.5 * (F.col("source_combined") + F.col("target_combined"))))


def confidence_score(metric: str, axis: str = "source") -> Column:
    """Score column of scored edges for one metric and axis (source, target, both)."""
    names = {"row_probability": "p", "max_coupling": "max", "entropy_confidence": "entropy_confidence",
             "top12_margin": "margin", "top12_ratio_log": "ratio_log",
             "effective_target_confidence": "effective_confidence", "retained_mass": "mass",
             "combined_concentration": "combined"}
    if metric == "probability":
        return F.col("probability")
    if metric not in names:
        raise ValueError("unknown metric: " + metric)
    if axis == "both":
        return 0.5 * (F.col("source_" + names[metric]) + F.col("target_" + names[metric]))
    return F.col(("target_" if axis == "target" else "source_") + names[metric])


def select_pairs(scored: DataFrame, selection: str) -> DataFrame:
    """all / top1 / top1_source / top1_target / mutual_top1."""
    flags = {"top1": "is_top1_target", "top1_source": "is_top1_target",
             "top1_target": "is_top1_source", "mutual_top1": "is_mutual_top1"}
    if selection == "all":
        return scored
    return scored.where(F.col(flags[selection]) == 1)


def confidence_select(candidates: DataFrame, keys, score: str, top_fraction: float | None,
                      min_confidence: float | None = None, probe: DataFrame | int | None = None) -> DataFrame:
    """Keep rows at or above the per-group top-fraction threshold (and the floor)."""
    if top_fraction is None and min_confidence is None:
        raise ValueError("give top_fraction, min_confidence or both")
    if top_fraction is None:
        return candidates.where(F.col(score) >= min_confidence).withColumn("threshold", F.lit(min_confidence))
    limits = quantiles(candidates, keys, score, {"threshold": 1.0 - top_fraction}, probe)
    if min_confidence is not None:
        limits = limits.withColumn("threshold", F.greatest("threshold", F.lit(min_confidence)))
    joined = join_on(candidates, limits, keys) if keys else attach_one(candidates, limits)
    return joined.where(F.col(score) >= F.col("threshold"))


def filter_summary(measured: DataFrame, kept: DataFrame, candidates: DataFrame, score: str,
                   bound: int | None = None) -> DataFrame:
    """Per group counts, retained fractions, score spread and medians of the cell metrics.

    Cells are the edges of rank 1 of their side, so counts and medians come from one aggregate of the edges. `bound`:
    proven number of edges; beyond what one task should hold, medians are found from distributed counts.
    """
    best = lambda side, c: F.when(F.col(side + "_rank") == 1, F.col(c))
    metrics = [(s, m) for s in ("source", "target") for m in ("max", "entropy_confidence", "margin")]
    counts = [F.count(F.lit(1)).alias("n_before"), *[F.count(best(s, s + "_rank")).alias(f"unique_{s}s") for s in ("source", "target")]]
    if is_hot(measured, ["grp"], bound):
        frame = measured.groupBy("grp").agg(*counts)
        for s, m in metrics:
            cells = measured.select("grp", best(s, f"{s}_{m}").alias("v"))
            frame = join_on(frame, quantiles(cells, ["grp"], "v", {f"{s}_{m}_median": 0.5}), ["grp"], "left")
    else:
        frame = measured.groupBy("grp").agg(*counts, *[F.percentile(best(s, f"{s}_{m}"), F.lit(0.5)).alias(f"{s}_{m}_median") for s, m in metrics])
    spread = [F.count(F.lit(1)).alias("n_candidates"), F.min(score).alias("score_min"), F.max(score).alias("score_max")]
    if is_hot(candidates, ["grp"], bound):
        cand = join_on(candidates.groupBy("grp").agg(*spread), quantiles(candidates, ["grp"], score, {"score_median": 0.5}), ["grp"], "left")
    else:
        cand = candidates.groupBy("grp").agg(*spread, F.percentile(score, F.lit(0.5)).alias("score_median"))
    after = kept.groupBy("grp").agg(F.count(F.lit(1)).alias("n_after"), F.max("threshold").alias("threshold"))
    frame = join_on(join_on(frame, cand, ["grp"], "left"), after, ["grp"], "left")
    return (frame.na.fill(0, ["n_candidates", "n_after"])
            .withColumn("retained_of_all", F.col("n_after") / F.col("n_before"))
            .withColumn("retained_of_candidates", F.when(F.col("n_candidates") > 0,
                                                         F.col("n_after") / F.col("n_candidates")).otherwise(0.0)))


def matrix_confidence(edges: DataFrame, n_cells: DataFrame, sizes: DataFrame, side: str,
                      min_probability: float = EDGE_MIN_PROBABILITY) -> DataFrame:
    """Edge metrics of one side of a (chunked) transport matrix in long form.

    `grp` names job and chunk; `n_cells` (grp, n_cells) counts this side's cells, also those without an entry: an all-zero
    row has entropy 0, confidence 1, and takes part in the percentile ranks. All of a group's zero rows are one row with
    their number as its weight, so no cell is listed that has no edge.
    """
    cell, p = side + "_id", side + "_p"
    base, bound = prepare_counted(edges)
    measured = cut(measured_side(base, sizes, side, bound))
    cells = cells_of(measured, side)
    zero = {"max": 0.0, "margin": 0.0, "entropy_confidence": 1.0}
    present = cells.groupBy("grp").agg(F.count(F.lit(1)).alias("_present"))
    absent = join_on(n_cells, present, ["grp"], "left").withColumn("_n", F.col("n_cells") - F.coalesce("_present", F.lit(0))).where("_n > 0")
    marked = cells.select("grp", cell, *CONCENTRATION, F.lit(1).cast("bigint").alias("_n"), F.lit(False).alias("_zero"))
    zeros = absent.select("grp", F.lit(None).cast("string").alias(cell), *[F.lit(zero[m]).alias(m) for m in CONCENTRATION], "_n", F.lit(True).alias("_zero"))
    ranks = concentration(marked.unionByName(zeros), side, bound + 1, "_n").where("NOT _zero").select("grp", cell, "combined")
    kept = measured.where(F.col(p) >= min_probability)  # the greatest entries of a cell: ranks stay as they are
    kept = kept.withColumnRenamed(side + "_rank", "rank")
    for c in ("max", "second", "entropy_confidence", "ratio_log"):
        kept = kept.withColumn(c, F.col(f"{side}_{c}"))
    return join_on(kept, ranks, ["grp", cell]).withColumn("is_top1", (F.col("rank") == 1).cast("int"))


def pair_ids(kept: DataFrame, file_col: str = "grp", bound: int | None = None) -> DataFrame:
    """Running pair id over all files in file order; edge id restarts in every file.

    The per-file rank is windowed by file; file offsets come from the small per-file counts,
    so no window covers the whole table. `bound`: proven number of rows.
    """
    per_file = row_rank(kept, [file_col], [("ord", True)], "edge_no", bound)
    counts = kept.groupBy(file_col).agg(F.count(F.lit(1)).alias("_n"))
    offsets = running(counts, [], [file_col], {"_end": "_n"}, bound).select(
        file_col, (F.col("_end") - F.col("_n")).alias("_before"))
    numbered = join_on(per_file, offsets, [file_col]).withColumn("pair_no", F.col("_before") + F.col("edge_no"))
    return (numbered
            .withColumn("pair_id", F.concat_ws("|", file_col, F.concat(F.lit("highconf_pair_"), F.col("pair_no") - 1)))
            .withColumn("edge_id", F.concat_ws("|", file_col, F.concat(F.lit("edge_"), F.col("edge_no") - 1)))
            .drop("_before"))


def combined_confidence(df: DataFrame, out: str = "combined_confidence") -> DataFrame:
    """Weighted sum of four component columns, each clipped to [0,1], missing -> 0."""
    total = F.lit(0.0)
    for c, w in COMBINED.items():
        v = F.coalesce(F.nanvl(F.col(c), F.lit(None)), F.lit(0.0))
        total = total + F.lit(w) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return df.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def training_weight(df: DataFrame, shard: str, confidence: str, gamma: float = 1.0,
                    low: float = 0.2, high: float = 3.0, out: str = "training_weight") -> DataFrame:
    """(max(c,0)+eps)^gamma over its shard mean (before any filter), clipped."""
    c = F.greatest(F.coalesce(F.nanvl(F.col(confidence), F.lit(None)), F.lit(0.0)), F.lit(0.0))
    df = df.withColumn("_raw", F.pow(c + F.lit(EPS), F.lit(gamma)))
    df = with_totals(df, [shard], _mean=F.avg("_raw"))
    weight = F.when(F.col("_mean") <= EPS, 1.0).otherwise(F.col("_raw") / F.col("_mean"))
    return df.withColumn(out, F.greatest(F.lit(low), F.least(F.lit(high), weight))).drop("_raw", "_mean")


def cost_confidence(edges: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """exp(-expected cost / tau), tau = multiplier * group median of the expected costs."""
    expected = edges.groupBy("grp", "source_id").agg(F.sum(F.col("source_p") * F.col("cost")).alias("expected_cost"))
    tau = quantiles(expected, ["grp"], "expected_cost", {"_median": 0.5})
    return expected.join(tau, "grp").withColumn(
        "cost_confidence", F.exp(-F.col("expected_cost") / (F.lit(multiplier) * F.col("_median")))).drop("_median")


def stability_confidence(runs: DataFrame, reference: DataFrame, neighbours: DataFrame, k: int = 5) -> DataFrame:
    """Share of repeat runs whose chosen target is among the k nearest of the reference target.

    runs(source_id, run, target_id); reference(source_id, ref_target); neighbours(target_id, near_id, rank).
    """
    near = neighbours.where(F.col("rank") <= k).select(F.col("target_id").alias("ref_target"),
                                                       F.col("near_id").alias("target_id"), F.lit(1).alias("_hit"))
    joined = runs.join(reference, "source_id").join(near, ["ref_target", "target_id"], "left")
    return joined.groupBy("source_id").agg(
        F.avg(F.coalesce(F.col("_hit"), F.lit(0)).cast("double")).alias("stability_confidence"),
        F.count(F.lit(1)).alias("n_runs"))


def cycle_consistency(ranked: DataFrame, ks=(1, 5, 10)) -> DataFrame:
    """For each source's best target: is the source among the k best of that target?"""
    best = ranked.where(F.col("source_rank") == 1)
    return best.select("grp", "source_id", "target_id", F.col("target_rank").alias("reverse_rank"),
                       *[(F.col("target_rank") <= k).alias(f"cycle_{k}") for k in ks])


def retained_mass_unbalanced(edges: DataFrame, masses: DataFrame) -> DataFrame:
    """Transported mass over prior mass per source cell."""
    moved = edges.groupBy("grp", "source_id").agg(F.sum("probability").alias("moved"))
    return moved.join(masses, ["grp", "source_id"]).withColumn(
        "retained_mass", F.col("moved") / (F.col("prior_mass") + F.lit(EPS)))


def confidence_band(value: Column, metric: str) -> Column:
    """Label ladder of one metric; null stays null."""
    ladder = BANDS[metric]
    out = F.lit(ladder[-1][1])
    for low, label in reversed(ladder[:-1]):
        out = F.when(value >= low, label).otherwise(out)
    return F.when(value.isNotNull(), out)


def pairing_noise(pairs: DataFrame, levels, seed: int = 0) -> DataFrame:
    """Corrupt the targets of a hashed fraction of sources, per noise level.

    Chosen sources exchange targets in a ring (each takes the next chosen source's target),
    so targets keep their distribution. Output: level, source_id, target_id, noisy_target, corrupted.
    """
    unit = F.pmod(F.col("ord") * F.lit(2654435761) + F.lit(seed), F.lit(1000003)) / F.lit(1000003.0)
    spread = pairs.withColumn("_u", unit).withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    chosen = row_rank(spread.where(F.col("_u") < F.col("level")), ["level"], [("ord", True)], "_pos")
    sizes = chosen.groupBy("level").agg(F.count(F.lit(1)).alias("_n"))
    nxt = chosen.join(sizes, "level").select("level", F.when(F.col("_pos") == 1, F.col("_n")).otherwise(
        F.col("_pos") - 1).alias("_pos"), F.col("target_id").alias("noisy_target"))
    moved = chosen.join(nxt, ["level", "_pos"]).select("level", "ord", "noisy_target")
    return spread.join(moved, ["level", "ord"], "left").select(
        "level", "ord", "source_id", "target_id",
        F.coalesce("noisy_target", "target_id").alias("noisy_target"),
        F.col("noisy_target").isNotNull().cast("int").alias("corrupted"))


def noise_detection(noisy: DataFrame, doubt: str) -> DataFrame:
    """How well a score (high: doubtful) finds the corrupted pairs, per noise level: AUPRC first, AUROC, Spearman.

    noisy(level, corrupted, doubt). All three are read off from the distinct scores of a level with their counts, from one
    ranked pass; a level with one class has no value.
    """
    counts, n = cut_counted(noisy.where(F.col(doubt).isNotNull()).groupBy("level", F.col(doubt).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("corrupted").alias("_pos")).withColumn("_neg", -F.col("_v")))
    steps = running(counts, ["level"], ["_neg"], {"_cn": "_n", "_cp": "_pos"}, n)
    totals = counts.groupBy("level").agg(F.sum("_n").alias("n"), F.sum("_pos").alias("n_corrupted"))
    steps = join_on(steps, totals, ["level"])
    rank = F.col("n") - F.col("_cn") + (F.col("_n") + 1) / F.lit(2.0)  # ascending, averaged over ties
    out = steps.groupBy("level", "n", "n_corrupted").agg(
        F.sum(rank * F.col("_pos")).alias("_ranks"), F.sum(F.col("_pos") * F.col("_cp") / F.col("_cn")).alias("_area"),
        F.sum(F.col("_n") * rank * rank).alias("_squares"))
    pos, size = F.col("n_corrupted").cast("double"), F.col("n").cast("double")
    neg, mean = size - pos, (size + 1) / 2
    both = (pos > 0) & (neg > 0)
    spread = F.sqrt((F.col("_squares") - size * mean * mean) * pos * neg / size)  # ranks against a 0/1 label
    return out.select("level", "n", "n_corrupted", F.when(both, (F.col("_ranks") - pos * (pos + 1) / 2) / (pos * neg)).alias("auroc"),
                      F.when(both, F.col("_area") / pos).alias("auprc"),
                      F.when(both & (spread > 0), (F.col("_ranks") - pos * mean) / spread).alias("spearman"))


def min_then_top(pairs: DataFrame, score: str, min_confidence: float, top_fraction: float) -> DataFrame:
    """Floor first, then the top fraction of the survivors."""
    return confidence_select(pairs.where(F.col(score) >= min_confidence), [], score, top_fraction)


def shard_summary(before: DataFrame, kept: DataFrame, shard: str, group: str, score: str) -> DataFrame:
    """Per shard: groups, rows before/after, retained share, score spread before the filter."""
    groups = before.select(shard, group).distinct().groupBy(shard).agg(
        F.array_join(F.sort_array(F.collect_list(group)), ",").alias("groups"))
    base = before.groupBy(shard).agg(F.count(F.lit(1)).alias("n_before"), F.min(score).alias("score_min"),
                                     F.max(score).alias("score_max"))
    after = kept.groupBy(shard).agg(F.count(F.lit(1)).alias("n_after"))
    return (base.join(groups, shard).join(quantiles(before, [shard], score, {"score_median": 0.5}), shard)
            .join(after, shard, "left").na.fill(0, ["n_after"])
            .withColumn("retained", F.col("n_after") / F.col("n_before")))
