"""Model-selection reports over training logs and evaluation records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepair.plans.ordered import row_rank, top_rows, with_totals

# fixed values: selection metric of the population-loss arms and of every other arm
POPULATION_METRIC = "loss"
DEFAULT_METRIC = "loss_pair"
# fixed values: weights of the composite score
COMPOSITE = {"role": 0.5, "recon": 0.3, "mix": 0.2}


def arm_metric(arm: str, population_arms) -> Column:
    """Value of the arm's own selection metric: the full loss for population-loss arms, else the pair loss."""
    return F.when(F.col(arm).isin(list(population_arms)), F.col(POPULATION_METRIC)).otherwise(F.col(DEFAULT_METRIC))


def best_epoch(logs: DataFrame, run, metric: Column, order: str = "epoch") -> DataFrame:
    """First row of minimum metric per run; the other metrics are those of that epoch."""
    rows = logs.withColumn("best", metric).where(F.col("best").isNotNull() & ~F.isnan("best"))
    epochs = logs.groupBy(*run).agg(F.count(F.lit(1)).alias("n_epochs"))
    return top_rows(rows, run, ["best", order], 1, "_k").drop("_k").join(epochs, list(run))


def run_aggregate(best: DataFrame, config, arm: str, extra=()) -> DataFrame:
    """Mean and population sd of the best metric over folds; rank inside the arm."""
    out = best.groupBy(*config, arm).agg(F.count(F.lit(1)).alias("n_folds"), F.avg("best").alias("best_mean"),
                                         F.stddev_pop("best").alias("best_sd"), *[F.avg(c).alias(c) for c in extra])
    keyed = out.withColumn("_b", F.round("best_mean", 9))
    return row_rank(keyed, [arm], ["_b", *config], "arm_rank").drop("_b")


def is_floor(level: str, config: str) -> Column:
    return F.col(level).cast("string").isin("0", "0.0") | F.col(config).cast("string").contains("identity")


def vs_floor(agg: DataFrame, arm: str, level: str, config: str, top: int) -> DataFrame:
    """% improvement over the best level-0 run of the arm, null without a positive one; the top beaters are promoted.

    Means are compared at nine digits: equal runs neither beat nor miss the floor by the order in which they were summed.
    """
    best = F.col("_mean")
    rows = agg.withColumn("_floor", is_floor(level, config)).withColumn("_mean", F.round("best_mean", 9))
    rows = with_totals(rows, [arm], floor=F.min(F.when(F.col("_floor"), best)))
    rows = rows.withColumn("improvement_pct", F.when(F.col("floor") > 0, 100.0 * (F.col("floor") - best) / F.col("floor")))
    rows = rows.withColumn("beats_floor", F.coalesce(~F.col("_floor") & (best < F.col("floor")), F.lit(False)))
    promoted = top_rows(rows.where("beats_floor"), [arm], [best, F.col(config)], top, "_k").select(
        arm, config, F.lit(True).alias("promoted"))
    return rows.join(promoted, [arm, config], "left").na.fill(False, ["promoted"]).drop("_floor", "_mean")


def cross_arm(agg: DataFrame, mmd: str, arm: str, level: str, config: str) -> DataFrame:
    """All runs with a population metric, ranked across arms, and whether they beat the best floor."""
    rows = agg.where(F.col(mmd).isNotNull() & ~F.isnan(mmd)).withColumn("_floor", is_floor(level, config)).withColumn("_m", F.round(mmd, 9))
    rows = with_totals(rows, [], best_floor=F.min(F.when(F.col("_floor"), F.col(mmd))))
    rows = rows.withColumn("beats_floor", F.coalesce(~F.col("_floor") & (F.col(mmd) < F.col("best_floor")), F.lit(False)))
    return row_rank(rows, [], ["_m", arm, config], "cross_rank").drop("_m", "_floor")


def composite_rank(records: DataFrame, config: str, weights=None) -> DataFrame:
    """Fold means of Pearson, mixing ratio and role ratio; min-max scaled; weighted score and ranks.

    records: config, pearson, same_study, study_chance, same_role, role_chance.
    """
    w = {**COMPOSITE, **(weights or {})}
    low = F.lit(1e-12)
    rows = records.withColumn("_mix", F.col("same_study") / F.greatest(F.col("study_chance"), low)).withColumn(
        "_role", F.col("same_role") / F.greatest(F.col("role_chance"), low))
    out = rows.groupBy(config).agg(F.count(F.lit(1)).alias("n_folds"), F.avg("pearson").alias("recon"), F.stddev_pop("pearson").alias("recon_sd"),
                                   F.avg("_mix").alias("mix"), F.avg("_role").alias("role"))
    ends = {f"_{e}_{c}": fn(c) for c in w for e, fn in (("lo", F.min), ("hi", F.max))}
    out = with_totals(out, [], **ends)
    score = F.lit(0.0)
    for c, weight in w.items():
        span = F.col("_hi_" + c) - F.col("_lo_" + c)
        unit = F.when(span < 1e-12, 0.5).otherwise((F.col(c) - F.col("_lo_" + c)) / F.nullif(span, F.lit(0.0)))
        score = score + F.lit(weight) * (F.when(span < 1e-12, 0.5).otherwise(1 - unit) if c == "mix" else unit)
    out = out.withColumn("score", score / sum(w.values())).drop(*ends)
    for name, col, up in (("score_rank", "score", False), ("recon_rank", "recon", False), ("mix_rank", "mix", True), ("role_rank", "role", False)):
        out = row_rank(out.withColumn("_o", F.round(col, 9)), [], [("_o", up), (config, True)], name).drop("_o")
    return out


def loss_screen(logs: DataFrame, run, tag: str, fold: str, final_epoch: int = 49, by: str = "loss_pair", metrics=()) -> DataFrame:
    """Complete runs only: best-epoch and last-epoch metrics averaged over folds by tag, ranked by four keys."""
    run = list(run)
    last = top_rows(logs, run, [F.desc("epoch")], 1, "_k").drop("_k").where(F.col("epoch") == final_epoch)
    best = top_rows(logs.join(last.select(*run), run, "left_semi"), run, [F.col(by), F.col("epoch")], 1, "_k")
    names = [by, *metrics]
    final = last.select(*run, tag, fold, *[F.col(c).alias("final_" + c) for c in names])
    joined = final.join(best.select(*run, *[F.col(c).alias("best_" + c) for c in names]), run)
    out = joined.groupBy(tag).agg(F.count_distinct(fold).alias("n_folds"), *[
        F.avg(f"{w}_{c}").alias(f"mean_{w}_{c}") for w in ("best", "final") for c in names])
    order = [f"mean_best_{by}", f"mean_final_{by}"] + [f"mean_final_{c}" for c in metrics]
    keyed = out
    for i, c in enumerate(order):
        keyed = keyed.withColumn(f"_o{i}", F.round(c, 9))
    return row_rank(keyed, [], [*[f"_o{i}" for i in range(len(order))], tag], "screen_rank").drop(*[f"_o{i}" for i in range(len(order))])
