"""Group statistics: tests, rank statistics, agreement and resampling."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepair.functions.pvalues import mannwhitney_p, student_t_p, wilcoxon_p
from tidepair.plans.ordered import attach_one, avg_rank, join_on, quantiles, row_rank, running, with_totals
from tidepair.plans.session import broadcast_rows, cut, cut_counted, hot_rows


def safe_corr(x, y) -> Column:
    """Pearson aggregate that is null (not an error) for a constant or single-row side."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    r = F.try_divide(F.covar_pop(x, y), spread)
    return F.when(spread > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def t_columns(n: Column, mean: Column, m2: Column, low: Column, high: Column, first: Column):
    """(t, p) of a one-sample t on n values with mean, squared deviations, range and first value.

    All values close to the first give t=0, p=1; fewer than two values give null.
    """
    tol = F.lit(1e-8) + F.lit(1e-5) * F.abs(first)
    same = (high - first <= tol) & (first - low <= tol)
    se = F.sqrt(m2 / F.greatest(n - 1, F.lit(1)) / F.nullif(n, F.lit(0)))
    t = F.when(n >= 2, F.when(same, 0.0).otherwise(F.when(se > 0, mean / se)))
    p = F.when(n >= 2, F.when(same, 1.0).otherwise(student_t_p(t, (n - 1).cast("double"))))
    return t, p


def one_sample_t(df: DataFrame, keys, delta: str, order: str) -> DataFrame:
    """t of `delta` against 0 per group; `order` names the first replicate."""
    out = df.groupBy(*keys).agg(
        F.count(delta).alias("n_replicates"), F.avg(delta).alias("mean_delta"),
        (F.var_pop(delta) * F.count(delta)).alias("_m2"), F.min(delta).alias("_lo"), F.max(delta).alias("_hi"),
        F.min_by(delta, order).alias("_first"))
    t, p = t_columns(*[F.col(c) for c in ("n_replicates", "mean_delta", "_m2", "_lo", "_hi", "_first")])
    return out.withColumn("t_stat", t).withColumn("p_value", p).drop("_m2", "_lo", "_hi", "_first")


def zscore_within(df: DataFrame, keys, value: str, out: str, sample: bool = True) -> DataFrame:
    """(x - mean) / sd per group; a zero sd gives null (population form: sd 0 counts as 1)."""
    sd = F.stddev_samp(value) if sample else F.stddev_pop(value)
    df = with_totals(df, keys, _mu=F.avg(value), _sd=sd)
    scale = F.nullif(F.col("_sd"), F.lit(0.0)) if sample else F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd"))
    return df.withColumn(out, (F.col(value) - F.col("_mu")) / scale).drop("_mu", "_sd")


def _labelled(df, keys, score, label):
    """Per group and distinct score: n, positives, cumulative counts (ascending score)."""
    counts = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, score).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_pos"))
    return counts


def auroc(df: DataFrame, keys, score: str, label: str, min_rows: int = 3, probe=None) -> DataFrame:
    """Area under the ROC curve from average-tie ranks; null below min_rows or with one class.

    Also n, n_pos. Works on distinct scores, so ties and repeats shrink before any sort.
    """
    keys = list(keys)
    steps = running(_labelled(df, keys, score, label), keys, [score], {"_cum": "_n"}, probe)
    rank = F.col("_cum") - (F.col("_n") - 1) / F.lit(2.0)
    out = steps.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum("_pos").alias("n_pos"),
                                   F.sum(rank * F.col("_pos")).alias("_ranks"))
    neg = F.col("n") - F.col("n_pos")
    area = F.try_divide(F.col("_ranks") - F.col("n_pos") * (F.col("n_pos") + 1) / F.lit(2.0), F.col("n_pos") * neg)
    return out.withColumn("auroc", F.when((F.col("n") >= min_rows) & (F.col("n_pos") > 0) & (neg > 0), area)).drop("_ranks")


def auprc(df: DataFrame, keys, score: str, label: str, min_rows: int = 3, probe=None) -> DataFrame:
    """Average precision, one step per distinct score (descending)."""
    keys = list(keys)
    counts = _labelled(df, keys, score, label).withColumn("_neg", -F.col(score))
    steps = running(counts, keys, ["_neg"], {"_cn": "_n", "_cp": "_pos"}, probe)
    out = steps.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum("_pos").alias("n_pos"),
                                   F.sum(F.col("_pos") * F.col("_cp") / F.col("_cn")).alias("_area"))
    both = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n")) & (F.col("n") >= min_rows)
    return out.withColumn("auprc", F.when(both, F.col("_area") / F.col("n_pos"))).drop("_area")


def cohen_d(df: DataFrame, keys, value: str, label: str) -> DataFrame:
    """Pooled-sd difference of label 1 minus label 0; null with fewer than 2 values a side or zero sd."""
    side = lambda fn, k: fn(F.when(F.col(label) == k, F.col(value)))
    out = df.groupBy(*keys).agg(
        side(F.avg, 1).alias("mean_1"), side(F.avg, 0).alias("mean_0"), side(F.var_samp, 1).alias("_v1"),
        side(F.var_samp, 0).alias("_v0"), side(F.count, 1).alias("n_1"), side(F.count, 0).alias("n_0"))
    pooled = F.sqrt(F.try_divide((F.col("n_1") - 1) * F.col("_v1") + (F.col("n_0") - 1) * F.col("_v0"), F.col("n_1") + F.col("n_0") - 2))
    ok = (F.col("n_1") >= 2) & (F.col("n_0") >= 2) & (pooled > 0)
    return out.withColumn("cohen_d", F.when(ok, (F.col("mean_1") - F.col("mean_0")) / pooled)).drop("_v1", "_v0")


def spearman(df: DataFrame, keys, x: str, y: str, probe=None) -> DataFrame:
    """Correlation of average-tie ranks (null for a constant side) and its t-based p.

    Equal pairs of values are counted first and written once; both sides' ranks are read off from their counts, and the
    pairs meet them with their number as weight. So rows are shuffled once, and less the more of them are equal.
    """
    keys = list(keys)
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
    pairs, bound = cut_counted(both.groupBy(*keys, "_x", "_y").agg(F.count(F.lit(1)).alias("_n")))
    sizes = pairs.groupBy(*keys).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))
    ranked = join_on(pairs, sizes, keys) if keys else attach_one(pairs, sizes)
    for v in ("_x", "_y"):
        steps = running(pairs.groupBy(*keys, v).agg(F.sum("_n").alias("_t")), keys, [v], {"_cum": "_t"}, bound)
        centred = F.col("_cum") - (F.col("_t") - 1) / F.lit(2.0)
        ranked = join_on(ranked, steps.select(*keys, v, centred.alias("_r" + v)), [*keys, v])
    rx, ry, w = [F.col("_r" + v) - (F.col("n") + 1) / F.lit(2.0) for v in ("_x", "_y")] + [F.col("_n")]
    out = ranked.groupBy(*keys).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.sum(w * rx * ry).alias("_xy"), F.sum(w * rx * rx).alias("_xx"), F.sum(w * ry * ry).alias("_yy"))
    spread = F.sqrt("_xx") * F.sqrt("_yy")
    out = out.withColumn("rho", F.when(spread > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_xy") / spread)))).drop("_xy", "_xx", "_yy")
    df_ = (F.col("n") - 2).cast("double")
    t = F.when((F.col("n") > 2) & F.col("rho").isNotNull(), F.when(F.abs("rho") >= 1, F.lit(float("inf"))).otherwise(
        F.col("rho") * F.sqrt(df_ / (1 - F.col("rho") * F.col("rho")))))
    return out.withColumn("p_value", student_t_p(t, df_))


def mann_whitney(df: DataFrame, keys, value: str, label: str, probe=None) -> DataFrame:
    """U of label 1 against label 0 with average ties, sizes, tie sum and two-sided p."""
    keys = list(keys)
    steps = running(_labelled(df, keys, value, label), keys, [value], {"_cum": "_n"}, probe)
    rank = F.col("_cum") - (F.col("_n") - 1) / F.lit(2.0)
    cube = F.col("_n").cast("double")
    out = steps.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.sum("_pos").alias("n_1"),
                                   F.sum(rank * F.col("_pos")).alias("_ranks"),
                                   F.sum(cube * cube * cube - cube).alias("tie_sum"))
    out = out.withColumn("n_0", F.col("_all") - F.col("n_1"))
    u = F.col("_ranks") - F.col("n_1") * (F.col("n_1") + 1) / F.lit(2.0)
    out = out.withColumn("u_stat", F.when((F.col("n_1") > 0) & (F.col("n_0") > 0), u)).drop("_ranks", "_all")
    return out.withColumn("p_value", mannwhitney_p("u_stat", "n_1", "n_0", "tie_sum"))


def wilcoxon(df: DataFrame, keys, delta: str, probe=None) -> DataFrame:
    """Signed-rank statistic min(W+, W-) over non-zero differences, and its p."""
    nz = df.where(F.col(delta) != 0).withColumn("_abs", F.abs(delta))
    ranked = avg_rank(nz, keys, "_abs", "_r", probe)
    w = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                  F.sum(F.when(F.col(delta) > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"),
                                  F.sum(F.when(F.col(delta) < 0, F.col("_r")).otherwise(0.0)).alias("w_minus"))
    cube = F.col("_n").cast("double")
    ties = nz.groupBy(*keys, "_abs").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(
        F.sum(cube * cube * cube - cube).alias("_ties"))
    w = w.join(ties, list(keys)) if keys else attach_one(w, ties)
    w = w.withColumn("w_stat", F.least("w_plus", "w_minus"))
    return w.withColumn("p_value", wilcoxon_p("w_stat", "n", "_ties")).drop("_ties")


def draw_index(rep: Column, slot: Column, n: Column, seed: int = 0) -> Column:
    """Arithmetic hash index in [0, n) of one bootstrap draw (the same in every engine)."""
    a = (rep * F.lit(1000003) + slot * F.lit(7919) + F.lit(seed)).cast("bigint")
    b = F.pmod(F.pmod(a, F.lit(2147483647)) * F.lit(2654435761), F.lit(2147483647))  # within 64 bits for any table
    return F.pmod(F.pmod(b * F.lit(48271), F.lit(2147483647)), n)


#: Draws that one task makes at most, and slots of one replicate that are listed at once.
TASK_DRAWS, SLOTS_AT_ONCE = 2_000_000, 10_000


def draw_tasks(spark, draws: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-draws // TASK_DRAWS))


def draw_slots(lots: DataFrame, keys, n: str, tasks: int) -> DataFrame:
    """Slots 0 to n - 1 of every lot as `_slot`; lots are dealt to tasks by their keys before their slots are listed."""
    first = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(n) - 1) / SLOTS_AT_ONCE) * SLOTS_AT_ONCE, F.lit(SLOTS_AT_ONCE).cast("bigint"))
    dealt = lots.where(F.col(n) > 0).repartition(tasks, *keys).select(*lots.columns, F.explode(first).alias("_first"))
    last = F.least(F.col("_first") + SLOTS_AT_ONCE, F.col(n)) - 1
    return dealt.select(*lots.columns, F.explode(F.sequence(F.col("_first"), last)).alias("_slot"))


def bootstrap_draws(df: DataFrame, order: str, reps: int, seed: int = 0) -> DataFrame:
    """Rows of `df` drawn with replacement: n rows per replicate `rep`, the draws of a replicate in one partition.

    Replicates are dealt to tasks before their slots are listed, so no task makes more than TASK_DRAWS draws (or one
    replicate), and only rows that are drawn meet the numbered table: sent to the tasks if proven small, else by a hash
    join on the position.
    """
    return _draws(df, order, reps, seed)[0]


def _draws(df: DataFrame, order: str, reps: int, seed: int) -> tuple[DataFrame, int]:
    """The draws and the size n of a replicate."""
    spark = df.sparkSession
    rows, n = cut_counted(row_rank(df, [], [order], "_pos").withColumn("_pos", F.col("_pos") - 1))
    lots = spark.range(1, reps + 1).select(F.col("id").cast("int").alias("rep"), F.lit(n).cast("bigint").alias("_n"))
    tasks = draw_tasks(spark, n * reps)
    slots = draw_slots(lots, ["rep"], "_n", tasks)
    draws = slots.select("rep", draw_index(F.col("rep"), F.col("_slot"), F.col("_n"), seed).alias("_pos"))
    if n <= broadcast_rows(spark):
        return draws.join(F.broadcast(rows), "_pos").drop("_pos"), n
    return draws.join(rows.hint("shuffle_hash"), "_pos").drop("_pos").repartition(tasks, "rep"), n


def bootstrap_auroc_ci(df: DataFrame, order: str, score: str, label: str, reps: int, seed: int = 0) -> DataFrame:
    """2.5 / 97.5 percentiles of the AUROC over resamples; single-class draws are skipped."""
    draws, n = _draws(df.select(order, score, label), order, reps, seed)
    stats = auroc(draws.drop(order), ["rep"], score, label, probe=n if n <= hot_rows(df.sparkSession) else None)
    stats = cut(stats.where(F.col("auroc").isNotNull()))  # a row a replicate, read twice
    ci = quantiles(stats, [], "auroc", {"ci_low": 0.025, "ci_high": 0.975}, reps)
    return attach_one(ci, stats.agg(F.count(F.lit(1)).alias("n_valid")))


def response_performance(df: DataFrame, keys, cohort: str, score: str, label: str, min_rows: int = 3) -> DataFrame:
    """AUROC and AUPRC pooled ('all') and per cohort."""
    both = df.withColumn("scope", F.explode(F.array(F.lit("all"), F.concat(F.lit("cohort:"), F.col(cohort)))))
    keys = list(keys) + ["scope"]
    pr = auprc(both, keys, score, label, min_rows).select(*keys, "auprc")
    return auroc(both, keys, score, label, min_rows).join(pr, keys)


def cohort_mean_ci(df: DataFrame, keys, value: str) -> DataFrame:
    """Mean, standard error, count and the 1.96 band over cohorts."""
    out = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"),
                                (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"))
    return out.withColumn("ci_low", F.col("mean") - 1.96 * F.col("sem")).withColumn(
        "ci_high", F.col("mean") + 1.96 * F.col("sem"))


# fixed values: score families where a high value means non-response
INVERTED_SCORES = ["TAM", "TEXH", "CAF", "TIDE"]


def orient_score(name: Column, value: Column) -> Column:
    return F.when(F.upper(F.substring_index(name, "__", 1)).isin(INVERTED_SCORES), -value).otherwise(value)


def classification_metrics(df: DataFrame, keys, prob: str, label: str, cut: float = 0.5) -> DataFrame:
    """AUROC, AUPRC, balanced accuracy and MCC at the cut."""
    keys = list(keys)
    hit = lambda p, y: F.count_if(((F.col(prob) >= cut) if p else (F.col(prob) < cut)) & (F.col(label) == y))
    c = df.groupBy(*keys).agg(hit(1, 1).alias("tp"), hit(0, 0).alias("tn"), hit(1, 0).alias("fp"), hit(0, 1).alias("fn"))
    tp, tn, fp, fn = (F.col(x).cast("double") for x in ("tp", "tn", "fp", "fn"))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    c = c.withColumn("balanced_accuracy", 0.5 * (F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp))).withColumn(
        "mcc", F.when(den > 0, (tp * tn - fp * fn) / den).otherwise(0.0))
    a = auroc(df, keys, prob, label, 0).select(*keys, "auroc")
    b = auprc(df, keys, prob, label, 0).select(*keys, "auprc")
    if not keys:
        return attach_one(attach_one(c, a), b)
    return c.join(a, keys, "left").join(b, keys, "left")


