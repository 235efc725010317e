"""Clinical endpoints, survival association, endpoint metrics and cross-validated baselines."""

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepair.functions.clean import clean, max_nonnegative, progression_flag, response_class, to_number
from tidepair.functions.pvalues import normal_two_sided
from tidepair.operators import stats as S
from tidepair.plans.ordered import quantiles, row_rank, running, top_rows
from tidepair.plans.session import cut, cut_counted

DIAGNOSES = ("array<struct<days_to_last_follow_up:string,days_to_last_known_disease_status:string,days_to_recurrence:string,"
             "progression_or_recurrence:string,prior_treatment:string,ajcc_pathologic_stage:string,"
             "treatments:array<struct<treatment_outcome:string,therapeutic_agents:string>>>>")
FOLLOW_UPS = ("array<struct<days_to_follow_up:string,days_to_progression:string,days_to_progression_free:string,"
              "days_to_recurrence:string,progression_or_recurrence:string,disease_response:string>>")
CASE = (f"submitter_id string, demographic struct<vital_status:string,days_to_death:string,age_at_index:string,sex_at_birth:string>,"
        f" diagnoses {DIAGNOSES}, follow_ups {FOLLOW_UPS}")


def _some(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def _texts(values: Column) -> Column:
    """Cleaned non-blank texts."""
    return F.filter(F.transform(values, clean), lambda x: x != "")


def _joined(values: Column) -> Column:
    out = F.array_join(F.array_sort(F.array_distinct(values)), "|")
    return F.when(out == "", "NA").otherwise(out)


def _case_parts(cases: DataFrame) -> DataFrame:
    """Times, flags and text lists a derivation needs, as columns _..."""
    d = F.coalesce(F.col("diagnoses"), F.from_json(F.lit("[]"), DIAGNOSES))
    f = F.coalesce(F.col("follow_ups"), F.from_json(F.lit("[]"), FOLLOW_UPS))
    get = lambda a, k: F.transform(a, lambda x: x[k])
    num = lambda c: to_number(c, True)
    treat = F.flatten(F.transform(d, lambda x: F.coalesce(x["treatments"], F.array().cast(
        "array<struct<treatment_outcome:string,therapeutic_agents:string>>"))))
    follow = F.concat(get(d, "days_to_last_follow_up"), get(d, "days_to_last_known_disease_status"), get(f, "days_to_follow_up"))
    event = F.concat(get(f, "days_to_progression"), get(f, "days_to_progression_free"),
                     get(d, "days_to_recurrence"), get(f, "days_to_recurrence"))
    untimed = F.exists(d, lambda x: progression_flag(x["progression_or_recurrence"]) & num(x["days_to_recurrence"]).isNull()) | \
        F.exists(f, lambda x: progression_flag(x["progression_or_recurrence"]) & num(x["days_to_progression"]).isNull()
                 & num(x["days_to_progression_free"]).isNull() & num(x["days_to_recurrence"]).isNull())
    death = num(F.col("demographic.days_to_death"))
    outcomes = _texts(get(treat, "treatment_outcome"))
    classes = F.concat(F.transform(outcomes, response_class), F.transform(get(f, "disease_response"), response_class))
    return cases.select(
        "*", clean(F.col("demographic.vital_status")).alias("_vital"), death.alias("_death"),
        max_nonnegative(follow).alias("_censor"), untimed.alias("_untimed"),
        F.array_min(_some(F.concat(F.transform(event, num), F.array(death)))).alias("_first_event"),
        F.array_sort(F.array_distinct(_some(classes))).alias("_classes"), outcomes.alias("_outcomes"),
        _texts(get(treat, "therapeutic_agents")).alias("_agents"), _texts(get(d, "prior_treatment")).alias("_prior"),
        F.get(_texts(get(d, "ajcc_pathologic_stage")), F.lit(0)).alias("_stage"))


def derive_outcomes(cases: DataFrame) -> DataFrame:
    """Survival, progression and response endpoints with rules, and the clinical text sets."""
    p = _case_parts(cases)
    dead = (F.lower("_vital") == "dead") & F.col("_death").isNotNull()
    alive = (F.lower("_vital") == "alive") & F.col("_censor").isNotNull()
    timed = F.col("_first_event").isNotNull()
    cens = F.col("_censor").isNotNull() & ~F.col("_untimed")
    k = F.size("_classes")
    one = F.get(F.col("_classes"), F.lit(0))
    text = lambda c: F.when(clean(F.col(c)) == "", "NA").otherwise(clean(F.col(c)))
    keep = [c for c in cases.columns if c not in ("demographic", "diagnoses", "follow_ups")]
    return p.select(
        *keep, text("demographic.age_at_index").alias("age_at_index"), text("demographic.sex_at_birth").alias("sex"),
        F.coalesce("_stage", F.lit("NA")).alias("pathologic_stage"),
        F.when(F.col("_vital") == "", "NA").otherwise(F.col("_vital")).alias("vital_status"),
        F.when(dead, F.col("_death")).when(alive, F.col("_censor")).alias("os_time_days"),
        F.when(dead, 1).when(alive, 0).alias("os_event"),
        F.when(dead, "dead_days_to_death").when(alive, "alive_max_followup").otherwise("insufficient").alias("os_rule"),
        F.when(timed, F.col("_first_event")).when(cens, F.col("_censor")).alias("pfs_time_days"),
        F.when(timed, 1).when(cens, 0).alias("pfs_event"),
        F.when(timed, "earliest_progression_recurrence_or_death").when(cens, "censored_at_max_followup_no_timed_event").otherwise(
            "insufficient_or_untimed_event").alias("pfs_rule"),
        F.when(F.col("_untimed") | (~timed & cens), "yes").otherwise("no").alias("pfs_needs_review"),
        F.when(k == 0, "NA").otherwise(F.array_join("_classes", "|")).alias("response_category"),
        F.when(k != 1, "NA").when(one.isin("CR", "PR"), "Response").otherwise("Non-response").alias("response_group"),
        F.when(k == 1, "no").when(k > 1, "yes_conflicting").otherwise("yes_missing").alias("response_needs_review"),
        _joined(F.col("_outcomes")).alias("treatment_outcomes"), _joined(F.col("_agents")).alias("therapeutic_agents"),
        _joined(F.col("_prior")).alias("prior_treatment"))


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.count(F.lit(1)).alias("n"), F.count("os_time_days").alias("os_evaluable"),
        F.count_if(F.col("os_event") == 1).alias("os_events"), F.count("pfs_time_days").alias("pfs_evaluable"),
        F.count_if(F.col("response_group").isin("Response", "Non-response")).alias("response_unambiguous"))


def melt_features(wide: DataFrame, ids, features, layer: str) -> DataFrame:
    """Wide -> long numeric features of one layer; non-numeric values are dropped."""
    texts = wide.select(*ids, *[F.col(c).cast("string").alias(c) for c in features])
    long = texts.unpivot(list(ids), list(features), "feature", "raw")
    return long.select(*ids, F.lit(layer).alias("layer"), "feature", to_number(F.col("raw")).alias("value")).where(
        F.col("value").isNotNull())


def cox_univariate(df: DataFrame, keys, stratum: str, time: str, event: str, z: str, penalizer: float = 0.01,
                   iterations: int = 60, min_rows: int = 20, min_events: int = 5, tolerance: float = 1e-9) -> DataFrame:
    """One-covariate Cox model per key, stratified, Efron ties, ridge n*penalizer*beta^2/2 (our choice).

    Every Newton step is one aggregation over distinct event times plus a running risk-set
    total; only the small per-key coefficient table is cut between steps. A step that lowers the penalised likelihood is
    halved; a key leaves once its step is below the tolerance. Keys left after `iterations` steps fail the job.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(stratum).alias("_g"), F.col(time).cast("double").alias("_t"),
                     F.col(event).cast("int").alias("_e"), F.col(z).cast("double").alias("_z")).dropna()
    gates = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("_e").alias("events"), F.stddev_samp("_z").alias("_sd"))
    gates = gates.where((F.col("n") >= min_rows) & (F.col("events") >= min_events) & (F.col("_sd") > 0)).drop("_sd")
    rows = cut(rows.join(gates.select(*keys), keys, "left_semi").groupBy(*keys, "_g", "_t", "_e", "_z").agg(
        F.count(F.lit(1)).cast("double").alias("_k")))
    bound = rows.groupBy(*keys, "_g").agg(F.count_distinct("_t").alias("n")).agg(F.max("n")).first()[0] or 0
    none = F.lit(None).cast("double")
    beta = cut(gates.withColumn("beta", F.lit(0.0)).withColumn("_old", F.lit(0.0)).withColumn("_best", none).withColumn("_info", none).withColumn("_done", F.lit(False)))
    for _ in range(iterations):
        live = beta.where("NOT _done")
        w = F.col("_k") * F.exp(F.col("beta") * F.col("_z"))
        zz, e = F.col("_z"), F.col("_e") == 1
        ev = lambda c: F.sum(F.when(e, c).otherwise(0.0))
        steps = rows.join(live.select(*keys, "beta"), keys).groupBy(*keys, "_g", "_t").agg(
            F.sum(w).alias("_s0"), F.sum(w * zz).alias("_s1"), F.sum(w * zz * zz).alias("_s2"), ev(F.col("_k")).alias("_d"),
            ev(F.col("_k") * zz).alias("_ez"), ev(w).alias("_e0"), ev(w * zz).alias("_e1"), ev(w * zz * zz).alias("_e2"))
        risk = running(steps, keys + ["_g"], [("_t", False)], {"_r0": "_s0", "_r1": "_s1", "_r2": "_s2"}, int(bound))
        # Efron: one term per tied event, spread in blocks so that a heavy tie stays distributed
        d = F.col("_d").cast("bigint")
        block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((d - 1) / 10000)))
        tied = risk.where(F.col("_d") > 0).withColumn("_blk", block)
        first = F.col("_blk") * 10000
        tied = tied.withColumn("_l", F.explode(F.sequence(first, F.least(first + 9999, d - 1))))
        f = F.col("_l") / F.col("_d")
        a0, a1, a2 = (F.col("_r" + i) - f * F.col("_e" + i) for i in "012")
        lead = F.when(F.col("_l") == 0, F.col("_ez")).otherwise(0.0)
        slope = tied.groupBy(*keys).agg(F.sum(lead - a1 / a0).alias("_u"), F.sum(a2 / a0 - (a1 / a0) * (a1 / a0)).alias("_i"),
                                        F.sum(lead).alias("_lead"), F.sum(F.log(a0)).alias("_log"))
        pen, b = F.col("n") * penalizer, F.col("beta")
        step = (F.col("_u") - pen * b) / (F.col("_i") + pen)
        near = lambda x, bound: F.abs(x) <= bound * (1 + F.abs(b))
        scored = live.drop("_info").join(slope, keys).withColumn("_value", b * F.col("_lead") - F.col("_log") - pen * b * b / 2).withColumn("_info", F.col("_i") + pen)
        rises = F.isnull("_best") | (~F.isnan("_value") & (F.col("_value") >= F.col("_best") - 1e-10 * (1 + F.abs("_best"))))
        scored = scored.withColumn("_up", rises).withColumn("_done", F.when(F.col("_up"), near(step, tolerance)).otherwise(near(b - F.col("_old"), tolerance * 1e-2)))
        move = F.when(F.col("_done"), b).when(F.col("_up"), b + step).otherwise((b + F.col("_old")) / 2)
        moved = scored.select(*keys, "n", "events", move.alias("beta"), F.when(F.col("_up"), b).otherwise(F.col("_old")).alias("_old"),
                              F.when(F.col("_up"), F.col("_value")).otherwise(F.col("_best")).alias("_best"), "_info", "_done")
        beta = cut(moved.unionByName(beta.where("_done")))
        if not beta.where("NOT _done").limit(1).count():
            break
    else:
        raise RuntimeError(f"Cox models without convergence: {beta.where('NOT _done').select(*keys).limit(5).collect()}")
    beta = beta.drop("_old", "_best", "_done")
    se = 1 / F.sqrt(F.col("_info"))
    out = beta.withColumn("hazard_ratio", F.exp("beta")).withColumn("ci_low", F.exp(F.col("beta") - 1.959963984540054 * se)).withColumn(
        "ci_high", F.exp(F.col("beta") + 1.959963984540054 * se)).withColumn("p_value", normal_two_sided(F.col("beta") / se)).drop("_info")
    pairs = concordance_counts(rows, keys)
    good = F.when(F.col("beta") >= 0, F.col("larger")).otherwise(F.col("pairs") - F.col("larger") - F.col("tied"))
    return out.join(pairs, keys, "left").withColumn(
        "concordance", F.when(F.col("pairs") > 0, (good + F.col("tied") / 2) / F.col("pairs"))).drop("larger", "tied", "pairs")


def concordance_counts(rows: DataFrame, keys) -> DataFrame:
    """Comparable pairs, pairs where the earlier event has the larger z, and z ties, without listing pairs.

    z ranks are cut into dyadic nodes: the values below a rank are at most one node per level,
    so counting 'outlives me with smaller z' is a running count inside (level, node) over time.
    rows: keys, _g stratum, _t time, _e event, _z, _k multiplicity.
    """
    keys = list(keys)
    ranks = running(rows.select(*keys, "_z").distinct(), keys, ["_z"], {"_rank": F.lit(1).cast("bigint")})
    top = ranks.agg(F.max("_rank")).first()[0] or 1
    levels = int(top).bit_length()
    base = rows.join(ranks, keys + ["_z"]).withColumn("_u", F.col("_t") * 2 + F.when(F.col("_e") == 1, 0).otherwise(1))
    grid = F.array(*[F.lit(i) for i in range(levels)])
    r = F.col("_rank")
    shift = lambda i: F.floor(r / F.element_at(F.lit([float(2 ** j) for j in range(levels)]), i + 1)).cast("bigint")
    here = F.transform(grid, lambda i: F.struct(i.alias("lev"), shift(i).alias("node"), F.col("_k").alias("s"), F.lit(0.0).alias("q")))
    asks = F.transform(F.filter(grid, lambda i: shift(i) % 2 == 1), lambda i: F.struct(
        i.alias("lev"), (shift(i) - 1).alias("node"), F.lit(0.0).alias("s"), F.col("_k").alias("q")))
    own = lambda lev, node: F.struct(F.lit(lev).alias("lev"), node.alias("node"), F.col("_k").alias("s"),
                                     F.when(F.col("_e") == 1, F.col("_k")).otherwise(0.0).alias("q"))
    items = F.concat(here, F.when(F.col("_e") == 1, asks).otherwise(F.filter(asks, lambda x: F.lit(False))),
                     F.array(own(-1, r), own(-2, F.lit(0).cast("bigint"))))
    flat = base.select(*keys, "_g", "_u", F.explode(items).alias("_x")).groupBy(
        *keys, "_g", "_u", "_x.lev", "_x.node").agg(F.sum("_x.s").alias("_s"), F.sum("_x.q").alias("_q"))
    seen = running(flat, keys + ["_g", "lev", "node"], [("_u", False)], {"_cum": "_s"})
    hits = F.col("_q") * (F.col("_cum") - F.col("_s"))
    return seen.groupBy(*keys).agg(F.sum(F.when(F.col("lev") >= 0, hits).otherwise(0.0)).alias("larger"),
                                   F.sum(F.when(F.col("lev") == -1, hits).otherwise(0.0)).alias("tied"),
                                   F.sum(F.when(F.col("lev") == -2, hits).otherwise(0.0)).alias("pairs"))


def median_stratification(df: DataFrame, keys, value: str, time: str, event: str) -> DataFrame:
    """Per key and high/low group (value >= median is high): n, events, median time, cutoff."""
    keys = list(keys)
    rows = df.join(quantiles(df, keys, value, {"cutoff": 0.5}), keys)
    rows = rows.withColumn("risk_group", F.when(F.col(value) >= F.col("cutoff"), "high").otherwise("low"))
    group = keys + ["risk_group"]
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum(event).alias("events"), F.max("cutoff").alias("cutoff")).join(
        quantiles(rows, group, time, {"median_time_days": 0.5}), group)


def clarification_rank(df: DataFrame, keys, min_rows: int = 4) -> DataFrame:
    """Score usefulness per key: AUROC against the label, rho against the model probability, effect sizes.

    df: keys, z (cohort z-score), probability, label (0/1), correct (0/1 or null).
    """
    keys = list(keys)
    valid = df.where(F.col("z").isNotNull() & F.col("probability").isNotNull() & F.col("label").isNotNull())
    out = S.auroc(valid, keys, "z", "label", 0).join(
        S.spearman(valid, keys, "z", "probability").select(*keys, "rho", F.col("p_value").alias("rho_p")), keys, "left").join(
        S.cohen_d(valid, keys, "z", "label").select(*keys, "cohen_d"), keys, "left").join(
        S.cohen_d(valid.where(F.col("correct").isNotNull()), keys, "z", "correct").select(
            *keys, F.col("cohen_d").alias("correct_cohen_d"), F.col("n_1").alias("n_correct"), F.col("n_0").alias("n_incorrect")),
        keys, "left")
    score = (F.coalesce("auroc", F.lit(0.5)) - 0.5 + 0.25 * F.coalesce(F.abs("rho"), F.lit(0.0))
             + 0.05 * F.least(F.coalesce(F.abs("cohen_d"), F.lit(0.0)), F.lit(5.0)))
    return out.where(F.col("n") >= min_rows).withColumn("clarification_score", score)


def model_correctness(df: DataFrame, probability: str, label: str) -> DataFrame:
    cls = F.when(F.col(probability) >= 0.5, 1).otherwise(0)
    ok = F.col(probability).isNotNull() & F.col(label).isNotNull()
    return df.withColumn("model_class", cls).withColumn("model_correct", F.when(ok, (cls == F.col(label)).cast("int")))


def endpoint_metrics(long: DataFrame, keys) -> DataFrame:
    """Per key over genes (truth, pred, source): errors, correlations (constant -> null) and shift norms."""
    dp, dt = F.col("pred") - F.col("source"), F.col("truth") - F.col("source")
    err = F.col("pred") - F.col("truth")
    safe = S.safe_corr
    return long.groupBy(*keys).agg(
        F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"), safe(F.col("pred"), F.col("truth")).alias("post_pearson"),
        safe(dp, dt).alias("delta_pearson"), F.sqrt(F.sum(dp * dp)).alias("predicted_delta_l2"),
        F.sqrt(F.sum(dt * dt)).alias("observed_delta_l2"))


def method_summary(metrics: DataFrame, columns) -> DataFrame:
    """Mean, median and count of metric columns per method."""
    long = metrics.unpivot(["method"], list(columns), "metric", "value")
    base = long.groupBy("method", "metric").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    return base.join(quantiles(long, ["method", "metric"], "value", {"median": 0.5}), ["method", "metric"], "left")


def baseline_mean_delta(long: DataFrame) -> DataFrame:
    """Prediction = source + mean training delta of the gene, per held-out fold (total minus own fold)."""
    d = F.col("truth") - F.col("source")
    own = long.groupBy("gene_id", "fold").agg(F.sum(d).alias("_f"), F.count(F.lit(1)).alias("_nf"))
    total = own.groupBy("gene_id").agg(F.sum("_f").alias("_t"), F.sum("_nf").alias("_nt"))
    shift = own.join(total, "gene_id").select("gene_id", "fold", (
        (F.col("_t") - F.col("_f")) / F.nullif(F.col("_nt") - F.col("_nf"), F.lit(0))).alias("_shift"))
    return long.join(shift, ["gene_id", "fold"]).withColumn("pred", F.col("source") + F.col("_shift")).drop("_shift")


def _gram(batches):
    """Partial [Z 1]'[Z 1 Y] of one task; tasks are summed by Spark."""
    total = None
    for pdf in batches:
        z, y = np.stack(pdf["_z"].to_numpy()), np.stack(pdf["_y"].to_numpy())
        one = np.ones((len(z), 1))
        left = np.hstack([z, one])
        part = left.T @ np.hstack([left, y])
        total = part if total is None else total + part
    if total is not None:
        yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total)})


def baseline_pca_ridge(rows: DataFrame, fold: str, x: str, y: str, components: int = 32, alpha: float = 10.0) -> DataFrame:
    """Out-of-fold PCA (MLlib) + ridge for all output dimensions at once; x, y are array columns.

    The ridge needs only the cross-product matrix of the components and outputs: tasks add up
    partial products, the (components + 1) x outputs model is solved and sent back as literals.
    """
    vec = rows.withColumn("_x", array_to_vector(x)).withColumn("_y", F.col(y).cast("array<double>"))
    folds = [r[0] for r in vec.select(fold).distinct().orderBy(fold).collect()]  # fold count is a parameter, not data
    out = None
    for k in folds:
        train = vec.where(F.col(fold) != k)
        n, dims = train.agg(F.count(F.lit(1)), F.max(F.size(x))).first()
        model = PCA(k=min(components, dims, n - 1), inputCol="_x", outputCol="_p").fit(train)
        z = model.transform(train).select(vector_to_array("_p").alias("_z"), "_y")
        sums = z.mapInPandas(_gram, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy(
            "i", "j").agg(F.sum("v").alias("v")).groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("r"))
        gram = np.array([[c["v"] for c in r["r"]] for r in sums.orderBy("i").collect()])
        q = len(gram)
        penalty = np.diag([alpha] * (q - 1) + [0.0])  # the intercept is free
        coef = np.linalg.solve(gram[:, :q] + penalty, gram[:, q:])

        def predict(batches, coef=coef):
            for pdf in batches:
                z = np.stack(pdf.pop("_z").to_numpy())
                yield pdf.assign(pred=list(np.hstack([z, np.ones((len(z), 1))]) @ coef))

        test = model.transform(vec.where(F.col(fold) == k)).select(*rows.columns, vector_to_array("_p").alias("_z"))
        done = test.mapInPandas(predict, ", ".join(f"`{c}` {d}" for c, d in rows.dtypes) + ", pred array<double>")
        out = done if out is None else out.unionByName(done)
    return out


def _numbers(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def response_classifier(rows: DataFrame, fold: str, x: str, label: str, components: int | None = None, c: float = 0.1) -> DataFrame:
    """Out-of-fold probability of a standardised, class-balanced L2 logistic model (MLlib).

    Fitted means, deviations and weights enter the plan as plain numbers. A fitted model can't: the summary of its training
    holds the session, which can't be sent to tasks once it has observed anything (cut_counted).
    """
    vec = cut(rows.withColumn("_x0", F.col(x).cast("array<double>")))  # read in several passes for every fold
    out = None
    for k in [r[0] for r in vec.select(fold).distinct().orderBy(fold).collect()]:
        train = vec.where((F.col(fold) != k) & F.col(label).isNotNull())
        test = vec.where((F.col(fold) == k) & F.col(label).isNotNull())
        counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}  # two classes
        n = sum(counts.values())
        if n < 4 or len(counts) < 2:
            scored = test.withColumn("probability", F.lit(None).cast("double"))
        else:
            if components:
                pca = PCA(k=components, inputCol="_v", outputCol="_p").fit(train.withColumn("_v", array_to_vector("_x0")))
                axes = [_numbers(axis) for axis in pca.pc.toArray().T]
                project = F.array(*[_dot(F.col("_x0"), axis) for axis in axes])
                train, test = train.withColumn("_x0", project), test.withColumn("_x0", project)
            fit = StandardScaler(withMean=True, withStd=True, inputCol="_v", outputCol="_s").fit(train.select(array_to_vector("_x0").alias("_v")))
            mean, scale = _numbers(fit.mean), _numbers([1 / s if s else 0.0 for s in fit.std])
            scaled = F.zip_with(F.zip_with("_x0", mean, lambda v, m: v - m), scale, lambda v, s: v * s)
            weight = F.lit(0.0)
            for cls, m in counts.items():
                weight = F.when(F.col(label) == cls, n / (2.0 * m)).otherwise(weight)
            model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1.0 / (c * n), elasticNetParam=0.0,
                                       standardization=False, maxIter=2000).fit(
                train.select(array_to_vector(scaled).alias("_x"), weight.alias("_w"), F.col(label).cast("double").alias("_y")))
            margin = _dot(scaled, _numbers(model.coefficients)) + F.lit(float(model.intercept))
            scored = test.withColumn("probability", 1 / (1 + F.exp(-margin)))
        scored = scored.select(*rows.columns, "probability")
        out = scored if out is None else out.unionByName(scored)
    return out


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def grouped_stratified_folds(rows: DataFrame, group: str, label: str, folds: int, seed: int = 0) -> DataFrame:
    """Group-disjoint folds, label balanced: groups sorted by stratum mix and size are dealt in a snake."""
    stratum = F.coalesce(F.col(label).cast("int"), F.lit(2))
    count = lambda k: F.count_if(stratum == k)
    groups = rows.groupBy(group).agg(count(1).alias("_n1"), count(0).alias("_n0"), count(2).alias("_n2"))
    groups = groups.withColumn("_k", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"))))
    dealt = row_rank(groups, [], [("_n1", False), ("_n0", False), ("_n2", False), ("_k", True), (group, True)], "_pos")
    turn = F.floor((F.col("_pos") - 1) / folds)
    slot = (F.col("_pos") - 1) % folds
    return dealt.select(group, F.when(turn % 2 == 0, slot).otherwise(folds - 1 - slot).cast("bigint").alias("fold"))


def finetune_comparison(metrics: DataFrame, reps: int = 2000) -> DataFrame:
    """Paired improvement of world_finetuned over world_pretrained per metric, averaged per patient.

    metrics: method, row_index, patient_id, mse, mae, post_pearson, delta_pearson.
    Errors improve downwards, correlations upwards.
    """
    columns = ["mse", "mae", "post_pearson", "delta_pearson"]
    long = metrics.unpivot(["method", "row_index", "patient_id"], columns, "metric", "value")
    at = lambda m: F.max(F.when(F.col("method") == m, F.col("value")))
    wide = long.where(F.col("method").isin("world_pretrained", "world_finetuned")).groupBy("metric", "patient_id", "row_index").agg(
        at("world_pretrained").alias("_p"), at("world_finetuned").alias("_f"))
    gain = F.when(F.col("metric").isin("mse", "mae"), F.col("_p") - F.col("_f")).otherwise(F.col("_f") - F.col("_p"))
    patient = wide.groupBy("metric", "patient_id").agg(F.avg(gain).alias("gain")).where(F.col("gain").isNotNull())
    patient, n = cut_counted(patient)  # read five times
    base = patient.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n_patients"), F.avg("gain").alias("mean_improvement"),
        F.avg((F.col("gain") > 0).cast("double")).alias("win_rate"), F.avg((F.col("gain") == 0).cast("double")).alias("tie_rate"))
    rank = S.wilcoxon(patient, ["metric"], "gain").select("metric", "w_stat", F.col("p_value").alias("wilcoxon_p"))
    # bootstrap of the mean per metric by arithmetic draws
    pos = row_rank(patient, ["metric"], ["patient_id"], "_pos").withColumn("_pos", F.col("_pos") - 1)
    sizes = patient.groupBy("metric").agg(F.count(F.lit(1)).alias("n_patients"))
    lots = sizes.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    slots = S.draw_slots(lots, ["metric", "rep"], "n_patients", S.draw_tasks(metrics.sparkSession, n * reps))
    draws = slots.select("metric", "rep", S.draw_index(F.col("rep"), F.col("_slot"), F.col("n_patients")).alias("_pos"))
    means = draws.join(pos.select("metric", "_pos", "gain").hint("shuffle_hash"), ["metric", "_pos"]).groupBy("metric", "rep").agg(F.avg("gain").alias("_m"))
    ci = quantiles(means, ["metric"], "_m", {"ci_low": 0.025, "ci_high": 0.975}, reps)
    med = quantiles(patient, ["metric"], "gain", {"median_improvement": 0.5})
    return base.join(med, "metric").join(ci, "metric").join(rank, "metric", "left")


def clinical_lookup(patients: DataFrame, cases: DataFrame, order: str) -> DataFrame:
    """Patient -> case by cleaned submitter id; the last duplicate wins, a missing case fails the job."""
    last = top_rows(cases.withColumn("_id", clean(F.col("submitter_id"))), ["_id"], [F.desc(order)], 1, "_k").drop("_k")
    out = patients.withColumn("_id", clean(F.col("source_patient_id"))).join(last, "_id", "left")
    ok = F.when(F.col("submitter_id").isNotNull(), F.col("submitter_id")).otherwise(F.raise_error("patient without a clinical case"))
    return out.withColumn("submitter_id", ok).drop("_id")


