"""Clinical outcomes, association and evaluation statistics."""

from pyspark.sql import functions as F

from tidepair.operators import outcomes as O
from tidepair.operators import stats as S

from .sqlmath import avg_rank
from .tables import query


def _r(c, n=9, alias=None):
    return F.round(c, n).alias(alias or c)


RESPONSES = ["Complete Response", "Partial Response", "Stable Disease", "Unknown", "Progressive Disease", "CR", "PR-Partial Response", "other", "--"]
CASES = f"""li AS (SELECT l_orderkey, l_linenumber AS n, l_linestatus AS st, l_returnflag AS rf, l_quantity AS q, l_partkey AS pk, l_suppkey AS sk, l_discount AS dc,
  ({RESPONSES!r})[CAST(round(l_tax * 100) AS INT) + 1] AS outcome FROM lineitem),
 di AS (SELECT *, CASE WHEN n % 2 = 1 THEN q * 10 END AS fu, pk * 1.0::DOUBLE AS kn, CASE WHEN rf = 'R' AND n % 2 = 0 THEN sk END AS rec, rf = 'R' AS prog FROM li WHERE st = 'O'),
 fo AS (SELECT *, q * 12 AS fu, CASE WHEN rf = 'A' THEN pk END AS pr, rf = 'N' AS prog, CASE WHEN dc > 0.05 THEN 'Stable Disease' WHEN dc > 0.03 THEN 'CR' END AS resp FROM li WHERE st = 'F'),
 cl AS (SELECT 'x' AS t, 'CR' AS c WHERE false UNION ALL SELECT unnest(['Complete Response', 'CR']), 'CR' UNION ALL SELECT unnest(['Partial Response', 'PR-Partial Response']), 'PR'
  UNION ALL SELECT 'Stable Disease', 'SD' UNION ALL SELECT 'Progressive Disease', 'PD'),
 dg AS (SELECT l_orderkey, greatest(max(fu), max(kn)) AS fu, min(rec) AS rec, bool_or(prog AND rec IS NULL) AS unt, string_agg(DISTINCT rf, '|' ORDER BY rf) AS prior,
   string_agg(DISTINCT outcome, '|' ORDER BY outcome) FILTER (outcome NOT IN ('Unknown', '--')) AS outs, string_agg(DISTINCT concat('Drug ', sk % 5), '|' ORDER BY concat('Drug ', sk % 5)) AS agents,
   concat('Stage ', min(n)) AS stage FROM di GROUP BY 1),
 fg AS (SELECT l_orderkey, max(fu) AS fu, min(pr) AS pr, bool_or(prog AND pr IS NULL) AS unt FROM fo GROUP BY 1),
 rc AS (SELECT l_orderkey, c FROM di JOIN cl ON outcome = t UNION SELECT l_orderkey, c FROM fo JOIN cl ON resp = t),
 rg AS (SELECT l_orderkey, count(*) AS k, string_agg(c, '|' ORDER BY c) AS cat FROM rc GROUP BY 1),
 oc AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'Dead' WHEN 'O' THEN 'Alive' ELSE '' END AS vital, CASE WHEN o_orderkey % 3 <> 0 THEN floor(o_totalprice / 100) END AS death,
   greatest(dg.fu, fg.fu) AS cens, least(rec, pr, CASE WHEN o_orderkey % 3 <> 0 THEN floor(o_totalprice / 100) END) AS ev, coalesce(dg.unt, false) OR coalesce(fg.unt, false) AS unt,
   coalesce(k, 0) AS k, cat, outs, agents, prior, stage FROM orders LEFT JOIN dg ON dg.l_orderkey = o_orderkey LEFT JOIN fg ON fg.l_orderkey = o_orderkey LEFT JOIN rg ON rg.l_orderkey = o_orderkey),
 outc AS (SELECT id, coalesce(nullif(vital, ''), 'NA') AS vital_status, CASE WHEN vital = 'Dead' AND death IS NOT NULL THEN death WHEN vital = 'Alive' THEN cens END AS os_time_days,
   CASE WHEN vital = 'Dead' AND death IS NOT NULL THEN 1 WHEN vital = 'Alive' AND cens IS NOT NULL THEN 0 END AS os_event,
   CASE WHEN vital = 'Dead' AND death IS NOT NULL THEN 'dead_days_to_death' WHEN vital = 'Alive' AND cens IS NOT NULL THEN 'alive_max_followup' ELSE 'insufficient' END AS os_rule,
   CASE WHEN ev IS NOT NULL THEN ev WHEN NOT unt THEN cens END AS pfs_time_days, CASE WHEN ev IS NOT NULL THEN 1 WHEN cens IS NOT NULL AND NOT unt THEN 0 END AS pfs_event,
   CASE WHEN ev IS NOT NULL THEN 'earliest_progression_recurrence_or_death' WHEN cens IS NOT NULL AND NOT unt THEN 'censored_at_max_followup_no_timed_event' ELSE 'insufficient_or_untimed_event' END AS pfs_rule,
   CASE WHEN unt OR (ev IS NULL AND cens IS NOT NULL) THEN 'yes' ELSE 'no' END AS pfs_needs_review, coalesce(cat, 'NA') AS response_category,
   CASE WHEN k <> 1 THEN 'NA' WHEN cat IN ('CR', 'PR') THEN 'Response' ELSE 'Non-response' END AS response_group,
   CASE WHEN k = 1 THEN 'no' WHEN k > 1 THEN 'yes_conflicting' ELSE 'yes_missing' END AS response_needs_review,
   coalesce(outs, 'NA') AS treatment_outcomes, coalesce(agents, 'NA') AS therapeutic_agents, coalesce(prior, 'NA') AS prior_treatment, coalesce(stage, 'NA') AS pathologic_stage FROM oc)"""


def cases(t):
    """Nested clinical cases: one per order, its order lines as diagnoses and follow-ups."""
    li, n, text = t("lineitem"), F.col("l_linenumber"), lambda c: c.cast("string")
    outcome = F.element_at(F.array(*map(F.lit, RESPONSES)), (F.round(F.col("l_tax") * 100).cast("int") + 1))
    rf = F.col("l_returnflag")
    diagnosis = F.when(F.col("l_linestatus") == "O", F.struct(
        n.alias("n"), F.when(n % 2 == 1, text(F.col("l_quantity") * 10)).otherwise("NA").alias("days_to_last_follow_up"),
        text(F.col("l_partkey")).alias("days_to_last_known_disease_status"),
        F.when((rf == "R") & (n % 2 == 0), text(F.col("l_suppkey"))).alias("days_to_recurrence"),
        F.when(rf == "R", " Yes ").otherwise("no").alias("progression_or_recurrence"), rf.alias("prior_treatment"),
        F.concat(F.lit("Stage "), text(n)).alias("ajcc_pathologic_stage"),
        F.array(F.struct(outcome.alias("treatment_outcome"), F.concat(F.lit("Drug "), text(F.col("l_suppkey") % 5)).alias("therapeutic_agents"))).alias("treatments")))
    follow = F.when(F.col("l_linestatus") == "F", F.struct(
        n.alias("n"), text(F.col("l_quantity") * 12).alias("days_to_follow_up"), F.when(rf == "A", text(F.col("l_partkey"))).alias("days_to_progression"),
        F.lit("--").alias("days_to_progression_free"), F.lit(None).cast("string").alias("days_to_recurrence"),
        F.when(rf == "N", "TRUE").otherwise("").alias("progression_or_recurrence"),
        F.when(F.col("l_discount") > 0.05, "stable disease").when(F.col("l_discount") > 0.03, "CR").alias("disease_response")))
    # an order has at most a handful of lines, so the per-case lists are bounded
    lists = li.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.sort_array(F.collect_list(diagnosis)).alias("d"), F.sort_array(F.collect_list(follow)).alias("f"))
    o, k = t("orders"), F.col("o_orderkey")
    demo = F.struct(F.when(F.col("o_orderstatus") == "F", "Dead").when(F.col("o_orderstatus") == "O", " Alive ").otherwise("not reported").alias("vital_status"),
                    F.when(k % 3 != 0, text(F.floor(F.col("o_totalprice") / 100))).otherwise("--").alias("days_to_death"),
                    text(k % 90).alias("age_at_index"), F.lit("unknown").alias("sex_at_birth"))
    drop = lambda c, kind: F.transform(c, lambda x: x.dropFields("n")).cast(kind)
    return o.join(lists, k == F.col("id"), "left").select(
        k.alias("id"), F.concat(F.lit("TCGA-"), text(k)).alias("submitter_id"), demo.alias("demographic"),
        drop(F.col("d"), O.DIAGNOSES).alias("diagnoses"), drop(F.col("f"), O.FOLLOW_UPS).alias("follow_ups"))


def _outcomes(t):
    return O.derive_outcomes(cases(t))


def _outcome_query(name, columns):
    query(f"WITH {CASES} SELECT id, {', '.join(columns)} FROM outc", name=name)(lambda t: _outcomes(t).select("id", *columns))


_outcome_query("derive_os", ["vital_status", "os_time_days", "os_event", "os_rule"])
_outcome_query("derive_pfs", ["pfs_time_days", "pfs_event", "pfs_rule", "pfs_needs_review"])
_outcome_query("derive_response", ["response_category", "response_group", "response_needs_review"])
_outcome_query("clinical_text_sets", ["treatment_outcomes", "therapeutic_agents", "prior_treatment", "pathologic_stage"])


@query(f"""WITH {CASES} SELECT count(*) AS n, count(os_time_days) AS os_evaluable, count(*) FILTER (os_event = 1) AS os_events, count(pfs_time_days) AS pfs_evaluable,
 count(*) FILTER (response_group IN ('Response', 'Non-response')) AS response_unambiguous FROM outc""")
def outcome_summary(t):
    return O.outcome_summary(_outcomes(t))


@query("""WITH w AS (SELECT c_custkey AS patient_id, c_mktsegment AS dataset_id, c_acctbal, CASE WHEN c_nationkey = 4 THEN NULL ELSE c_nationkey END AS nat FROM customer)
 SELECT patient_id, dataset_id, 'world_model' AS layer, 'acctbal' AS feature, c_acctbal AS value FROM w UNION ALL SELECT patient_id, dataset_id, 'world_model', 'nation', nat FROM w WHERE nat IS NOT NULL
 UNION ALL SELECT patient_id, dataset_id, 'empirical', 'score', c_acctbal / 2 FROM w""")
def melt_features(t):
    w = t("customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_mktsegment").alias("dataset_id"), F.col("c_acctbal").alias("acctbal"),
                             F.when(F.col("c_nationkey") == 4, "bad").otherwise(F.col("c_nationkey").cast("string")).alias("nation"),
                             (F.col("c_acctbal") / 2).alias("score"))
    ids = ["patient_id", "dataset_id"]
    return O.melt_features(w, ids, ["acctbal", "nation"], "world_model").unionByName(O.melt_features(w, ids, ["score"], "empirical"))


@query("""SELECT id, round((score - avg(score) OVER w) / nullif(stddev_samp(score) OVER w, 0), 9) AS z FROM scores WINDOW w AS (PARTITION BY cohort)""")
def zscore_within(t):
    return S.zscore_within(t("scores"), ["cohort"], "score", "z").select("id", _r("z"))


def _survival(t):
    return S.zscore_within(t("survival"), ["stratum"], "value", "z")


@query()
def cox_univariate(t):
    rows = _survival(t)
    both = rows.withColumn("cohort", F.explode(F.array(F.lit("ALL"), F.col("stratum"))))
    out = O.cox_univariate(both, ["feature", "cohort"], "stratum", "time_days", "event", "z")
    return out.select("feature", "cohort", "n", "events", *[_r(c, 6) for c in ("hazard_ratio", "ci_low", "ci_high", "p_value", "concordance")])


@query("""WITH m AS (SELECT feature, stratum, quantile_cont(value, 0.5) AS cutoff FROM survival GROUP BY ALL),
 g AS (SELECT s.*, cutoff, CASE WHEN value >= cutoff THEN 'high' ELSE 'low' END AS risk_group FROM survival s JOIN m USING (feature, stratum))
 SELECT feature, stratum, risk_group, count(*) AS n, sum(event)::BIGINT AS events, round(max(cutoff), 9) AS cutoff, quantile_cont(time_days, 0.5) AS median_time_days FROM g GROUP BY ALL""")
def median_stratification(t):
    out = O.median_stratification(t("survival"), ["feature", "stratum"], "value", "time_days", "event")
    return out.withColumn("cutoff", F.round("cutoff", 9))


AUC = f"""rk AS (SELECT *, {avg_rank('score', 'layer')} AS r FROM scores),
 au AS (SELECT layer, count(*) AS n, sum(label)::BIGINT AS n_pos, (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * (count(*) - sum(label)), 0) AS auroc FROM rk GROUP BY 1)"""
AP = """pc AS (SELECT layer, score, count(*) AS k, sum(label) AS p FROM scores GROUP BY ALL),
 pd AS (SELECT *, sum(k) OVER w AS ck, sum(p) OVER w AS cp FROM pc WINDOW w AS (PARTITION BY layer ORDER BY score DESC)),
 ap AS (SELECT layer, CASE WHEN sum(p) > 0 AND sum(p) < sum(k) THEN sum(p * cp / ck) / sum(p) END AS auprc FROM pd GROUP BY 1)"""


@query(f"WITH {AUC} SELECT layer, n, n_pos, round(auroc, 9) AS auroc FROM au")
def auroc(t):
    return S.auroc(t("scores"), ["layer"], "score", "label").select("layer", "n", "n_pos", _r("auroc"))


@query(f"WITH {AP} SELECT layer, round(auprc, 9) AS auprc FROM ap")
def auprc(t):
    return S.auprc(t("scores"), ["layer"], "score", "label").select("layer", _r("auprc"))


def _draw_sql(rep, slot, n):
    b = f"((({rep}) * 1000003 + ({slot}) * 7919) % 2147483647 * 2654435761 % 2147483647)"
    return f"(({b} * 48271) % 2147483647 % ({n}))"


@query(f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos FROM scores), n AS (SELECT count(*) AS n FROM o),
 d AS (SELECT rep, {_draw_sql('rep', 'pos', 'n')} AS pick FROM o, n, (SELECT unnest(range(1, 1001)) AS rep)),
 b AS (SELECT rep, score, label FROM d JOIN o ON o.pos = pick), r AS (SELECT *, {avg_rank('score', 'rep')} AS r FROM b),
 a AS (SELECT rep, (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * (count(*) - sum(label)), 0) AS auc FROM r GROUP BY 1)
 SELECT round(quantile_cont(auc, 0.025), 9) AS ci_low, round(quantile_cont(auc, 0.975), 9) AS ci_high, count(auc) AS n_valid FROM a""")
def bootstrap_ci(t):
    return S.bootstrap_auroc_ci(t("scores"), "id", "score", "label", 1000).select(_r("ci_low"), _r("ci_high"), "n_valid")


@query("""SELECT doc_id, name, CASE WHEN split_part(upper(name), '__', 1) IN ('TAM', 'TEXH', 'CAF', 'TIDE') THEN -v ELSE v END AS oriented FROM
 (SELECT doc_id, concat((['TIDE', 'IFNG', 'caf', 'TAMX', 'Texh'])[doc_id % 5 + 1], '__', lang) AS name, n_chars::DOUBLE AS v FROM documents)""")
def orient_score(t):
    name = F.concat(F.element_at(F.array(*map(F.lit, ["TIDE", "IFNG", "caf", "TAMX", "Texh"])), (F.col("doc_id") % 5 + 1).cast("int")), F.lit("__"), "lang")
    d = t("documents").select("doc_id", name.alias("name"), F.col("n_chars").cast("double").alias("v"))
    return d.select("doc_id", "name", S.orient_score(F.col("name"), F.col("v")).alias("oriented"))


PERF = f"""b AS (SELECT layer, 'all' AS scope, score, label FROM scores UNION ALL SELECT layer, concat('cohort:', cohort), score, label FROM scores),
 r AS (SELECT *, {avg_rank('score', 'layer, scope')} AS r FROM b),
 a AS (SELECT layer, scope, count(*) AS n, sum(label)::BIGINT AS n_pos, CASE WHEN count(*) >= 3 THEN (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * (count(*) - sum(label)), 0) END AS auroc FROM r GROUP BY ALL),
 pc AS (SELECT layer, scope, score, count(*) AS k, sum(label) AS p FROM b GROUP BY ALL),
 pd AS (SELECT *, sum(k) OVER w AS ck, sum(p) OVER w AS cp FROM pc WINDOW w AS (PARTITION BY layer, scope ORDER BY score DESC)),
 ap AS (SELECT layer, scope, CASE WHEN sum(p) > 0 AND sum(p) < sum(k) AND sum(k) >= 3 THEN sum(p * cp / ck) / sum(p) END AS auprc FROM pd GROUP BY ALL)"""


@query(f"WITH {PERF} SELECT a.layer, a.scope, n, n_pos, round(auroc, 9) AS auroc, round(auprc, 9) AS auprc FROM a JOIN ap USING (layer, scope)")
def response_performance(t):
    out = S.response_performance(t("scores"), ["layer"], "cohort", "score", "label")
    return out.select("layer", "scope", "n", "n_pos", _r("auroc"), _r("auprc"))


@query(f"""WITH {PERF} SELECT layer, round(avg(auroc), 9) AS mean, count(auroc) AS n, round(stddev_samp(auroc) / sqrt(count(auroc)), 9) AS sem,
 round(avg(auroc) - 1.96 * stddev_samp(auroc) / sqrt(count(auroc)), 9) AS ci_low, round(avg(auroc) + 1.96 * stddev_samp(auroc) / sqrt(count(auroc)), 9) AS ci_high
 FROM a WHERE scope <> 'all' GROUP BY 1""")
def cohort_mean_ci(t):
    perf = S.response_performance(t("scores"), ["layer"], "cohort", "score", "label").where("scope <> 'all'")
    out = S.cohort_mean_ci(perf, ["layer"], "auroc")
    return out.select("layer", "n", *[_r(c) for c in ("mean", "sem", "ci_low", "ci_high")])


@query("""WITH x AS (SELECT l_suppkey AS sample_id, CASE WHEN p_size < 3 THEN '' ELSE p_name END AS symbol, l_quantity AS value FROM lineitem JOIN part ON l_partkey = p_partkey)
 SELECT sample_id, symbol, round(avg(value), 9) AS value FROM x WHERE symbol <> '' GROUP BY ALL""")
def collapse_duplicate_symbols(t):
    from tidepair.operators.joins import collapse_duplicate_symbols as collapse
    x = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("sample_id"), F.when(F.col("p_size") < 3, " ").otherwise(F.col("p_name")).alias("symbol"), F.col("l_quantity").alias("value"))
    return collapse(x).select("sample_id", "symbol", _r("value"))


D = """(CASE WHEN n1 >= 2 AND n0 >= 2 THEN (m1 - m0) / nullif(sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 0) END)"""


def _sides(keys, value, label, src):
    f = lambda fn, k, a: f"{fn}({value}) FILTER ({label} = {k}) AS {a}"
    return (f"SELECT {keys}, " + ", ".join([f("avg", 1, "m1"), f("avg", 0, "m0"), f("var_samp", 1, "v1"), f("var_samp", 0, "v0"), f("count", 1, "n1"), f("count", 0, "n0")])
            + f" FROM {src} GROUP BY ALL")


@query(f"WITH s AS ({_sides('layer, cohort', 'score', 'label', 'scores')}) SELECT layer, cohort, n1 AS n_1, n0 AS n_0, round({D}, 8) AS cohen_d FROM s")
def cohen_d(t):
    return S.cohen_d(t("scores"), ["layer", "cohort"], "score", "label").select("layer", "cohort", "n_1", "n_0", _r("cohen_d", 8))


@query(f"""WITH r AS (SELECT l_returnflag, l_linestatus, {avg_rank('l_quantity', 'l_returnflag, l_linestatus')} AS rx, {avg_rank('l_extendedprice', 'l_returnflag, l_linestatus')} AS ry FROM lineitem),
 c AS (SELECT l_returnflag, l_linestatus, count(*) AS n, corr(rx, ry) AS rho FROM r GROUP BY ALL) SELECT l_returnflag, l_linestatus, n, round(rho, 9) AS rho FROM c""")
def spearman(t):
    out = S.spearman(t("lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", "l_linestatus", "n", _r("rho"))


@query(f"""WITH r AS (SELECT l_returnflag, l_linestatus = 'O' AS y, {avg_rank('l_quantity', 'l_returnflag')} AS r FROM lineitem),
 tt AS (SELECT l_returnflag, sum(c * c * c - c) AS tie_sum FROM (SELECT l_returnflag, count(*)::DOUBLE AS c FROM lineitem GROUP BY l_returnflag, l_quantity) GROUP BY 1)
 SELECT l_returnflag, count(*) FILTER (y) AS n_1, count(*) FILTER (NOT y) AS n_0, sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2 AS u_stat, max(tie_sum) AS tie_sum
 FROM r JOIN tt USING (l_returnflag) GROUP BY 1""")
def mann_whitney(t):
    rows = t("lineitem").withColumn("y", (F.col("l_linestatus") == "O").cast("int"))
    return S.mann_whitney(rows, ["l_returnflag"], "l_quantity", "y").select("l_returnflag", "n_1", "n_0", "u_stat", "tie_sum")


EXPL = """ex AS (SELECT layer, id, (score - avg(score) OVER (PARTITION BY layer, cohort)) / nullif(stddev_samp(score) OVER (PARTITION BY layer, cohort), 0) AS z,
 (id % 97) / 97.0::DOUBLE AS probability, label FROM scores), ec AS (SELECT *, CAST((probability >= 0.5)::INT = label AS INT) AS correct FROM ex WHERE z IS NOT NULL)"""


def _expl(t):
    z = S.zscore_within(t("scores"), ["layer", "cohort"], "score", "z").withColumn("probability", F.col("id") % 97 / 97.0)
    return O.model_correctness(z, "probability", "label").withColumnRenamed("model_correct", "correct")


@query(f"""WITH {EXPL}, r AS (SELECT *, {avg_rank('round(z, 12)', 'layer')} AS rz, {avg_rank('probability', 'layer')} AS rp FROM ec),
 a AS (SELECT layer, count(*) AS n, (sum(rz) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * (count(*) - sum(label)), 0) AS auroc, corr(rz, rp) AS rho FROM r GROUP BY 1),
 s AS ({_sides('layer', 'z', 'label', 'ec')}), c AS ({_sides('layer', 'z', 'correct', 'ec')}),
 x AS (SELECT layer, {D} AS d FROM s), y AS (SELECT layer, {D} AS cd, n1, n0 FROM c)
 SELECT layer, n, round(auroc, 8) AS auroc, round(rho, 8) AS rho, round(d, 8) AS cohen_d, round(cd, 8) AS correct_cohen_d, n1 AS n_correct, n0 AS n_incorrect,
 round(coalesce(auroc, 0.5) - 0.5 + 0.25 * coalesce(abs(rho), 0) + 0.05 * least(coalesce(abs(d), 0), 5), 8) AS clarification_score FROM a JOIN x USING (layer) JOIN y USING (layer) WHERE n >= 4""")
def clarification_rank(t):
    rows = _expl(t).withColumn("z", F.round("z", 12))
    out = O.clarification_rank(rows, ["layer"])
    return out.select("layer", "n", "n_correct", "n_incorrect", *[_r(c, 8) for c in ("auroc", "rho", "cohen_d", "correct_cohen_d", "clarification_score")])


@query("""SELECT doc_id, CAST(p >= 0.5 AS INT) AS model_class, CASE WHEN quality IS NOT NULL THEN CAST((p >= 0.5)::INT = quality AS INT) END AS model_correct
 FROM (SELECT doc_id, (doc_id % 97) / 97.0::DOUBLE AS p, quality FROM documents LEFT JOIN labels USING (doc_id))""")
def model_correctness(t):
    rows = t("documents").join(t("labels"), "doc_id", "left").withColumn("p", F.col("doc_id") % 97 / 97.0)
    return O.model_correctness(rows, "p", "quality").select("doc_id", "model_class", "model_correct")


@query(f"""WITH {EXPL} SELECT s.id, s.layer, round(z, 9) AS z, label, probability FROM scores s LEFT JOIN (SELECT id, layer, z, probability FROM ex) e ON e.id = s.id AND e.layer = s.layer""")
def scores_with_predictions(t):
    from tidepair.operators.joins import scores_with_predictions as join_
    base = _expl(t).select("id", "layer", "z", "probability", "label")
    return join_(base.select("id", "layer", "z", F.lit(9).alias("label")), base.drop("z"), ["id", "layer"]).select(
        "id", "layer", _r("z"), "label", "probability")


LONG = """lg AS (SELECT l_suppkey AS row_index, l_partkey AS gene, sum(l_quantity) AS truth, sum(l_quantity * (1 - l_discount)) AS pred, sum(l_quantity) / 2 + max(l_linenumber) AS source FROM lineitem GROUP BY ALL)"""


def _long(t):
    return t("lineitem").groupBy(F.col("l_suppkey").alias("row_index"), F.col("l_partkey").alias("gene_id")).agg(
        F.sum("l_quantity").alias("truth"), F.sum(F.col("l_quantity") * (1 - F.col("l_discount"))).alias("pred"),
        (F.sum("l_quantity") / 2 + F.max("l_linenumber")).alias("source"))


EM = """em AS (SELECT row_index, avg((pred - truth) ** 2) AS mse, avg(abs(pred - truth)) AS mae, corr(pred, truth) AS post_pearson, corr(pred - source, truth - source) AS delta_pearson,
 sqrt(sum((pred - source) ** 2)) AS predicted_delta_l2, sqrt(sum((truth - source) ** 2)) AS observed_delta_l2 FROM lg GROUP BY 1)"""
EM_COLS = ["mse", "mae", "post_pearson", "delta_pearson", "predicted_delta_l2", "observed_delta_l2"]


@query(f"WITH {LONG}, {EM} SELECT row_index, {', '.join(f'round({c}, 8) AS {c}' for c in EM_COLS)} FROM em")
def endpoint_metrics(t):
    return O.endpoint_metrics(_long(t), ["row_index"]).select("row_index", *[_r(c, 8) for c in EM_COLS])


def _folded(t):
    return _long(t).withColumn("fold", F.col("row_index") % 5)


MD = LONG + """, fs AS (SELECT row_index % 5 AS fold, gene, sum(truth - source) AS s, count(*) AS n FROM lg GROUP BY ALL),
 sh AS (SELECT fold, gene, (sum(s) OVER w - s) / nullif(sum(n) OVER w - n, 0) AS shift FROM fs WINDOW w AS (PARTITION BY gene)),
 pr AS (SELECT lg.*, source + shift AS p FROM lg JOIN sh ON lg.gene = sh.gene AND lg.row_index % 5 = sh.fold)"""


@query(f"WITH {LONG} SELECT row_index, gene AS gene_id, source AS pred FROM lg")
def baseline_identity(t):
    return _long(t).select("row_index", "gene_id", F.col("source").alias("pred"))


@query(f"WITH {MD} SELECT row_index, gene AS gene_id, round(p, 8) AS pred FROM pr")
def baseline_mean_delta(t):
    return O.baseline_mean_delta(_folded(t)).select("row_index", "gene_id", _r("pred", 8))


def _two_methods(t):
    from tidepair.plans.session import cut
    cols = ["mse", "mae", "post_pearson", "delta_pearson"]
    rows = _folded(t)
    a = O.endpoint_metrics(rows.withColumn("pred", F.col("source")), ["row_index"]).withColumn("method", F.lit("world_pretrained"))
    b = O.endpoint_metrics(O.baseline_mean_delta(rows).where(F.col("pred").isNotNull()), ["row_index"]).withColumn("method", F.lit("world_finetuned"))
    return cut(a.unionByName(b).select("method", "row_index", F.floor(F.col("row_index") / 2).alias("patient_id"), *cols))


TWO = MD + """, mt AS (SELECT 'world_pretrained' AS method, row_index, avg((source - truth) ** 2) AS mse, avg(abs(source - truth)) AS mae, corr(source, truth) AS post_pearson, NULL::DOUBLE AS delta_pearson FROM lg GROUP BY row_index
 UNION ALL SELECT 'world_finetuned', row_index, avg((p - truth) ** 2), avg(abs(p - truth)), corr(p, truth), corr(p - source, truth - source) FROM pr WHERE p IS NOT NULL GROUP BY row_index),
 ml AS (SELECT method, row_index, 'mse' AS metric, mse AS v FROM mt UNION ALL SELECT method, row_index, 'mae', mae FROM mt UNION ALL SELECT method, row_index, 'post_pearson', post_pearson FROM mt
 UNION ALL SELECT method, row_index, 'delta_pearson', delta_pearson FROM mt)"""


@query(f"WITH {TWO} SELECT method, metric, round(avg(v), 8) AS mean, count(v) AS n, round(quantile_cont(v, 0.5), 8) AS median FROM ml GROUP BY ALL")
def method_summary(t):
    out = O.method_summary(_two_methods(t), ["mse", "mae", "post_pearson", "delta_pearson"])
    return out.select("method", "metric", _r("mean", 8), "n", _r("median", 8))


@query(f"""WITH {TWO}, w AS (SELECT metric, row_index // 2 AS patient_id, row_index, max(v) FILTER (method = 'world_pretrained') AS p, max(v) FILTER (method = 'world_finetuned') AS f FROM ml GROUP BY ALL),
 g AS (SELECT metric, patient_id, avg(CASE WHEN metric IN ('mse', 'mae') THEN p - f ELSE f - p END) AS gain FROM w GROUP BY ALL HAVING gain IS NOT NULL),
 r AS (SELECT *, {avg_rank('abs(gain)', 'metric')} AS r FROM g)
 SELECT metric, count(*) AS n_patients, round(avg(gain), 8) AS mean_improvement, round(quantile_cont(gain, 0.5), 8) AS median_improvement, round(avg((gain > 0)::INT), 9) AS win_rate,
 round(avg((gain = 0)::INT), 9) AS tie_rate, least(coalesce(sum(r) FILTER (gain > 0), 0), coalesce(sum(r) FILTER (gain < 0), 0)) AS w_stat FROM r GROUP BY 1""")
def finetune_comparison(t):
    out = O.finetune_comparison(_two_methods(t))
    return out.select("metric", "n_patients", _r("mean_improvement", 8), _r("median_improvement", 8), _r("win_rate"), _r("tie_rate"), "w_stat")


CM = f"""pb AS (SELECT layer, score / 20000 AS p, label FROM scores), r AS (SELECT *, {avg_rank('p', 'layer')} AS r FROM pb),
 c AS (SELECT layer, count(*) FILTER (p >= 0.5 AND label = 1) AS tp, count(*) FILTER (p < 0.5 AND label = 0) AS tn, count(*) FILTER (p >= 0.5 AND label = 0) AS fp, count(*) FILTER (p < 0.5 AND label = 1) AS fn,
  (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * (count(*) - sum(label)), 0) AS auroc FROM r GROUP BY 1)"""


@query(f"""WITH {CM}, {AP} SELECT layer, tp, tn, fp, fn, round(0.5 * (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)), 9) AS balanced_accuracy,
 round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 9) AS mcc,
 round(auroc, 9) AS auroc, round(auprc, 9) AS auprc FROM c JOIN ap USING (layer)""")
def classification_metrics(t):
    rows = t("scores").withColumn("p", F.col("score") / 20000)
    out = S.classification_metrics(rows, ["layer"], "p", "label")
    return out.select("layer", "tp", "tn", "fp", "fn", *[_r(c) for c in ("balanced_accuracy", "mcc", "auroc", "auprc")])


def _vectors(t):
    return t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label"), (F.col("vec_id") % 5).alias("fold"),
                                  F.transform("embedding", lambda v: v.cast("double") * 2 + 1).alias("y"))


@query()
def baseline_pca_ridge(t):
    out = O.baseline_pca_ridge(_vectors(t), "fold", "x", "y", components=32)
    return out.select("vec_id", "fold", F.transform("pred", lambda v: F.round(v, 6)).alias("pred"))


@query()
def response_classifier(t):
    rows = _vectors(t).select("vec_id", "fold", "x", F.when(F.col("label") < 5, 1).otherwise(0).alias("label"))
    return O.response_classifier(rows, "fold", "x", "label").select("vec_id", "fold", "label", _r("probability", 6))


@query("""WITH g AS (SELECT source AS grp, count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality = 0) AS n0, count(*) FILTER (quality IS NULL) AS n2 FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1),
 p AS (SELECT grp, row_number() OVER (ORDER BY n1 DESC, n0 DESC, n2 DESC, md5(concat('1:', grp)), grp) - 1 AS pos FROM g)
 SELECT grp AS source, CASE WHEN (pos // 5) % 2 = 0 THEN pos % 5 ELSE 4 - pos % 5 END AS fold FROM p""")
def grouped_stratified_folds(t):
    rows = t("documents").join(t("labels"), "doc_id", "left")
    return O.grouped_stratified_folds(rows, "source", "quality", 5, 1)

