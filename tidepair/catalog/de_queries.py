"""Pseudobulk differential expression and composition queries."""

from pyspark.sql import functions as F

from tidepair.operators import pseudobulk as P
from tidepair.plans.session import broadcast_rows, cut, cut_counted

from .sqlmath import bh, fisher, t_p
from .tables import query


def _r(c, n=9, alias=None):
    return F.round(c, n).alias(alias or c)


MIN_PAIRS = 20
PAIRS = """pr AS (SELECT concat(study, '|', dataset_id) AS replicate_id, dataset_id AS tumor_type, pair_id, source_cell, target_cell, source_label, target_label, probability FROM pairs)"""
SCOPES = PAIRS + f""", sc0 AS (SELECT replicate_id, pair_id, source_cell, target_cell, 'tumor_type' AS scope, tumor_type AS scope_key FROM pr
 UNION ALL SELECT replicate_id, pair_id, source_cell, target_cell, 'global', 'all' FROM pr
 UNION ALL SELECT replicate_id, pair_id, source_cell, target_cell, 'cell_type', source_label FROM pr
 UNION ALL SELECT replicate_id, pair_id, source_cell, target_cell, 'cell_type', target_label FROM pr WHERE target_label <> source_label),
 sz AS (SELECT scope, scope_key, replicate_id, count(*) AS n_pairs FROM sc0 GROUP BY ALL HAVING scope <> 'cell_type' OR count(*) >= {MIN_PAIRS}),
 sc AS (SELECT * FROM sc0 JOIN sz USING (scope, scope_key, replicate_id))"""
METRICS = PAIRS + """, sc0 AS (SELECT replicate_id, pair_id, source_cell, target_cell, metric AS scope, tumor_type AS scope_key
  FROM pr, (VALUES ('any', 0.0), ('mid', 0.4), ('top', 0.6)) m(metric, low) WHERE probability >= low),
 sz AS (SELECT scope, scope_key, replicate_id, count(*) AS n_pairs FROM sc0 GROUP BY ALL), sc AS (SELECT * FROM sc0 JOIN sz USING (scope, scope_key, replicate_id))"""
BULK = """, lng AS (SELECT scope, scope_key, replicate_id, gene_id, value AS s, 0 AS t, n_pairs FROM sc JOIN expr ON cell_id = source_cell
  UNION ALL SELECT scope, scope_key, replicate_id, gene_id, 0, value, n_pairs FROM sc JOIN expr ON cell_id = target_cell),
 bk AS (SELECT scope, scope_key, replicate_id, gene_id, sum(s) AS source_sum, sum(t) AS target_sum, count(*) FILTER (s > 0) AS source_nnz,
  count(*) FILTER (t > 0) AS target_nnz, max(n_pairs) AS n_pairs, sum(s) / max(n_pairs) AS source_mean, sum(t) / max(n_pairs) AS target_mean FROM lng GROUP BY ALL)"""
SUMMARY = """, gs AS (SELECT scope, scope_key, gene_id, tot AS n_pairs, sum(source_sum) / tot AS source_mean, sum(target_sum) / tot AS target_mean,
  sum(source_nnz) / tot AS source_pct, sum(target_nnz) / tot AS target_pct FROM bk
  JOIN (SELECT scope, scope_key, sum(n_pairs) AS tot FROM sz GROUP BY ALL) USING (scope, scope_key) GROUP BY scope, scope_key, gene_id, tot)"""
# every gene against every replicate of its scope, absent ones as zero
DENSE = """, gd AS (SELECT DISTINCT scope, scope_key, gene_id FROM bk), dn AS (SELECT gd.scope, gd.scope_key, gd.gene_id, sz.replicate_id,
  coalesce(bk.source_mean, 0) AS sm, coalesce(bk.target_mean, 0) AS tm FROM gd JOIN sz USING (scope, scope_key)
  LEFT JOIN bk ON bk.scope = gd.scope AND bk.scope_key = gd.scope_key AND bk.gene_id = gd.gene_id AND bk.replicate_id = sz.replicate_id)"""
TTEST = DENSE + f""", tt0 AS (SELECT scope, scope_key, gene_id, count(*) AS n_replicates, avg(sm) AS ps, avg(tm) AS pt, avg(tm - sm) AS pd, stddev_samp(tm - sm) AS sd,
  min_by(tm - sm, replicate_id) AS d0, min(tm - sm) AS lo, max(tm - sm) AS hi FROM dn GROUP BY ALL),
 tt1 AS (SELECT *, CASE WHEN n_replicates < 2 THEN NULL WHEN greatest(hi - d0, d0 - lo) <= 1e-8 + 1e-5 * abs(d0) THEN 0.0::DOUBLE
  ELSE pd / (sd / sqrt(n_replicates)) END AS t_stat FROM tt0),
 tt AS (SELECT *, {t_p('t_stat', '(n_replicates - 1)')} AS p_value FROM tt1)"""
_RAW, _Q = bh("p_value", "scope, scope_key")
TABLE = SUMMARY + TTEST + f""", q0 AS (SELECT *, {_RAW} AS raw_q FROM tt), q1 AS (SELECT *, {_Q} AS fdr FROM q0),
 de AS (SELECT q1.*, gs.n_pairs, gs.source_mean, gs.target_mean, gs.target_mean - gs.source_mean AS mean_delta, abs(gs.target_mean - gs.source_mean) AS abs_mean_delta,
  fdr <= 0.05 AS significant_05, fdr <= 0.10 AS significant_10 FROM q1 JOIN gs USING (scope, scope_key, gene_id))"""


def _pairs(t):
    return t("pairs").select(F.concat_ws("|", "study", "dataset_id").alias("replicate_id"), F.col("dataset_id").alias("tumor_type"),
                             "pair_id", "source_cell", "target_cell", "source_label", "target_label", "probability")


LABELS = ["tumor_type", "source_label", "target_label"]
LOWS = {"any": 0.0, "mid": 0.4, "top": 0.6}


def _metric_scopes():
    """Scopes of a pair's band: every metric whose lower bound it reaches, under its tumor type."""
    return F.array_compact(F.array(*[F.when(F.col("band") >= i + 1, F.struct(F.lit(m).alias("scope"), F.col("tumor_type").alias("scope_key")))
                                     for i, m in enumerate(LOWS)]))


def _scoped(t, by_metric=False):
    """(pairs, columns that scopes are made of, scopes, least pairs of a cell type in a replicate)."""
    pairs = _pairs(t)
    if by_metric:
        band = sum(((F.col("probability") >= low).cast("int") for low in LOWS.values()), F.lit(0))
        return pairs.withColumn("band", band), ["tumor_type", "band"], _metric_scopes(), 0
    return pairs, LABELS, P.tumor_scopes(), MIN_PAIRS


def _small(t, df, n):
    return F.broadcast(df) if n <= broadcast_rows(t.spark) else df


def _sparse(t, by_metric=False, replicates=True, expr=None):
    """(sums, counts, sizes) for genes that few cells hold: sums per scope, gene and, if asked for, replicate."""
    pairs, by, scopes, least = _scoped(t, by_metric)
    combos, n_combos = P.coded(pairs.groupBy("replicate_id", *by).agg(F.count(F.lit(1)).alias("_n")), "_combo")
    counts, n = P.coded(P.combo_counts(combos, scopes, least), "_g")
    sizes, n_sizes = P.coded(P.scope_sizes(counts), "_scope")
    groups = counts if replicates else P.join_on(counts.drop("_g"), sizes.select(*KEYS, F.col("_scope").alias("_g")), KEYS)
    listed = cut(P.combo_groups(combos, scopes, groups.select(*KEYS, "replicate_id", "_g")))
    sums = P.sparse_sums(pairs, t("expr") if expr is None else expr, combos, by, listed, n_combos <= broadcast_rows(t.spark))
    names = _small(t, counts, n) if replicates else _small(t, sizes.select(F.col("_scope").alias("_g"), *KEYS, "n_pairs"), n_sizes)
    return sums.join(names, "_g").drop("_g"), counts.drop("_g"), _small(t, sizes.drop("_scope"), n_sizes)


def _tested(t, by_metric=False):
    """(genes with their paired test under the number of their scope, scope_sizes with that number)."""
    pairs, by, scopes, least = _scoped(t, by_metric)
    combos, n_combos = P.coded(pairs.groupBy("replicate_id", *by).agg(F.count(F.lit(1)).alias("_n")), "_combo")
    counts, n = P.coded(P.combo_counts(combos, scopes, least), "_g")
    sizes, n_sizes = P.coded(P.scope_sizes(counts), "_scope")
    if max(n, n_combos) > broadcast_rows(t.spark):
        bulk, own = _bulk(t, by_metric)
        numbered = P.join_on(P.gene_states(bulk, own).drop("n_pairs", "n_replicates"), sizes.select(*KEYS, "_scope"), KEYS).drop(*KEYS)
        return P.tested_genes(numbered, _small(t, sizes, n_sizes)), _small(t, sizes, n_sizes)
    groups = P.scope_groups(combos, scopes, counts, sizes)
    return P.tested_genes(P.sparse_states(pairs, t("expr"), combos, by, groups), F.broadcast(sizes)), F.broadcast(sizes)


def _bulk(t, by_metric=False, expr=None):
    """Means per scope, replicate and gene, and sizes of the scopes. expr: expression of few genes, held by many cells."""
    if expr is None:
        sums, _, sizes = _sparse(t, by_metric)
        return P.with_means(sums), sizes
    pairs, by, scopes, least = _scoped(t, by_metric)
    counts, n = cut_counted(P.scope_counts(pairs, by, scopes, least))
    counts = _small(t, counts, n)
    sizes, n = cut_counted(P.scope_sizes(counts))
    return P.pseudobulk_means(P.pseudobulk_states(pairs, expr, by), scopes, counts), _small(t, sizes, n)


def _summary(t):
    """gene_summary without the replicates, which it only adds up; and scope_counts."""
    sums, counts, _ = _sparse(t, replicates=False)
    return P.with_summary(sums), counts


def _table(t, by_metric=False):
    tested, sizes = _tested(t, by_metric)
    tested, n = cut_counted(tested.select("_scope", "gene_id", "mean_delta", "abs_mean_delta", "t_stat", "p_value"))
    table = P.bh_fdr(tested, ["_scope"], "p_value", "fdr", n)
    return P.with_flags(table.join(sizes.select("_scope", *KEYS, "n_pairs", "n_replicates"), "_scope").drop("_scope"))


def _first(t, pick):
    """Rows that pick takes from the tested genes, their scopes named."""
    tested, sizes = _tested(t)
    tested = cut(tested.select("_scope", "gene_id", "abs_mean_delta", "p_value"))
    return pick(tested, ["_scope"]).join(sizes.select("_scope", *KEYS), "_scope")


KEYS = P.KEYS


@query(f"WITH {SCOPES} SELECT scope, scope_key, replicate_id, count(*) AS n_pairs, count(DISTINCT pair_id) AS n_ids FROM sc GROUP BY ALL")
def de_scopes(t):
    return P.de_scopes(_pairs(t), MIN_PAIRS).groupBy(*KEYS, "replicate_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("pair_id").alias("n_ids"))


@query(f"WITH {SCOPES}{BULK} SELECT scope, scope_key, replicate_id, gene_id, n_pairs, round(source_mean, 9) AS source_mean, round(target_mean, 9) AS target_mean FROM bk")
def pseudobulk_means(t):
    return _bulk(t)[0].select(*KEYS, "replicate_id", "gene_id", "n_pairs", _r("source_mean"), _r("target_mean"))


@query(f"""WITH {SCOPES}{BULK}{SUMMARY} SELECT scope, scope_key, gene_id, n_pairs, round(source_mean, 9) AS source_mean, round(target_mean, 9) AS target_mean,
 round(source_pct, 9) AS source_pct, round(target_pct, 9) AS target_pct, round(target_mean - source_mean, 9) AS mean_delta,
 round(log2((target_mean + 1e-6::DOUBLE) / (source_mean + 1e-6::DOUBLE)), 7) AS log2fc FROM gs""")
def gene_summary(t):
    return _summary(t)[0].select(
        *KEYS, "gene_id", "n_pairs", *[_r(c) for c in ("source_mean", "target_mean", "source_pct", "target_pct", "mean_delta")], _r("log2fc", 7))


@query(f"""WITH {SCOPES}{BULK}{TTEST} SELECT scope, scope_key, gene_id, n_replicates, round(ps, 9) AS pseudobulk_source_mean, round(pt, 9) AS pseudobulk_target_mean,
 round(pd, 9) AS pseudobulk_delta, round(t_stat, 6) AS t_stat, round(p_value, 7) AS p_value FROM tt""")
def paired_t_test(t):
    tested, sizes = _tested(t)
    return tested.drop("n_pairs").join(sizes.select("_scope", *KEYS), "_scope").select(
        *KEYS, "gene_id", "n_replicates", _r("pseudobulk_source_mean"), _r("pseudobulk_target_mean"), _r("pseudobulk_delta"),
        _r("t_stat", 6), _r("p_value", 7))


_R2, _Q2 = bh("p_value")
_R3, _Q3 = bh("p_value", "l_returnflag")


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice / 200000 END AS p_value FROM lineitem),
 a AS (SELECT *, {_R2} AS raw_q FROM s), b AS (SELECT * EXCLUDE raw_q, {_Q2} AS q_all FROM a), c AS (SELECT *, {_R3} AS raw_q FROM b)
 SELECT l_orderkey, l_linenumber, p_value, round(q_all, 9) AS q_all, round({_Q3}, 9) AS q_group FROM c""")
def bh_fdr(t):
    from tidepair.plans.ordered import bh_fdr as bh_
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.when(
        F.col("l_linenumber") != 3, F.col("l_extendedprice") / 200000).alias("p_value"))
    out = bh_(bh_(rows, [], "p_value", "q_all"), ["l_returnflag"], "p_value", "q_group", values=rows)
    return out.select("l_orderkey", "l_linenumber", "p_value", _r("q_all"), _r("q_group"))


@query(f"""WITH {SCOPES}{BULK}{TABLE} SELECT scope, scope_key, gene_id, n_pairs, n_replicates, round(mean_delta, 9) AS mean_delta, round(t_stat, 6) AS t_stat,
 round(p_value, 7) AS p_value, round(fdr, 6) AS fdr, significant_05, significant_10 FROM de""")
def de_table(t):
    return _table(t).select(*KEYS, "gene_id", "n_pairs", "n_replicates", _r("mean_delta"), _r("t_stat", 6), _r("p_value", 7), _r("fdr", 6),
                            "significant_05", "significant_10")


@query(f"""WITH {SCOPES}{BULK}{TABLE} SELECT scope, scope_key, max(n_pairs)::BIGINT AS n_pairs, max(n_replicates) AS n_replicates, count(*) AS n_genes,
 count(*) FILTER (significant_05) AS n_fdr_0p05, count(*) FILTER (significant_10) AS n_fdr_0p10 FROM de GROUP BY ALL""")
def de_index(t):
    return P.index_of_tested(*_tested(t))


ORDER = "round(fdr, 9) NULLS LAST, round(abs_mean_delta, 9) DESC, gene_id"


@query(f"""WITH {SCOPES}{BULK}{TABLE}, r AS (SELECT *, row_number() OVER (PARTITION BY scope, scope_key ORDER BY {ORDER}) AS gene_rank FROM de)
 SELECT scope, scope_key, gene_id, gene_rank FROM r WHERE gene_rank <= 200""")
def top_genes(t):
    return _first(t, lambda tested, keys: P.top_genes(P.leading(tested, keys, 200), keys, 200)).select(*KEYS, "gene_id", F.col("gene_rank").cast("bigint").alias("gene_rank"))


@query(f"""WITH {SCOPES}{BULK}{TABLE} SELECT scope, scope_key, gene_id, row_number() OVER (PARTITION BY scope, scope_key
 ORDER BY coalesce(round(fdr, 9), 'inf'::DOUBLE), coalesce(round(p_value, 9), 'inf'::DOUBLE), -coalesce(round(abs_mean_delta, 9), 0), gene_id) AS gene_rank FROM de""")
def all_genes_ranked(t):
    return P.all_genes_ranked(_table(t), KEYS).select(*KEYS, "gene_id", "gene_rank")


TRANS = PAIRS + """, tr AS (SELECT tumor_type, replicate_id, source_label, target_label, count(*) AS n_pairs FROM pr GROUP BY ALL)"""


@query(f"WITH {TRANS} SELECT *, round(n_pairs / sum(n_pairs) OVER (PARTITION BY tumor_type, replicate_id), 9) AS fraction FROM tr")
def annotation_transitions(t):
    return P.annotation_transitions(_pairs(t), ["tumor_type", "replicate_id"]).withColumn("fraction", F.round("fraction", 9))


FRACS = PAIRS + """, sd AS (SELECT tumor_type, replicate_id, source_label AS label, 1 AS s FROM pr UNION ALL SELECT tumor_type, replicate_id, target_label, 0 FROM pr),
 nn AS (SELECT replicate_id, count(*) AS n_pairs FROM pr GROUP BY 1), fr AS (SELECT tumor_type, replicate_id, label, max(n_pairs) AS n_pairs, sum(s) / max(n_pairs) AS source_fraction,
 sum(1 - s) / max(n_pairs) AS target_fraction FROM sd JOIN nn USING (replicate_id) GROUP BY ALL)"""


@query(f"""WITH {FRACS} SELECT tumor_type, replicate_id, label, n_pairs, round(source_fraction, 9) AS source_fraction, round(target_fraction, 9) AS target_fraction,
 round(target_fraction - source_fraction, 9) AS fraction_delta FROM fr""")
def annotation_fraction_replicates(t):
    out = P.annotation_fraction_replicates(_pairs(t), ["tumor_type", "replicate_id"])
    return out.select("tumor_type", "replicate_id", "label", "n_pairs", _r("source_fraction"), _r("target_fraction"), _r("fraction_delta"))


@query(f"""WITH {TRANS}, x AS (SELECT tumor_type, target_label, sum(n_pairs)::BIGINT AS n_pairs FROM tr GROUP BY ALL)
 SELECT *, round(n_pairs / sum(n_pairs) OVER (PARTITION BY tumor_type), 9) AS fraction FROM x""")
def target_annotation_fraction(t):
    tr = P.annotation_transitions(_pairs(t), ["tumor_type", "replicate_id"])
    return P.target_annotation_fraction(tr, ["tumor_type"]).withColumn("fraction", F.round("fraction", 9))


_R4, _Q4 = bh("p_value", "tumor_type")


@query(f"""WITH {FRACS}, a AS (SELECT tumor_type, label, count(*) AS n_replicates, avg(source_fraction) AS ms, avg(target_fraction) AS mt, avg(target_fraction - source_fraction) AS md,
 stddev_samp(target_fraction - source_fraction) AS sd FROM fr GROUP BY ALL), b AS (SELECT *, md / (sd / sqrt(n_replicates)) AS t_stat FROM a),
 c AS (SELECT *, {t_p('t_stat', '(n_replicates - 1)')} AS p_value FROM b), d AS (SELECT *, {_R4} AS raw_q FROM c)
 SELECT tumor_type, label, n_replicates, round(ms, 9) AS mean_source_fraction, round(mt, 9) AS mean_target_fraction, round(md, 9) AS mean_delta, round(t_stat, 6) AS t_stat,
 round(p_value, 7) AS p_value, round({_Q4}, 7) AS fdr FROM d""")
def paired_fraction_test(t):
    fr = P.annotation_fraction_replicates(_pairs(t), ["tumor_type", "replicate_id"])
    return P.paired_fraction_test(fr, ["tumor_type"]).select(
        "tumor_type", "label", "n_replicates", *[_r(c) for c in ("mean_source_fraction", "mean_target_fraction", "mean_delta")],
        _r("t_stat", 6), _r("p_value", 7), _r("fdr", 7))


@query(f"""WITH {TRANS}, x AS (SELECT tumor_type, source_label, target_label, sum(n_pairs)::BIGINT AS observed FROM tr GROUP BY ALL),
 y AS (SELECT *, (sum(observed) OVER (PARTITION BY tumor_type, source_label))::BIGINT AS rt, (sum(observed) OVER (PARTITION BY tumor_type, target_label))::BIGINT AS ct,
 (sum(observed) OVER (PARTITION BY tumor_type))::BIGINT AS total FROM x), z AS (SELECT *, {fisher('observed', 'rt - observed', 'ct - observed', 'total - rt - ct + observed')} AS p_value FROM y),
 w AS (SELECT *, {_R4} AS raw_q FROM z)
 SELECT tumor_type, source_label, target_label, observed, total, round(rt * ct / total, 7) AS expected, round(observed / (rt * ct / total + 1e-6::DOUBLE), 7) AS observed_over_expected,
 round(observed * (total - rt - ct + observed) / ((rt - observed) * (ct - observed)), 7) AS odds_ratio, round(p_value, 7) AS p_value, round({_Q4}, 7) AS fdr FROM w""")
def transition_enrichment(t):
    tr = P.annotation_transitions(_pairs(t), ["tumor_type", "replicate_id"])
    return P.transition_enrichment(tr, ["tumor_type"]).select(
        "tumor_type", "source_label", "target_label", "observed", "total",
        *[_r(c, 7) for c in ("expected", "observed_over_expected", "odds_ratio", "p_value", "fdr")])


@query(f"""WITH {SCOPES}{BULK}, gn AS (SELECT concat('SIG_', brand) AS signature, gene_id FROM genes), nf AS (SELECT signature, count(*) AS n_genes_found FROM gn GROUP BY 1),
 ss AS (SELECT scope, scope_key, replicate_id, signature, sum(source_mean) / max(n_genes_found) AS sm, sum(target_mean) / max(n_genes_found) AS tm
  FROM bk JOIN gn USING (gene_id) JOIN nf USING (signature) GROUP BY ALL),
 gr AS (SELECT scope, scope_key, replicate_id, signature FROM sz, nf), dn AS (SELECT gr.*, coalesce(sm, 0) AS sm, coalesce(tm, 0) AS tm FROM gr LEFT JOIN ss USING (scope, scope_key, replicate_id, signature)),
 a AS (SELECT scope, scope_key, signature, count(*) AS n_replicates, avg(sm) AS ms, avg(tm) AS mt, avg(tm - sm) AS md, stddev_samp(tm - sm) AS sd FROM dn GROUP BY ALL),
 b AS (SELECT *, md / (sd / sqrt(n_replicates)) AS t_stat FROM a), c AS (SELECT *, {t_p('t_stat', '(n_replicates - 1)')} AS p_value FROM b), d AS (SELECT *, {_RAW} AS raw_q FROM c)
 SELECT scope, scope_key, signature, n_genes_found, n_replicates, round(ms, 9) AS mean_source_score, round(mt, 9) AS mean_target_score, round(md, 9) AS mean_delta,
 round(t_stat, 6) AS t_stat, round(p_value, 7) AS p_value, round({_Q}, 6) AS fdr FROM d JOIN nf USING (signature)""")
def signature_scores_test(t):
    signatures = t("genes").select(F.concat(F.lit("SIG_"), "brand").alias("signature"), F.col("gene_symbol").alias("symbol"))
    found = cut(P.signature_genes(t("genes"), signatures))
    out = P.signature_scores_test(*_bulk(t, expr=P.signature_expression(t("expr"), found)), found)
    return out.select(*KEYS, "signature", "n_genes_found", "n_replicates", _r("pseudobulk_source_mean", 9, "mean_source_score"),
                      _r("pseudobulk_target_mean", 9, "mean_target_score"), _r("pseudobulk_delta", 9, "mean_delta"), _r("t_stat", 6),
                      _r("p_value", 7), _r("fdr", 6))


TOP = "row_number() OVER (PARTITION BY scope, scope_key ORDER BY {o}) <= 200"
MEMBERS = f""", mem AS (SELECT scope_key, scope, gene_id, 'fdr_0p05' AS kind FROM de WHERE fdr <= 0.05
 UNION ALL (SELECT scope_key, scope, gene_id, 'top200_abs_delta' FROM de QUALIFY {TOP.format(o='round(abs_mean_delta, 9) DESC, gene_id')})
 UNION ALL (SELECT scope_key, scope, gene_id, 'top200_pvalue' FROM de QUALIFY {TOP.format(o='round(p_value, 9) NULLS LAST, gene_id')}))"""
PAIRWISE = """, ms AS (SELECT DISTINCT scope_key, scope FROM de), kd AS (SELECT DISTINCT scope_key, kind FROM {m}),
 gp AS (SELECT a.scope_key, kind, a.scope AS metric_a, b.scope AS metric_b FROM ms a JOIN ms b ON a.scope_key = b.scope_key AND a.scope < b.scope JOIN kd ON kd.scope_key = a.scope_key),
 ov AS (SELECT a.scope_key, a.kind, a.scope AS metric_a, b.scope AS metric_b, count(*) AS overlap, string_agg(a.gene_id, ';' ORDER BY a.gene_id) AS overlap_genes
  FROM {m} a JOIN {m} b ON a.scope_key = b.scope_key AND a.kind = b.kind AND a.gene_id = b.gene_id AND a.scope < b.scope GROUP BY ALL),
 cn AS (SELECT scope_key, kind, scope, count(*) AS n FROM {m} GROUP BY ALL),
 pw AS (SELECT gp.*, coalesce(ca.n, 0) AS n_a, coalesce(cb.n, 0) AS n_b, coalesce(overlap, 0) AS overlap, coalesce(overlap_genes, '') AS overlap_genes FROM gp
  LEFT JOIN ov USING (scope_key, kind, metric_a, metric_b) LEFT JOIN cn ca ON ca.scope_key = gp.scope_key AND ca.kind = gp.kind AND ca.scope = metric_a
  LEFT JOIN cn cb ON cb.scope_key = gp.scope_key AND cb.kind = gp.kind AND cb.scope = metric_b)"""


@query(f"""WITH {METRICS}{BULK}{TABLE}, mem AS (SELECT scope_key, scope, gene_id, 'sig' AS kind FROM de WHERE fdr <= 0.05
 UNION ALL (SELECT scope_key, scope, gene_id, 'top' FROM de QUALIFY {TOP.format(o=ORDER)})){PAIRWISE.format(m='mem')}
 SELECT scope_key, kind, metric_a, metric_b, n_a, n_b, overlap, n_a + n_b - overlap AS n_union,
 round(coalesce(overlap / nullif(n_a + n_b - overlap, 0), 0), 9) AS jaccard FROM pw""")
def metric_robustness(t):
    out = P.metric_robustness(cut(_table(t, by_metric=True)), ["scope_key"], "scope")
    return out.select("scope_key", "kind", "metric_a", "metric_b", "n_a", "n_b", "overlap", "n_union", _r("jaccard"))


@query(f"""WITH {METRICS}{BULK}{TABLE}{MEMBERS}{PAIRWISE.format(m='mem')}, pg AS (SELECT scope_key, kind, gene_id, count(*) AS g FROM mem GROUP BY ALL),
 ne AS (SELECT scope_key, kind, count(DISTINCT scope) AS m FROM mem GROUP BY ALL)
 SELECT scope_key, kind, 'pairwise' AS row_type, metric_a, metric_b, overlap, n_a + n_b - overlap AS n_union, round(overlap / nullif(n_a + n_b - overlap, 0), 9) AS jaccard, overlap_genes FROM pw
 UNION ALL SELECT scope_key, kind, 'summary', 'ALL_METRICS', '', count(*) FILTER (g = m), count(*), round(count(*) FILTER (g = m) / count(*), 9),
 coalesce(string_agg(gene_id, ';' ORDER BY gene_id) FILTER (g = m), '') FROM pg JOIN ne USING (scope_key, kind) GROUP BY scope_key, kind""")
def metric_overlap_summary(t):
    return P.metric_overlap_summary(cut(_table(t, by_metric=True)), ["scope_key"], "scope").withColumn("jaccard", F.round("jaccard", 9))


@query(f"""WITH {SCOPES}{BULK}{TABLE}, r AS (SELECT *, row_number() OVER (PARTITION BY scope, scope_key ORDER BY {ORDER}) AS k FROM de)
 SELECT scope, scope_key, gene_id, round(-log10(greatest(fdr, 1e-300)), 5) AS neg_log10_fdr, coalesce(fdr <= 0.05, false) AS significant, CASE WHEN k <= 12 THEN gene_id END AS label FROM r""")
def volcano_table(t):
    return P.volcano_table(cut(_table(t)), KEYS).select(*KEYS, "gene_id", F.round(F.abs("neg_log10_fdr"), 5).alias("neg_log10_fdr"), "significant", "label")


@query(f"""WITH {SCOPES}{BULK}{SUMMARY}, tp AS (SELECT scope, scope_key, gene_id FROM gs QUALIFY row_number() OVER (PARTITION BY scope, scope_key
  ORDER BY round(abs(target_mean - source_mean), 9) DESC, gene_id) <= 20),
 dd AS (SELECT tp.scope, tp.scope_key, tp.gene_id, sz.replicate_id, coalesce(bk.target_mean - bk.source_mean, 0) AS delta FROM tp JOIN sz USING (scope, scope_key)
  LEFT JOIN bk ON bk.scope = tp.scope AND bk.scope_key = tp.scope_key AND bk.gene_id = tp.gene_id AND bk.replicate_id = sz.replicate_id),
 zz AS (SELECT *, avg(delta) OVER w AS mu, stddev_pop(delta) OVER w AS sd FROM dd WINDOW w AS (PARTITION BY scope, scope_key, gene_id))
 SELECT scope, scope_key, gene_id, replicate_id, round(delta, 9) AS delta, round((delta - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 7) AS z FROM zz""")
def replicate_delta_z(t):
    from tidepair.plans.ordered import top_rows
    summary, counts = _summary(t)
    top = cut(top_rows(summary, KEYS, [P.rounded("abs_mean_delta").desc(), F.col("gene_id")], 20).select(*KEYS, "gene_id"))
    bulk = P.with_means(_sparse(t, expr=t("expr").join(top.select("gene_id").distinct(), "gene_id", "left_semi"))[0])
    return P.replicate_delta_z(bulk, top, KEYS, counts).select(*KEYS, "gene_id", "replicate_id", _r("delta"), _r("z", 7))


@query(f"""WITH {TRANS}, x AS (SELECT tumor_type, source_label, target_label, sum(n_pairs)::BIGINT AS n_pairs FROM tr GROUP BY ALL),
 s0 AS (SELECT tumor_type, source_label, sum(n_pairs) AS n FROM x GROUP BY ALL), g0 AS (SELECT tumor_type, target_label, sum(n_pairs) AS n FROM x GROUP BY ALL),
 s AS (SELECT tumor_type, source_label FROM s0 QUALIFY row_number() OVER (PARTITION BY tumor_type ORDER BY n DESC, source_label) <= 3),
 g AS (SELECT tumor_type, target_label FROM g0 QUALIFY row_number() OVER (PARTITION BY tumor_type ORDER BY n DESC, target_label) <= 3)
 SELECT tumor_type, source_label, target_label, n_pairs, round(n_pairs / sum(n_pairs) OVER (PARTITION BY tumor_type), 9) AS share FROM x
 JOIN s USING (tumor_type, source_label) JOIN g USING (tumor_type, target_label)""")
def transition_matrix_topn(t):
    tr = P.annotation_transitions(_pairs(t), ["tumor_type", "replicate_id"])
    return P.transition_matrix_topn(tr, ["tumor_type"], 3).select("tumor_type", "source_label", "target_label", "n_pairs", _r("share"))


CAT = "CASE WHEN scope = 'global' OR scope_key = 'all' THEN 'global' WHEN scope_key LIKE '%BUILD%' THEN 'breast' WHEN scope_key LIKE '%AUTO%' THEN 'prostate' END"


def _category():
    return (F.when((F.col("scope") == "global") | (F.col("scope_key") == "all"), "global").when(F.col("scope_key").contains("BUILD"), "breast")
            .when(F.col("scope_key").contains("AUTO"), "prostate"))


@query(f"""WITH {SCOPES}{BULK}{TABLE}, ix AS (SELECT scope, scope_key, max(n_replicates) AS n_replicates, count(*) FILTER (significant_10) AS n_fdr_0p10 FROM de GROUP BY ALL)
 SELECT {CAT} AS category, scope, scope_key, n_replicates, n_fdr_0p10 FROM ix WHERE category IS NOT NULL""")
def screen_summary(t):
    ix = P.index_of_tested(*_tested(t)).withColumn("metric", F.lit("entropy_confidence"))
    return P.screen_summary(ix, _category()).select("category", "scope", "scope_key", "n_replicates", "n_fdr_0p10")


@query(f"""WITH {SCOPES}{BULK}{TABLE}, r AS (SELECT *, row_number() OVER (PARTITION BY scope, scope_key ORDER BY coalesce(round(fdr, 9), 'inf'::DOUBLE),
  coalesce(round(p_value, 9), 'inf'::DOUBLE), -coalesce(round(abs_mean_delta, 9), 0), gene_id) AS gene_rank, max((fdr <= 0.10)::INT) OVER (PARTITION BY scope, scope_key) AS anysig FROM de),
 k AS (SELECT *, row_number() OVER (PARTITION BY scope, scope_key ORDER BY gene_rank) AS screen_rank FROM r WHERE coalesce(anysig, 0) = 0 OR fdr <= 0.10)
 SELECT scope, scope_key, gene_id, screen_rank FROM k WHERE screen_rank <= 25""")
def screen_top_genes(t):
    return _first(t, lambda tested, keys: P.screen_of_tested(tested, keys, 25)).select(*KEYS, "gene_id", F.col("screen_rank").cast("bigint").alias("screen_rank"))
