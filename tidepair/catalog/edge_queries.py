"""Queries over the transport-edge carriers."""

from pyspark.sql import functions as F

from tidepair.operators import edges as E
from tidepair.plans.ordered import percent_rank_avg, quantiles, with_totals

from tidepair.plans.session import cut

from .sqlmath import avg_rank
from .tables import query

PREP = """prep AS (SELECT grp, ord, regexp_replace(source_cell, '_[01]$', '') AS source_id,
    regexp_replace(target_cell, '_[01]$', '') AS target_id, probability FROM edges)"""


def _side(side, src="prep", tag=""):
    """CTE chain n_<side> (normalised, ranked) and c_<side> (cell metrics with percentile ranks)."""
    s, other = side, "n_target" if side == "source" else "n_source"
    k = f"{s}_id"
    return f"""n0_{s}{tag} AS (SELECT *, sum(probability) OVER (PARTITION BY grp, {k}) AS {s}_mass FROM {src}),
 n1_{s}{tag} AS (SELECT *, probability / ({s}_mass + 1e-8::DOUBLE) AS {s}_p FROM n0_{s}{tag}),
 n_{s}{tag} AS (SELECT *, row_number() OVER (PARTITION BY grp, {k} ORDER BY {s}_p DESC, ord) AS {s}_rank FROM n1_{s}{tag}),
 c0_{s}{tag} AS (SELECT grp, {k}, max({s}_p) FILTER ({s}_rank = 1) AS mx, coalesce(max({s}_p) FILTER ({s}_rank = 2), 0.0::DOUBLE) AS sec,
   -sum({s}_p * ln({s}_p + 1e-8::DOUBLE)) AS ent, max({s}_mass) AS mass,
   greatest(max({other}), 2)::DOUBLE AS n_other FROM n_{s}{tag} JOIN edge_sizes USING (grp) GROUP BY grp, {k}),
 c1_{s}{tag} AS (SELECT *, mx - sec AS margin, mx / (sec + 1e-8::DOUBLE) AS ratio, ln(mx / (sec + 1e-8::DOUBLE) + 1e-8::DOUBLE) AS ratio_log,
   greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - ent / ln(n_other))) AS econf, exp(ent) AS neff, exp(ent) / n_other AS nfrac,
   greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - (exp(ent) - 1) / greatest(n_other - 1, 1.0::DOUBLE))) AS nconf FROM c0_{s}{tag}),
 c_{s}{tag} AS (SELECT *, {_prank('econf')} AS e_rank, {_prank('margin')} AS m_rank, {_prank('mx')} AS x_rank FROM c1_{s}{tag})"""


def _prank(c, part="grp"):
    r = f"round({c}, 12)"
    return (f"((rank() OVER (PARTITION BY {part} ORDER BY {r})) + (count(*) OVER (PARTITION BY {part}, {r}) - 1) / 2.0::DOUBLE)"
            f" / count(*) OVER (PARTITION BY {part})")


COMB = "(0.40::DOUBLE * {p}.e_rank + 0.30::DOUBLE * {p}.m_rank + 0.30::DOUBLE * {p}.x_rank)"
SCORED = f"""{PREP}, {_side('source')}, {_side('target')},
 scored AS (SELECT s.grp, s.ord, s.source_id, s.target_id, s.probability, s.source_mass, s.source_p, s.source_rank,
   t.target_mass, t.target_p, t.target_rank,
   cs.mx AS source_max, cs.sec AS source_second, cs.margin AS source_margin, cs.ratio_log AS source_ratio_log,
   cs.econf AS source_entropy_confidence, cs.neff AS source_effective_n, cs.nconf AS source_effective_confidence,
   {COMB.format(p='cs')} AS source_combined,
   ct.mx AS target_max, ct.sec AS target_second, ct.margin AS target_margin, ct.ratio_log AS target_ratio_log,
   ct.econf AS target_entropy_confidence, ct.neff AS target_effective_n, ct.nconf AS target_effective_confidence,
   {COMB.format(p='ct')} AS target_combined
  FROM n_source s JOIN n_target t ON s.grp = t.grp AND s.ord = t.ord
  JOIN c_source cs ON cs.grp = s.grp AND cs.source_id = s.source_id
  JOIN c_target ct ON ct.grp = s.grp AND ct.target_id = s.target_id)"""


def _norm(t, side):
    base, n = E.prepare_counted(t("edges"))
    return E.normalize(base, side, n)


def _ranked(t, *sides):
    out, n = E.prepare_counted(t("edges"))
    for side in sides:
        out = E.ranked_side(out, side, n)
    return out


def _scored(t):
    return E.score_edges(t("edges"), t("edge_sizes"))


def _r(c, n=9, alias=None):
    return F.round(c, n).alias(alias or c)


@query(f"WITH {PREP} SELECT grp, ord, sum(probability) OVER (PARTITION BY grp, source_id) AS source_mass,"
       " round(probability / (sum(probability) OVER (PARTITION BY grp, source_id) + 1e-8::DOUBLE), 9) AS source_p FROM prep")
def row_normalize(t):
    return _norm(t, "source").select("grp", "ord", "source_mass", _r("source_p"))


@query(f"WITH {PREP} SELECT grp, ord, sum(probability) OVER (PARTITION BY grp, target_id) AS target_mass,"
       " round(probability / (sum(probability) OVER (PARTITION BY grp, target_id) + 1e-8::DOUBLE), 9) AS target_p FROM prep")
def col_normalize(t):
    return _norm(t, "target").select("grp", "ord", "target_mass", _r("target_p"))


@query(f"WITH {PREP}, {_side('source')} SELECT grp, ord, source_rank FROM n_source")
def rank_in_source(t):
    return _ranked(t, "source").select("grp", "ord", "source_rank")


@query(f"WITH {PREP}, {_side('target')} SELECT grp, ord, target_rank FROM n_target")
def rank_in_target(t):
    return _ranked(t, "target").select("grp", "ord", "target_rank")


def _flags(t):
    ranked = _ranked(t, "source", "target")
    return ranked.select("grp", "ord", (F.col("source_rank") == 1).cast("int").alias("is_top1_target"),
                         (F.col("target_rank") == 1).cast("int").alias("is_top1_source"))


FLAGS = f"""{PREP}, {_side('source')}, {_side('target')}, fl AS (SELECT s.grp, s.ord, CAST(source_rank = 1 AS INT) AS is_top1_target,
 CAST(target_rank = 1 AS INT) AS is_top1_source FROM n_source s JOIN n_target t ON s.grp = t.grp AND s.ord = t.ord)"""


@query(f"WITH {FLAGS} SELECT * FROM fl")
def top1_flags(t):
    return _flags(t)


@query(f"WITH {FLAGS} SELECT grp, ord, is_top1_target * is_top1_source AS is_mutual_top1 FROM fl")
def mutual_top1(t):
    return _flags(t).select("grp", "ord", (F.col("is_top1_target") * F.col("is_top1_source")).alias("is_mutual_top1"))


def _cells(t, side="source"):
    base, n = E.prepare_counted(t("edges"))
    return E.cells_of(E.measured_side(base, t("edge_sizes"), side, n), side)


@query(f"""WITH {PREP}, {_side('source')}, {_side('target')}
 SELECT 'source' AS side, grp, source_id AS cell_id, round(mx, 9) AS max, round(sec, 9) AS second, round(margin, 9) AS margin,
 round(ratio_log, 9) AS ratio_log FROM c1_source UNION ALL
 SELECT 'target', grp, target_id, round(mx, 9), round(sec, 9), round(margin, 9), round(ratio_log, 9) FROM c1_target""")
def top12(t):
    one = lambda s: _cells(t, s).select(
        F.lit(s).alias("side"), "grp", F.col(s + "_id").alias("cell_id"), _r("max"), _r("second"), _r("margin"), _r("ratio_log"))
    return one("source").unionByName(one("target"))


@query(f"""WITH {PREP}, {_side('source')}, {_side('target')}
 SELECT 'source' AS side, grp, source_id AS cell_id, round(ent, 9) AS entropy, round(econf, 9) AS entropy_confidence FROM c1_source
 UNION ALL SELECT 'target', grp, target_id, round(ent, 9), round(econf, 9) FROM c1_target""")
def entropy_confidence(t):
    one = lambda s: _cells(t, s).select(
        F.lit(s).alias("side"), "grp", F.col(s + "_id").alias("cell_id"), _r("entropy"), _r("entropy_confidence"))
    return one("source").unionByName(one("target"))


@query(f"""WITH {PREP}, {_side('source')} SELECT grp, source_id, round(neff, 7) AS effective_n, round(nfrac, 9) AS effective_fraction,
 round(nconf, 9) AS effective_confidence FROM c1_source""")
def effective_n(t):
    return _cells(t).select("grp", "source_id", _r("effective_n", 7), _r("effective_fraction"), _r("effective_confidence"))


@query(f"""WITH {PREP} SELECT 'source' AS side, grp, source_id AS cell_id, sum(probability) AS retained_mass FROM prep GROUP BY ALL
 UNION ALL SELECT 'target', grp, target_id, sum(probability) FROM prep GROUP BY ALL""")
def retained_mass(t):
    base = E.prepare(t("edges"))
    one = lambda s: base.groupBy("grp", F.col(s + "_id").alias("cell_id")).agg(
        F.sum("probability").alias("retained_mass")).select(F.lit(s).alias("side"), "grp", "cell_id", "retained_mass")
    return one("source").unionByName(one("target"))


@query("""WITH v AS (SELECT grp, ord, CASE WHEN ord % 17 = 0 THEN NULL ELSE probability END AS x FROM edges),
 r AS (SELECT grp, ord, x, CASE WHEN x IS NOT NULL THEN (rank() OVER (PARTITION BY grp ORDER BY x NULLS LAST)
   + (count(x) OVER (PARTITION BY grp, x) - 1) / 2.0::DOUBLE) / count(x) OVER (PARTITION BY grp) END AS p,
   count(x) OVER (PARTITION BY grp) AS m FROM v)
 SELECT grp, ord, round(p, 9) AS share, round(CASE WHEN m <= 1 THEN 1.0::DOUBLE ELSE coalesce(p, 0.0::DOUBLE) END, 9) AS share_builder FROM r""")
def percentile_rank(t):
    v = t("edges").select("grp", "ord", F.when(F.col("ord") % 17 != 0, F.col("probability")).alias("x"))
    out = percent_rank_avg(v, ["grp"], "x", "share", builder=False)
    return out.select("grp", "ord", _r("share"), F.round(F.coalesce("share", F.lit(0.0)), 9).alias("share_builder"))


@query(f"""WITH {PREP}, {_side('source')}, {_side('target')} SELECT 'source' AS side, grp, source_id AS cell_id,
 round({COMB.format(p='c_source')}, 9) AS combined FROM c_source UNION ALL
 SELECT 'target', grp, target_id, round({COMB.format(p='c_target')}, 9) FROM c_target""")
def combined_concentration(t):
    measured, n = E.measure_edges(t("edges"), t("edge_sizes"))
    one = lambda s: E.concentration(E.cells_of(measured, s), s, n).select(
        F.lit(s).alias("side"), "grp", F.col(s + "_id").alias("cell_id"), _r("combined"))
    return one("source").unionByName(one("target"))


_COLS = {"probability": ("probability", "probability"), "row_probability": ("source_p", "target_p"),
         "max_coupling": ("source_max", "target_max"),
         "entropy_confidence": ("source_entropy_confidence", "target_entropy_confidence"),
         "top12_margin": ("source_margin", "target_margin"), "top12_ratio_log": ("source_ratio_log", "target_ratio_log"),
         "effective_target_confidence": ("source_effective_confidence", "target_effective_confidence"),
         "retained_mass": ("source_mass", "target_mass"), "combined_concentration": ("source_combined", "target_combined")}


def _axis(s, x, axis):
    return s if axis == "source" else x if axis == "target" else f"(0.5::DOUBLE * ({s} + {x}))"


@query(f"WITH {SCORED} SELECT grp, ord, " + ", ".join(
    f"round({_axis(*_COLS[m], a)}, 10) AS {m}__{a}" for m in E.METRICS for a in ("source", "target", "both")) + " FROM scored")
def confidence_score(t):
    return _scored(t).select("grp", "ord", *[F.round(E.confidence_score(m, a), 10).alias(f"{m}__{a}")
                                             for m in E.METRICS for a in ("source", "target", "both")])


@query(f"""WITH {SCORED}, u AS (SELECT 'all' AS selection, grp, ord FROM scored
 UNION ALL SELECT 'top1', grp, ord FROM scored WHERE source_rank = 1
 UNION ALL SELECT 'top1_target', grp, ord FROM scored WHERE target_rank = 1
 UNION ALL SELECT 'mutual_top1', grp, ord FROM scored WHERE source_rank = 1 AND target_rank = 1),
 s AS (SELECT selection, grp, count(*) AS n, sum(ord)::DECIMAL(38, 0) AS ord_sum FROM u GROUP BY ALL)
 SELECT selection, grp, ord, n, ord_sum FROM u JOIN s USING (selection, grp)""")
def pair_selection(t):
    """The pairs of every selection, beside the size of their selection in their group and its sum of ord."""
    ranked = _ranked(t, "source", "target")
    flags = cut(ranked.select("grp", "ord", (F.col("source_rank") == 1).alias("a"), (F.col("target_rank") == 1).alias("b")))  # read twice
    picked = F.array_compact(F.array(
        F.lit("all"), F.when(F.col("a"), F.lit("top1")), F.when(F.col("b"), F.lit("top1_target")),
        F.when(F.col("a") & F.col("b"), F.lit("mutual_top1"))))
    pairs = flags.select(F.explode(picked).alias("selection"), "grp", "ord")
    total = F.sum(F.col("ord").cast("decimal(20, 0)")).cast("decimal(38, 0)")  # beyond 64 bits on large tables
    return with_totals(pairs, ["selection", "grp"], n=F.count(F.lit(1)), ord_sum=total)


SELECTED = f"""{SCORED}, cand AS (SELECT *, round(source_combined, 12) AS score FROM scored WHERE source_rank = 1),
 lim AS (SELECT grp, quantile_cont(score, 0.75) AS threshold FROM cand GROUP BY grp),
 kept AS (SELECT cand.*, threshold FROM cand JOIN lim USING (grp) WHERE score >= threshold)"""


def _selected(t):
    """Measured edges, the best edge of each source with its score, those at or above the group's threshold, and the
    number of edges."""
    measured, n = E.measure_edges(t("edges"), t("edge_sizes"))
    cand = E.select_pairs(E.add_concentration(measured, ["source"], n), "top1")
    cand = cut(cand.select("grp", "ord", F.round("source_combined", 12).alias("score")))
    return measured, cand, E.confidence_select(cand, ["grp"], "score", 0.25, probe=n), n


@query(f"WITH {SELECTED} SELECT grp, ord, round(score, 9) AS score, round(threshold, 9) AS threshold FROM kept")
def edge_confidence_select(t):
    return _selected(t)[2].select("grp", "ord", _r("score"), _r("threshold"))


_MED = {f"{s}_{m}_median": (s, c) for s in ("source", "target")
        for m, c in (("max", "mx"), ("entropy_confidence", "econf"), ("margin", "margin"))}


@query(f"""WITH {SELECTED}, a AS (SELECT grp, count(*) AS n_before FROM scored GROUP BY grp),
 b AS (SELECT grp, count(*) AS n_candidates, round(min(score), 9) AS score_min, round(max(score), 9) AS score_max,
   round(quantile_cont(score, 0.5), 9) AS score_median FROM cand GROUP BY grp),
 k AS (SELECT grp, count(*) AS n_after, round(max(threshold), 9) AS threshold FROM kept GROUP BY grp),
 s AS (SELECT grp, count(*) AS unique_sources, """ + ", ".join(
    f"round(quantile_cont({c}, 0.5), 9) AS {n}" for n, (sd, c) in _MED.items() if sd == "source") + """ FROM c1_source GROUP BY grp),
 x AS (SELECT grp, count(*) AS unique_targets, """ + ", ".join(
    f"round(quantile_cont({c}, 0.5), 9) AS {n}" for n, (sd, c) in _MED.items() if sd == "target") + """ FROM c1_target GROUP BY grp)
 SELECT *, round(n_after / n_before, 9) AS retained_of_all, round(n_after / n_candidates, 9) AS retained_of_candidates
 FROM a JOIN b USING (grp) JOIN k USING (grp) JOIN s USING (grp) JOIN x USING (grp)""")
def edge_filter_summary(t):
    measured, cand, kept, n = _selected(t)
    out = E.filter_summary(measured, kept, cand, "score", n)
    return out.select(*[_r(c) if d == "double" else c for c, d in out.dtypes])


@query(f"WITH {SCORED} SELECT grp, ord, round(source_p, 9) AS source_p FROM scored WHERE source_p >= 1e-4")
def edge_min_probability(t):
    return _norm(t, "source").where(F.col("source_p") >= E.EDGE_MIN_PROBABILITY).select("grp", "ord", _r("source_p"))


def _matrix_sql(side):
    s = side
    other = "n_target" if s == "source" else "n_source"
    dim = ("SELECT DISTINCT concat(l_returnflag, '|', l_linestatus) AS grp, concat('S', s_suppkey) AS source_id FROM lineitem, supplier"
           if s == "source" else
           "SELECT DISTINCT concat(l_returnflag, '|', l_linestatus) AS grp, concat('T', p_partkey) AS target_id FROM lineitem, part")
    return f"""WITH {PREP}, {_side(s)}, dim AS ({dim}),
 z AS (SELECT d.grp, d.{s}_id, coalesce(mx, 0) AS mx, coalesce(sec, 0) AS sec, coalesce(margin, 0) AS margin, coalesce(ent, 0) AS ent,
   coalesce(econf, 1) AS econf, coalesce(neff, 1) AS neff, coalesce(nconf, 1) AS nconf FROM dim d LEFT JOIN c1_{s} c ON c.grp = d.grp AND c.{s}_id = d.{s}_id),
 zr AS (SELECT *, {_prank('econf')} AS e_rank, {_prank('margin')} AS m_rank, {_prank('mx')} AS x_rank FROM z),
 k AS (SELECT *, row_number() OVER (PARTITION BY grp, {s}_id ORDER BY {s}_p DESC, ord) AS rnk FROM n_{s} WHERE {s}_p >= 1e-4)
 SELECT k.grp, k.ord, rnk AS rank, CAST(rnk = 1 AS INT) AS is_top1, round({s}_p, 9) AS p, round(econf, 9) AS entropy_confidence,
 round(ln(mx / (sec + 1e-8::DOUBLE) + 1e-8::DOUBLE), 8) AS ratio_log, round({COMB.format(p='zr')}, 9) AS combined
 FROM k JOIN zr ON k.grp = zr.grp AND k.{s}_id = zr.{s}_id"""


def _matrix(t, side):
    # every cell belongs to every group, whether it has an edge there or not: only their number is needed
    cells = t("supplier" if side == "source" else "part").agg(F.count(F.lit(1)).alias("n")).scalar()
    n_cells = t("edge_sizes").select("grp", cells.alias("n_cells"))
    out = E.matrix_confidence(t("edges"), n_cells, t("edge_sizes"), side)
    return out.select("grp", "ord", F.col("rank").cast("bigint").alias("rank"), "is_top1", _r(side + "_p", 9, "p"),
                      _r("entropy_confidence"), _r("ratio_log", 8), _r("combined"))


@query(_matrix_sql("source"))
def matrix_source_confidence(t):
    return _matrix(t, "source")


@query(_matrix_sql("target"))
def matrix_target_confidence(t):
    return _matrix(t, "target")


NUM = f"""WITH {SELECTED}, e AS (SELECT grp, ord, row_number() OVER (PARTITION BY grp ORDER BY ord) AS edge_no,
 row_number() OVER (ORDER BY grp, ord) AS pair_no FROM kept)"""


@query(NUM + " SELECT grp, ord, concat(grp, '|highconf_pair_', pair_no - 1) AS pair_id FROM e")
def pair_id(t):
    _, _, kept, n = _selected(t)
    return E.pair_ids(cut(kept.select("grp", "ord")), bound=n).select("grp", "ord", "pair_id")


@query(f"""WITH {PREP}, e AS (SELECT grp, ord, row_number() OVER (PARTITION BY grp ORDER BY ord) AS edge_no FROM prep)
 SELECT grp, ord, concat(grp, '|edge_', edge_no - 1) AS edge_id FROM e""")
def edge_id(t):
    base, n = E.prepare_counted(t("edges"))
    return E.pair_ids(base.select("grp", "ord"), bound=n).select("grp", "ord", "edge_id")


_SHARDED = "WITH sh AS (SELECT *, ord // 500 AS shard FROM pairs)"


def _sharded(t):
    return t("pairs").withColumn("shard", F.floor(F.col("ord") / 500))


@query(_SHARDED + """, lim AS (SELECT dataset_id, quantile_cont(probability, 0.75) AS threshold FROM sh GROUP BY 1),
 k AS (SELECT shard, count(*) AS n_after FROM sh JOIN lim USING (dataset_id) WHERE probability >= threshold GROUP BY 1),
 b AS (SELECT shard, count(*) AS n_before, min(probability) AS score_min, max(probability) AS score_max,
  round(quantile_cont(probability, 0.5), 9) AS score_median, string_agg(DISTINCT dataset_id, ',' ORDER BY dataset_id) AS groups FROM sh GROUP BY 1)
 SELECT b.shard, n_before, score_min, score_max, score_median, groups, coalesce(n_after, 0) AS n_after,
 round(coalesce(n_after, 0) / n_before, 9) AS retained FROM b LEFT JOIN k USING (shard)""")
def shard_filter_summary(t):
    sh = _sharded(t)
    kept = E.confidence_select(sh, ["dataset_id"], "probability", 0.25)
    out = E.shard_summary(sh, kept, "shard", "dataset_id", "probability")
    return out.withColumn("retained", F.round("retained", 9)).withColumn("score_median", F.round("score_median", 9))


COMPONENTS = """SELECT ord, probability AS entropy_confidence, CASE WHEN ord % 17 = 0 THEN NULL ELSE probability * 1.5 - 0.25 END AS top12_margin,
 1 - probability AS cost_confidence, CASE WHEN ord % 13 = 0 THEN NULL ELSE probability * probability END AS stability_confidence FROM pairs"""


def _components(t):
    p = F.col("probability")
    return t("pairs").select(
        "ord", p.alias("entropy_confidence"), F.when(F.col("ord") % 17 != 0, p * 1.5 - 0.25).alias("top12_margin"),
        (1 - p).alias("cost_confidence"), F.when(F.col("ord") % 13 != 0, p * p).alias("stability_confidence"))


_CLIP = "coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {c})), 0) * CASE WHEN {c} IS NULL THEN 0 ELSE 1 END"


@query(f"""WITH m AS ({COMPONENTS}) SELECT ord, round(0.30 * {_CLIP.format(c='entropy_confidence')} + 0.20 * {_CLIP.format(c='top12_margin')}
 + 0.20 * {_CLIP.format(c='cost_confidence')} + 0.30 * {_CLIP.format(c='stability_confidence')}, 9) AS combined_confidence FROM m""")
def combined_confidence(t):
    return E.combined_confidence(_components(t)).select("ord", _r("combined_confidence"))


@query(_SHARDED + """, r AS (SELECT ord, shard, pow(greatest(probability, 0) + 1e-8::DOUBLE, 2.0) AS raw FROM sh),
 w AS (SELECT ord, shard, raw / avg(raw) OVER (PARTITION BY shard) AS w FROM r)
 SELECT ord, shard, round(greatest(0.2::DOUBLE, least(3.0::DOUBLE, w)), 8) AS training_weight FROM w""")
def training_weight(t):
    return E.training_weight(_sharded(t), "shard", "probability", 2.0).select("ord", "shard", _r("training_weight", 8))


@query(f"""WITH {PREP}, {_side('source')}, c AS (SELECT grp, source_id, sum(source_p * (1 + source_rank / 8.0::DOUBLE)) AS cost FROM n_source GROUP BY ALL),
 m AS (SELECT grp, quantile_cont(cost, 0.5) AS med FROM c GROUP BY 1)
 SELECT grp, source_id, round(cost, 8) AS expected_cost, round(exp(-cost / (0.5 * med)), 8) AS conf_half, round(exp(-cost / med), 8) AS conf_one,
 round(exp(-cost / (2 * med)), 8) AS conf_two FROM c JOIN m USING (grp)""")
def cost_confidence(t):
    e = _ranked(t, "source").withColumn("cost", 1 + F.col("source_rank") / 8.0)
    out = E.cost_confidence(e).withColumnRenamed("cost_confidence", "conf_one")
    one = F.col("conf_one")
    return out.select("grp", "source_id", _r("expected_cost", 8), F.round(one * one, 8).alias("conf_half"), _r("conf_one", 8),
                      F.round(F.sqrt(one), 8).alias("conf_two"))


@query("""WITH rn AS (SELECT concat('S', l_suppkey) AS source_id, l_linenumber AS run, min(l_partkey) AS target_id FROM lineitem GROUP BY ALL),
 ref AS (SELECT source_id, min(target_id) AS ref_target FROM rn GROUP BY 1),
 h AS (SELECT rn.source_id, CASE WHEN abs(target_id - ref_target) <= 2 THEN 1 ELSE 0 END AS hit FROM rn JOIN ref USING (source_id))
 SELECT source_id, round(avg(hit), 9) AS stability_confidence, count(*) AS n_runs FROM h GROUP BY 1""")
def stability_confidence(t):
    runs = t("lineitem").groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source_id"),
                                 F.col("l_linenumber").alias("run")).agg(F.min("l_partkey").alias("target_id"))
    reference = runs.groupBy("source_id").agg(F.min("target_id").alias("ref_target"))
    near = t("part").select(F.col("p_partkey").alias("target_id"), F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("rank"), F.lit(d).alias("d")) for i, d in enumerate((0, -1, 1, -2, 2))])).alias("n"))
    near = near.select("target_id", (F.col("target_id") + F.col("n.d")).alias("near_id"), F.col("n.rank").alias("rank"))
    return E.stability_confidence(runs, reference, near).withColumn("stability_confidence", F.round("stability_confidence", 9))


@query(f"""WITH {PREP}, {_side('source')}, {_side('target')} SELECT s.grp, s.source_id, s.target_id, target_rank AS reverse_rank,
 target_rank <= 1 AS cycle_1, target_rank <= 5 AS cycle_5, target_rank <= 10 AS cycle_10
 FROM n_source s JOIN n_target t ON s.grp = t.grp AND s.ord = t.ord WHERE source_rank = 1""")
def cycle_consistency(t):
    return E.cycle_consistency(_ranked(t, "source", "target"))


@query(f"""WITH {PREP}, m AS (SELECT grp, source_id, sum(probability) AS moved, count(*) / 32.0::DOUBLE AS prior_mass FROM prep GROUP BY ALL)
 SELECT grp, source_id, moved, prior_mass, round(moved / (prior_mass + 1e-8::DOUBLE), 9) AS retained_mass FROM m""")
def retained_mass_unbalanced(t):
    e = E.prepare(t("edges"))
    masses = e.groupBy("grp", "source_id").agg((F.count(F.lit(1)) / 32.0).alias("prior_mass"))
    return E.retained_mass_unbalanced(e, masses).select("grp", "source_id", "moved", "prior_mass", _r("retained_mass"))


def _band_sql(col, metric):
    ladder = E.BANDS[metric]
    steps = " ".join(f"WHEN {col} >= {low} THEN '{label}'" for low, label in ladder[:-1])
    return f"CASE WHEN {col} IS NULL THEN NULL {steps} ELSE '{ladder[-1][1]}' END"


@query(f"""WITH m AS ({COMPONENTS}) SELECT ord, {_band_sql('entropy_confidence', 'entropy_confidence')} AS entropy_band,
 {_band_sql('top12_margin', 'top12_margin')} AS margin_band, {_band_sql('cost_confidence', 'cost_confidence')} AS cost_band,
 {_band_sql('stability_confidence', 'stability')} AS stability_band, {_band_sql('entropy_confidence', 'retained_mass')} AS mass_band,
 {_band_sql('cost_confidence', 'combined_confidence')} AS combined_band FROM m""")
def confidence_band(t):
    band = lambda c, m, a: E.confidence_band(F.col(c), m).alias(a)
    return _components(t).select(
        "ord", band("entropy_confidence", "entropy_confidence", "entropy_band"), band("top12_margin", "top12_margin", "margin_band"),
        band("cost_confidence", "cost_confidence", "cost_band"), band("stability_confidence", "stability", "stability_band"),
        band("entropy_confidence", "retained_mass", "mass_band"), band("cost_confidence", "combined_confidence", "combined_band"))


NOISE = """sp AS (SELECT p.ord, source_cell AS source_id, target_cell AS target_id, probability, level, ((p.ord * 2654435761) % 1000003) / 1000003.0::DOUBLE AS u
  FROM pairs p, (VALUES (0.0::DOUBLE), (0.1), (0.2), (0.3), (0.4)) l(level)),
 mv AS (SELECT level, ord, coalesce(lead(target_id) OVER w, first_value(target_id) OVER w) AS noisy FROM sp WHERE u < level WINDOW w AS (PARTITION BY level ORDER BY ord)),
 noise AS (SELECT sp.level, sp.ord, source_id, target_id, probability, coalesce(noisy, target_id) AS noisy_target, CAST(noisy IS NOT NULL AS INT) AS corrupted
  FROM sp LEFT JOIN mv USING (level, ord))"""


def _noise(t):
    p = t("pairs").select("ord", F.col("source_cell").alias("source_id"), F.col("target_cell").alias("target_id"))
    return E.pairing_noise(p, (0.0, 0.1, 0.2, 0.3, 0.4))


@query(f"WITH {NOISE} SELECT level, ord, source_id, target_id, noisy_target, corrupted FROM noise")
def pairing_noise(t):
    return _noise(t)


# the score of a corrupted pair: its confidence, halved for two of three, so that detection is neither perfect nor by chance
_SEEN = "probability * CASE WHEN corrupted = 1 AND ord % 3 <> 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END"


@query(f"""WITH {NOISE}, s AS (SELECT level, corrupted AS y, round(-({_SEEN}), 6) AS doubt FROM noise), rk AS (SELECT *, {avg_rank('doubt', 'level')} AS r, {avg_rank('y', 'level')} AS ry FROM s),
 au AS (SELECT level, count(*) AS n, sum(y)::BIGINT AS n_corrupted, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auroc,
  CASE WHEN sum(y) > 0 THEN corr(r, ry) END AS spearman FROM rk GROUP BY 1),
 pc AS (SELECT level, doubt, count(*) AS k, sum(y) AS p FROM s GROUP BY ALL), pd AS (SELECT *, sum(k) OVER w AS ck, sum(p) OVER w AS cp FROM pc WINDOW w AS (PARTITION BY level ORDER BY doubt DESC)),
 ap AS (SELECT level, CASE WHEN sum(p) > 0 AND sum(p) < sum(k) THEN sum(p * cp / ck) / sum(p) END AS auprc FROM pd GROUP BY 1)
 SELECT level, n, n_corrupted, round(auroc, 9) AS auroc, round(auprc, 9) AS auprc, round(spearman, 9) AS spearman FROM au JOIN ap USING (level)""")
def pairing_noise_scores(t):
    seen = F.col("probability") * F.when((F.col("corrupted") == 1) & (F.col("ord") % 3 != 0), 0.5).otherwise(1.0)
    noise = _noise(t).join(t("pairs").select("ord", "probability"), "ord").select("level", "corrupted", F.round(-seen, 6).alias("doubt"))
    return E.noise_detection(noise, "doubt").select("level", "n", "n_corrupted", _r("auroc"), _r("auprc"), _r("spearman"))


@query("""WITH l AS (SELECT dataset_id, quantile_cont(probability, 0.75) AS threshold FROM pairs GROUP BY 1)
 SELECT ord, dataset_id, probability FROM pairs JOIN l USING (dataset_id) WHERE probability >= greatest(threshold, 0.5)""")
def threshold_local(t):
    return E.confidence_select(t("pairs"), ["dataset_id"], "probability", 0.25, 0.5).select("ord", "dataset_id", "probability")


@query("""SELECT ord, dataset_id, probability FROM pairs WHERE probability >= (SELECT quantile_cont(probability, 0.9) FROM pairs)""")
def threshold_global(t):
    return E.confidence_select(t("pairs"), [], "probability", 0.1).select("ord", "dataset_id", "probability")


@query("SELECT dataset_id, round(quantile_cont(probability, 0.75), 9) AS threshold FROM pairs GROUP BY 1 ORDER BY 1")
def threshold_report(t):
    return quantiles(t("pairs"), ["dataset_id"], "probability", {"threshold": 0.75}).select(
        "dataset_id", _r("threshold")).orderBy("dataset_id")


@query("""WITH f AS (SELECT * FROM pairs WHERE probability >= 0.4)
 SELECT ord, probability FROM f WHERE probability >= (SELECT quantile_cont(probability, 0.8) FROM f) ORDER BY probability DESC, ord""")
def min_confidence_then_top(t):
    return E.min_then_top(t("pairs"), "probability", 0.4, 0.2).select("ord", "probability").orderBy(F.desc("probability"), "ord")


