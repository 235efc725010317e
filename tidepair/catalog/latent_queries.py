"""Latent-space, spatial and model-selection queries."""

from pyspark.sql import functions as F

from tidepair.operators import latent as L
from tidepair.operators import neighbors as N
from tidepair.operators import reports as R
from tidepair.operators import spatial as P
from tidepair.plans.session import cut

from .sqlmath import avg_rank
from .tables import query


def _r(c, n=9, alias=None):
    return F.round(c, n).alias(alias or c)


# ---------------------------------------------------------------- latent space
ZD = """z AS (SELECT vec_id, label, vec_id // 64 AS batch, (vec_id % 7) / 7.0::DOUBLE AS w, list_transform(embedding, lambda v: v::DOUBLE) AS zs,
 list_transform(embedding, lambda v: v::DOUBLE * 0.9::DOUBLE + 0.05::DOUBLE) AS zp, list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE) AS zt FROM embeddings)"""


def _z(t):
    e = F.col("embedding").cast("array<double>")
    return t("embeddings").select("vec_id", "label", F.floor(F.col("vec_id") / 64).alias("batch"), (F.col("vec_id") % 7 / 7.0).alias("w"), e.alias("zs"),
                                  F.transform(e, lambda v: v * 0.9 + 0.05).alias("zp"), F.transform(e, lambda v: v * v).alias("zt"))


@query(f"""WITH {ZD}, d AS (SELECT a.vec_id, b.vec_id AS neighbor, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.zs, b.zs), b.vec_id) AS rank
 FROM z a JOIN z b ON a.vec_id <> b.vec_id) SELECT * FROM d WHERE rank <= 30""")
def knn_join(t):
    return N.knn_join(_z(t), [], "vec_id", "zs", 30).select("vec_id", "neighbor", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {ZD}, d AS (SELECT a.label AS la, b.label AS lb, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.zs, b.zs), b.vec_id) AS rank
 FROM z a JOIN z b ON a.vec_id <> b.vec_id), s AS (SELECT avg((la = lb)::INT) AS same FROM d WHERE rank <= 30), c AS (SELECT count(*) AS n FROM z GROUP BY label),
 p AS (SELECT sum(n * n) / (sum(n) * sum(n)) AS chance FROM c) SELECT round(same, 9) AS same, round(chance, 9) AS chance, round(same / greatest(chance, 1e-8), 7) AS ratio FROM s, p""")
def knn_label_mixing(t):
    return L.knn_label_mixing(_z(t), "vec_id", "zs", "label", 30).select(_r("same"), _r("chance"), _r("ratio", 7))


_E = "list_sum(list_transform(list_zip({a}, {b}), lambda q: (q[1] - q[2]) ** 2))"
_PER = ZD + f", e AS (SELECT batch, w, {_E.format(a='zp', b='zt')} / 64 AS e FROM z)"


@query(f"WITH {_PER} SELECT batch, round(sum(w * e) / (sum(w) + 1e-8), 9) AS pair_mse, round(sum(w * e) / sum(w), 9) AS pair_mse_normalized FROM e GROUP BY 1")
def weighted_pair_mse(t):
    return L.weighted_pair_mse(_z(t), ["batch"], "zp", "zt", "w").select("batch", _r("pair_mse"), _r("pair_mse_normalized"))


_MMD = " + ".join(f"{{k}} * exp(-d / (2 * {b}))" for b in L.MMD_BANDWIDTHS)


@query(f"""WITH {ZD}, n AS (SELECT *, w / sum(w) OVER (PARTITION BY batch) AS a, 1.0::DOUBLE / count(*) OVER (PARTITION BY batch) AS u FROM z),
 xx AS (SELECT x.batch, x.a * y.a AS k, {_E.format(a='x.zp', b='y.zp')} AS d FROM n x JOIN n y USING (batch) UNION ALL
  SELECT x.batch, x.u * y.u, {_E.format(a='x.zt', b='y.zt')} FROM n x JOIN n y USING (batch) UNION ALL
  SELECT x.batch, -2 * x.a * y.u, {_E.format(a='x.zp', b='y.zt')} FROM n x JOIN n y USING (batch))
 SELECT batch, round(sum({_MMD.format(k='k')}) / 6, 9) AS loss_mmd FROM xx GROUP BY 1""")
def rbf_mmd(t):
    return L.rbf_mmd(_z(t), "batch", "zp", "zt", "w").select("batch", _r("loss_mmd"))


@query()
def sinkhorn_w2(t):
    return L.sinkhorn_w2(_z(t), "batch", "zp", "zt", "w").select("batch", _r("loss_w2", 8))


@query(f"""WITH {ZD}, e AS (SELECT batch, w, list_sum(list_transform(list_zip(zs, zp, zt), lambda q: ((q[2] - q[1]) - (q[3] - q[1])) ** 2)) / 64 AS e FROM z)
 SELECT batch, round(sum(w * e) / sum(w), 9) AS loss_drift FROM e GROUP BY 1""")
def paired_drift(t):
    return L.paired_drift(_z(t), ["batch"], "zs", "zp", "zt", "w").select("batch", _r("loss_drift"))


def _flow(t):
    return _z(t).withColumn("residual", F.zip_with("zp", "zs", lambda a, b: a - b))


@query(f"""WITH {ZD}, e AS (SELECT batch, w, greatest(-list_sum(list_transform(list_zip(zs, zp, zt), lambda q: (q[2] - q[1]) * q[3])), 0) AS u FROM z)
 SELECT batch, round(sum(w * u) / sum(w), 9) AS loss_down FROM e GROUP BY 1""")
def downhill(t):
    return L.downhill(_flow(t), ["batch"], "residual", "zt", "w").select("batch", _r("loss_down"))


@query()
def population_loss(t):
    out = L.population_loss(_flow(t), "batch", "zs", "zp", "zt", "w", "residual", "zt")
    return out.select("batch", *[_r(c, 8) for c in ("loss_mmd", "loss_w2", "loss_drift", "loss_down", "loss")])


RECON = """ms AS (SELECT DISTINCT c_nationkey AS dataset_id, l_partkey AS gene_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R'),
 rl AS (SELECT c_custkey AS cell_id, c_nationkey AS dataset_id, l_partkey AS gene_id, sum(l_quantity) AS truth, sum(l_quantity * (1 - l_discount)) AS pred
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
 mk AS (SELECT rl.* FROM rl JOIN ms USING (dataset_id, gene_id))"""


def _recon(t):
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    mask = rows.where("l_returnflag = 'R'").select(F.col("c_nationkey").alias("dataset_id"), F.col("l_partkey").alias("gene_id")).distinct()
    long = rows.groupBy(F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").alias("dataset_id"), F.col("l_partkey").alias("gene_id")).agg(
        F.sum("l_quantity").alias("truth"), F.sum(F.col("l_quantity") * (1 - F.col("l_discount"))).alias("pred"))
    return long, mask


@query(f"""WITH {RECON}, c AS (SELECT cell_id, sum((pred - truth) ** 2) AS se, count(*) AS n, CASE WHEN stddev_pop(pred) > 0 AND stddev_pop(truth) > 0 THEN corr(pred, truth) ELSE 0 END AS r FROM mk GROUP BY 1)
 SELECT round(sum(se) / sum(n), 8) AS mse, round(avg(r), 8) AS pearson_mean, round(quantile_cont(r, 0.5), 8) AS pearson_median, count(*) AS n_cells FROM c""")
def masked_reconstruction(t):
    return L.masked_reconstruction(*_recon(t)).select(_r("mse", 8), _r("pearson_mean", 8), _r("pearson_median", 8), "n_cells")


@query(f"""WITH {RECON}, c AS (SELECT cell_id, avg((pred - truth) ** 2) AS e, count(*) AS n FROM mk GROUP BY 1),
 w AS (SELECT c_custkey AS cell_id, greatest(c_acctbal, 0) / 1000 AS w FROM customer) SELECT round(sum(coalesce(e, 0) * w) / sum(w), 8) AS reconstruction, round(avg(coalesce(n, 0)), 8) AS mean_measured_genes FROM w LEFT JOIN c USING (cell_id)""")
def masked_cell_mse(t):
    weights = t("customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").alias("dataset_id"), (F.col("c_acctbal") / 1000).alias("weight"))
    return L.masked_cell_mse(*_recon(t), weights).select(_r("reconstruction", 8), _r("mean_measured_genes", 8))


@query(f"""WITH {RECON} SELECT cell_id, dataset_id, gene_id, truth, ms.gene_id IS NOT NULL AS measured FROM rl LEFT JOIN ms USING (dataset_id, gene_id)""")
def gene_mask_join(t):
    from tidepair.operators.joins import gene_mask_join as join_
    long, mask = _recon(t)
    cells = t("customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").alias("dataset_id"))
    return join_(long.drop("dataset_id"), cells, mask).select("cell_id", "dataset_id", "gene_id", "truth", "measured")


@query(f"""WITH {ZD} SELECT vec_id, round(list_distance(zt, zs), 9) AS predicted_delta_l2, round(list_distance(zp, zs), 9) AS latent_residual_l2, round(sqrt(list_sum(list_transform(zs, lambda v: v * v))), 9) AS source_latent_l2 FROM z""")
def latent_shift_features(t):
    out = L.latent_shift_features(_z(t), "zs", "zt", "zs", "zp")
    return out.select("vec_id", _r("predicted_delta_l2"), _r("latent_residual_l2"), _r("source_latent_l2"))


# ---------------------------------------------------------------- spatial
NN = """nn AS (SELECT * FROM (SELECT a.sample_id, a.spot_id, b.spot_id AS neighbor, row_number() OVER (PARTITION BY a.spot_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.spot_id) AS rk
 FROM spots a JOIN spots b ON a.sample_id = b.sample_id AND a.spot_id <> b.spot_id) WHERE rk <= 8)"""
SG = """sg AS (SELECT label AS sample_id, vec_id AS spot_id, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS v FROM embeddings),
 sl AS (SELECT sample_id, spot_id, concat('D', j) AS gene_id, abs(v) AS pre, v * v * 4 - 0.02::DOUBLE AS pred FROM sg)"""


def _sl(t):
    e = t("embeddings").select(F.col("label").alias("sample_id"), F.col("vec_id").alias("spot_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("j", "v"))
    return e.select("sample_id", "spot_id", F.concat(F.lit("D"), F.col("j").cast("string")).alias("gene_id"), F.abs("v").alias("pre"), (F.col("v") * F.col("v") * 4 - 0.02).alias("pred"))


ELIG = """st AS (SELECT c_custkey AS file, concat('GSE', c_nationkey) AS gse_id, c_custkey // 3 AS patient_id, concat(c_name, '.x') AS stem, c_acctbal AS g,
  CASE c_custkey % 3 WHEN 0 THEN 'Pre-treatment' WHEN 1 THEN 'Baseline' ELSE 'Post' END AS tp, CASE WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE c_mktsegment END AS rg,
  c_nationkey % 7 <> 0 AS ok FROM customer), ba AS (SELECT * FROM st WHERE g > 1000 AND ok)"""


def _manifest(t):
    c, k = t("customer"), F.col("c_custkey")
    text = lambda x: x.cast("string")
    stats = c.select(k.alias("file"), F.concat(F.lit("GSE"), text(F.col("c_nationkey"))).alias("gse_id"), F.floor(k / 3).alias("patient_id"),
                     F.concat("c_name", F.lit(".x")).alias("stem"), text(F.col("c_acctbal")).alias("n_genes"),
                     F.when(k % 3 == 0, "Pre-treatment").when(k % 3 == 1, "Baseline").otherwise("Post").alias("timepoint"),
                     F.when(k % 5 == 0, "unknown").otherwise(F.col("c_mktsegment")).alias("response_group"))
    ok = F.when(F.col("c_nationkey") % 7 != 0, "True").otherwise("False")
    schema = c.select(k.alias("file"), F.lit("True").alias("spatial_present"), ok.alias("spatial_shape_valid"), F.lit("True").alias("x_integer"))
    return P.spatial_manifest(stats, schema, 1000)


@query(f"""WITH {ELIG} SELECT replace(concat(gse_id, '__', patient_id, '__', stem), '#', '_') AS sample_id, gse_id, patient_id, file, CASE WHEN rg = 'unknown' THEN 'NA' ELSE rg END AS response_group
 FROM ba WHERE tp <> 'Post'""")
def spatial_manifest(t):
    return _manifest(t)[0]


@query(f"""WITH {ELIG} SELECT count(*) FILTER (tp <> 'Post') AS baseline_samples, count(DISTINCT patient_id) FILTER (tp <> 'Post') AS patients,
 string_agg(DISTINCT gse_id, ';' ORDER BY gse_id) FILTER (tp <> 'Post') AS datasets, count(*) AS eligible_samples FROM ba""")
def spatial_manifest_summary(t):
    return _manifest(t)[1]


@query(f"WITH {NN} SELECT sample_id, spot_id, neighbor, rk AS rank FROM nn")
def neighbor_lookup(t):
    return P.spatial_neighbors(t("spots"), ["sample_id"]).select("sample_id", "spot_id", "neighbor", F.col("rank").cast("bigint").alias("rank"))


MOR = """mu AS (SELECT sample_id, {f}avg({v}) AS mu, count(*) AS n FROM {s} GROUP BY ALL), ze AS (SELECT {s}.sample_id, {g}{s}.spot_id, {v} - mu AS z, n FROM {s} JOIN mu USING (sample_id{u})),
 dn AS (SELECT sample_id, {h}sum(z * z) AS zz, max(n) AS n FROM ze GROUP BY ALL), nu AS (SELECT a.sample_id, {a}sum(a.z * b.z) AS num, count(*) AS links FROM ze a JOIN nn ON nn.spot_id = a.spot_id
  JOIN ze b ON b.spot_id = nn.neighbor{j} GROUP BY ALL), mo AS (SELECT sample_id, {h}n AS n_spots, n / links * num / zz AS morans_i FROM dn JOIN nu USING (sample_id{u}))"""


@query(f"WITH {NN}, {MOR.format(f='', v='value', s='spots', g='', u='', h='', a='', j='')} SELECT sample_id, n_spots, round(morans_i, 8) AS morans_i FROM mo")
def morans_i(t):
    s = t("spots")
    return P.morans_i(s.select("sample_id", "spot_id", "value"), s, "sample_id").select("sample_id", "n_spots", _r("morans_i", 8))


@query("""WITH s AS (SELECT vec_id, label AS sample_id, CASE WHEN label < 5 THEN '' WHEN embedding[5] > 0 THEN 'tumor' ELSE 'NA' END AS a, CASE WHEN label < 2 THEN 'none' ELSE concat('R', vec_id % 3) END AS b FROM embeddings),
 c AS (SELECT *, CASE WHEN upper(a) IN ('', 'NA') THEN 'all' ELSE a END AS ca, CASE WHEN upper(b) IN ('NONE') THEN 'all' ELSE b END AS cb FROM s)
 SELECT vec_id AS spot_id, CASE WHEN bool_or(ca <> 'all') OVER (PARTITION BY sample_id) THEN ca WHEN bool_or(cb <> 'all') OVER (PARTITION BY sample_id) THEN cb ELSE 'all' END AS segment FROM c""")
def segment_label(t):
    s = t("embeddings").select(F.col("vec_id").alias("spot_id"), F.col("label").alias("sample_id"),
                               F.when(F.col("label") < 5, "").when(F.col("embedding")[4] > 0, "tumor").otherwise("NA").alias("segment_type"),
                               F.when(F.col("label") < 2, "none").otherwise(F.concat(F.lit("R"), (F.col("vec_id") % 3).cast("string"))).alias("region_type"))
    return P.segment_label(s, "sample_id").select("spot_id", "segment")


GT = SG + """, ns AS (SELECT sample_id, count(*) AS observations FROM spots GROUP BY 1),
 gt AS (SELECT sample_id, gene_id, observations, sum(pre) / max(observations) AS pm, sum(pred) / max(observations) AS qm, substr(gene_id, 2)::INT % 5 <> 0 AS measured FROM sl JOIN ns USING (sample_id) GROUP BY ALL)"""


def _gt(t):
    return cut(P.gene_table(_sl(t), t("spots"), ["sample_id"]).withColumn("measured", F.substring("gene_id", 2, 9).cast("int") % 5 != 0).withColumn("symbol", F.col("gene_id")))


def _spots_shift(t):
    return t("spots").withColumn("shift", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))


SHIFT = GT + """, sh AS (SELECT sample_id, count(*) AS observations, avg(s) AS m, quantile_cont(s, 0.5) AS md, quantile_cont(s, 0.9) AS q9 FROM (SELECT sample_id, sqrt(x * x + y * y) AS s FROM spots) GROUP BY 1),
 gm AS (SELECT sample_id, count(*) FILTER (measured) AS measured_genes, avg(measured::INT) AS coverage, avg(abs(qm - pm)) FILTER (measured) AS l1, sqrt(sum((qm - pm) ** 2) FILTER (measured)) AS l2,
  count(*) FILTER (measured AND qm > pm) AS up_genes, count(*) FILTER (measured AND qm < pm) AS down_genes FROM gt GROUP BY 1)"""


def _shift(t):
    return P.sample_shift_metrics(_spots_shift(t), _gt(t).withColumnRenamed("predicted_delta", "delta"), "sample_id")


@query(f"""WITH {SHIFT}, ng AS (SELECT sample_id, avg((pred < 0)::INT) AS ng FROM sl GROUP BY 1) SELECT sample_id, observations, round(m, 8) AS shift_mean, round(md, 8) AS shift_median, round(q9, 8) AS shift_q90, measured_genes,
 round(coverage, 8) AS coverage, round(l1, 8) AS delta_l1_mean, round(l2, 8) AS delta_l2, up_genes, down_genes, round(ng, 8) AS negative_share FROM sh JOIN gm USING (sample_id) JOIN ng USING (sample_id)""")
def sample_shift_metrics(t):
    out = _shift(t).join(P.negative_share(_sl(t), "sample_id"), "sample_id")
    return out.select("sample_id", "observations", "measured_genes", "up_genes", "down_genes",
                      *[_r(c, 8) for c in ("shift_mean", "shift_median", "shift_q90", "coverage", "delta_l1_mean", "delta_l2", "negative_share")])


@query(f"WITH {GT} SELECT sample_id, gene_id, observations, measured, round(pm, 9) AS pretreatment_mean, round(qm, 9) AS predicted_mean, round(qm - pm, 9) AS predicted_delta FROM gt")
def gene_table(t):
    return _gt(t).select("sample_id", "gene_id", "observations", "measured", _r("pretreatment_mean"), _r("predicted_mean"), _r("predicted_delta"))


SGT = SG + """, ns AS (SELECT sample_id, segment_type AS segment, count(*) AS observations FROM spots GROUP BY ALL),
 st AS (SELECT sample_id, segment, gene_id, observations, sum(pre) / max(observations) AS pm, sum(pred) / max(observations) AS qm FROM sl JOIN spots USING (sample_id, spot_id) JOIN ns USING (sample_id) WHERE segment_type = segment GROUP BY ALL)"""


def _sgt(t):
    seg = t("spots").select("sample_id", "spot_id", F.col("segment_type").alias("segment"))
    return P.gene_table(_sl(t).join(seg, ["sample_id", "spot_id"]), seg, ["sample_id", "segment"])


@query(f"WITH {SGT} SELECT sample_id, segment, gene_id, observations, round(pm, 9) AS pretreatment_mean, round(qm, 9) AS predicted_mean FROM st")
def segment_gene_table(t):
    return _sgt(t).select("sample_id", "segment", "gene_id", "observations", _r("pretreatment_mean"), _r("predicted_mean"))


@query(f"WITH {SGT} SELECT segment, gene_id, count(DISTINCT sample_id) AS samples, round(avg(pm), 9) AS pretreatment_mean, round(avg(qm), 9) AS predicted_mean, round(avg(qm - pm), 9) AS mean_delta FROM st GROUP BY ALL")
def segment_gene_changes(t):
    return P.segment_gene_changes(_sgt(t)).select("segment", "gene_id", "samples", _r("pretreatment_mean"), _r("predicted_mean"), _r("mean_delta"))


HOT = GT + f""", ho AS (SELECT sample_id, gene_id FROM gt WHERE measured QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY round(abs(qm - pm), 9) DESC, gene_id) <= 50
 UNION SELECT sample_id, gene_id FROM gt WHERE measured AND gene_id IN ('D1', 'D2', 'D5', 'D33')), hv AS (SELECT sl.sample_id, sl.spot_id, gene_id, pred - pre AS value FROM sl JOIN ho USING (sample_id, gene_id)),
 {NN}, {MOR.format(f='gene_id, ', v='value', s='hv', g='hv.gene_id, ', u=', gene_id', h='gene_id, ', a='a.gene_id, ', j=' AND b.gene_id = a.gene_id')}, hm AS (SELECT sample_id, gene_id, avg(value) AS mean_delta FROM hv GROUP BY ALL)"""


def _hot(t):
    panel = P.panel_table(t.spark, {g: "panel" for g in ("d1", "D2", "D5", "D33")})
    hot = P.hotspot_genes(_gt(t), "sample_id", panel)
    values = _sl(t).join(hot, ["sample_id", "gene_id"]).withColumn("value", F.col("pred") - F.col("pre"))
    mean = values.groupBy("sample_id", "gene_id").agg(F.avg("value").alias("mean_delta"))
    return P.morans_i(values.select("sample_id", "gene_id", "spot_id", "value"), t("spots"), "sample_id", ["gene_id"]).join(mean, ["sample_id", "gene_id"])


@query(f"WITH {HOT} SELECT sample_id, gene_id, n_spots, round(mean_delta, 9) AS mean_delta, round(morans_i, 8) AS morans_i FROM mo JOIN hm USING (sample_id, gene_id)")
def hotspot_genes(t):
    return _hot(t).select("sample_id", "gene_id", "n_spots", _r("mean_delta"), _r("morans_i", 8))


@query(f"""WITH {HOT} SELECT gene_id, count(DISTINCT sample_id) AS samples, round(avg(mean_delta), 9) AS mean_delta, round(avg(morans_i), 8) AS mean_morans_i, round(quantile_cont(morans_i, 0.5), 8) AS median_morans_i
 FROM mo JOIN hm USING (sample_id, gene_id) GROUP BY 1""")
def hotspot_summary(t):
    return P.hotspot_summary(cut(_hot(t))).select("gene_id", "samples", _r("mean_delta"), _r("mean_morans_i", 8), _r("median_morans_i", 8))


CTL = """gm AS (SELECT concat('G', l_partkey) AS gene_id, l_partkey AS gene_index, round(avg(l_quantity), 9) AS mean FROM lineitem GROUP BY l_partkey),
 rk AS (SELECT *, row_number() OVER (ORDER BY mean, gene_index) - 1 AS r, count(*) OVER () AS n FROM gm), bn AS (SELECT *, least(r * 6 // n, 5) AS bin FROM rk),
 sg0 AS (SELECT gene_id FROM genes WHERE brand = 'Brand#3'), ub AS (SELECT DISTINCT bin FROM bn WHERE gene_id IN (SELECT gene_id FROM sg0)),
 cd AS (SELECT gene_id, bin, row_number() OVER (PARTITION BY bin ORDER BY r) - 1 AS p, count(*) OVER (PARTITION BY bin) AS l FROM bn WHERE bin IN (SELECT bin FROM ub) AND gene_id NOT IN (SELECT gene_id FROM sg0)),
 ct AS (SELECT gene_id, bin FROM cd WHERE l <= 100 OR p IN (SELECT floor(j * (l - 1) / 99.0::DOUBLE)::BIGINT FROM range(0, 100) v(j)))"""


def _controls(t):
    gm = t("lineitem").groupBy(F.col("l_partkey").alias("gene_index")).agg(F.round(F.avg("l_quantity"), 9).alias("mean")).withColumn(
        "gene_id", F.concat(F.lit("G"), F.col("gene_index").cast("string")))
    return P.matched_controls(gm, t("genes").where("brand = 'Brand#3'").select("gene_id"), [], 6, 100)


@query(f"WITH {CTL} SELECT gene_id, bin FROM ct")
def matched_controls(t):
    return _controls(t)


MOD = SG + """, sg1 AS (SELECT DISTINCT sample_id, gene_id FROM sl WHERE substr(gene_id, 2)::INT IN (1, 2, 3, 4)), ct1 AS (SELECT DISTINCT sample_id, gene_id FROM sl WHERE substr(gene_id, 2)::INT BETWEEN 10 AND 29),
 ms AS (SELECT sample_id, spot_id, avg(pre) FILTER (substr(gene_id, 2)::INT BETWEEN 1 AND 4) - avg(pre) FILTER (substr(gene_id, 2)::INT BETWEEN 10 AND 29) AS a,
  avg(pred) FILTER (substr(gene_id, 2)::INT BETWEEN 1 AND 4) - avg(pred) FILTER (substr(gene_id, 2)::INT BETWEEN 10 AND 29) AS b FROM sl GROUP BY ALL)"""


def _module(t):
    sl = _sl(t)
    number = F.substring("gene_id", 2, 9).cast("int")
    pick = lambda lo, hi: sl.where(number.between(lo, hi)).select("sample_id", "gene_id").distinct()
    return P.module_score(sl, pick(1, 4), pick(10, 29), t("spots"), "sample_id")


@query(f"WITH {MOD} SELECT sample_id, spot_id, round(a, 9) AS module_pre, round(b, 9) AS module_pred, round(b - a, 9) AS module_delta FROM ms")
def module_score(t):
    return _module(t).select("sample_id", "spot_id", _r("module_pre"), _r("module_pred"), _r("module_delta"))


@query(f"""WITH {MOD}, s AS (SELECT sample_id, avg(b - a) AS d FROM ms GROUP BY 1) SELECT count(DISTINCT sample_id // 2) AS patients, round(avg(d), 9) AS mean_change, round(quantile_cont(d, 0.5), 9) AS median_change,
 count(*) FILTER (d < 0) AS with_reversal FROM s""")
def module_summary(t):
    by = P.module_by_sample(_module(t), "sample_id").withColumn("patient_id", F.floor(F.col("sample_id") / 2))
    return P.module_summary(by, "patient_id").select("patients", "with_reversal", _r("mean_change"), _r("median_change"))


@query(f"""WITH {NN}, tm AS (SELECT sample_id, count(*) FILTER (segment_type = 'tumor') AS nt FROM spots GROUP BY 1), nm AS (SELECT nn.sample_id, nn.spot_id, avg(value2) AS m FROM nn JOIN spots s ON s.spot_id = nn.neighbor GROUP BY ALL),
 ow AS (SELECT s.sample_id, s.spot_id, s.value, round(m, 12) AS m, nt FROM spots s JOIN tm USING (sample_id) JOIN nm USING (sample_id, spot_id) WHERE nt < 4 OR segment_type = 'tumor'),
 rr AS (SELECT sample_id, nt, {avg_rank('value', 'sample_id')} AS a, {avg_rank('m', 'sample_id')} AS b FROM ow)
 SELECT sample_id, count(*) AS n, round(corr(a, b), 8) AS rho, CASE WHEN max(nt) >= 4 THEN 'tumor_annotated' ELSE 'all_observations' END AS target_scope FROM rr GROUP BY 1""")
def neighbor_spearman(t):
    return P.neighbor_spearman(t("spots"), "sample_id", "value", "value2").select("sample_id", "n", _r("rho", 8), "target_scope")


METR = """mt AS (SELECT c_custkey AS sample_id, concat('GSE', c_nationkey) AS gse_id, c_mktsegment AS platform, (['response', 'non-response', 'NA', 'partial response'])[c_custkey % 4 + 1] AS response_group,
 c_acctbal AS m1, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal * c_nationkey END AS m2 FROM customer)"""


def _metrics(t):
    k = F.col("c_custkey")
    return t("customer").select(k.alias("sample_id"), F.concat(F.lit("GSE"), F.col("c_nationkey").cast("string")).alias("gse_id"), F.col("c_mktsegment").alias("platform"),
                                F.element_at(F.array(*map(F.lit, ["response", "non-response", "NA", "partial response"])), (k % 4 + 1).cast("int")).alias("response_group"),
                                F.col("c_acctbal").alias("m1"), F.when(k % 9 != 0, F.col("c_acctbal") * F.col("c_nationkey")).alias("m2"))


_SETS = [["gse_id", "platform"], ["platform"], ["response_group"]]


@query(f"""WITH {METR}, l AS (""" + " UNION ALL ".join(
    f"SELECT '{'+'.join(ks)}' AS key_set, concat_ws('|', {', '.join(ks)}) AS key, '{m}' AS metric, {m} AS v FROM mt" for ks in _SETS for m in ("m1", "m2")) +
       ") SELECT key_set, key, metric, round(avg(v), 7) AS mean, count(v) AS n, round(quantile_cont(v, 0.5), 7) AS median FROM l GROUP BY ALL")
def metric_summaries(t):
    return P.metric_summaries(_metrics(t), _SETS, ["m1", "m2"]).select("key_set", "key", "metric", _r("mean", 7), "n", _r("median", 7))


@query(f"""WITH {METR}, l AS (SELECT gse_id, 'm1' AS metric, response_group, m1 AS v FROM mt UNION ALL SELECT gse_id, 'm2', response_group, m2 FROM mt),
 y AS (SELECT gse_id, metric, v, CASE WHEN response_group = 'non-response' THEN 0 ELSE 1 END AS y FROM l WHERE response_group <> 'NA' AND v IS NOT NULL), r AS (SELECT *, {avg_rank('v', 'gse_id, metric')} AS r FROM y),
 g AS (SELECT gse_id, metric, count(*) FILTER (y = 1) AS responders, count(*) FILTER (y = 0) AS nonresponders, avg(v) FILTER (y = 1) AS a, avg(v) FILTER (y = 0) AS b,
  sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2 AS u FROM r GROUP BY ALL)
 SELECT gse_id, metric, responders, nonresponders, round(a, 7) AS mean_responders, round(b, 7) AS mean_nonresponders, round(a - b, 7) AS difference, CASE WHEN responders >= 2 AND nonresponders >= 2 THEN u END AS u_stat FROM g""")
def response_association(t):
    long = _metrics(t).unpivot(["gse_id", "response_group"], ["m1", "m2"], "metric", "value")
    return P.response_association(long, ["gse_id", "metric"]).select(
        "gse_id", "metric", "responders", "nonresponders", *[_r(c, 7) for c in ("mean_responders", "mean_nonresponders", "difference")], "u_stat")


PANEL = GT + """, pn(symbol, mechanism) AS (VALUES ('D1', 'a'), ('D2', 'a'), ('D3', 'b'), ('D64', 'c')), pb AS (SELECT sample_id, sample_id // 2 AS patient_id, symbol, mechanism, pm, qm, qm - pm AS d FROM gt JOIN pn ON symbol = upper(gene_id) WHERE measured)"""


def _panel(t):
    panel = P.panel_table(t.spark, {"D1": "a", "D2": "a", "D3": "b", "D64": "c"})
    genes = _gt(t).where("measured").withColumn("gene_symbol", F.lower("gene_id")).withColumn("patient_id", F.floor(F.col("sample_id") / 2))
    return P.panel_by_sample(genes, panel)


@query(f"WITH {PANEL} SELECT sample_id, symbol, mechanism, round(pm, 9) AS pretreatment_mean, round(d, 9) AS predicted_delta FROM pb")
def panel_by_sample(t):
    return _panel(t).select("sample_id", "symbol", "mechanism", _r("pretreatment_mean"), _r("predicted_delta"))


@query(f"""WITH {PANEL} SELECT symbol, mechanism, count(DISTINCT sample_id) AS samples, count(DISTINCT patient_id) AS patients, round(avg(pm), 9) AS pretreatment_mean, round(avg(qm), 9) AS predicted_mean, round(avg(d), 9) AS mean_delta,
 round(quantile_cont(d, 0.5), 9) AS median_delta, round(avg((d > 0)::INT), 9) AS share_up, round(avg((d < 0)::INT), 9) AS share_down FROM pb GROUP BY ALL""")
def panel_summary(t):
    return P.panel_summary(_panel(t)).select("symbol", "mechanism", "samples", "patients",
                                             *[_r(c) for c in ("pretreatment_mean", "predicted_mean", "mean_delta", "median_delta", "share_up", "share_down")])


@query(f"""WITH {SGT}, pn(symbol, mechanism) AS (VALUES ('D1', 'a'), ('D2', 'a'), ('D3', 'b')) SELECT segment, symbol, mechanism, count(DISTINCT sample_id) AS samples, round(avg(qm - pm), 9) AS mean_delta,
 round(quantile_cont(qm - pm, 0.5), 9) AS median_delta FROM st JOIN pn ON symbol = gene_id GROUP BY ALL""")
def panel_by_segment(t):
    panel = P.panel_table(t.spark, {"D1": "a", "D2": "a", "D3": "b"})
    rows = P.panel_by_sample(_sgt(t).withColumn("gene_symbol", F.col("gene_id")).withColumn("patient_id", F.col("sample_id")), panel)
    return P.panel_summary(rows, ["segment", "symbol", "mechanism"]).select("segment", "symbol", "mechanism", "samples", _r("mean_delta"), _r("median_delta"))


@query(f"""WITH {GT}, d AS (SELECT gene_id, qm - pm AS d FROM gt WHERE measured) SELECT gene_id, count(*) AS samples, round(avg(d), 9) AS mean_delta, round(quantile_cont(d, 0.5), 9) AS median_delta, round(stddev_samp(d), 9) AS sd_delta,
 round(avg((d > 0)::INT), 9) AS share_up, round(avg((d < 0)::INT), 9) AS share_down, round(avg(abs(d)), 9) AS mean_abs_delta, round(greatest(avg((d > 0)::INT), avg((d < 0)::INT)), 9) AS consistency FROM d GROUP BY 1""")
def gene_change_consistency(t):
    return P.gene_change_consistency(_gt(t).where("measured")).select("gene_id", "samples", *[
        _r(c) for c in ("mean_delta", "median_delta", "sd_delta", "share_up", "share_down", "mean_abs_delta", "consistency")])


@query("""WITH m AS (SELECT DISTINCT l_linestatus || l_returnflag AS sample_id, concat('G', l_partkey) AS gene_id FROM lineitem) SELECT gene_id FROM m GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT sample_id) FROM m)""")
def common_measured_genes(t):
    m = t("lineitem").select(F.concat("l_linestatus", "l_returnflag").alias("sample_id"), F.concat(F.lit("G"), F.col("l_partkey").cast("string")).alias("gene_id"))
    return P.common_measured_genes(m)


SD = """sc0 AS (SELECT o_custkey AS patient_id, CASE WHEN o_orderstatus = 'F' THEN 'pre' WHEN o_orderstatus = 'O' THEN 'post' ELSE 'mid' END AS tp, avg(o_totalprice) AS s1, max(o_totalprice) AS s2 FROM orders GROUP BY ALL),
 sd0 AS (SELECT patient_id, 's1' AS score, max(s1) FILTER (tp = 'pre') AS pre, max(s1) FILTER (tp = 'post') AS post FROM sc0 GROUP BY 1 UNION ALL SELECT patient_id, 's2', max(s2) FILTER (tp = 'pre'), max(s2) FILTER (tp = 'post') FROM sc0 GROUP BY 1),
 sd1 AS (SELECT *, post - pre AS delta FROM sd0 WHERE pre IS NOT NULL AND post IS NOT NULL)"""


def _score_delta(t):
    st = F.col("o_orderstatus")
    tp = F.when(st == "F", "pre").when(st == "O", "post").otherwise("mid")
    rows = t("orders").groupBy(F.col("o_custkey").alias("patient_id"), tp.alias("timepoint")).agg(F.avg("o_totalprice").alias("s1"), F.max("o_totalprice").alias("s2"))
    return P.score_delta(rows, ["patient_id"], ["s1", "s2"])


@query(f"WITH {SD} SELECT patient_id, score, round(delta, 6) AS delta FROM sd1")
def score_delta(t):
    return _score_delta(t).select("patient_id", "score", _r("delta", 6))


@query(f"WITH {SD} SELECT score, round(avg(delta), 6) AS mean, round(quantile_cont(delta, 0.5), 6) AS median, round(stddev_samp(delta), 6) AS sd, count(*) AS n FROM sd1 GROUP BY 1")
def score_delta_summary(t):
    return P.score_delta_summary(_score_delta(t)).select("score", _r("mean", 6), _r("median", 6), _r("sd", 6), "n")


# ---------------------------------------------------------------- model selection
LOGS = """lo AS (SELECT user_id AS run_id, event_type AS kind, CASE WHEN event_type IN ('view', 'click') THEN 'population' ELSE 'pair_mse' END AS arm, event_id AS epoch, value AS loss, value / 3 + event_id % 7 AS loss_pair,
 value * value AS metric_mmd, user_id % 5 AS fold, user_id // 5 AS config, CASE WHEN user_id < 20 THEN 0 ELSE user_id % 6 END AS level FROM events),
 lb AS (SELECT *, CASE WHEN arm = 'population' THEN loss ELSE loss_pair END AS best, count(*) OVER (PARTITION BY arm, run_id) AS n_epochs FROM lo), be AS (SELECT * FROM lb QUALIFY row_number() OVER (PARTITION BY arm, run_id ORDER BY best, epoch) = 1)"""


def _logs(t):
    u, v = F.col("user_id"), F.col("value")
    arm = F.when(F.col("event_type").isin("view", "click"), "population").otherwise("pair_mse")
    return t("events").select(u.alias("run_id"), arm.alias("arm"), F.col("event_id").alias("epoch"), v.alias("loss"), (v / 3 + F.col("event_id") % 7).alias("loss_pair"),
                              (v * v).alias("metric_mmd"), (u % 5).alias("fold"), F.floor(u / 5).alias("config"), F.when(u < 20, 0).otherwise(u % 6).alias("level"))


def _best(t):
    return R.best_epoch(_logs(t), ["arm", "run_id"], R.arm_metric("arm", ["population"]))


@query(f"WITH {LOGS} SELECT arm, run_id, epoch, n_epochs, round(best, 9) AS best, round(metric_mmd, 7) AS metric_mmd FROM be")
def best_epoch(t):
    return _best(t).select("arm", "run_id", "epoch", "n_epochs", _r("best"), _r("metric_mmd", 7))


AGG = LOGS + """, ag AS (SELECT config, arm, count(*) AS n_folds, avg(best) AS best_mean, stddev_pop(best) AS best_sd, avg(metric_mmd) AS mmd, avg(level) AS level FROM be GROUP BY ALL)"""


def _agg(t):
    return R.run_aggregate(_best(t), ["config"], "arm", ["metric_mmd", "level"])


@query(f"WITH {AGG} SELECT config, arm, n_folds, round(best_mean, 9) AS best_mean, round(best_sd, 9) AS best_sd, row_number() OVER (PARTITION BY arm ORDER BY round(best_mean, 9), config) AS arm_rank FROM ag")
def run_aggregate(t):
    return _agg(t).select("config", "arm", "n_folds", _r("best_mean"), _r("best_sd"), "arm_rank")


@query(f"""WITH {AGG}, m AS (SELECT config, arm, level, round(best_mean, 9) AS best FROM ag), f AS (SELECT *, min(best) FILTER (level = 0) OVER (PARTITION BY arm) AS floor FROM m),
 b AS (SELECT *, coalesce(level <> 0 AND best < floor, false) AS beats FROM f), p AS (SELECT *, beats AND row_number() OVER (PARTITION BY arm, beats ORDER BY best, config) <= 3 AS promoted FROM b)
 SELECT config, arm, round(floor, 9) AS floor, CASE WHEN floor > 0 THEN round(100 * (floor - best) / floor, 6) + 0.0::DOUBLE END AS improvement_pct, beats AS beats_floor, promoted FROM p""")
def vs_floor(t):
    out = R.vs_floor(cut(_agg(t)), "arm", "level", "config", 3)
    return out.select("config", "arm", _r("floor"), _r("improvement_pct", 6), "beats_floor", "promoted")


@query(f"""WITH {AGG} SELECT arm, config, round(mmd, 7) AS metric_mmd, row_number() OVER (ORDER BY round(mmd, 9), arm, config) AS cross_rank, level <> 0 AND mmd < min(mmd) FILTER (level = 0) OVER () AS beats_floor FROM ag""")
def cross_arm(t):
    return R.cross_arm(cut(_agg(t)), "metric_mmd", "arm", "level", "config").select("arm", "config", _r("metric_mmd", 7), "cross_rank", "beats_floor")


@query("""WITH e AS (SELECT c_nationkey AS config, c_acctbal / 10000 AS pearson, (c_custkey % 11 + 1) / 12.0::DOUBLE AS ss, 0.25::DOUBLE AS sc, (c_custkey % 5 + 1) / 6.0::DOUBLE AS sr, 0.5::DOUBLE AS rc FROM customer),
 g AS (SELECT config, count(*) AS n_folds, avg(pearson) AS recon, stddev_pop(pearson) AS recon_sd, avg(ss / sc) AS mix, avg(sr / rc) AS role FROM e GROUP BY 1),
 s AS (SELECT *, 0.5 * (role - min(role) OVER ()) / (max(role) OVER () - min(role) OVER ()) + 0.3 * (recon - min(recon) OVER ()) / (max(recon) OVER () - min(recon) OVER ())
  + 0.2 * (1 - (mix - min(mix) OVER ()) / (max(mix) OVER () - min(mix) OVER ())) AS score FROM g)
 SELECT config, n_folds, round(recon, 8) AS recon, round(recon_sd, 8) AS recon_sd, round(mix, 8) AS mix, round(role, 8) AS role, round(score, 8) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, config) AS score_rank,
 row_number() OVER (ORDER BY round(recon, 9) DESC, config) AS recon_rank, row_number() OVER (ORDER BY round(mix, 9), config) AS mix_rank, row_number() OVER (ORDER BY round(role, 9) DESC, config) AS role_rank FROM s""")
def composite_rank(t):
    k = F.col("c_custkey")
    rec = t("customer").select(F.col("c_nationkey").alias("config"), (F.col("c_acctbal") / 10000).alias("pearson"), ((k % 11 + 1) / 12.0).alias("same_study"), F.lit(0.25).alias("study_chance"),
                               ((k % 5 + 1) / 6.0).alias("same_role"), F.lit(0.5).alias("role_chance"))
    out = R.composite_rank(rec, "config")
    return out.select("config", "n_folds", *[_r(c, 8) for c in ("recon", "recon_sd", "mix", "role", "score")], "score_rank", "recon_rank", "mix_rank", "role_rank")


@query("""WITH l0 AS (SELECT l_orderkey AS run_id, l_linenumber AS epoch, l_quantity AS loss_pair, l_discount AS metric_mmd, l_suppkey AS fold0 FROM lineitem),
 u AS (SELECT run_id, epoch, min(loss_pair) AS loss_pair, min(metric_mmd) AS metric_mmd FROM l0 GROUP BY ALL), la AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) = 1),
 ok AS (SELECT * FROM la WHERE epoch = 7), bs AS (SELECT u.* FROM u SEMI JOIN ok USING (run_id) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY loss_pair, epoch) = 1),
 g AS (SELECT ok.run_id % 100 AS tag, count(DISTINCT ok.run_id // 100) AS n_folds, avg(bs.loss_pair) AS bp, avg(ok.loss_pair) AS fp, avg(bs.metric_mmd) AS bm, avg(ok.metric_mmd) AS fm FROM ok JOIN bs USING (run_id) GROUP BY 1)
 SELECT tag, n_folds, round(bp, 8) AS mean_best_loss_pair, round(fp, 8) AS mean_final_loss_pair, round(bm, 8) AS mean_best_metric_mmd, round(fm, 8) AS mean_final_metric_mmd,
 row_number() OVER (ORDER BY round(bp, 9), round(fp, 9), round(fm, 9), tag) AS screen_rank FROM g""")
def loss_screen(t):
    logs = t("lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("epoch")).agg(
        F.min("l_quantity").alias("loss_pair"), F.min("l_discount").alias("metric_mmd"))
    logs = logs.withColumn("tag", F.col("run_id") % 100).withColumn("fold", F.floor(F.col("run_id") / 100))
    out = R.loss_screen(logs, ["run_id"], "tag", "fold", 7, metrics=["metric_mmd"])
    return out.select("tag", "n_folds", *[_r(f"mean_{w}_{c}", 8) for w in ("best", "final") for c in ("loss_pair", "metric_mmd")], "screen_rank")
