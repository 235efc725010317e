"""Reader and writer round trips over data that Spark derives from the given tables."""

import uuid

from pyspark.sql import functions as F

from tidepair.operators import edges as E
from tidepair.operators.joins import gather_pair_expression
from tidepair.plans.session import cut, shared_folder
from tidepair.sources import readers as R
from tidepair.sources import writers as W

from .edge_queries import SCORED, _scored
from .outcome_queries import cases
from .tables import query


def _r(c, n=9, alias=None):
    return F.round(c, n).alias(alias or c)


def workdir(spark) -> str:
    """Fresh folder inside the cluster's shared folder."""
    return f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"


def _pair_files(t):
    """Edge CSVs as <patient>/<dataset>/nonzero_pairs_<direction>/, one folder per group (a handful of groups). The files of
    patient A have their columns in another order, behind one more column."""
    base = workdir(t.spark)
    rows = cut(t("edges"))
    for r in rows.select("grp").distinct().collect():
        patient, dataset = r[0].split("|")
        names = ["ord", "probability", "target_cell", "source_cell"] if patient == "A" else ["source_cell", "target_cell", "probability"]
        mine = rows.where(F.col("grp") == r[0]).select(*names)
        for d, keep in (("source_to_target", mine), ("target_to_source", mine.where("probability > 0.03"))):
            keep.write.option("header", True).csv(f"{base}/{patient}/{dataset}/nonzero_pairs_{d}")
    return base


@query("""WITH b AS (SELECT grp, 'source_to_target' AS pair_direction, source_cell, target_cell, probability FROM edges UNION ALL SELECT grp, 'target_to_source', source_cell, target_cell, probability FROM edges WHERE probability > 0.03)
 SELECT split_part(grp, '|', 1) AS patient_id, split_part(grp, '|', 2) AS dataset_id, pair_direction, source_cell, target_cell, probability FROM b""")
def scan_pair_files(t):
    base = _pair_files(t)
    rows = R.scan_pair_files(t.spark, base, "both")
    return R.path_metadata(rows, base).select("patient_id", "dataset_id", "pair_direction", "source_cell", "target_cell", "probability")


@query("""WITH p AS (SELECT o_orderkey AS id, concat('P', o_custkey) AS pa, concat('D', o_orderkey % 7) AS da, o_orderkey % 2 = 0 AS s, (['baseline_to_posttreatment', 'baseline_to_week4', 'odd'])[o_orderkey % 3 + 1] AS tr FROM orders)
 SELECT id, pa AS patient_id, da AS dataset_id, CASE WHEN s THEN 'source_to_target' ELSE 'target_to_source' END AS pair_direction, tr AS transition, concat(pa, '/', da, '/baseline.h5ad') AS baseline_file,
 CASE tr WHEN 'odd' THEN '' ELSE concat(pa, '/', da, '/', substr(tr, 13), '.h5ad') END AS target_file FROM p""")
def path_metadata(t):
    k, text = F.col("o_orderkey"), lambda c: c.cast("string")
    folder = F.when(k % 2 == 0, "nonzero_pairs_source_to_target").otherwise("nonzero_pairs_target_to_source")
    tr = F.element_at(F.array(*map(F.lit, ["baseline_to_posttreatment", "baseline_to_week4", "odd"])), (k % 3 + 1).cast("int"))
    name = F.when(tr == "odd", "odd.csv").otherwise(F.concat(folder, F.lit("_"), tr, F.lit(".csv")))
    path = F.concat(F.lit("/data/run/P"), text(F.col("o_custkey")), F.lit("/D"), text(k % 7), F.lit("/"), folder, F.lit("/"), name)
    rows = t("orders").select(k.alias("id"), path.alias("file_path"))
    return R.path_metadata(rows, "/data/run").select(
        "id", "patient_id", "dataset_id", "pair_direction", "transition", "baseline_file", "target_file")


def _known_cells(t):
    li = t("lineitem").select(F.concat_ws("|", "l_returnflag", "l_linestatus").alias("file_path"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("s"),
                              F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("x"), (F.col("l_suppkey") < 90).alias("keep"))
    return li.where("keep").select("file_path", F.lit("source").alias("side"), F.col("s").alias("cell_id")).union(
        li.select("file_path", F.lit("target"), "x")).distinct()


MATCH = """h AS (SELECT grp, source_cell, target_cell FROM edges),
 s AS (SELECT DISTINCT grp, regexp_replace(source_cell, '_[01]$', '') AS c FROM h), x AS (SELECT DISTINCT grp, target_cell AS c FROM h),
 m AS (SELECT grp, avg((substr(c, 2)::INT < 90)::INT) AS sm FROM s GROUP BY 1), n AS (SELECT DISTINCT grp, 1.0::DOUBLE AS tm FROM x)"""


def _match(t):
    pairs = t("edges").withColumnRenamed("grp", "file_path")
    return R.pair_cell_match_fraction(pairs, _known_cells(t))


@query(f"WITH {MATCH} SELECT grp AS file_path, round(sm, 9) AS source_match_fraction, tm AS target_match_fraction FROM m JOIN n USING (grp)")
def pair_cell_match_fraction(t):
    return _match(t).select("file_path", _r("source_match_fraction"), _r("target_match_fraction"))


AUDITED = f"""{MATCH}, c AS (SELECT grp, count(*) AS n_rows FROM edges GROUP BY 1), i AS (SELECT DISTINCT concat(l_returnflag, '|', l_linestatus) AS f, l_returnflag <> 'N' AS hb FROM lineitem
  UNION SELECT DISTINCT concat(o_orderstatus, '|none'), true FROM orders)"""


@query(f"""WITH {AUDITED}, k AS (SELECT i.*, CASE WHEN split_part(f, '|', 2) = 'none' THEN '' WHEN f LIKE 'R%' THEN 'source_cell,target_cell' WHEN f LIKE 'A%' THEN 'ord,probability,target_cell,source_cell'
  ELSE 'source_cell,target_cell,probability' END AS columns FROM i)
 SELECT f AS file_path, coalesce(n_rows, 0) AS n_rows, columns, columns LIKE '%probability%' AS required_columns, hb AS has_baseline, true AS has_target, round(coalesce(sm, 0), 9) AS source_match_fraction, coalesce(tm, 0) AS target_match_fraction,
 coalesce(n_rows, 0) > 0 AND columns LIKE '%probability%' AND hb AND coalesce(sm, 0) > 0.5 AND coalesce(tm, 0) > 0.5 AS valid FROM k LEFT JOIN c ON c.grp = f LEFT JOIN m ON m.grp = f LEFT JOIN n ON n.grp = f""")
def pair_file_audit(t):
    """Files of three headers: as usual, reordered with one more column (A), without probability (R); and listed files that
    are not there."""
    base, rows = workdir(t.spark), cut(t("edges"))
    for patient, names in (("A", ["ord", "probability", "target_cell", "source_cell"]), ("N", ["source_cell", "target_cell", "probability"]), ("R", ["source_cell", "target_cell"])):
        mine = rows.where(F.col("grp").startswith(patient)).select("grp", *names)  # several files a group, written where the rows are
        mine.write.partitionBy("grp").option("header", True).csv(f"{base}/{patient}/all/nonzero_pairs_source_to_target")
    paths = [f"{base}/*/all/nonzero_pairs_source_to_target/*/*.csv"]
    group = F.url_decode(F.regexp_extract("file_path", "grp=([^/]*)/", 1)).alias("grp")
    pairs = R.by_header(t.spark, paths, R.PAIR_COLUMNS, strict=False).withColumn("file_path", group)
    headers = R.file_headers(t.spark, paths).select(group.alias("file_path"), "columns").dropDuplicates(["file_path"])
    files = t("lineitem").select(F.concat_ws("|", "l_returnflag", "l_linestatus").alias("file_path"), (F.col("l_returnflag") != "N").alias("has_baseline"))
    empty = t("orders").select(F.concat("o_orderstatus", F.lit("|none")), F.lit(True))
    inventory = files.union(empty).distinct().withColumn("has_target", F.lit(True))
    match = R.pair_cell_match_fraction(pairs, _known_cells(t))
    return R.pair_file_audit(pairs, inventory, match, threshold=0.5, headers=headers).withColumn("source_match_fraction", F.round("source_match_fraction", 9))


@query("SELECT l_returnflag AS job, l_linestatus AS chunk, concat('S', l_suppkey) AS source_cell, concat('T', l_partkey) AS target_cell, greatest(sum(l_quantity - 10), 0) AS probability FROM lineitem GROUP BY ALL")
def scan_transport_matrix(t):
    path = workdir(t.spark)
    t("lineitem").groupBy(F.col("l_returnflag").alias("job"), F.col("l_linestatus").alias("chunk"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source_cell"),
                          F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("target_cell")).agg(F.sum(F.col("l_quantity") - 10).alias("value")).write.parquet(path)
    return R.scan_transport_matrix(t.spark, path).select("job", "chunk", "source_cell", "target_cell", "probability")


@query("SELECT CAST(c_custkey AS STRING) AS patient_id, CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE c_mktsegment END AS dataset_id, c_name AS name FROM customer")
def read_string_tsv(t):
    path = workdir(t.spark)
    t("customer").select(F.col("c_name").alias("name"), F.lit("x").alias("other"), F.when(F.col("c_nationkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("dataset_id"),
                         F.col("c_custkey").cast("string").alias("patient_id")).write.option("sep", "\t").option("header", True).csv(path)
    return R.read_string_tsv(t.spark, path, ["patient_id", "dataset_id", "name"])


@query("""SELECT 'bulk' AS dataset_id, concat('G', l_partkey) AS gene_id, min(p_name) AS gene_symbol, l_returnflag AS sample_id, sum(l_quantity) AS "count" FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('A', 'R') GROUP BY ALL
 UNION ALL SELECT 'bulk', concat('G', p_partkey), p_name, f, 0 FROM part, (VALUES ('A'), ('R')) v(f) WHERE p_partkey IN (SELECT l_partkey FROM lineitem) AND (p_partkey, f) NOT IN (SELECT l_partkey, l_returnflag FROM lineitem)""")
def read_wide_counts(t):
    path = workdir(t.spark)
    wide = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.concat(F.lit("G"), F.col("l_partkey").cast("string")).alias("gene_id"), F.col("p_name").alias("gene_symbol")).pivot(
        "l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity")).na.fill(0)
    wide.write.option("sep", "\t").option("header", True).csv(path)
    return R.read_wide_counts(t.spark, path, ["gene_id", "gene_symbol", "A", "N", "R"], ["A", "R"], "bulk")


@query("""WITH g AS (SELECT DISTINCT p_brand AS set_name, upper(p_name) AS gene FROM part), s AS (SELECT set_name, count(*) AS n FROM g GROUP BY 1) SELECT set_name, gene FROM g JOIN s USING (set_name) WHERE n BETWEEN 5 AND 60""")
def read_gene_sets(t):
    path = workdir(t.spark)
    # a set is one line of the file, bounded by the gene panel
    lines = t("part").groupBy("p_brand").agg(F.array_join(F.collect_list(F.concat(F.lit(" "), "p_name", F.lit(" "))), "\t").alias("genes"))
    lines.select(F.concat_ws("\t", "p_brand", F.lit("url"), "genes", F.lit("")).alias("value")).union(
        t("nation").select(F.concat_ws("\t", "n_name", F.lit("short")))).write.text(path)
    return R.read_gene_sets(t.spark, path, "A", 5, 60)


@query("""SELECT concat('TCGA-', o_orderkey) AS submitter_id, CASE o_orderstatus WHEN 'F' THEN 'Dead' WHEN 'O' THEN ' Alive ' ELSE 'not reported' END AS vital_status,
 (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O') AS n_diagnoses FROM orders""")
def read_clinical_json(t):
    path = workdir(t.spark)
    c = cases(t).withColumn("_k", F.floor(F.col("id") / 50))
    # documents of 50 cases in the three accepted shapes
    docs = c.groupBy("_k").agg(F.to_json(F.sort_array(F.collect_list(F.struct("submitter_id", "demographic", "diagnoses", "follow_ups")))).alias("j"))
    shape = F.when(F.col("_k") % 3 == 0, F.col("j")).when(F.col("_k") % 3 == 1, F.concat(F.lit('{"data":{"hits":'), "j", F.lit("}}"))).otherwise(
        F.concat(F.lit('{"data":'), "j", F.lit("}")))
    docs.select(shape.alias("value")).write.text(path)
    lines = t.spark.read.text(path)
    out = R.parse_clinical_json(lines)
    return out.select("submitter_id", "demographic.vital_status", F.coalesce(F.size("diagnoses"), F.lit(0)).cast("bigint").alias("n_diagnoses"))


@query("SELECT DISTINCT concat('D', c_nationkey) AS dataset_id, concat('10x ', lower(n_name)) AS technology FROM customer JOIN nation ON c_nationkey = n_nationkey")
def technology_lookup(t):
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit(" D"), F.col("c_nationkey").cast("string"), F.lit(" ")).alias("dataset_id"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("10X   "), "n_name")).otherwise(F.concat(F.lit(" 10x "), F.lower("n_name"), F.lit(" "))).alias("technology"))
    return R.technology_lookup(rows)


@query("SELECT concat('G', p_partkey) AS gene_id FROM part")
def keep_gene_list(t):
    rows = t("part").select((F.col("p_partkey") + 1).alias("ord"), F.concat_ws("\t", F.concat(F.lit("G"), F.col("p_partkey").cast("string")), "p_name").alias("value"))
    head = t("region").where("r_regionkey = 0").select(F.lit(0).cast("bigint").alias("ord"), F.lit("gene_id\tname").alias("value"))
    return R.keep_gene_list(head.union(rows)).select("gene_id")


@query("""WITH b AS (SELECT o_custkey AS p, o_orderkey % 3 AS d, CASE WHEN o_orderpriority = '5-LOW' THEN 'nan' ELSE o_orderpriority END AS v, o_orderdate < TIMESTAMP '1998-01-01' AS s FROM orders),
 c AS (SELECT p, d, s, v, count(*) AS n FROM b WHERE v <> 'nan' GROUP BY ALL), m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY p, d, s ORDER BY n DESC, v) = 1),
 k AS (SELECT DISTINCT p, d FROM b) SELECT k.p AS patient_id, k.d AS dataset_id, coalesce(x.v, y.v, concat(k.p, '__', k.d)) AS value, CASE WHEN x.v IS NOT NULL THEN 'Cancer_Type' WHEN y.v IS NOT NULL THEN 'disease' ELSE 'fallback_patient_dataset' END AS "column"
 FROM k LEFT JOIN m x ON x.p = k.p AND x.d = k.d AND x.s LEFT JOIN m y ON y.p = k.p AND y.d = k.d AND NOT y.s""")
def candidate_metadata_column(t):
    o = t("orders").select(F.col("o_custkey").alias("patient_id"), (F.col("o_orderkey") % 3).alias("dataset_id"),
                           F.when(F.col("o_orderpriority") == "5-LOW", "nan").otherwise(F.col("o_orderpriority")).alias("Cancer_Type"), F.col("o_orderstatus").alias("tissue"),
                           (F.col("o_orderdate") < F.lit("1998-01-01").cast(t("orders").schema["o_orderdate"].dataType)).alias("s"))
    return R.candidate_metadata_column(o.where("s").drop("s"), o.where("NOT s").drop("s").withColumnRenamed("Cancer_Type", "disease"))


@query("""WITH sh AS (SELECT pair_id, (row_number() OVER (ORDER BY ord) - 1) // 2500 AS shard_idx, row_number() OVER (ORDER BY ord) AS row_no, source_cell, target_cell FROM pairs), c AS (SELECT cell_id, count(*) AS k FROM expr GROUP BY 1)
 SELECT shard_idx, count(*) AS n_pairs, min(row_no) - 1 AS start_row, max(row_no) AS end_row, sum(coalesce(a.k, 0))::BIGINT AS source_nnz, sum(coalesce(b.k, 0))::BIGINT AS target_nnz, (SELECT count(*) FROM genes) AS n_genes
 FROM sh LEFT JOIN c a ON a.cell_id = source_cell LEFT JOIN c b ON b.cell_id = target_cell GROUP BY 1""")
def write_pair_shards(t):
    sharded = W.assign_shards(t("pairs"), ["ord"], 2500)
    values = gather_pair_expression(t("pairs"), t("expr"), t("cells"))
    return W.write_pair_shards(sharded, values, t("genes").count(), workdir(t.spark))


@query("""SELECT 'source' AS role, gene_id, count(*) AS n, sum(value) AS total FROM pairs JOIN expr ON cell_id = source_cell GROUP BY ALL UNION ALL SELECT 'target', gene_id, count(*), sum(value) FROM pairs JOIN expr ON cell_id = target_cell GROUP BY ALL""")
def pool_roles(t):
    side = lambda s: t("pairs").select("pair_id", F.col(s + "_cell").alias("cell_id")).join(t("expr"), "cell_id")
    pool = W.pool_roles(side("source"), side("target"), t("genes"), t("genes"))
    return pool.groupBy("role", "gene_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query(f"""WITH {SCORED} SELECT grp, ord, 'max_coupling' AS metric, round(source_max, 9) AS confidence FROM scored UNION ALL SELECT grp, ord, 'entropy_confidence', round(source_entropy_confidence, 9) FROM scored
 UNION ALL SELECT grp, ord, 'top12_margin', round(source_margin, 9) FROM scored""")
def write_edges_by_metric(t):
    out = W.write_edges_by_metric(_scored(t), workdir(t.spark), "source", ["max_coupling", "entropy_confidence", "top12_margin"])
    return out.select("grp", "ord", "metric", _r("confidence"))


@query("""SELECT count(*) AS n_pairs, count(DISTINCT patient_id) AS n_patients, count(DISTINCT (patient_id, dataset_id)) AS n_patient_datasets, count(DISTINCT (source_label, target_label)) AS n_transitions, count(DISTINCT source_cell) AS n_source_cells,
 count(DISTINCT target_cell) AS n_target_cells, round(avg(probability), 9) AS probability_mean, round(min(probability), 9) AS probability_min, round(max(probability), 9) AS probability_max, round(quantile_cont(probability, 0.5), 9) AS probability_median FROM pairs""")
def global_pair_summary(t):
    out = W.global_pair_summary(t("pairs"))
    return out.select(*[_r(c) if d == "double" else c for c, d in out.dtypes])


FILT = """sh AS (SELECT *, (row_number() OVER (ORDER BY ord) - 1) // 2500 AS shard_idx FROM pairs), l AS (SELECT dataset_id, quantile_cont(probability, 0.75) AS th FROM sh GROUP BY 1), k AS (SELECT sh.* FROM sh JOIN l USING (dataset_id) WHERE probability >= th)"""


@query(f"""WITH {FILT}, b AS (SELECT shard_idx, count(*) AS n_before FROM sh GROUP BY 1), c AS (SELECT shard_idx, count(*) AS n_pairs FROM k GROUP BY 1) SELECT 'manifest' AS part, CAST(shard_idx AS STRING) AS key, n_pairs AS n, n_before FROM b JOIN c USING (shard_idx)
 UNION ALL SELECT 'pair', pair_id, 1, 1 FROM k""")
def rewrite_filtered_dataset(t):
    sharded = W.assign_shards(t("pairs"), ["ord"], 2500)
    kept = E.confidence_select(sharded, ["dataset_id"], "probability", 0.25)
    manifest, table = W.rewrite_filtered_dataset(sharded, kept, t("pairs"), workdir(t.spark))
    return manifest.select(F.lit("manifest").alias("part"), F.col("shard_idx").cast("string").alias("key"), F.col("n_pairs").alias("n"), "n_before").unionByName(
        table.select(F.lit("pair").alias("part"), F.col("pair_id").alias("key"), F.lit(1).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("n_before")))
