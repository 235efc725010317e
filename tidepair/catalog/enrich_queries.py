"""Gene-set enrichment and join queries."""

from pyspark.sql import functions as F

from tidepair.operators import enrich as E
from tidepair.operators import joins as J

from .outcome_queries import CASES, cases
from .sqlmath import bh
from .tables import query


def _r(c, n=9, alias=None):
    return F.round(c, n).alias(alias or c)


# ---------------------------------------------------------------- enrichment
DEG = """dg0 AS (SELECT l_orderkey * 10 + l_linenumber AS ord, l_returnflag AS tumor, upper(p_name) AS symbol, CASE WHEN l_linenumber = 5 THEN NULL ELSE l_tax END AS fdr, l_discount - 0.05 AS delta, l_quantity * (l_discount - 0.05) AS score,
 l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _deg(t):
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_returnflag").alias("tumor"), F.upper("p_name").alias("symbol"),
                       F.when(F.col("l_linenumber") != 5, F.col("l_tax")).alias("fdr"), (F.col("l_discount") - 0.05).alias("delta"),
                       (F.col("l_quantity") * (F.col("l_discount") - 0.05)).alias("score"), "l_partkey")


@query(f"""WITH {DEG}, s AS (SELECT * FROM dg0 WHERE fdr <= 0.05), d AS (SELECT tumor, 'all_degs' AS direction, symbol, ord FROM s UNION ALL SELECT tumor, CASE WHEN delta > 0 THEN 'up_after_treatment' ELSE 'down_after_treatment' END, symbol, ord FROM s WHERE delta <> 0)
 SELECT tumor, direction, symbol, min(ord) AS ord FROM d GROUP BY ALL""")
def split_deg(t):
    return E.split_deg(_deg(t), ["tumor"])


@query(f"WITH {DEG} SELECT tumor, symbol, ord, round(score, 9) AS score FROM dg0 QUALIFY row_number() OVER (PARTITION BY tumor, symbol ORDER BY abs(score) DESC, ord) = 1")
def rank_genes_max_abs(t):
    return E.rank_genes_max_abs(_deg(t), ["tumor"]).select("tumor", "symbol", "ord", _r("score"))


@query(f"WITH {DEG} SELECT tumor, symbol, round(avg(delta), 9) AS score FROM dg0 GROUP BY ALL")
def rank_genes_mean(t):
    return E.rank_genes_mean(_deg(t), ["tumor"], "delta").select("tumor", "symbol", _r("score"))


POS = "ps AS (SELECT gene_id, score, row_number() OVER (ORDER BY score DESC, gene_id) - 1 AS pos, count(*) OVER () AS n FROM ranked)"


def _es_sql(hits, keys, n="max(n)"):
    """Full running-sum scan over every position (brute force), per key."""
    return f"""sz_{hits} AS (SELECT {keys}, count(*) AS k, sum(w) AS tot FROM {hits} GROUP BY {keys}),
 fl_{hits} AS (SELECT {keys}, ps.pos, ps.n, k, CASE WHEN h.pos IS NOT NULL THEN CASE WHEN tot > 0 THEN h.w / tot ELSE 1.0::DOUBLE / k END ELSE -1.0::DOUBLE / (ps.n - k) END AS step
  FROM sz_{hits} CROSS JOIN ps LEFT JOIN {hits} h USING ({keys}, pos)),
 rs_{hits} AS (SELECT {keys}, k, sum(step) OVER (PARTITION BY {keys} ORDER BY pos) AS run FROM fl_{hits}),
 es_{hits} AS (SELECT {keys}, max(k) AS k, CASE WHEN round(abs(max(run)), 12) >= round(abs(min(run)), 12) THEN max(run) ELSE min(run) END AS es FROM rs_{hits} GROUP BY {keys})"""


OBS = POS + ", ob AS (SELECT set_name, pos, abs(score) AS w FROM gene_sets JOIN ps USING (gene_id)), " + _es_sql("ob", "set_name")


@query(f"WITH {OBS} SELECT set_name, k AS n_hit, round(es, 8) AS es FROM es_ob")
def gsea_es(t):
    return E.gsea_es(t("ranked"), t("gene_sets")).select("set_name", "n_hit", _r("es", 8))


_RAWQ, _QQ = bh("p_value")


@query(f"""WITH {OBS}, pm AS (SELECT perm, pos, score, row_number() OVER (PARTITION BY perm ORDER BY md5(concat('4:', perm, ':', gene_id)), gene_id) AS r FROM ps, (SELECT unnest(range(1, 1001)) AS perm)),
 sk AS (SELECT DISTINCT k AS size FROM es_ob), nl AS (SELECT size, perm, pos, abs(score) AS w FROM pm JOIN sk ON r <= size), {_es_sql('nl', 'size, perm')},
 cmp AS (SELECT o.set_name, o.k, o.es, e.es AS nul FROM es_ob o JOIN es_nl e ON e.size = o.k),
 a AS (SELECT set_name, k, es, coalesce(abs(avg(CASE WHEN es >= 0 AND nul >= 0 OR es < 0 AND nul < 0 THEN nul END)), 1.0::DOUBLE) AS d,
  (count(*) FILTER (CASE WHEN es >= 0 THEN round(nul, 12) >= round(es, 12) ELSE round(nul, 12) <= round(es, 12) END) + 1) / 1001.0::DOUBLE AS p_value FROM cmp GROUP BY ALL),
 b AS (SELECT *, {_RAWQ} AS raw_q FROM a), le AS (SELECT set_name, string_agg(gene_id, ';' ORDER BY pos) AS leading_edge_genes FROM
  (SELECT set_name, gene_id, pos FROM gene_sets JOIN ps USING (gene_id) QUALIFY row_number() OVER (PARTITION BY set_name ORDER BY pos) <= 50) GROUP BY 1)
 SELECT set_name, k AS n_hit, round(es, 8) AS es, round(es / (d + 1e-6), 6) AS nes, round(p_value, 9) AS p_value, round({_QQ}, 9) AS fdr, leading_edge_genes FROM b JOIN le USING (set_name)""")
def gsea_nes(t):
    out = E.gsea_nes(t("ranked"), t("gene_sets"), 1000, 1, 4)
    return out.select("set_name", "n_hit", _r("es", 8), _r("nes", 6), _r("p_value"), _r("fdr"), "leading_edge_genes")


def _lc(x, y):
    return f"(lgamma({x} + 1) - lgamma({y} + 1) - lgamma({x} - {y} + 1))"


_TAIL = (f"list_sum(list_transform(range(n_overlap, least(n_list, n_set) + 1), lambda v: exp({_lc('n_list', 'v')} + {_lc('(n_bg - n_list)', '(n_set - v)')} - {_lc('n_bg', 'n_set')})))")
_R5, _Q5 = bh("p_value", "brand")


@query(f"""WITH ls AS (SELECT DISTINCT CASE WHEN score > 0 THEN 'up' ELSE 'down' END AS brand, gene_id FROM ranked WHERE abs(score) > 0.5), nl AS (SELECT brand, count(*) AS n_list FROM ls GROUP BY 1), ns AS (SELECT set_name, count(*) AS n_set FROM gene_sets GROUP BY 1),
 x AS (SELECT brand, set_name, count(*) AS n_overlap FROM ls JOIN gene_sets USING (gene_id) GROUP BY ALL), y AS (SELECT *, (SELECT count(*) FROM genes) AS n_bg FROM x JOIN nl USING (brand) JOIN ns USING (set_name)),
 z AS (SELECT *, {_TAIL} AS p_value FROM y), w AS (SELECT *, {_R5} AS raw_q FROM z)
 SELECT brand AS direction, set_name, n_overlap, concat(n_overlap, '/', n_set) AS overlap, round(n_overlap * (n_bg - n_list - n_set + n_overlap) / nullif((n_list - n_overlap) * (n_set - n_overlap), 0), 7) AS odds_ratio,
 round(p_value, 7) AS p_value, round({_Q5}, 7) AS fdr FROM w""")
def ora(t):
    lists = t("ranked").where(F.abs("score") > 0.5).select(F.when(F.col("score") > 0, "up").otherwise("down").alias("direction"), "gene_id")
    out = E.ora(lists, ["direction"], t("gene_sets"), t("genes").select("gene_id"))
    return out.select("direction", "set_name", "n_overlap", "overlap", *[_r(c, 7) for c in ("odds_ratio", "p_value", "fdr")])


CTX = """cr AS (SELECT o_orderkey AS id, o_custkey AS patient_id, concat('D', c_custkey % 400) AS dataset_id, CASE c_nationkey % 4 WHEN 0 THEN 'Mixed' WHEN 1 THEN ' NA ' ELSE concat('R', c_nationkey) END AS response_group,
  CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS segment_type FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query(f"""WITH {CTX}, l AS (SELECT id, patient_id, 'global' AS context_type, 'all_baselines' AS context FROM cr UNION ALL SELECT id, patient_id, 'dataset', dataset_id FROM cr UNION ALL
  SELECT id, patient_id, 'response', response_group FROM cr WHERE response_group LIKE 'R%' UNION ALL SELECT id, patient_id, 'segment', CASE WHEN segment_type = '' THEN 'all' ELSE segment_type END FROM cr)
 SELECT context_type, context, count(*) AS n, count(DISTINCT patient_id) AS n_patients FROM l GROUP BY ALL HAVING count(DISTINCT patient_id) >= 3 OR context_type = 'global'""")
def enrichment_contexts(t):
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = F.col("c_nationkey")
    rows = rows.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("patient_id"), F.concat(F.lit("D"), (F.col("c_custkey") % 400).cast("string")).alias("dataset_id"),
                       F.when(n % 4 == 0, "Mixed").when(n % 4 == 1, " NA ").otherwise(F.concat(F.lit("R"), n.cast("string"))).alias("response_group"),
                       F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderpriority")).alias("segment_type"))
    return E.enrichment_contexts(rows).groupBy("context_type", "context").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("patient_id").alias("n_patients"))


@query("""WITH rg AS (SELECT DISTINCT l_suppkey AS context, concat('G', l_partkey) AS gene_id FROM lineitem), ns AS (SELECT set_name, count(*) AS n_set FROM gene_sets GROUP BY 1),
 h AS (SELECT context, set_name, count(*) AS n_overlap, n_set FROM rg JOIN gene_sets USING (gene_id) JOIN ns USING (set_name) GROUP BY ALL),
 k AS (SELECT *, n_overlap / n_set AS coverage FROM h WHERE n_overlap / n_set >= 0.2 AND n_overlap BETWEEN 15 AND 500)
 SELECT context, set_name, n_overlap, n_set, round(coverage, 9) AS coverage, round(quantile_cont(coverage, 0.5) OVER (PARTITION BY context), 9) AS median_coverage FROM k""")
def pathway_coverage_filter(t):
    ranked = t("lineitem").select(F.col("l_suppkey").alias("context"), F.concat(F.lit("G"), F.col("l_partkey").cast("string")).alias("gene_id"))
    out = E.pathway_coverage_filter(ranked, ["context"], t("gene_sets"))
    return out.select("context", "set_name", "n_overlap", "n_set", _r("coverage"), _r("median_coverage"))


LIBS = ["KEGG_2021_Human", "Reactome_2022", "GO_Biological_Process_2023", "Hallmark_2020"]
TERMS = f"""te AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS category, l_linestatus AS tumor, ({LIBS!r})[l_linenumber % 4 + 1] AS library,
  CASE WHEN l_linenumber > 4 THEN 'up_after_treatment' ELSE 'down_after_treatment' END AS direction, concat('term ', l_partkey, ' (GO:', l_suppkey, ')') AS term, l_extendedprice / 300000 AS fdr, l_extendedprice / 900000 AS p_value,
  concat(CAST(l_quantity AS INT), '/', l_partkey) AS overlap FROM lineitem)"""


def _terms(t):
    n, text = F.col("l_linenumber"), lambda c: F.col(c).cast("string")
    return t("lineitem").select((F.col("l_orderkey") * 10 + n).alias("id"), F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("tumor"),
                                F.element_at(F.array(*map(F.lit, LIBS)), (n % 4 + 1).cast("int")).alias("library"),
                                F.when(n > 4, "up_after_treatment").otherwise("down_after_treatment").alias("direction"),
                                F.concat(F.lit("term "), text("l_partkey"), F.lit(" (GO:"), text("l_suppkey"), F.lit(")")).alias("term"),
                                (F.col("l_extendedprice") / 300000).alias("fdr"), (F.col("l_extendedprice") / 900000).alias("p_value"),
                                F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("/"), text("l_partkey")).alias("overlap"))


@query(f"""WITH {TERMS}, s AS (SELECT *, CASE WHEN direction LIKE 'up%' THEN -log10(fdr) ELSE log10(fdr) END AS score FROM te WHERE fdr > 0 AND fdr <= 0.25)
 SELECT category, tumor, direction, library, term, round(score, 8) AS score, row_number() OVER (PARTITION BY category, tumor ORDER BY round(abs(score), 9) DESC, direction, library, term) AS term_rank FROM s QUALIFY term_rank <= 12""")
def directional_terms(t):
    out = E.directional_terms(_terms(t), ["category", "tumor"])
    return out.select("category", "tumor", "direction", "library", "term", _r("score", 8), F.col("term_rank").cast("bigint").alias("term_rank"))


_LAB = "concat(trim(split_part(term, '(GO:', 1)), ' [', CASE WHEN library LIKE 'KEGG%' THEN 'KEGG' WHEN library LIKE 'Reactome%' THEN 'Reactome' WHEN library LIKE 'GO%' THEN 'GO BP' ELSE library END, ']')"


@query(f"""WITH {TERMS} SELECT id, {_LAB} AS term_label, split_part(overlap, '/', 1)::INT AS overlap_count, split_part(overlap, '/', 2)::INT AS overlap_total, round(-log10(p_value), 8) AS neg_log10_p, round(-log10(fdr), 8) AS neg_log10_fdr FROM te WHERE fdr > 0""")
def combine_terms(t):
    return E.combine_terms(_terms(t)).select("id", "term_label", "overlap_count", "overlap_total", _r("neg_log10_p", 8), _r("neg_log10_fdr", 8))


@query(f"""WITH {TERMS}, c AS (SELECT category, direction, {_LAB} AS term_label, p_value, split_part(overlap, '/', 1)::INT AS k, round(-log10(p_value), 9) AS s FROM te),
 p AS (SELECT DISTINCT term_label FROM (SELECT term_label FROM c WHERE p_value <= 0.05 QUALIFY row_number() OVER (PARTITION BY category ORDER BY s DESC, k DESC, term_label, direction) <= 10)),
 b AS (SELECT term_label, max(s) AS best FROM c WHERE term_label IN (SELECT term_label FROM p) GROUP BY 1)
 SELECT term_label, round(best, 8) AS best_score, row_number() OVER (ORDER BY best DESC, term_label) AS term_rank FROM b QUALIFY term_rank <= 20""")
def choose_terms(t):
    out = E.choose_terms(E.combine_terms(_terms(t)))
    return out.select("term_label", _r("best_score", 8), F.col("term_rank").cast("bigint").alias("term_rank"))


# ---------------------------------------------------------------- joins
@query("""WITH s AS (SELECT pair_id, gene_id, value AS s, 0 AS t FROM pairs JOIN expr ON cell_id = source_cell UNION ALL SELECT pair_id, gene_id, 0, value FROM pairs JOIN expr ON cell_id = target_cell)
 SELECT pair_id, gene_id, max(s) AS source_value, max(t) AS target_value FROM s GROUP BY ALL""")
def gather_pair_expression(t):
    return J.gather_pair_expression(t("pairs"), t("expr"), t("cells"))


ALIAS = """ce AS (SELECT o_orderkey AS cell_id, concat('N', o_orderkey) AS obs_name, CASE WHEN o_orderkey % 2 = 0 THEN concat('B', o_custkey) END AS raw_barcode, concat('X', o_orderkey // 3) AS barcode FROM orders),
 wa AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN concat('N', l_orderkey, '_1') WHEN 1 THEN concat('B', l_partkey) WHEN 2 THEN concat('X', l_orderkey, '_0') ELSE concat('N', l_orderkey) END AS cell_ref FROM lineitem)"""


@query(f"""WITH {ALIAS}, al AS (SELECT cell_id, 0 AS p, obs_name AS a FROM ce UNION ALL SELECT cell_id, 1, raw_barcode FROM ce UNION ALL SELECT cell_id, 2, barcode FROM ce),
 f AS (SELECT a, cell_id FROM al WHERE a IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a ORDER BY p, cell_id) = 1)
 SELECT l_orderkey, l_linenumber, cell_ref, coalesce(x.cell_id, y.cell_id) AS cell_id FROM wa LEFT JOIN f x ON x.a = cell_ref LEFT JOIN f y ON y.a = regexp_replace(cell_ref, '_[01]$', '')""")
def resolve_cell_id(t):
    k, text = F.col("o_orderkey"), lambda c: c.cast("string")
    cells = t("orders").select(k.alias("cell_id"), k.alias("ord"), F.concat(F.lit("N"), text(k)).alias("obs_name"),
                               F.when(k % 2 == 0, F.concat(F.lit("B"), text(F.col("o_custkey")))).alias("raw_barcode"), F.concat(F.lit("X"), text(F.floor(k / 3))).alias("barcode"))
    n, o = F.col("l_linenumber") % 4, text(F.col("l_orderkey"))
    ref = (F.when(n == 0, F.concat(F.lit("N"), o, F.lit("_1"))).when(n == 1, F.concat(F.lit("B"), text(F.col("l_partkey"))))
           .when(n == 2, F.concat(F.lit("X"), o, F.lit("_0"))).otherwise(F.concat(F.lit("N"), o)))
    return J.resolve_cell_id(t("lineitem").select("l_orderkey", "l_linenumber", ref.alias("cell_ref")), cells, "ord")


@query("SELECT gene_id, gene_index FROM genes WHERE gene_id IN (SELECT gene_id FROM expr)")
def align_genes(t):
    return J.align_genes(t("genes").select("gene_id", "gene_index"), t("expr"))


@query("""WITH a AS (SELECT pair_id FROM pairs WHERE probability >= 0.7), b AS (SELECT source_cell, target_cell FROM pairs WHERE source_label = target_label)
 SELECT pair_id, ord FROM pairs WHERE pair_id IN (SELECT pair_id FROM a) OR (source_cell, target_cell) IN (SELECT source_cell, target_cell FROM b)""")
def semi_join_or(t):
    p = t("pairs")
    return J.semi_join_or(p, p.where("probability >= 0.7").select("pair_id"), p.where("source_label = target_label").select("source_cell", "target_cell")).select("pair_id", "ord")


GENES = """mo AS (SELECT p_partkey AS gene_index, concat('ENSG', p_partkey) AS gene_id, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE concat(p_name, p_partkey) END AS gene_symbol FROM part),
 so AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, l_suppkey AS sample_id, concat('D', l_linenumber) AS dataset_id, CASE l_linenumber % 4 WHEN 0 THEN concat('ensg', l_partkey, '.3') WHEN 1 THEN concat('x', l_partkey) ELSE 'NA' END AS gene_id,
  CASE l_linenumber % 3 WHEN 0 THEN concat(' ', p_name, l_partkey) WHEN 1 THEN p_name ELSE concat('alias', l_partkey) END AS gene_symbol, l_quantity AS value FROM lineitem JOIN part ON l_partkey = p_partkey),
 re AS (SELECT p_partkey AS ord, concat('alias', p_partkey // 2) AS input_symbol, concat('ENSG', p_partkey, '.1') AS ensembl_gene_id FROM part),
 rf AS (SELECT upper(input_symbol) AS sym, ord AS gi FROM re QUALIFY row_number() OVER (PARTITION BY upper(input_symbol) ORDER BY ord) = 1),
 un AS (SELECT upper(gene_symbol) AS sym, min(gene_index) AS gi FROM mo GROUP BY 1 HAVING count(*) = 1),
 rs AS (SELECT so.*, m.gene_index AS e, rf.gi AS r, un.gi AS u, coalesce(m.gene_index, rf.gi, un.gi) AS model_gene_index,
  CASE WHEN m.gene_index IS NOT NULL THEN 'exact_ensembl' WHEN rf.gi IS NOT NULL THEN 'ranked_symbol_reference' WHEN un.gi IS NOT NULL THEN 'unique_checkpoint_symbol' ELSE 'unresolved' END AS mapping_method
  FROM so LEFT JOIN mo m ON m.gene_id = regexp_replace(upper(so.gene_id), '\\.[0-9]+$', '') LEFT JOIN rf ON rf.sym = upper(trim(so.gene_symbol)) LEFT JOIN un ON un.sym = upper(trim(so.gene_symbol)))"""


def _genes(t):
    p, n, text = F.col("p_partkey"), F.col("l_linenumber"), lambda c: c.cast("string")
    model = t("part").select(p.alias("gene_index"), F.concat(F.lit("ENSG"), text(p)).alias("gene_id"),
                             F.when(p % 3 == 0, F.col("p_name")).otherwise(F.concat("p_name", text(p))).alias("gene_symbol"))
    ref = t("part").select(p.alias("ord"), F.concat(F.lit("alias"), text(F.floor(p / 2))).alias("input_symbol"), F.concat(F.lit("ENSG"), text(p), F.lit(".1")).alias("ensembl_gene_id"))
    g = text(F.col("l_partkey"))
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == p).select(
        (F.col("l_orderkey") * 10 + n).alias("row_id"), F.col("l_suppkey").alias("sample_id"), F.concat(F.lit("D"), text(n)).alias("dataset_id"),
        F.when(n % 4 == 0, F.concat(F.lit("ensg"), g, F.lit(".3"))).when(n % 4 == 1, F.concat(F.lit("x"), g)).otherwise("NA").alias("gene_id"),
        F.when(n % 3 == 0, F.concat(F.lit(" "), F.col("p_name"), g)).when(n % 3 == 1, F.col("p_name")).otherwise(F.concat(F.lit("alias"), g)).alias("gene_symbol"),
        F.col("l_quantity").alias("value"))
    return rows, J.resolve_gene(rows, model, ref), model


@query(f"WITH {GENES} SELECT row_id, model_gene_index, mapping_method FROM rs")
def resolve_gene(t):
    return _genes(t)[1].select("row_id", "model_gene_index", "mapping_method")


@query(f"""WITH {GENES} SELECT row_id, CASE WHEN rs.gene_id = 'NA' THEN '' ELSE rs.gene_id END AS source_gene_id, trim(rs.gene_symbol) AS source_gene_symbol, model_gene_index, coalesce(mo.gene_id, 'NA') AS model_gene_id, mapping_method
 FROM rs LEFT JOIN mo ON mo.gene_index = model_gene_index""")
def gene_alignment_report(t):
    _, resolved, model = _genes(t)
    return J.gene_alignment_report(resolved, model, ["row_id"])


@query(f"""WITH {GENES} SELECT dataset_id, count(*) AS source_genes, count(model_gene_index) AS mapped_rows, count(DISTINCT model_gene_index) AS unique_model_genes, (SELECT count(*) FROM mo) AS model_genes,
 round(count(DISTINCT model_gene_index) / (SELECT count(*) FROM mo), 9) AS coverage, """ + ", ".join(f"count(*) FILTER (mapping_method = '{m}') AS mapping_{m}" for m in J.METHODS) + " FROM rs GROUP BY 1")
def gene_alignment_summary(t):
    _, resolved, model = _genes(t)
    return J.gene_alignment_summary(resolved, model).withColumn("coverage", F.round("coverage", 9))


@query(f"WITH {GENES} SELECT sample_id, model_gene_index, sum(value) AS value FROM rs WHERE model_gene_index IS NOT NULL GROUP BY ALL")
def align_expression(t):
    rows, resolved, _ = _genes(t)
    keys = ["gene_id", "gene_symbol"]
    genes = resolved.select(*keys, "model_gene_index").distinct()
    return J.align_expression(rows.select("sample_id", *keys, "value"), genes, keys)


@query(f"""WITH {GENES}, me AS (SELECT gene_index, gene_index IN (SELECT model_gene_index FROM rs WHERE model_gene_index IS NOT NULL) AS measured FROM mo), su AS (SELECT model_gene_index, sum(value) AS total, count(DISTINCT sample_id) AS n_samples FROM rs WHERE model_gene_index IS NOT NULL GROUP BY 1)
 SELECT gene_index, measured, coalesce(total, 0) AS total, coalesce(n_samples, 0) AS n_samples FROM me LEFT JOIN su ON model_gene_index = gene_index""")
def spatial_align(t):
    rows, resolved, model = _genes(t)
    keys = ["gene_id", "gene_symbol"]
    genes = resolved.select(*keys, "model_gene_index").distinct()
    counts, mask = J.spatial_align(rows.select("sample_id", *keys, "value"), genes, model, keys)
    total = counts.groupBy(F.col("model_gene_index").alias("gene_index")).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n_samples"))
    return mask.select("gene_index", "measured").join(total, "gene_index", "left").na.fill(0, ["total", "n_samples"])


@query("""WITH vo AS (SELECT p_partkey AS token_id, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS token FROM part), f AS (SELECT upper(token) AS s, token, token_id FROM vo QUALIFY row_number() OVER (PARTITION BY upper(token) ORDER BY token_id) = 1)
 SELECT l_returnflag AS dataset_id, l_suppkey AS sample_id, token, token_id, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN f ON s = upper(p_name) GROUP BY ALL""")
def vocab_align(t):
    vocab = t("part").select(F.col("p_partkey").alias("token_id"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("token"))
    counts = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_returnflag").alias("dataset_id"), F.col("l_suppkey").alias("sample_id"), F.concat(F.lit(" "), "p_name").alias("gene_symbol"), F.col("l_quantity").alias("value"))
    return J.vocab_align(counts, vocab)


@query("""SELECT a.o_orderkey AS pair_id, c_custkey AS patient_id, c_nationkey AS dataset_id, concat('GSE', n_regionkey) AS source_dataset_id, concat('GSE', n_regionkey, '__P', c_custkey) AS biological_patient_id, a.o_orderkey AS pre_sample_id, b.o_orderkey AS post_sample_id,
 CASE WHEN c_mktsegment = 'BUILDING' THEN 'Response' WHEN c_mktsegment = 'MACHINERY' THEN 'Non-response' ELSE 'NA' END AS response_group, CASE WHEN c_mktsegment = 'BUILDING' THEN '1' WHEN c_mktsegment = 'MACHINERY' THEN '0' ELSE 'NA' END AS response_binary,
 CASE WHEN c_nationkey < 5 THEN 'Melanoma' ELSE c_mktsegment END AS cancer_subtype, CASE WHEN c_nationkey < 5 THEN 'SKCM' ELSE 'NA' END AS cancer_code,
 CASE WHEN b.o_orderstatus = 'F' THEN 'Nivolumab + x' WHEN b.o_orderstatus = 'O' THEN 'ipilimumab' ELSE 'NA' END AS therapeutic_regimen, CASE WHEN b.o_orderstatus = 'F' THEN 'PD1' WHEN b.o_orderstatus = 'O' THEN 'CTLA4' ELSE 'NA' END AS drug_target
 FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 JOIN customer ON a.o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def pair_star_join(t):
    o, c = t("orders"), t("customer")
    pairs = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(o.select((F.col("o_orderkey") - 1).alias("o_orderkey")), "o_orderkey", "left_semi").select(
        F.col("o_orderkey").alias("pair_id"), F.col("o_custkey").alias("patient_id"), F.col("c_nationkey").alias("dataset_id"),
        F.col("o_orderkey").alias("pre_sample_id"), (F.col("o_orderkey") + 1).alias("post_sample_id"))
    seg = F.col("c_mktsegment")
    patients = c.select(F.col("c_custkey").alias("patient_id"), F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("source_patient_id"),
                        F.when(seg == "BUILDING", "Response").when(seg == "MACHINERY", " Non-response ").otherwise("unknown").alias("response_group"),
                        F.when(F.col("c_nationkey") < 5, "Melanoma").otherwise(seg).alias("cancer_subtype"))
    st = F.col("o_orderstatus")
    samples = o.select(F.col("o_orderkey").alias("sample_id"), F.when(st == "F", "Nivolumab + x").when(st == "O", "ipilimumab").otherwise("").alias("therapeutic_regimen"))
    studies = t("nation").select(F.col("n_nationkey").alias("dataset_id"), F.concat(F.lit("GSE"), F.col("n_regionkey").cast("string")).alias("source_dataset_id"))
    return J.pair_star_join(pairs, patients, samples, studies)


@query("SELECT l_orderkey AS sample_id, l_linenumber, l_suppkey AS dataset_id, o_orderpriority AS tissue FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'P'")
def file_sample_join(t):
    files = t("lineitem").select(F.col("l_orderkey").alias("sample_id"), "l_linenumber", F.col("l_suppkey").alias("dataset_id"))
    samples = t("orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("tissue"))
    return J.file_sample_join(files, samples, ["sample_id"])


@query(f"WITH {CASES} SELECT o_orderkey AS patient_id, id AS case_id, vital_status FROM orders JOIN outc ON id = o_orderkey")
def clinical_lookup(t):
    from tidepair.operators.outcomes import clinical_lookup as lookup, derive_outcomes
    c = cases(t)
    both = derive_outcomes(c.unionByName(c.withColumn("id", F.col("id") - 1000000000))).withColumnRenamed("id", "case_id")
    patients = t("orders").select(F.col("o_orderkey").alias("patient_id"), F.concat(F.lit(" TCGA-"), F.col("o_orderkey").cast("string")).alias("source_patient_id"))
    return lookup(patients, both, "case_id").select("patient_id", "case_id", "vital_status")


@query("SELECT o_orderkey, o_custkey AS patient_id FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def selected_patient_semi(t):
    rows = t("orders").select("o_orderkey", F.col("o_custkey").alias("patient_id"), "o_orderstatus")
    return J.selected_patient_semi(rows, rows.where("o_orderstatus = 'P'").select("patient_id")).select("o_orderkey", "patient_id")


@query("SELECT o_orderkey, o_custkey AS patient_id, c_nationkey AS dataset_id, o_totalprice AS value, c_acctbal AS os_time FROM orders JOIN customer ON c_custkey = o_custkey")
def features_with_outcomes(t):
    c = t("customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_nationkey").alias("dataset_id"), F.col("c_acctbal").alias("os_time"))
    f = t("orders").join(c.drop("os_time"), F.col("o_custkey") == F.col("patient_id")).select("o_orderkey", "patient_id", "dataset_id", F.col("o_totalprice").alias("value"))
    return J.features_with_outcomes(f, c)
