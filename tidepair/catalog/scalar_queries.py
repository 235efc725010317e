"""Cleaning and labelling functions over the given tables (dirty values injected by expression)."""

from pyspark.sql import functions as F

from tidepair.functions import clean as C

from .tables import query

DIRTY = """dirty AS (SELECT o_orderkey AS id, CASE o_orderkey % 13 WHEN 0 THEN ' NA ' WHEN 1 THEN 'nan' WHEN 2 THEN NULL
 WHEN 3 THEN 'Not Reported' WHEN 4 THEN '--' WHEN 5 THEN concat('ensg0000', o_custkey, '.', o_orderkey % 7)
 WHEN 6 THEN concat('  ', o_orderpriority, ' ') WHEN 7 THEN 'unknown' WHEN 8 THEN concat('GSE', o_custkey, '_rest')
 WHEN 9 THEN concat('C', o_orderkey, '_', o_orderkey % 3) WHEN 10 THEN CAST(o_totalprice - 200000 AS STRING)
 WHEN 11 THEN '1e400' ELSE '' END AS raw FROM orders)"""
WIDE = ", ".join(f"'{v}'" for v in C.MISSING_WIDE)
NARROW = ", ".join(f"'{v}'" for v in C.MISSING_NARROW)
CLEAN = f"CASE WHEN upper(trim(coalesce(raw, ''))) IN ({WIDE}) THEN '' ELSE trim(coalesce(raw, '')) END"


def _dirty(t):
    k = F.col("o_orderkey") % 13
    text = lambda c: F.col(c).cast("string")
    raw = (F.when(k == 0, " NA ").when(k == 1, "nan").when(k == 2, F.lit(None)).when(k == 3, "Not Reported").when(k == 4, "--")
           .when(k == 5, F.concat(F.lit("ensg0000"), text("o_custkey"), F.lit("."), (F.col("o_orderkey") % 7).cast("string")))
           .when(k == 6, F.concat(F.lit("  "), "o_orderpriority", F.lit(" "))).when(k == 7, "unknown")
           .when(k == 8, F.concat(F.lit("GSE"), text("o_custkey"), F.lit("_rest")))
           .when(k == 9, F.concat(F.lit("C"), text("o_orderkey"), F.lit("_"), (F.col("o_orderkey") % 3).cast("string")))
           .when(k == 10, (F.col("o_totalprice") - 200000).cast("string")).when(k == 11, "1e400").otherwise(""))
    return t("orders").select(F.col("o_orderkey").alias("id"), raw.alias("raw"))


@query(f"WITH {DIRTY} SELECT id, CASE WHEN id % 13 = 10 THEN 'number' ELSE {CLEAN} END AS cleaned FROM dirty")
def clean(t):
    return _dirty(t).select("id", F.when(F.col("id") % 13 == 10, "number").otherwise(C.clean(F.col("raw"))).alias("cleaned"))


@query(f"""WITH {DIRTY} SELECT id, CASE WHEN id % 13 = 10 THEN 'number' WHEN lower(trim(coalesce(raw, ''))) IN ({NARROW}) THEN ''
 ELSE trim(coalesce(raw, '')) END AS cleaned FROM dirty""")
def clean_str(t):
    return _dirty(t).select("id", F.when(F.col("id") % 13 == 10, "number").otherwise(C.clean_str(F.col("raw"))).alias("cleaned"))


@query(f"""WITH {DIRTY}, c AS (SELECT id, CASE WHEN id % 13 = 10 THEN 'number' ELSE {CLEAN} END AS x FROM dirty)
 SELECT id, CASE WHEN upper(x) LIKE 'ENSG%' THEN regexp_replace(upper(x), '\\.[0-9]+$', '') ELSE x END AS gene FROM c""")
def strip_ensembl_version(t):
    # the numeric spelling of doubles differs between engines; those rows are compared by to_number
    raw = F.when(F.col("id") % 13 == 10, "number").otherwise(F.col("raw"))
    return _dirty(t).select("id", C.strip_ensembl_version(raw).alias("gene"))


@query("SELECT ord, grp, regexp_replace(source_cell, '_[01]$', '') AS source_id FROM edges")
def strip_concat_suffix(t):
    return t("edges").select("ord", "grp", C.strip_concat_suffix("source_cell").alias("source_id"))


STUDY_ID = """CASE o_orderkey % 4 WHEN 0 THEN concat('GSE', o_custkey, '-arm') WHEN 1 THEN concat('E-MTAB-', o_custkey, '_x')
 WHEN 2 THEN concat('PRJNA', o_custkey, '|y') ELSE concat(' local', o_custkey, ' ') END"""


@query(f"""WITH i AS (SELECT o_orderkey AS id, trim({STUDY_ID}) AS x FROM orders)
 SELECT id, coalesce(nullif(regexp_extract(x, '{C.STUDY_PATTERN}', 1), ''), x) AS study FROM i""")
def source_study(t):
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    raw = (F.when(k == 0, F.concat(F.lit("GSE"), c, F.lit("-arm"))).when(k == 1, F.concat(F.lit("E-MTAB-"), c, F.lit("_x")))
           .when(k == 2, F.concat(F.lit("PRJNA"), c, F.lit("|y"))).otherwise(F.concat(F.lit(" local"), c, F.lit(" "))))
    return t("orders").select(F.col("o_orderkey").alias("id"), C.source_study(raw).alias("study"))


@query("""SELECT p_partkey, lower(trim(regexp_replace(concat('  10X  ', upper(p_name), ' '), '\\s+', ' ', 'g'))) AS technology FROM part""")
def normalize_technology(t):
    raw = F.concat(F.lit("  10X  "), F.upper("p_name"), F.lit(" "))
    return t("part").select("p_partkey", C.normalize_technology(raw).alias("technology"))


@query(f"""WITH {DIRTY}, n AS (SELECT id, try_cast(nullif({CLEAN}, '') AS DOUBLE) AS v FROM dirty)
 SELECT id, CASE WHEN isfinite(v) THEN v END AS num, CASE WHEN isfinite(v) AND v >= 0 THEN v END AS num_nonneg FROM n""")
def to_number(t):
    return _dirty(t).select("id", C.to_number(F.col("raw")).alias("num"), C.to_number(F.col("raw"), True).alias("num_nonneg"))


@query(f"""WITH {DIRTY}, n AS (SELECT id, try_cast(nullif({CLEAN}, '') AS DOUBLE) AS v, o_totalprice - 250000 AS w, o_custkey::DOUBLE AS z FROM dirty
  JOIN orders ON id = o_orderkey), m AS (SELECT id, CASE WHEN isfinite(v) AND v >= 0 THEN v END AS a, CASE WHEN w >= 0 THEN w END AS b,
  CASE WHEN id % 3 = 0 THEN z END AS c FROM n) SELECT id, greatest(a, b, c) AS top FROM m""")
def max_nonnegative(t):
    rows = _dirty(t).join(t("orders"), F.col("id") == F.col("o_orderkey"))
    values = F.array("raw", (F.col("o_totalprice") - 250000).cast("string"),
                     F.when(F.col("id") % 3 == 0, F.col("o_custkey").cast("string")))
    return rows.select("id", C.max_nonnegative(values).alias("top"))


GENE_COLS = """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN concat('ENSG', p_partkey) ELSE p_name END AS sym,
 CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_brand END AS gene, p_type AS name, concat('ENSG', p_partkey) AS gid FROM part"""


def _gene_cols(t):
    k, e = F.col("p_partkey"), F.concat(F.lit("ENSG"), F.col("p_partkey").cast("string"))
    return t("part").select(
        "p_partkey", F.when(k % 3 == 0, "").when(k % 3 == 1, e).otherwise(F.col("p_name")).alias("sym"),
        F.when(k % 5 == 0, " ").otherwise(F.col("p_brand")).alias("gene"), F.col("p_type").alias("name"), e.alias("gid"))


_U = lambda c: f"CASE WHEN trim({c}) <> '' AND NOT upper(trim({c})) LIKE 'ENSG%' THEN trim({c}) END"


@query(f"""WITH g AS ({GENE_COLS}) SELECT p_partkey, CASE WHEN lower(sym) IN ('', 'nan', 'none', 'null') THEN gid ELSE sym END AS loader,
 coalesce({_U('sym')}, {_U('gene')}, gid) AS label, upper(coalesce({_U('sym')}, {_U('gene')}, {_U('gid')}, '')) AS symbol FROM g""")
def gene_label(t):
    s, g, i = F.col("sym"), F.col("gene"), F.col("gid")
    return _gene_cols(t).select("p_partkey", C.loader_symbol(s, i).alias("loader"),
                                C.gene_label(s, g, F.lit(""), i).alias("label"), C.gene_symbol_upper(s, g, i).alias("symbol"))


SCORE_COLS = """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'nan'::DOUBLE WHEN l_linenumber = 2 THEN NULL ELSE l_tax END AS a,
 CASE WHEN l_linenumber = 2 THEN 'inf'::DOUBLE ELSE l_discount END AS b, l_quantity AS c FROM lineitem"""


def _score_cols(t):
    n = F.col("l_linenumber")
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", F.when(n == 1, float("nan")).when(n == 2, F.lit(None)).otherwise(F.col("l_tax")).alias("a"),
        F.when(n == 2, float("inf")).otherwise(F.col("l_discount")).alias("b"), F.col("l_quantity").alias("c"))


@query(f"WITH s AS ({SCORE_COLS}) SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN isfinite(a) THEN a END, CASE WHEN isfinite(b) THEN b END) AS delta FROM s")
def delta_value(t):
    return _score_cols(t).select("l_orderkey", "l_linenumber", C.first_finite(F.col("a"), F.col("b")).alias("delta"))


@query(f"""WITH s AS ({SCORE_COLS}) SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN isfinite(a) THEN a END, CASE WHEN isfinite(b) THEN b END,
 CASE WHEN isfinite(c) THEN c END) AS score FROM s""")
def ranking_score(t):
    return _score_cols(t).select("l_orderkey", "l_linenumber", C.first_finite(*map(F.col, "abc")).alias("score"))


TUMOR = """SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'Global' ELSE 'tumor' END AS scope, CASE c_custkey % 5 WHEN 0 THEN 'Breast cancer'
 WHEN 1 THEN 'PROSTRATE ca' WHEN 2 THEN 'all' WHEN 3 THEN concat('mammary ', c_mktsegment) ELSE c_mktsegment END AS tumor FROM customer"""


@query(f"""WITH x AS ({TUMOR}) SELECT c_custkey, CASE WHEN lower(scope) = 'global' OR lower(tumor) = 'all' THEN 'global'
 WHEN lower(tumor) SIMILAR TO '.*(breast|mammary).*' THEN 'breast' WHEN lower(tumor) SIMILAR TO '.*(prostate|prostatic|prostrate).*' THEN 'prostate' END AS category FROM x""")
def tumor_category(t):
    k = F.col("c_custkey") % 5
    tumor = (F.when(k == 0, "Breast cancer").when(k == 1, "PROSTRATE ca").when(k == 2, "all")
             .when(k == 3, F.concat(F.lit("mammary "), "c_mktsegment")).otherwise(F.col("c_mktsegment")))
    scope = F.when(F.col("c_nationkey") == 3, "Global").otherwise("tumor")
    return t("customer").select("c_custkey", C.tumor_category(scope, tumor).alias("category"))


RESP = "['Complete Response', 'pr-partial response', ' SD ', 'Progressive disease', 'Unknown', 'other', 'CR', 'non-response', 'Disease Control', 'non_PR', 'Response', 'no disease control']"
RESP_LIST = [x.strip().strip("'") for x in RESP[1:-1].split("', '")]
RESP_LIST[2] = " SD "


def _resp(t):
    return t("orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, RESP_LIST)), (F.col("o_orderkey") % 12 + 1).cast("int")).alias("x"))


_CLASS = " ".join(f"WHEN upper(trim(x)) IN ({', '.join(repr(v) for v in vs)}) THEN '{k}'" for k, vs in C.RESPONSE_TEXT.items())


@query(f"WITH r AS (SELECT o_orderkey, ({RESP})[o_orderkey % 12 + 1] AS x FROM orders) SELECT o_orderkey, CASE {_CLASS} END AS response FROM r")
def response_class(t):
    return _resp(t).select("o_orderkey", C.response_class(F.col("x")).alias("response"))


@query(f"""WITH r AS (SELECT o_orderkey, replace(replace(lower(trim(({RESP})[o_orderkey % 12 + 1])), '-', '_'), ' ', '_') AS x FROM orders)
 SELECT o_orderkey, CASE WHEN x IN ({', '.join(repr(v) for v in C.RESPONDER_TEXT)}) THEN 1.0::DOUBLE
 WHEN x IN ({', '.join(repr(v) for v in C.NON_RESPONDER_TEXT)}) THEN 0.0::DOUBLE END AS label FROM r""")
def response_binary(t):
    return _resp(t).select("o_orderkey", C.response_binary(F.col("x")).alias("label"))


@query("""SELECT o_orderkey, lower(trim((['Yes', 'no ', ' TRUE', '1', 'Progression', 'Recurrence', 'unknown'])[o_orderkey % 7 + 1]))
 IN ('yes', 'true', '1', 'progression', 'recurrence', 'progression or recurrence') AS progressed FROM orders""")
def progression_flag(t):
    words = F.array(*map(F.lit, ["Yes", "no ", " TRUE", "1", "Progression", "Recurrence", "unknown"]))
    x = F.element_at(words, (F.col("o_orderkey") % 7 + 1).cast("int"))
    return t("orders").select("o_orderkey", C.progression_flag(x).alias("progressed"))


@query("""WITH r AS (SELECT o_orderkey, upper((['nivolumab + ipilimumab', 'Durvalumab', 'tremelimumab x', 'chemo', 'Avelumab;Cemiplimab'])[o_orderkey % 5 + 1]) AS x FROM orders)
 SELECT o_orderkey, CASE WHEN regexp_matches(x, 'NIVOLUMAB|PEMBROLIZUMAB|CEMIPLIMAB') THEN 'PD1' WHEN regexp_matches(x, 'ATEZOLIZUMAB|DURVALUMAB|AVELUMAB') THEN 'PDL1'
 WHEN regexp_matches(x, 'IPILIMUMAB|TREMELIMUMAB') THEN 'CTLA4' ELSE 'NA' END AS target FROM r""")
def drug_target(t):
    words = F.array(*map(F.lit, ["nivolumab + ipilimumab", "Durvalumab", "tremelimumab x", "chemo", "Avelumab;Cemiplimab"]))
    x = F.element_at(words, (F.col("o_orderkey") % 5 + 1).cast("int"))
    return t("orders").select("o_orderkey", C.drug_target(x).alias("target"))


_NAMES = list(C.CANCER_CODES) + ["OTHER"]


@query("WITH m(name, code) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in C.CANCER_CODES.items()) +
       f"), r AS (SELECT o_orderkey, ({_NAMES!r})[o_orderkey % {len(_NAMES)} + 1] AS name FROM orders)"
       " SELECT o_orderkey, coalesce(code, 'NA') AS code FROM r LEFT JOIN m USING (name)")
def cancer_code(t):
    x = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("o_orderkey") % len(_NAMES) + 1).cast("int"))
    return t("orders").select("o_orderkey", C.cancer_code(F.lower(x)).alias("code"))


@query("""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g') AS x FROM pages)
 SELECT page_id, CASE WHEN x = '' THEN 'unknown' ELSE x END AS slug FROM s""")
def slug(t):
    return t("pages").select("page_id", C.slug(F.col("url")).alias("slug"))


@query("""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat(source, ' pathway (GO:', doc_id, ')') ELSE text END AS x FROM documents)
 SELECT doc_id, CASE WHEN contains(x, '(GO:') THEN left(trim(split_part(x, '(GO:', 1)), 95) ELSE left(x, 95) END AS term95,
 CASE WHEN contains(x, '(GO:') THEN left(trim(split_part(x, '(GO:', 1)), 100) ELSE left(x, 100) END AS term100 FROM s""")
def clean_term(t):
    x = F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit(" pathway (GO:"), F.col("doc_id").cast("string"), F.lit(")"))).otherwise(F.col("text"))
    d = t("documents").select("doc_id", x.alias("x"))
    return d.select("doc_id", C.clean_term(F.col("x")).alias("term95"), C.clean_term(F.col("x"), 100).alias("term100"))


LIBS = ["KEGG_2021_Human", "Reactome_2022", "GO_Biological_Process_2023", "MSigDB_Hallmark_2020"]


@query(f"""WITH l AS (SELECT p_partkey, ({LIBS!r})[p_partkey % 4 + 1] AS x FROM part)
 SELECT p_partkey, CASE WHEN x LIKE 'KEGG%' THEN 'KEGG' WHEN x LIKE 'Reactome%' THEN 'Reactome' WHEN x LIKE 'GO\\_%' ESCAPE '\\' THEN 'GO BP'
 ELSE split_part(x, '_', 1) END AS label FROM l""")
def library_label(t):
    x = F.element_at(F.array(*map(F.lit, LIBS)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t("part").select("p_partkey", C.library_label(x).alias("label"))


@query("""WITH o AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat(p_size, '/', p_partkey) WHEN 1 THEN concat('x/', p_size) ELSE 'bad' END AS x FROM part)
 SELECT p_partkey, coalesce(try_cast(split_part(x, '/', 1) AS INT), 0) AS k, coalesce(try_cast(split_part(x, '/', 2) AS INT), 0) AS n FROM o""")
def parse_overlap(t):
    s, p, m = F.col("p_size").cast("string"), F.col("p_partkey").cast("string"), F.col("p_partkey") % 3
    x = F.when(m == 0, F.concat(s, F.lit("/"), p)).when(m == 1, F.concat(F.lit("x/"), s)).otherwise("bad")
    k, n = C.parse_overlap(x)
    return t("part").select("p_partkey", k.alias("k"), n.alias("n"))
