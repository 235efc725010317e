"""Scalar cleaning and labelling as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: missing-text sentinels (wide set for clinical text, narrow set for ids)
MISSING_WIDE = ["", "NA", "N/A", "NAN", "NONE", "NULL", "NOT REPORTED", "UNKNOWN", "--"]
MISSING_NARROW = ["", "nan", "none", "null", "na"]
# fixed values: accepted spellings of the response categories
RESPONSE_TEXT = {
    "CR": ["COMPLETE RESPONSE", "CR-COMPLETE RESPONSE", "CR"],
    "PR": ["PARTIAL RESPONSE", "PR-PARTIAL RESPONSE", "PR"],
    "SD": ["STABLE DISEASE", "SD-STABLE DISEASE", "SD"],
    "PD": ["PROGRESSIVE DISEASE", "PD-PROGRESSIVE DISEASE", "PD"],
}
# fixed values: texts that mean a progression happened
PROGRESSION_TEXT = ["yes", "true", "1", "progression", "recurrence", "progression or recurrence"]
# fixed values: response words of the binary label
RESPONDER_TEXT = ["response", "partial_response", "disease_control", "complete_response"]
NON_RESPONDER_TEXT = ["non_response", "no_disease_control", "non_pr"]
# fixed values: tumour words of the two focus categories (one common misspelling)
BREAST_KEYS = ["breast", "mammary"]
PROSTATE_KEYS = ["prostate", "prostatic", "prostrate"]
# fixed values: drug names per target, in priority order
DRUG_TARGETS = {
    "PD1": ["NIVOLUMAB", "PEMBROLIZUMAB", "CEMIPLIMAB"],
    "PDL1": ["ATEZOLIZUMAB", "DURVALUMAB", "AVELUMAB"],
    "CTLA4": ["IPILIMUMAB", "TREMELIMUMAB"],
}
# fixed values: cancer name -> cohort code
CANCER_CODES = {
    "MELANOMA": "SKCM", "GLIOBLASTOMA": "GBM", "COLORECTAL CANCER": "COAD", "BREAST CANCER": "BRCA",
    "HER2-RECEPTOR NEGATIVE BREAST CANCER": "BRCA", "HER2-RECEPTOR POSITIVE BREAST CANCER": "BRCA",
    "ESTROGEN-RECEPTOR POSITIVE BREAST CANCER": "BRCA", "HEAD AND NECK SQUAMOUS CELL CARCINOMA": "HNSC",
    "OVARIAN CANCER": "OV", "OVARIAN SEROUS CARCINOMA": "OV", "PROSTATE CANCER": "PRAD", "ESOPHAGEAL CANCER": "ESCA",
}
# fixed value: study accession prefix of a dataset id
STUDY_PATTERN = r"^([A-Z]-[A-Z]+-\d+|GSE\d+|SRP\d+|PRJ[A-Z]+\d+)"


def trimmed(c: Column) -> Column:
    """Trim every whitespace kind, not only blanks."""
    return F.btrim(F.coalesce(c.cast("string"), F.lit("")), F.lit(" \t\n\x0b\f\r"))


def clean(c: Column) -> Column:
    """Trimmed text, '' for the wide missing set and for null."""
    t = trimmed(c)
    return F.when(F.upper(t).isin(MISSING_WIDE), "").otherwise(t)


def clean_str(c: Column) -> Column:
    """Trimmed text, '' for the narrow missing set and for null."""
    t = trimmed(c)
    return F.when(F.lower(t).isin(MISSING_NARROW), "").otherwise(t)


def strip_ensembl_version(c: Column) -> Column:
    t = clean(c)
    return F.when(F.upper(t).startswith("ENSG"), F.regexp_replace(F.upper(t), r"\.\d+$", "")).otherwise(t)


def strip_concat_suffix(c) -> Column:
    """Cleaned id without one trailing _0 or _1; missing words and null become the blank id."""
    return F.regexp_replace(clean_str(F.col(c) if isinstance(c, str) else c), "_[01]$", "")


def source_study(dataset: Column) -> Column:
    t = trimmed(dataset)
    study = F.regexp_extract(t, STUDY_PATTERN, 1)
    return F.when(study != "", study).otherwise(t)


def normalize_technology(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(trimmed(c), r"\s+", " ")))


def to_number(c: Column, non_negative: bool = False) -> Column:
    """Double or null; NaN and infinities become null."""
    t = clean(c)
    v = F.when(t != "", t.try_cast("double"))
    ok = ~F.isnan(v) & (F.abs(v) != float("inf"))
    if non_negative:
        ok = ok & (v >= 0)
    return F.when(ok, v)


def finite(c: Column) -> Column:
    """Numeric column with NaN and infinities as null."""
    v = c.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def max_nonnegative(values: Column) -> Column:
    """Largest valid number of a string array, null if none."""
    return F.array_max(F.filter(F.transform(values, lambda x: to_number(x, True)), lambda x: x.isNotNull()))


def loader_symbol(symbol: Column, gene_id: Column) -> Column:
    """Symbol, or the id where the symbol is blank or a missing word."""
    return F.when(F.lower(symbol).isin("", "nan", "none", "null") | symbol.isNull(), gene_id).otherwise(symbol)


def _symbols(*cols: Column):
    texts = [trimmed(c) for c in cols]
    return [F.when((t != "") & ~F.upper(t).startswith("ENSG"), t) for t in texts]


def gene_label(symbol: Column, gene: Column, name: Column, *ids: Column) -> Column:
    """First non-Ensembl of symbol, gene, name; then the first non-blank id."""
    fall = [F.when(trimmed(c) != "", trimmed(c)) for c in ids]
    return F.coalesce(*_symbols(symbol, gene, name), *fall, F.lit(""))


def gene_symbol_upper(*cols: Column) -> Column:
    """First non-blank, non-Ensembl column in upper case, else ''."""
    return F.upper(F.coalesce(*_symbols(*cols), F.lit("")))


def first_finite(*cols: Column) -> Column:
    """delta_value / ranking_score: the first finite of the ordered columns."""
    return F.coalesce(*[finite(c) for c in cols])


def tumor_category(scope: Column, tumor: Column) -> Column:
    t = F.lower(tumor)
    has = lambda keys: F.array_contains(F.array(*[t.contains(k) for k in keys]), True)
    return (F.when((F.lower(scope) == "global") | (t == "all"), "global")
            .when(has(BREAST_KEYS), "breast").when(has(PROSTATE_KEYS), "prostate"))


def response_class(c: Column) -> Column:
    t = F.upper(clean(c))
    out = F.lit(None).cast("string")
    for code, texts in RESPONSE_TEXT.items():
        out = F.when(t.isin(texts), code).otherwise(out)
    return out


def progression_flag(c: Column) -> Column:
    return F.lower(clean(c)).isin(PROGRESSION_TEXT)


def response_binary(c: Column) -> Column:
    t = F.regexp_replace(F.lower(trimmed(c)), "[- ]", "_")
    return F.when(t.isin(RESPONDER_TEXT), 1.0).when(t.isin(NON_RESPONDER_TEXT), 0.0)


def drug_target(regimen: Column) -> Column:
    """Target of the first drug class named in the regimen, in priority order."""
    t, out = F.upper(regimen), F.lit("NA")
    for target, drugs in reversed(DRUG_TARGETS.items()):
        out = F.when(t.rlike("|".join(drugs)), target).otherwise(out)
    return out


def cancer_code(subtype: Column) -> Column:
    t, out = F.upper(subtype), F.lit("NA")
    for name, code in CANCER_CODES.items():
        out = F.when(t == name, code).otherwise(out)
    return out


def slug(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(clean(c), "[^A-Za-z0-9._-]+", "_"), "^[_.]+|[_.]+$", "")
    return F.when(t == "", "unknown").otherwise(t)


def safe_text(c: Column) -> Column:
    t = F.regexp_replace(c, r"[^\p{L}\p{N}._-]", "_")
    t = F.substring(F.regexp_replace(t, "^_+|_+$", ""), 1, 100)
    return F.when(t == "", "unknown").otherwise(t)


def clean_term(c: Column, width: int = 95) -> Column:
    """Cut the ontology id, then shorten to `width` characters (95 in reports, 100 in combined tables)."""
    t = F.when(c.contains("(GO:"), F.trim(F.substring_index(c, "(GO:", 1))).otherwise(c)
    return F.substring(t, 1, width)


def library_label(c: Column, other_first_word: bool = True) -> Column:
    rest = F.substring_index(c, "_", 1) if other_first_word else c
    return (F.when(c.startswith("KEGG"), "KEGG").when(c.startswith("Reactome"), "Reactome")
            .when(c.startswith("GO_"), "GO BP").otherwise(rest))


def parse_overlap(c: Column) -> tuple[Column, Column]:
    """'k/n' -> (k, n); a bad part -> 0."""
    k = F.coalesce(F.split(c, "/", 2)[0].try_cast("int"), F.lit(0))
    n = F.coalesce(F.get(F.split(c, "/", 2), F.lit(1)).try_cast("int"), F.lit(0))
    return k, n
