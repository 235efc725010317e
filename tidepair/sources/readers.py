"""Readers: pair files, string tables, count matrices, gene sets, clinical JSON, lookups."""

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepair.functions.clean import clean, clean_str, normalize_technology, strip_concat_suffix, to_number, trimmed
from tidepair.operators.outcomes import CASE
from tidepair.plans.ordered import row_rank, top_rows, with_totals
from tidepair.plans.session import broadcast_rows, shared_folder, ship_package

DIRECTIONS = ("source_to_target", "target_to_source")
PAIR_COLUMNS = ("source_cell", "target_cell", "probability")


def with_file_order(df: DataFrame) -> DataFrame:
    """Adds file_path and ord: increasing with the row's place in its file. Takes rows of by_header().

    A block starting at byte b holds fewer rows than bytes, so b + row-in-block is unique and
    ordered; the per-block minimum is a tiny aggregate.
    """
    rows = with_totals(df, ["file_path", "_b"], _m0=F.min("_m"))
    return rows.withColumn("ord", F.col("_b") + F.col("_m") - F.col("_m0")).drop("_b", "_m", "_m0")


#: Bytes that a header task is told a file costs to open: more than any split, so that each task gets one file.
WHOLE_FILE = 1 << 40


def file_headers(spark: SparkSession, paths, sep: str = ",") -> DataFrame:
    """(file_path, columns) of delimited files: the names in each file's first line.

    A task has one file, takes its first line and stops reading, so the bytes read do not grow with the files. The table is
    written to the shared folder. Files without a line are left out. The settings are those of a session of its own.
    """
    ship_package(spark)
    probe = spark.newSession()
    for name, value in (("files.maxPartitionBytes", WHOLE_FILE), ("files.openCostInBytes", WHOLE_FILE), ("execution.arrow.maxRecordsPerBatch", 1)):
        probe.conf.set("spark.sql." + name, str(value))

    def first_line(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    lines = probe.read.text(paths).select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("start"), "value")
    heads = lines.mapInArrow(first_line, "file_path string, start long, value string").where("start = 0")
    names = F.transform(F.split("value", re.escape(sep), -1), lambda n: F.btrim(F.btrim(n), F.lit('"\ufeff')))
    path = f"{shared_folder(spark)}/heads-{uuid.uuid4().hex}"
    heads.select("file_path", names.alias("columns")).write.parquet(path)
    return spark.read.schema("file_path string, columns array<string>").parquet(path)


def by_header(spark: SparkSession, paths, columns, sep: str = ",", strict: bool = True, **options) -> DataFrame:
    """String columns of delimited files by their names in each file's own header, whatever their order; other columns
    are left out. A missing one fails, or is null where strict is false. Adds file_path, and _b, _m for with_file_order().

    Files are read once, by position, as wide as the widest header. Positions come from the most frequent header; the files
    whose columns stand elsewhere are joined by their path (broadcast below the session's row bound).
    """
    columns = list(columns)
    heads = file_headers(spark, paths, sep)
    at = F.array(*[F.array_position("columns", c) for c in columns]).alias("at")  # from 1; 0 where a column is missing
    kinds = heads.select(at, F.size("columns").alias("width")).groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.max("width").alias("width"))
    usual = kinds.agg(F.max_by("at", F.struct("n", "at")).alias("at"), F.max("width").alias("width"), F.count(F.lit(1)).alias("kinds")).first()
    if not usual.kinds:
        names = ", ".join(f"`{c}` string" for c in columns)
        return spark.createDataFrame([], f"{names}, file_path string, _b long, _m long")
    if strict:
        bad = heads.where(F.exists(at, lambda i: i == 0)).limit(1).collect()
        if bad:
            raise ValueError(f"missing columns {[c for c in columns if c not in bad[0].columns]} in {bad[0].file_path}")
    schema = ", ".join(f"`_{i}` string" for i in range(1, usual.width + 1))
    rows = spark.read.options(sep=sep, mode="PERMISSIVE", **options).option("header", True).schema(schema).csv(paths)
    rows = rows.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    place = F.array(*[F.lit(i) for i in usual.at])
    if usual.kinds > 1:
        others = heads.select("file_path", at).where(F.col("at") != place).withColumnRenamed("at", "_at")
        others = F.broadcast(others) if others.count() <= broadcast_rows(spark) else others
        rows, place = rows.join(others, "file_path", "left"), F.coalesce("_at", place)
    values = F.array(*[F.col(f"_{i}") for i in range(1, usual.width + 1)])
    pick = lambda k: F.get(values, (place[k] - 1).cast("int")) if usual.kinds > 1 else (F.col(f"_{usual.at[k]}") if usual.at[k] else F.lit(None).cast("string"))
    return rows.select(*[pick(k).alias(c) for k, c in enumerate(columns)], "file_path", "_b", "_m")


def pair_paths(base: str, direction: str = "source_to_target") -> list[str]:
    """Pair CSVs under <base>/<patient>/<dataset>/nonzero_pairs_<direction>/; 'both' means both directions."""
    return [f"{base}/*/*/nonzero_pairs_{d}/*.csv" for d in (DIRECTIONS if direction == "both" else (direction,))]


def scan_pair_files(spark: SparkSession, base: str, direction: str = "source_to_target", ordered: bool = True, strict: bool = True) -> DataFrame:
    """Rows of the pair files. A file without a required column fails the scan; strict=False reads it with nulls, for
    pair_file_audit() to report."""
    rows = by_header(spark, pair_paths(base, direction), PAIR_COLUMNS, strict=strict).withColumn("probability", F.expr("try_cast(probability AS double)"))
    return with_file_order(rows) if ordered else rows.drop("_b", "_m")


def target_file(transition: Column) -> Column:
    """Expected target matrix of a transition, '' when it does not start at baseline."""
    t = clean_str(transition)
    rest = F.regexp_replace(t, "^baseline_to_", "")
    return F.when(~t.startswith("baseline_to_"), "").otherwise(F.concat(rest, F.lit(".h5ad")))


def path_metadata(df: DataFrame, base: str, path: str = "file_path", prefix: str | None = None,
                  suffix: str = ".csv") -> DataFrame:
    """patient, dataset, direction, transition and expected matrices from <base>/<patient>/<dataset>/<folder>/<file>.

    A file is named <prefix><transition><suffix>, the prefix being 'nonzero_pairs_<direction>_' by default;
    any other name is its own transition.
    """
    rel = F.regexp_replace(F.regexp_replace(path, "^file:/*", "/"), f"^{base.rstrip('/')}/", "")
    parts = F.split(rel, "/")
    name, folder = F.element_at(parts, -1), F.element_at(parts, -2)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    reverse = folder == "nonzero_pairs_target_to_source"
    head = F.lit(prefix) if prefix is not None else F.when(reverse, f"nonzero_pairs_{DIRECTIONS[1]}_").otherwise(f"nonzero_pairs_{DIRECTIONS[0]}_")
    ok = name.startswith(head) & name.endswith(suffix)
    inner = F.substring(name, F.length(head) + 1, F.length(name) - F.length(head) - len(suffix))
    out = df.withColumn("relative_path", rel).withColumn("patient_id", F.get(parts, F.lit(0))).withColumn("dataset_id", F.get(parts, F.lit(1)))
    out = out.withColumn("pair_direction", F.when(reverse, DIRECTIONS[1]).otherwise(DIRECTIONS[0]))
    out = out.withColumn("transition", F.when(ok, inner).otherwise(stem))
    return out.withColumn("baseline_file", F.concat_ws("/", "patient_id", "dataset_id", F.lit("baseline.h5ad"))).withColumn(
        "target_file", F.when(target_file(F.col("transition")) == "", "").otherwise(
            F.concat_ws("/", "patient_id", "dataset_id", target_file(F.col("transition")))))


def pair_cell_match_fraction(pairs: DataFrame, cells: DataFrame, file: str = "file_path", rows: int | None = None) -> DataFrame:
    """Share of each file's distinct stripped ids that exist in the cell index.

    cells(file, side, cell_id). All rows are checked; `rows` limits the check to a file's first rows.
    """
    if rows is None:
        head = pairs
    elif rows <= 1000:  # pruned to the first rows per task before the shuffle
        head = top_rows(pairs, [file], ["ord"], rows, "_k")
    else:
        head = row_rank(pairs, [file], ["ord"], "_k").where(F.col("_k") <= rows)
    ids = head.select(file, F.explode(F.array(
        F.struct(F.lit("source").alias("side"), strip_concat_suffix("source_cell").alias("cell_id")),
        F.struct(F.lit("target").alias("side"), strip_concat_suffix("target_cell").alias("cell_id")))).alias("_c")).select(file, "_c.*").distinct()
    known = cells.select(file, "side", "cell_id", F.lit(1.0).alias("_hit")).distinct()
    at = lambda s: F.coalesce(F.avg(F.when(F.col("side") == s, F.coalesce("_hit", F.lit(0.0)))), F.lit(0.0))
    return ids.join(known, [file, "side", "cell_id"], "left").groupBy(file).agg(
        at("source").alias("source_match_fraction"), at("target").alias("target_match_fraction"))


def pair_file_audit(pairs: DataFrame, inventory: DataFrame, match: DataFrame | None = None, file: str = "file_path",
                    threshold: float = 0.99, headers: DataFrame | None = None) -> DataFrame:
    """Per file: rows, column list, required columns present, matrices present, match fractions, valid flag.

    inventory(file, has_baseline, has_target) lists every discovered file, also empty ones. headers(file, columns) are the
    files' own headers (file_headers); a file without a header has no columns. Without headers, all files have those of pairs.
    """
    n = pairs.groupBy(file).agg(F.count(F.lit(1)).alias("n_rows"))
    out = inventory.join(n, file, "left").na.fill(0, ["n_rows"])
    if headers is None:
        listed = F.array(*[F.lit(c) for c in pairs.columns if c in PAIR_COLUMNS])
    else:
        out, listed = out.join(headers.withColumnRenamed("columns", "_listed"), file, "left"), F.coalesce("_listed", F.array().cast("array<string>"))
    needed = F.array(*[F.lit(c) for c in PAIR_COLUMNS])
    out = out.withColumn("columns", F.array_join(listed, ",")).withColumn("required_columns", F.size(F.array_except(needed, listed)) == 0).drop("_listed")
    ok = (F.col("n_rows") > 0) & F.col("required_columns") & F.col("has_baseline") & F.col("has_target")
    if match is not None:
        out = out.join(match, file, "left").na.fill(0.0, ["source_match_fraction", "target_match_fraction"])
        ok = ok & (F.col("source_match_fraction") > threshold) & (F.col("target_match_fraction") > threshold)
    return out.withColumn("valid", ok)


def scan_transport_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Long matrix entries (job, chunk, source_cell, target_cell, value) from Parquet; negative values clip to 0.

    grp names job and chunk, so percentile ranks stay chunk-local.
    """
    rows = spark.read.schema("job string, chunk string, source_cell string, target_cell string, value double").parquet(path)
    return rows.withColumn("probability", F.greatest(F.col("value"), F.lit(0.0))).withColumn("grp", F.concat_ws("|", "job", "chunk"))


def read_string_tsv(spark: SparkSession, path: str, columns) -> DataFrame:
    """All-string table, columns by name; an empty field stays an empty string."""
    rows = by_header(spark, path, columns, "\t", emptyValue="", nullValue="\u0000")
    return rows.select(*columns).na.fill("")


def read_wide_counts(spark: SparkSession, path: str, columns, samples, dataset: str) -> DataFrame:
    """Genes x samples TSV -> long (dataset, gene, symbol, sample, count) for the requested samples only.

    A negative, non-numeric or non-finite count fails the job.
    """
    wide = by_header(spark, path, columns, "\t")
    long = wide.select("gene_id", "gene_symbol", *samples).unpivot(["gene_id", "gene_symbol"], list(samples), "sample_id", "raw")
    value = to_number(F.col("raw"), True)
    checked = F.when(value.isNotNull(), value).otherwise(F.raise_error("invalid count"))
    return long.select(F.lit(dataset).alias("dataset_id"), "gene_id", "gene_symbol", "sample_id", checked.alias("count"))


def parse_gene_sets(lines: DataFrame, variant: str = "A", low: int = 1, high: int = 10 ** 9) -> DataFrame:
    """GMT lines (column value) -> (set_name, gene), upper case, distinct; lines under 3 fields are skipped.

    Variant A keeps sets of low..high genes; variant B cleans the words and keeps every set.
    """
    parts = F.split("value", "\t")
    word = (lambda g: F.upper(trimmed(g))) if variant == "A" else (lambda g: F.upper(clean(g)))
    name = F.get(parts, F.lit(0)) if variant == "A" else clean(F.get(parts, F.lit(0)))
    rows = lines.where(F.size(parts) >= 3).select(name.alias("set_name"), F.explode(
        F.array_distinct(F.transform(F.slice(parts, 3, F.size(parts)), word))).alias("gene")).where(F.col("gene") != "")
    rows = rows.dropDuplicates(["set_name", "gene"])
    if variant == "A":
        size = rows.groupBy("set_name").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n").between(low, high))
        rows = rows.join(size.select("set_name"), "set_name", "left_semi")
    return rows


def read_gene_sets(spark: SparkSession, path: str, variant: str = "A", low: int = 1, high: int = 10 ** 9) -> DataFrame:
    return parse_gene_sets(spark.read.text(path), variant, low, high)


def parse_clinical_json(texts: DataFrame, column: str = "value") -> DataFrame:
    """Cases from a JSON text: a top-level list, {data: {hits: [..]}}, {data: [..]} or {hits: [..]}; any other text fails."""
    case = f"array<struct<{', '.join(_fields())}>>"
    listed = F.from_json(column, case)
    hits = F.from_json(column, f"struct<data: struct<hits: {case}>>")["data"]["hits"]
    data = F.from_json(column, f"struct<data: {case}>")["data"]
    top = F.from_json(column, f"struct<hits: {case}>")["hits"]
    failed = F.raise_error(F.lit("a clinical document is no list of cases"))
    kind = F.when(F.trim(F.col(column)).startswith("["), F.coalesce(listed, failed)).otherwise(F.coalesce(hits, data, top, failed))
    return texts.select(*[c for c in texts.columns if c != column], F.explode(kind).alias("_c")).select(
        *[c for c in texts.columns if c != column], "_c.*")


def _fields():
    """CASE as struct fields 'name: type'."""
    depth, part, out = 0, "", []
    for ch in CASE:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(part)
            part = ""
        else:
            part += ch
    out.append(part)
    return [p.strip().replace(" ", ": ", 1) for p in out]


def read_clinical_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file (documents are read in parallel, a document by one task)."""
    return parse_clinical_json(spark.read.option("wholetext", True).text(path))


def technology_lookup(table: DataFrame) -> DataFrame:
    """dataset_id -> normalised technology; a dataset with two values or an empty table fails."""
    rows = table.select(F.trim("dataset_id").alias("dataset_id"), normalize_technology(F.col("technology")).alias("technology"))
    one = rows.groupBy("dataset_id").agg(F.min("technology").alias("_lo"), F.max("technology").alias("_hi"))
    if one.limit(1).count() == 0:
        raise ValueError("technology lookup is empty")
    return one.select("dataset_id", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(
        F.raise_error("dataset maps to two technologies")).alias("technology"))


def keep_gene_list(lines: DataFrame) -> DataFrame:
    """Gene ids from lines or a TSV with an optional header; duplicates or an empty list fail.

    lines(ord, value): the header is recognised in the first non-blank line only.
    """
    rows = lines.withColumn("gene_id", F.split(trimmed(F.col("value")), "\t")[0]).where(F.col("gene_id") != "")
    first = rows.agg(F.min("ord").alias("_f"))
    head = F.lower("gene_id").isin("gene_id", "gene") & (F.col("ord") == F.col("_f"))
    rows = rows.withColumn("_f", first.scalar()).where(~head).select("ord", "gene_id")
    if rows.limit(1).count() == 0:
        raise ValueError("gene list is empty")
    ids = rows.groupBy("gene_id").agg(F.count(F.lit(1)).alias("_n"), F.min("ord").alias("ord"))
    return ids.select(F.when(F.col("_n") == 1, F.col("gene_id")).otherwise(F.raise_error("duplicate gene id")).alias("gene_id"), "ord")


def pick_column(columns, candidates, preferred: str | None = None) -> str | None:
    """First candidate present (case-insensitive); an existing preferred column comes first."""
    if preferred and preferred in columns:
        return preferred
    real = {c.lower(): c for c in columns}
    return next((real[c.lower()] for c in candidates if c.lower() in real), None)


# fixed values: metadata columns that may hold the tumour type, in order of preference
TUMOR_TYPE_CANDIDATES = [
    "cancer_subtype", "cancer_doid", "tumor_type", "tumour_type", "cancer_type", "cancer", "disease", "disease_type", "diagnosis",
    "primary_diagnosis", "study", "cohort", "project", "tissue", "tissue_type", "organ", "site", "primary_site", "oncotree_code",
    "histology", "histological_type",
]
# fixed values: metadata columns that may hold the cell annotation, in order of preference
ANNOTATION_CANDIDATES = [
    "cell_type", "celltype", "celltypes", "cell_type_major", "cell_type_fine", "major_cell_type", "minor_cell_type", "annotation",
    "annotations", "manual_annotation", "predicted_cell_type", "celltypist_cell_label", "singler_label", "leiden", "louvain",
    "cluster", "seurat_clusters",
]


def dominant_value(meta: DataFrame, keys, column: str) -> DataFrame:
    """Most frequent real value per key (smallest on a tie)."""
    text = trimmed(F.col(column))
    rows = meta.where(~F.lower(text).isin("", "nan", "none", "null", "na")).groupBy(*keys, F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("_n"))
    return top_rows(rows, list(keys), [F.desc("_n"), F.col("value")], 1, "_k").select(*keys, "value")


def candidate_metadata_column(baseline: DataFrame, target: DataFrame, keys=("patient_id", "dataset_id"), candidates=None,
                              preferred: str | None = None) -> DataFrame:
    """Dominant value of the first candidate column, baseline before target, else patient__dataset."""
    keys = list(keys)
    out = baseline.select(*keys).union(target.select(*keys)).distinct()
    for i, side in enumerate((baseline, target)):
        c = pick_column([x for x in side.columns if x not in keys], candidates or TUMOR_TYPE_CANDIDATES, preferred)
        if c:
            out = out.join(dominant_value(side, keys, c).select(*keys, F.col("value").alias(f"_v{i}"), F.lit(c).alias(f"_c{i}")), keys, "left")
        else:
            out = out.withColumn(f"_v{i}", F.lit(None).cast("string")).withColumn(f"_c{i}", F.lit(None).cast("string"))
    return out.select(*keys, F.coalesce("_v0", "_v1", F.concat_ws("__", *keys)).alias("value"),
                      F.coalesce("_c0", "_c1", F.lit("fallback_patient_dataset")).alias("column"))
