"""Fixtures with known results and brute-force comparisons."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidepair.functions import clean as C
from tidepair.functions import pvalues as V
from tidepair.operators import enrich, joins, latent, neighbors, outcomes, reports, splits, stats
from tidepair.plans import ordered as O
from tidepair.plans.session import cut_counted
from tidepair.sources import readers


def rows(df):
    return [tuple(r) for r in df.collect()]


# ------------------------------------------------------------- known values
def test_p_values(spark):
    df = spark.createDataFrame([(2.0, 10.0), (-12.0, 5.0), (None, 4.0), (1.0, 1.0)], "t double, df double")
    p = [r[0] for r in df.select(V.student_t_p("t", "df")).collect()]
    assert p[0] == pytest.approx(0.07338803477, rel=1e-8) and p[1] == pytest.approx(7.0920e-05, rel=1e-3)
    assert p[2] is None and p[3] == pytest.approx(0.5, rel=1e-9)
    assert V.fisher_p(8, 2, 1, 5) == pytest.approx(0.03496503496, rel=1e-8)
    assert V.fisher_p(3, 0, 0, 3) == pytest.approx(0.1)
    mw = spark.createDataFrame([(0.0, 3, 3, 0.0)], "u double, a int, b int, t double")
    assert mw.select(V.mannwhitney_p("u", "a", "b", "t")).first()[0] == pytest.approx(0.1)
    w = spark.createDataFrame([(0.0, 5, 0.0)], "w double, n int, t double")
    assert w.select(V.wilcoxon_p("w", "n", "t")).first()[0] == pytest.approx(0.0625)


@given(st.integers(0, 12), st.integers(0, 12), st.integers(0, 12), st.integers(0, 12))
@settings(max_examples=200, deadline=None)
def test_fisher_against_enumeration(a, b, c, d):
    row, col, n = a + b, a + c, a + b + c + d
    prob = lambda k: math.comb(row, k) * math.comb(n - row, col - k) / math.comb(n, col)
    low, high = max(0, row + col - n), min(row, col)
    want = sum(prob(k) for k in range(low, high + 1) if prob(k) <= prob(a) * (1 + 1e-7))
    assert V.fisher_p(a, b, c, d) == pytest.approx(min(1.0, want), rel=1e-6)


def test_stable_fold_is_a_property_of_the_name(spark):
    names = [f"patient{i}" for i in range(50)]
    few, all_ = (spark.createDataFrame([(n,) for n in x], "g string") for x in (names[:20], names))
    a, b = dict(rows(splits.stable_fold(few, "g", 5, 3))), dict(rows(splits.stable_fold(all_, "g", 5, 3)))
    assert all(b[k] == v for k, v in a.items())
    digest = hashlib.blake2b(b"3:patient7", digest_size=8).digest()
    assert b["patient7"] == int.from_bytes(digest, "big") % 5


# ------------------------------------------------------------- fixtures
def test_gene_alignment_sums_duplicates_in_model_order(spark):
    model = spark.createDataFrame([(0, "ENSG000001", "A"), (1, "ENSG000002", "B"), (2, "ENSG000003", "C")],
                                  "gene_index long, gene_id string, gene_symbol string")
    source = [("ENSG000003.7", "C"), ("entrez-a", "A"), ("entrez-a-duplicate", "A"), ("missing", "NOPE")]
    counts = [[3, 4], [1, 2], [10, 20], [99, 99]]
    genes = spark.createDataFrame(source, "gene_id string, gene_symbol string")
    long = spark.createDataFrame([(f"s{j}", g, float(counts[i][j])) for i, (g, _) in enumerate(source) for j in range(2)],
                                 "sample_id string, gene_id string, value double")
    out = rows(joins.align_expression(long, joins.resolve_gene(genes, model), ["gene_id"]))
    assert sorted(out) == [("s0", 0, 11.0), ("s0", 2, 3.0), ("s1", 0, 22.0), ("s1", 2, 4.0)]


def test_outcome_derivation(spark):
    text = """[{"submitter_id": "X", "demographic": {"vital_status": "Dead", "days_to_death": 400},
      "diagnoses": [{"days_to_last_follow_up": 350, "days_to_recurrence": 200, "progression_or_recurrence": "Yes",
      "ajcc_pathologic_stage": "Stage II", "treatments": [{"treatment_outcome": "Partial Response", "therapeutic_agents": "Drug X"}]}]}]"""
    for shape in (text, '{"data": {"hits": %s}}' % text, '{"data": %s}' % text):
        case = readers.parse_clinical_json(spark.createDataFrame([(shape,)], "value string"))
        r = outcomes.derive_outcomes(case).first()
        assert (r.os_time_days, r.os_event, r.pfs_time_days, r.response_group) == (400.0, 1, 200.0, "Response")
        assert r.pathologic_stage == "Stage II" and r.therapeutic_agents == "Drug X"


def test_response_metric(spark):
    df = spark.createDataFrame([("GSE1", 1.0, 0), ("GSE1", 2.0, 0), ("GSE1", 8.0, 1), ("GSE1", 9.0, 1)], "cohort string, score double, y int")
    out = {r.scope: r.auroc for r in stats.response_performance(df, [], "cohort", "score", "y").collect()}
    assert out == {"all": 1.0, "cohort:GSE1": 1.0}


def test_paired_bulk_end_to_end(spark):
    pairs = spark.createDataFrame([("pair1", "P1d", "D1", "s_pre", "s_post")], "pair_id string, patient_id string, dataset_id string, pre_sample_id string, post_sample_id string")
    patients = spark.createDataFrame([("P1d", "P1", "Response", "Melanoma")], "patient_id string, source_patient_id string, response_group string, cancer_subtype string")
    samples = spark.createDataFrame([("s_post", "pembrolizumab")], "sample_id string, therapeutic_regimen string")
    studies = spark.createDataFrame([("D1", "GSE1")], "dataset_id string, source_dataset_id string")
    r = joins.pair_star_join(pairs, patients, samples, studies).first()
    assert (r.biological_patient_id, r.response_binary, r.cancer_code, r.drug_target) == ("GSE1__P1", "1", "SKCM", "PD1")
    with pytest.raises(Exception, match="not unique"):
        joins.pair_star_join(pairs, patients.union(patients), samples, studies).collect()


def test_failures_stop_the_job(spark):
    cells = spark.createDataFrame([("a", "d1")], "cell_id string, dataset_id string")
    with pytest.raises(Exception, match="dataset without technology"):
        splits.technology_filter(cells, spark.createDataFrame([("d2", "x")], "dataset_id string, technology string"), ["x"]).collect()
    with pytest.raises(Exception, match="two technologies"):
        readers.technology_lookup(spark.createDataFrame([("d", "a"), ("d", "b")], "dataset_id string, technology string")).collect()
    with pytest.raises(Exception, match="duplicate gene"):
        readers.keep_gene_list(spark.createDataFrame([(0, "g1"), (1, "g1")], "ord int, value string")).collect()


def test_gmt_variants(spark):
    lines = spark.createDataFrame([("S1\turl\tabc\t Abc \tdef\t",), ("S2\tonly",), ("S3\tu\tNA\tx",)], "value string")
    assert sorted(rows(readers.parse_gene_sets(lines, "A", 2, 5))) == [("S1", "ABC"), ("S1", "DEF"), ("S3", "NA"), ("S3", "X")]
    assert sorted(rows(readers.parse_gene_sets(lines, "B"))) == [("S1", "ABC"), ("S1", "DEF"), ("S3", "X")]


def test_clean_words(spark):
    df = spark.createDataFrame([("\tunknown ",), (" x ",), (None,), ("ensg01.12",)], "v string")
    assert rows(df.select(C.clean(F.col("v")), C.clean_str(F.col("v")), C.strip_ensembl_version(F.col("v")))) == [
        ("", "unknown", ""), ("x", "x", "x"), ("", "", ""), ("ensg01.12", "ensg01.12", "ENSG01")]


# ------------------------------------------------------------- hot groups
def test_ordered_toolkit_on_hot_groups(hot):
    rng = np.random.default_rng(1)
    data = [(int(g), float(v), i) for i, (g, v) in enumerate(zip(rng.integers(0, 2, 400), rng.integers(0, 40, 400)))]
    df = hot.createDataFrame(data, "g int, v double, i int").repartition(4)
    got = {r.i: r.r for r in O.row_rank(df, ["g"], [("v", False), ("i", True)], "r").collect()}
    for g in (0, 1):
        order = sorted((d for d in data if d[0] == g), key=lambda d: (-d[1], d[2]))
        assert [got[d[2]] for d in order] == list(range(1, len(order) + 1))
    q = {r.g: r.q for r in O.quantiles(df, ["g"], "v", {"q": 0.37}).collect()}
    for g in (0, 1):
        assert q[g] == pytest.approx(np.quantile([d[1] for d in data if d[0] == g], 0.37))
    p = hot.createDataFrame([(float(x),) for x in rng.random(200).round(2)], "p double")
    got = sorted((r.p, r.q) for r in O.bh_fdr(p, [], "p", "q").collect())
    pv = np.array([x for x, _ in got])
    want = np.minimum(1, np.minimum.accumulate((pv * len(pv) / np.arange(1, len(pv) + 1))[::-1])[::-1])
    np.testing.assert_allclose([y for _, y in got], want, rtol=1e-12)


@pytest.mark.parametrize("dims", [2, 16])
def test_knn_split_equals_brute_force(hot, dims):
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(0, 0.01, (60, dims)), rng.normal(0, 3, (40, dims)), np.zeros((12, dims))])
    df = hot.createDataFrame([("s" if i % 10 else "t", i, [float(v) for v in p]) for i, p in enumerate(x)], "s string, id long, v array<double>")
    got = {(r.id, r["rank"]): r.neighbor for r in neighbors.knn_join(df, ["s"], "id", "v", 4).collect()}
    part = np.array([i % 10 == 0 for i in range(len(x))])
    for i in range(len(x)):
        mates = [j for j in range(len(x)) if j != i and part[j] == part[i]]
        want = sorted(mates, key=lambda j: (((x[i] - x[j]) ** 2).sum(), j))[:4]
        assert [got[i, r + 1] for r in range(4)] == want


# ------------------------------------------------------------- iterative models
def _cox_loss(beta, data, penalizer):
    total = 0.0
    for g in {d[0] for d in data}:
        part = [d for d in data if d[0] == g]
        for t in sorted({d[1] for d in part if d[2]}):
            ev = [d[3] for d in part if d[1] == t and d[2]]
            risk = sum(math.exp(beta * d[3]) for d in part if d[1] >= t)
            tied = sum(math.exp(beta * z) for z in ev)
            total += sum(beta * z for z in ev) - sum(math.log(risk - j / len(ev) * tied) for j in range(len(ev)))
    return -total + len(data) * penalizer * beta ** 2 / 2


def _survival_data(n=90, seed=5):
    rng = np.random.default_rng(seed)
    return [(int(rng.integers(0, 2)), float(rng.integers(1, 15)), int(rng.random() < 0.6), float(np.round(rng.normal(), 1))) for _ in range(n)]


def test_cox_with_a_far_optimum_and_without_convergence(spark):
    """A rare covariate of large effect: whole Newton steps from 0 overshoot, halved ones arrive; too few steps fail."""
    data = [(0, float(i + 1), 1, 9.0 if i < 3 else 0.0) for i in range(60)]
    df = spark.createDataFrame([("k", *d) for d in data], "k string, g int, t double, e int, z double")
    beta = math.log(outcomes.cox_univariate(df, ["k"], "g", "t", "e", "z", penalizer=1e-4).first().hazard_ratio)
    assert all(_cox_loss(beta, data, 1e-4) <= _cox_loss(beta + d, data, 1e-4) for d in (-1e-3, 1e-3))
    with pytest.raises(RuntimeError, match="convergence"):
        outcomes.cox_univariate(df, ["k"], "g", "t", "e", "z", iterations=1)


@pytest.mark.parametrize("limit", ["4000000", "5"])
def test_cox_matches_direct_optimum(spark, limit):
    data = _survival_data()
    spark.conf.set("spark.tidepair.hotGroupRows", limit)
    try:
        df = spark.createDataFrame([("k", *d) for d in data], "k string, g int, t double, e int, z double")
        r = outcomes.cox_univariate(df, ["k"], "g", "t", "e", "z").first()
    finally:
        spark.conf.unset("spark.tidepair.hotGroupRows")
    lo, hi = -5.0, 5.0
    for _ in range(200):  # golden section on the convex loss
        a, b = hi - 0.618034 * (hi - lo), lo + 0.618034 * (hi - lo)
        lo, hi = (lo, b) if _cox_loss(a, data, 0.01) < _cox_loss(b, data, 0.01) else (a, hi)
    assert math.log(r.hazard_ratio) == pytest.approx((lo + hi) / 2, abs=1e-5)
    sign = 1 if r.hazard_ratio >= 1 else -1
    good = pairs = 0.0
    for a in data:
        for b in data:
            if a[2] and a[0] == b[0] and a is not b and (b[1] > a[1] or (b[1] == a[1] and not b[2])):
                pairs += 1
                good += 0.5 if a[3] == b[3] else float(sign * (a[3] - b[3]) > 0)
    assert r.concordance == pytest.approx(good / pairs, abs=1e-12)


def test_sinkhorn_reaches_the_exact_cost_of_a_clear_match(spark):
    p = [[0.0, 0.0], [5.0, 5.0]]
    df = spark.createDataFrame([(0, p[i], [p[i][0] + 0.1, p[i][1]], 1.0) for i in range(2)], "b int, p array<double>, t array<double>, w double")
    assert latent.sinkhorn_w2(df, "b", "p", "t", "w").first().loss_w2 == pytest.approx(0.01, abs=1e-6)
    same = latent.rbf_mmd(df, "b", "p", "p", "w").first().loss_mmd
    assert same == pytest.approx(0.0, abs=1e-12)


def test_pca_ridge_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4))
    y = x @ rng.normal(size=(4, 3)) + 0.1 * rng.normal(size=(60, 3))
    df = spark.createDataFrame([(i, i % 3, [float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(zip(x, y))],
                               "i int, fold int, x array<double>, y array<double>")
    got = {r.i: r.pred for r in outcomes.baseline_pca_ridge(df, "fold", "x", "y", components=2, alpha=10.0).collect()}
    for k in range(3):
        tr, te = np.arange(60) % 3 != k, np.arange(60) % 3 == k
        mu = x[tr].mean(0)
        comp = np.linalg.svd(x[tr] - mu)[2][:2].T
        z, zt = (x[tr] - mu) @ comp, (x[te] - mu) @ comp
        ym = y[tr].mean(0)
        coef = np.linalg.solve((z - z.mean(0)).T @ (z - z.mean(0)) + 10 * np.eye(2), (z - z.mean(0)).T @ (y[tr] - ym))
        want = ym + (zt - z.mean(0)) @ coef
        np.testing.assert_allclose([got[i] for i in np.nonzero(te)[0]], want, atol=1e-8)


# ------------------------------------------------------------- invariants
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 1)), min_size=6, max_size=40))
@settings(max_examples=8, deadline=None)
def test_auroc_is_antisymmetric(data):
    from pyspark.sql import SparkSession

    df = SparkSession.active().createDataFrame([(float(s), y) for s, y in data], "s double, y int")
    a = stats.auroc(df, [], "s", "y").first().auroc
    b = stats.auroc(df.withColumn("s", -F.col("s")), [], "s", "y").first().auroc
    assert (a is None and b is None) or a + b == pytest.approx(1.0)


def test_es_of_full_scan(spark):
    rng = np.random.default_rng(8)
    score = rng.normal(size=40)
    ranked = spark.createDataFrame([(f"g{i}", float(s)) for i, s in enumerate(score)], "gene_id string, score double")
    sets = {f"S{k}": rng.choice(40, size=k + 3, replace=False) for k in range(6)}
    table = spark.createDataFrame([(n, f"g{i}") for n, m in sets.items() for i in m], "set_name string, gene_id string")
    got = {r.set_name: r.es for r in enrich.gsea_es(ranked, table).collect()}
    order = np.argsort(-score)
    for name, members in sets.items():
        hit = np.isin(order, members)
        w = np.abs(score[order]) * hit
        run = np.cumsum(w / w.sum() - (~hit) / (~hit).sum())
        want = run.max() if abs(run.max()) >= abs(run.min()) else run.min()
        assert got[name] == pytest.approx(want, abs=1e-12)


# ------------------------------------------------------------- null keys and reader shapes
@pytest.mark.parametrize("limit", ["3", "4000000"])
def test_null_keys_are_groups(spark, limit):
    from tidepair.plans import ordered as O

    spark.conf.set("spark.tidepair.hotGroupRows", limit)
    try:
        rows = [(None if i % 2 else "g", float(i % 5), i) for i in range(40)]
        df = spark.createDataFrame(rows, "g string, v double, i int").repartition(3)
        ranks = {r.i: r.r for r in O.row_rank(df, ["g"], ["v", "i"], "r").collect()}
        for g in ("g", None):
            mine = sorted((v, i) for k, v, i in rows if k == g)
            assert [ranks[i] for _, i in mine] == list(range(1, 21))
        assert {(r.g, r.q) for r in O.quantiles(df, ["g"], "v", {"q": 0.5}).collect()} == {("g", 2.0), (None, 2.0)}
        average = O.avg_rank(df, ["g"], "v", "r", count="n").collect()
        assert len(average) == 40 and all(r.r == 4 * r.v + 2.5 and r.n == 20 for r in average)
        assert O.with_totals(df, ["g"], n=F.count(F.lit(1))).where("n = 20").count() == 40
        assert O.bh_fdr(df.withColumn("p", (F.col("v") + 1) / 10), ["g"], "p", "q").where("q IS NOT NULL").count() == 40
    finally:
        spark.conf.unset("spark.tidepair.hotGroupRows")


def test_pair_files_by_column_name(spark, tmp_path):
    from tidepair.sources import readers as R

    folder = tmp_path / "p1" / "d1" / "nonzero_pairs_source_to_target"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text("extra,probability,target_cell,source_cell\nx,0.25,T1,S1\ny,0.5,T2,S2\n")
    (folder / "b.csv").write_text("source_cell,target_cell,probability\nS3,T3,1\n")
    got = {(r.source_cell, r.target_cell, r.probability) for r in R.scan_pair_files(spark, str(tmp_path)).collect()}
    assert got == {("S1", "T1", 0.25), ("S2", "T2", 0.5), ("S3", "T3", 1.0)}
    (folder / "c.csv").write_text("source_cell,target_cell\nS3,T3\n")
    with pytest.raises(ValueError):
        R.scan_pair_files(spark, str(tmp_path))
    loose = R.scan_pair_files(spark, str(tmp_path), strict=False)
    assert sum(r.probability is None for r in loose.collect()) == 1
    short = lambda df: df.withColumn("file_path", F.substring_index("file_path", "/", -1))
    inventory = spark.createDataFrame([(f"{c}.csv", True, True) for c in "abcd"], "file_path string, has_baseline boolean, has_target boolean")
    heads = short(R.file_headers(spark, R.pair_paths(str(tmp_path))))
    audit = {r.file_path: (r.n_rows, r.columns, r.required_columns, r.valid) for r in R.pair_file_audit(short(loose), inventory, headers=heads).collect()}
    assert audit == {"a.csv": (2, "extra,probability,target_cell,source_cell", True, True), "b.csv": (1, "source_cell,target_cell,probability", True, True),
                     "c.csv": (1, "source_cell,target_cell", False, False), "d.csv": (0, "", False, False)}


def test_headers_read_first_lines_only(spark, tmp_path):
    """A file of a million lines gives its header without being read: the task stops after its first batch."""
    from tidepair.sources import readers as R

    for name, n in (("big", 1_000_000), ("small", 3)):
        (tmp_path / f"{name}.csv").write_text('"a", b\n' + "1,2\n" * n)
    (tmp_path / "empty.csv").write_text("")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    got = {r.file_path.rsplit("/", 1)[1]: r.columns for r in R.file_headers(spark, [f"{tmp_path}/*.csv"]).collect()}
    assert got == {"big.csv": ["a", "b"], "small.csv": ["a", "b"]}
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    ordered = R.with_file_order(R.by_header(spark, [f"{tmp_path}/small.csv"], ["b"])).orderBy("ord").collect()
    assert [r.b for r in ordered] == ["2"] * 3
    assert R.by_header(spark, [f"{tmp_path}/empty.csv"], ["b"]).count() == 0


def test_string_table_by_name(spark, tmp_path):
    from tidepair.sources import readers as R

    (tmp_path / "t.tsv").write_text("name\tother\tpatient_id\nx\ty\t1\n\tz\t2\n")
    assert sorted(map(tuple, R.read_string_tsv(spark, str(tmp_path / "t.tsv"), ["patient_id", "name"]).collect())) == [("1", "x"), ("2", "")]


def test_ids_are_cleaned_before_grouping(spark):
    from tidepair.functions.clean import strip_concat_suffix

    df = spark.createDataFrame([(" s1 ",), ("s1_0",), ("nan",), (None,)], "c string")
    assert [r[0] for r in df.select(strip_concat_suffix("c")).collect()] == ["s1", "s1", "", ""]


def test_clinical_json_shapes(spark):
    from tidepair.sources import readers as R

    case = '{"submitter_id": "A"}'
    good = [f"[{case}]", f'{{"data": {{"hits": [{case}]}}}}', f'{{"data": [{case}]}}', f'{{"hits": [{case}]}}']
    assert R.parse_clinical_json(spark.createDataFrame([(g,) for g in good], "value string")).count() == 4
    for bad in ("{broken", '{"other": 1}'):
        with pytest.raises(Exception, match="no list of cases"):
            R.parse_clinical_json(spark.createDataFrame([(bad,)], "value string")).collect()


def test_gsea_null_is_fine_enough_for_bh(spark):
    ranked = spark.createDataFrame([(f"g{i}", 30.0 - i) for i in range(60)], "gene_id string, score double")
    sets = spark.createDataFrame([("top", f"g{i}") for i in range(8)], "set_name string, gene_id string")
    assert enrich.gsea_nes(ranked, sets).first().p_value == pytest.approx(1 / 1001)


def test_reference_counts(spark, monkeypatch):
    """Resamples, iterations and components as many as the reference takes."""
    import __spark_entry__ as entry

    seen, real = [], outcomes.quantiles
    monkeypatch.setattr(outcomes, "quantiles", lambda df, keys, value, *a: (seen.append(df) if value == "_m" else None, real(df, keys, value, *a))[1])
    metrics = [(m, i, f"p{i}", 1.0 + i * (m == "world_finetuned"), 1.0, 0.1 * i, 0.2) for m in ("world_pretrained", "world_finetuned") for i in range(4)]
    outcomes.finetune_comparison(spark.createDataFrame(metrics, "method string, row_index int, patient_id string, mse double, mae double, post_pearson double, delta_pearson double"))
    assert seen[0].where("metric = 'mse'").count() == 2000
    steps, model = [], outcomes.LogisticRegression
    monkeypatch.setattr(outcomes, "LogisticRegression", lambda **a: (steps.append(a["maxIter"]), model(**a))[1])
    df = spark.createDataFrame([(i % 2, [float(i), float(i * i % 7)], i // 2 % 2) for i in range(16)], "fold int, x array<double>, label int")
    assert outcomes.response_classifier(df, "fold", "x", "label").count() == 16 and steps == [2000, 2000]
    pred = [r.pred for r in entry.queries()["baseline_pca_ridge"](spark, "/root/testdata/sf0.001").where("fold = 0").collect()]
    x = np.array(pred)
    assert np.linalg.matrix_rank(x - x.mean(axis=0), tol=1e-3) == min(32, len(x) - 1, x.shape[1])


def test_every_draw_meets_one_interval(spark):
    """Fractional, tiny, zero, null and NaN weights: n draws a shard, none of a weight of zero."""
    from tidepair.operators import splits

    weights = [0.1, 1e-30, 0.3, None, float("nan"), -2.0, 0.0, 1 / 3, 1e12 / 7]
    rows = [("a", i, w) for i, w in enumerate(weights)] + [("b", i, 0.0) for i in range(5)] + [("c", i, (i % 7 + 1) / 9.7) for i in range(400)]
    got = splits.probability_sampling(spark.createDataFrame(rows, "shard string, ord int, w double").repartition(3), "shard", "ord", "w", 300).collect()
    assert {s: sum(r.shard == s for r in got) for s in "abc"} == {"a": 300, "b": 300, "c": 300}
    assert {r.draw for r in got if r.shard == "c"} == set(range(1, 301))
    assert {r.ord for r in got if r.shard == "a"} <= {0, 1, 2, 7, 8} and len({r.ord for r in got if r.shard == "b"}) == 5


def test_an_empty_side_of_a_split_fails(spark):
    from tidepair.operators import splits

    rows = spark.createDataFrame([(i, f"p{i % 3}") for i in range(9)], "id int, patient string")
    folds = spark.createDataFrame([(f"p{i}", i) for i in range(3)], "patient string, fold int")
    assert splits.fold_split(rows, folds, "patient", 1).where("split = 'val'").count() == 3
    for held_out, fold in ((7, folds), (0, folds.withColumn("fold", F.lit(0)))):
        with pytest.raises(Exception, match="empty side"):
            splits.fold_split(rows, fold, "patient", held_out).collect()


def test_bootstrap_draws_are_dealt_and_whole(spark):
    df = spark.createDataFrame([(i, float(i * 7 % 11), i % 2) for i in range(1, 31)], "id int, score double, label int")
    n, reps = 30, 40
    pick = lambda rep, slot: ((rep * 1000003 + slot * 7919) % 2147483647 * 2654435761 % 2147483647 * 48271) % 2147483647 % n
    want = sorted((rep, pick(rep, slot) + 1) for rep in range(1, reps + 1) for slot in range(n))
    for bound in ("200000", "5"):  # sent to the tasks, and joined by hash
        spark.conf.set("spark.tidepair.broadcastRows", bound)
        try:
            draws = stats.bootstrap_draws(df, "id", reps).withColumn("part", F.spark_partition_id())
            rows = draws.select("rep", "id", "part").collect()
        finally:
            spark.conf.unset("spark.tidepair.broadcastRows")
        assert sorted((r[0], r[1]) for r in rows) == want
        by_part = {}
        for r in rows:
            by_part.setdefault(r[0], set()).add(r[2])
        assert len({p for s in by_part.values() for p in s}) > 1 and all(len(s) == 1 for s in by_part.values())


def test_floor_is_compared_at_nine_digits(spark):
    made = [("arm", 0.0, 1, 0.1 + 0.2), ("arm", 1.0, 2, 0.3), ("arm", 1.0, 3, 0.2), ("none", 1.0, 4, 0.5), ("zero", 0.0, 5, 0.0), ("zero", 2.0, 6, 0.0)]
    agg = spark.createDataFrame(made, "arm string, level double, config int, best_mean double")
    got = {r["config"]: (r["floor"], r["improvement_pct"], r["beats_floor"], r["promoted"]) for r in reports.vs_floor(agg, "arm", "level", "config", 3).collect()}
    assert got[2] == (0.3, 0.0, False, False) and got[1] == (0.3, 0.0, False, False)
    assert got[3][2:] == (True, True) and got[3][1] == pytest.approx(100 / 3)
    assert got[4] == (None, None, False, False) and got[5] == got[6] == (0.0, None, False, False)


def test_classifier_rows_carry_no_model(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    r = np.random.default_rng(5)
    x = r.normal(size=(60, 3)) * [1.0, 20.0, 0.0] + [0.0, 5.0, 2.0]
    y = (x[:, 0] + r.normal(size=60) > 0.4).astype(int).tolist()
    df = spark.createDataFrame([(i, i % 3, x[i].tolist(), y[i]) for i in range(60)], "id int, fold int, x array<double>, label int")
    assert cut_counted(df)[1] == 60  # a session that has observed something can't be sent along
    got = outcomes.response_classifier(df, "fold", "x", "label")
    got = {a.id: a.probability for a in got.collect()}
    vec = df.withColumn("v", array_to_vector("x"))
    for k in range(3):
        train, test = vec.where(F.col("fold") != k), vec.where(F.col("fold") == k)
        scaler = StandardScaler(withMean=True, withStd=True, inputCol="v", outputCol="s").fit(train)
        ones = sum(y[i] for i in range(60) if i % 3 != k)
        w = F.when(F.col("label") == 1, 40 / (2.0 * ones)).otherwise(40 / (2.0 * (40 - ones)))
        model = LogisticRegression(featuresCol="s", labelCol="label", weightCol="w", regParam=1 / (0.1 * 40), standardization=False, maxIter=2000).fit(scaler.transform(train).withColumn("w", w))
        for a in scaler.transform(test).withColumn("s", vector_to_array("s")).collect():
            assert got[a.id] == pytest.approx(1 / (1 + math.exp(-(np.dot(a.s, model.coefficients) + model.intercept))), abs=1e-9)
    assert len(got) == 60


def test_gsea_ranks_genes_once(spark, hot, monkeypatch):
    """One ranking of the genes serves scores, null and leading edges; bounded and counted ways give the same scores."""
    calls, real = [], enrich.positions
    monkeypatch.setattr(enrich, "positions", lambda *a, **k: (calls.append(1), real(*a, **k))[1])
    ranked = spark.createDataFrame([(f"g{i}", (17.0 - i) * (i % 5 > 0)) for i in range(35)], "gene_id string, score double")
    sets = spark.createDataFrame([(f"s{k}", f"g{i}") for k in range(1, 6) for i in range(35) if i % 5 == 0 or i % (k + 1) == 0][:60], "set_name string, gene_id string")
    sets = sets.union(spark.createDataFrame([("flat", f"g{i}") for i in (0, 5, 30)], sets.schema))
    split = sorted(rows(enrich.gsea_nes(ranked, sets, 20)))
    assert len(calls) == 1
    spark.conf.set("spark.tidepair.hotGroupRows", "4000000")
    whole = sorted(rows(enrich.gsea_nes(ranked, sets, 20)))
    assert len(whole) == len(split) > 3 and "flat" in {r[0] for r in whole}
    for a, b in zip(whole, split, strict=True):
        assert all(x == pytest.approx(y, abs=1e-9) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True))


def test_signature_scores_from_signature_sums(spark):
    from tidepair.operators import pseudobulk as P

    genes = spark.createDataFrame([(1, "g1", "a"), (2, "g2", "B"), (3, "g3", "A"), (4, "g4", "c")], "gene_index int, gene_id string, gene_symbol string")
    wanted = spark.createDataFrame([("s", "A"), ("s", "B"), ("s", "A"), ("u", "B"), ("v", "none")], "signature string, symbol string")
    found = P.signature_genes(genes, wanted)
    assert sorted(rows(found)) == [("s", "g1"), ("s", "g2"), ("u", "g2")]
    made = [(f"r{k}", "t", f"p{k}", f"a{k}", f"b{k}", "x", "x") for k in range(4)]
    pairs = spark.createDataFrame(made, "replicate_id string, tumor_type string, pair_id string, source_cell string, target_cell string, source_label string, target_label string")
    expr = [(f"b{k}", g, float(k + 1) * w) for k in range(3) for g, w in (("g1", 2.0), ("g2", 1.0), ("g3", 9.0))]
    expr = P.signature_expression(spark.createDataFrame(expr, "cell_id string, gene_id string, value double"), found)
    by = ["tumor_type", "source_label", "target_label"]
    states, counts = P.pseudobulk_states(pairs, expr, by), P.scope_counts(pairs, by, P.tumor_scopes())
    assert states.count() == 3 * 2  # a row a replicate and signature, not one a gene
    out = P.signature_scores_test(P.pseudobulk_means(states, P.tumor_scopes(), counts), P.scope_sizes(counts), found)
    got = {r.signature: (r.n_genes_found, r.n_replicates, r.pseudobulk_delta) for r in out.where("scope = 'global'").collect()}
    assert got == {"s": (2, 4, pytest.approx((1.5 + 3 + 4.5) / 4)), "u": (1, 4, pytest.approx((1 + 2 + 3) / 4))}


def test_bh_of_a_large_group_is_no_single_sort(spark, monkeypatch):
    """Beyond BH_ROWS, q comes from distinct p values; rows without p stay, wherever they are dealt."""
    from tidepair.plans import ordered

    made = [(i, "ab"[i % 2] if i % 7 else None, None if i % 5 == 0 else float("nan") if i % 11 == 0 else (i * 37 % 50) / 50) for i in range(300)]
    df = spark.createDataFrame(made, "id int, k string, p double")
    whole = {keys: sorted(rows(ordered.bh_fdr(df, keys, "p", "q").select("id", "q"))) for keys in ((), ("k",))}
    monkeypatch.setattr(ordered, "BH_ROWS", 20)
    for keys, want in whole.items():
        out = ordered.bh_fdr(df, keys, "p", "q", values=df.select("k", "p"))
        assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString().split("LeftOuter")[0]
        got = sorted(rows(out.select("id", "q")))
        assert len(got) == 300 and all(a[0] == b[0] and a[1] == (b[1] and pytest.approx(b[1], abs=1e-12)) for a, b in zip(got, want, strict=True))


def test_nearest_measures_few_pairs_and_keeps_ties(monkeypatch):
    r = np.random.default_rng(3)
    p = np.concatenate([r.integers(0, 4, size=(300, 3)).astype(float), 1e6 + r.normal(size=(100, 3)), [[np.nan, 0, 0], [np.inf, 1, 1]]])
    for pts in (p, p[:400], p[:1], p[:5]):
        ids = r.permutation(len(pts)).astype("int64")
        got = list(zip(*[x.tolist() for x in neighbors._nearest(pts, ids, pts, ids, 7)], strict=True))
        want = []
        for i, x in enumerate(pts):
            with np.errstate(invalid="ignore"):
                d = ((x - pts) ** 2).sum(axis=1)
            want += [(i, b, a) for a, b in sorted((a, b) for a, b in zip(d.tolist(), ids.tolist(), strict=True) if math.isfinite(a) and b != ids[i])[:7]]
        assert got == want
    seen, real = [], np.lexsort
    monkeypatch.setattr(neighbors.np, "lexsort", lambda keys, **a: (seen.append(np.size(keys[0])), real(keys, **a))[1])
    wide = r.normal(size=(2000, 8))
    neighbors._nearest(wide, np.arange(2000), wide, np.arange(2000), 10)
    assert sum(seen) < 2000 * 20


def test_sparse_sums_equal_states(spark):
    """Sums by numbered combinations equal those of states: repeated cells, null labels, small cell types left out, no row lost."""
    from pyspark.sql import functions as F

    from tidepair.operators import pseudobulk as P

    rows = [(f"r{i % 3}", f"t{i % 2}", i, f"c{i % 7}", f"c{i % 5}", ["a", "b", None][i % 3], ["b", "a"][i % 2]) for i in range(40)]
    pairs = spark.createDataFrame(rows, "replicate_id string, tumor_type string, pair_id long, source_cell string, target_cell string, source_label string, target_label string")
    expr = spark.createDataFrame([(f"c{i % 7}", f"g{i % 4}", float(i % 3)) for i in range(28)], "cell_id string, gene_id string, value double")
    by, scopes, least = ["tumor_type", "source_label", "target_label"], P.tumor_scopes(), 10
    counts = P.scope_counts(pairs, by, scopes, least)
    want = P.pseudobulk_means(P.pseudobulk_states(pairs, expr, by), scopes, counts)
    combos, _ = P.coded(pairs.groupBy("replicate_id", *by).agg(F.count(F.lit(1)).alias("_n")), "_combo")
    numbered, _ = P.coded(P.combo_counts(combos, scopes, least), "_g")
    groups = P.combo_groups(combos, scopes, numbered.drop("n_pairs"))
    for few in (True, False):
        sums = P.sparse_sums(pairs, expr, combos, by, groups, few).join(numbered, "_g").drop("_g")
        got = P.with_means(sums).select(want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 20
    plan = P.sparse_sums(pairs, expr, combos, by, groups, True)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x]
    assert not any("replicate_id" in x.split("hashpartitioning(")[1].split(")")[0] for x in dealt)
