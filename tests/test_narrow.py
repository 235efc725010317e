"""Steps that stay narrow: what is written and ranked on the way to a result."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepair.operators import edges as E
from tidepair.operators import enrich, neighbors, splits
from tidepair.operators import pseudobulk as P
from tidepair.operators import stats as S
from tidepair.plans.ordered import bh_counts, bh_fdr


def test_spearman_ranks_distinct_values(spark, monkeypatch):
    """Ranks come from the distinct values: 3 and 2 rows, whatever the number of rows."""
    seen, real = [], S.running
    monkeypatch.setattr(S, "running", lambda df, *a, **k: seen.append(df.count()) or real(df, *a, **k))
    rows = [("g", 1.0, 5.0), ("g", 2.0, 5.0), ("g", 2.0, 7.0), ("g", 3.0, 7.0), ("g", None, 1.0)] * 20
    got = S.spearman(spark.createDataFrame(rows, "k string, a double, b double"), ["k"], "a", "b").collect()
    assert seen == [3, 2]
    assert got[0].n == 80 and got[0].rho == pytest.approx(0.5 ** 0.5, abs=1e-12)


def test_scored_edges_are_written_narrow(spark, monkeypatch):
    """Tables of edges on the way hold what was read, not the metrics of their cells."""
    seen = []
    for name in ("cut", "cut_counted"):
        monkeypatch.setattr(E, name, lambda df, real=getattr(E, name): seen.append(df.columns) or real(df))
    rows = [("f", i, f"S{i % 3}", f"T{i % 4}", 0.1 * i) for i in range(12)]
    edges = spark.createDataFrame(rows, "grp string, ord long, source_cell string, target_cell string, probability double")
    sizes = spark.createDataFrame([("f", 3, 4)], "grp string, n_source long, n_target long")
    assert E.score_edges(edges, sizes).count() == 12
    assert max(len(c) for c in seen if "probability" in c) == 5


def _sparse_case(spark):
    """Pairs with repeated cells, null labels and small cell types; expression with a missing gene name and missing values."""
    rows = [(f"r{i % 3}", f"t{i % 2}", i, f"c{i % 7}", f"c{i % 5}", ["a", "b", None][i % 3], ["b", "a"][i % 2]) for i in range(40)]
    pairs = spark.createDataFrame(rows, "replicate_id string, tumor_type string, pair_id long, source_cell string, target_cell string, source_label string, target_label string")
    expr = [(f"c{i % 7}", f"g{i % 4}", float(i % 3)) for i in range(28)] + [("c1", None, 2.0), ("c6", "g8", None), ("c2", "g9", 1.5)]
    return pairs, spark.createDataFrame(expr, "cell_id string, gene_id string, value double")


@pytest.mark.parametrize("size", [1, 7, 50_000])
def test_sparse_states_equal_gene_states(spark, monkeypatch, size):
    """States added up batch by batch equal those from all sums per replicate and gene, wherever batches end."""
    monkeypatch.setattr(P, "STATE_ROWS", size)
    pairs, expr = _sparse_case(spark)
    by, scopes, least = ["tumor_type", "source_label", "target_label"], P.tumor_scopes(), 10
    counts = P.scope_counts(pairs, by, scopes, least)
    sizes, _ = P.coded(P.scope_sizes(counts), "_scope")
    bulk = P.pseudobulk_means(P.pseudobulk_states(pairs, expr.na.fill(0.0, ["value"]), by), scopes, counts)
    combos, _ = P.coded(pairs.groupBy("replicate_id", *by).agg(F.count(F.lit(1)).alias("_n")), "_combo")
    numbered, _ = P.coded(P.combo_counts(combos, scopes, least), "_g")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        states = P.sparse_states(pairs, expr, combos, by, P.scope_groups(combos, scopes, numbered, sizes))
        got = P.with_t_test(P.with_summary(states.join(sizes, "_scope"))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = P.with_t_test(P.with_summary(P.gene_states(bulk, sizes.drop("_scope")))).collect()
    key = lambda r: (r.scope, str(r.scope_key), str(r.gene_id))
    got, want = {key(r): r for r in got}, {key(r): r for r in want}
    assert got.keys() == want.keys() and len(got) > 20
    for k, w in want.items():
        for c in ("n_pairs", "n_replicates", "source_mean", "target_mean", "source_pct", "target_pct", "pseudobulk_source_mean", "pseudobulk_target_mean", "t_stat", "p_value"):
            if k[2] != "g8" or c not in ("source_mean", "target_mean"):
                same = got[k][c] is None if w[c] is None else got[k][c] == pytest.approx(w[c], rel=1e-9, abs=1e-12)
                assert same, (k, c, got[k][c], w[c])
    lost = [r for r in got.values() if r.gene_id == "g8"]
    assert lost and all(r.source_mean in (0.0, None) and r.target_mean in (0.0, None) for r in lost)


def _tested(spark):
    """Genes of scopes with many, few and no significant ones, tied and missing p values, and no p at all."""
    p = {1: [0.001 * (i % 6) if i < 9 else 0.3 + 0.01 * (i % 50) for i in range(90)], 2: [0.5 + 0.1 * (i % 3) for i in range(40)],
         3: [None] * 8, 4: [0.2, None, float("nan"), 0.9], 5: [0.0] * 30 + [None] * 5, 6: [0.01, 0.9, None]}
    rows = [(s, f"g{i}", float((i * 7) % 11), v) for s, vs in p.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "_scope long, gene_id string, abs_mean_delta double, p_value double")


@pytest.mark.parametrize("limit", [None, 3])
def test_leading_genes_and_counts_equal_full_q(spark, limit):
    """First genes and significant counts without the q of every gene equal those with it; small and hot groups."""
    if limit:
        spark.conf.set("spark.tidepair.hotGroupRows", str(limit))
    try:
        tested, keys = _tested(spark), ["_scope"]
        full = P.with_flags(bh_fdr(tested, keys, "p_value", "fdr"))
        pick = lambda df, rank: sorted((r["_scope"], r[rank], r["gene_id"]) for r in df.collect())
        for n in (5, 100):
            assert pick(P.top_genes(P.leading(tested, keys, n), keys, n), "gene_rank") == pick(P.top_genes(full, keys, n), "gene_rank")
            want = P.screen_top_genes(P.all_genes_ranked(full, keys), keys, n)
            assert pick(P.screen_of_tested(tested, keys, n), "screen_rank") == pick(want, "screen_rank")
        got = bh_counts(tested, keys, "p_value", {"a": 0.05, "b": 0.10}).collect()
        want = full.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("significant_05").alias("a"), F.count_if("significant_10").alias("b")).collect()
        assert sorted((r["_scope"], r.n_rows, r.a, r.b) for r in got) == sorted((r["_scope"], r.n_rows, r.a, r.b) for r in want)
        assert any(r.a for r in got)
    finally:
        spark.conf.unset("spark.tidepair.hotGroupRows")


def test_leading_rows_are_few(spark):
    """Only rows up to the block of the n-th q go on to be ranked; the last p of a key of 1,000 is not."""
    rows = spark.range(1000).select(F.lit(1).alias("_scope"), F.col("id").cast("string").alias("gene_id"),
                                    F.lit(0.0).alias("abs_mean_delta"), ((F.col("id") / 1000) ** 3).alias("p_value"))
    assert 10 <= P.leading(rows, ["_scope"], 10).count() < 30


@pytest.mark.parametrize("n_keys", [0, 1])
def test_points_near_many_regions_are_written_once(hot, monkeypatch, n_keys):
    """In many dimensions every region is near: points are asked in place, not written per region; ties, copies and infinities included."""
    rng = np.random.default_rng(n_keys)
    x = np.concatenate([rng.normal(0, 1, (130, 24)), np.full((6, 24), 0.25), rng.normal(0, 1, (64, 24)).round(), np.full((1, 24), np.inf)])
    x[140] = x[3]
    df = hot.createDataFrame([("ab"[i % 2], i, [float(v) for v in p]) for i, p in enumerate(x)], "s string, id long, v array<double>")
    seen, real = [], neighbors.cut
    monkeypatch.setattr(neighbors, "cut", lambda rows, **k: seen.append(real(rows, **k)) or seen[-1])
    monkeypatch.setattr(neighbors, "ASK_ROWS", 50)
    got = {(r.id, r["rank"]): (r.neighbor, r.dist2) for r in neighbors.knn_join(df, ["s"][:n_keys], "id", "v", 5).collect()}
    assert max(t.count() for t in seen if "_v" in t.columns) <= 2 * len(x)
    for i in range(len(x) - 1):
        mates = [j for j in range(len(x) - 1) if j != i and (not n_keys or i % 2 == j % 2)]
        want = sorted((((x[i] - x[j]) ** 2).sum(), j) for j in mates)[:5]
        assert [got[i, r + 1][0] for r in range(5)] == [j for _, j in want]
        assert [got[i, r + 1][1] for r in range(5)] == pytest.approx([d for d, _ in want], abs=1e-12)
    assert len(got) == 5 * (len(x) - 1)


def test_panel_coverage_reads_its_rows_once(spark):
    """All figures come from one pass over the measured rows; a row without a gene counts as a gene that no dataset measures."""
    rows = [(f"d{i % 7}", f"g{i % 11}") for i in range(60)] * 2 + [("d1", None), ("d2", "h"), ("d8", "g1")]
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda d: read.add(1) or d, "string")
    df = spark.createDataFrame(rows, "dataset_id string, gene_id string").withColumn("dataset_id", seen("dataset_id"))
    got = {r.q: r for r in splits.gene_panel_by_coverage(df, (0.2, 0.7)).collect()}
    assert read.value == len(rows)
    pairs = set(rows)
    n, many = len({d for d, _ in pairs}), Counter(g for _, g in pairs)
    for q in (0.2, 0.7):
        panel = {g for g, m in many.items() if m >= q * n}
        share = sorted(k / len(panel) for k in Counter(d for d, g in pairs if g in panel and g is not None).values())
        assert got[q].n_genes == len(panel)
        assert [got[q].density_min, got[q].density_max, got[q].density_median] == pytest.approx([share[0], share[-1], np.median(share)], abs=1e-12)
    assert set(got) == {0.2, 0.7}


def test_gsea_null_keeps_the_first_genes_of_each_order(spark):
    """Few genes of each order are kept, and scores are those of its first genes, counted here one by one."""
    n, sizes = 3000, [1, 40, 90]
    weight = [round(((i * 7919) % n) / 97, 3) for i in range(n)]
    pos = spark.createDataFrame([(f"G{i}", weight[i], i) for i in range(n)], "gene_id string, score double, pos long").cache()
    null = enrich._null_in_place(pos, n, sizes, 12, 4)
    got = sorted((r.n_hit, round(r["_null"], 9)) for r in null.collect())
    want = []
    for perm in range(1, 13):
        order = sorted(range(n), key=lambda i: hashlib.md5(f"4:{perm}:G{i}".encode()).hexdigest())
        for size in sizes:
            hit, total, run, high, low = set(order[:size]), sum(weight[i] for i in order[:size]), 0.0, 0.0, 0.0
            for i in range(n):
                run += weight[i] / total if i in hit else -1 / (n - size)
                high, low = max(high, run), min(low, run)
            want.append((size, round(high if round(high, 12) >= round(-low, 12) else low, 9)))
    assert [s for s, _ in got] == sorted(s for s, _ in want)
    assert [e for _, e in got] == pytest.approx([e for _, e in sorted(want)], abs=2e-9)
    pos.unpersist()


def test_gsea_query_takes_a_thousand_permutations(spark):
    import __spark_entry__ as entry

    p = [r.p_value * 1001 for r in entry.queries()["gsea_nes"](spark, "/root/testdata/sf0.001").collect()]
    assert all(x == pytest.approx(round(x), abs=1e-5) for x in p) and any(round(x) % 77 for x in p)  # 1001 = 13 * 77
    assert "range(1, 1001)" in entry.oracle_sql()["gsea_nes"]
