"""Registered queries against their SQL twins on the small tables.

TIDEPAIR_ALL=1 compares every query; by default one set per operator family runs.
"""

import os

import pytest

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"
FAST = """row_normalize rank_in_source top12 percentile_rank pair_selection edge_confidence_select pairing_noise training_weight
threshold_local min_confidence_then_top clean to_number gene_label response_class log1p_10k bin_n cpm stable_fold_sha fold_split
technology_filter drop_unseen_categories gene_panel_by_coverage subsample_cells select_primary_profile probability_sampling
make_batches is_count_like pseudobulk_means de_table transition_enrichment metric_overlap_summary bh_fdr derive_pfs derive_response
zscore_within median_stratification auroc auprc bootstrap_ci spearman mann_whitney endpoint_metrics baseline_mean_delta
grouped_stratified_folds knn_join rbf_mmd masked_reconstruction morans_i gene_table matched_controls neighbor_spearman
best_epoch vs_floor composite_rank gsea_nes ora choose_terms gather_pair_expression resolve_cell_id semi_join_or resolve_gene
pair_star_join scan_pair_files read_clinical_json write_pair_shards""".split()
NAMES = list(entry.queries()) if os.environ.get("TIDEPAIR_ALL") else FAST


@pytest.fixture(scope="module")
def con():
    return check.oracle_session(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, con, name):
    assert check.compare(spark, con, FOLDER, name) is None


HOT = """rank_in_source percentile_rank threshold_local bh_fdr auroc auprc spearman mann_whitney median_stratification subsample_cells
probability_sampling make_batches gsea_es neighbor_lookup knn_join""".split()


@pytest.mark.parametrize("name", HOT)
def test_hot_groups_give_the_same_rows(spark, con, name):
    spark.conf.set("spark.tidepair.hotGroupRows", "60")
    spark.conf.set("spark.tidepair.knnLeafRows", "15")
    try:
        assert check.compare(spark, con, FOLDER, name) is None
    finally:
        spark.conf.unset("spark.tidepair.hotGroupRows")
        spark.conf.unset("spark.tidepair.knnLeafRows")


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 200
