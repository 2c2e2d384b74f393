"""Queries against their SQL on the same tables."""

import pytest
from helpers import DATA, same_rows

NAMES = [
    "exact_topk_docs", "exact_topk_cust", "padded_topk_cust", "row_norms", "max_normalised", "global_max_normalised", "norm_range_partition", "idf_weights", "idf_full_universe", "fixed_layout", "sketch_slots",
    "fixed_sketch_sizes", "minhash_signatures_arrow", "doc_signatures", "overlap_estimates", "kmeans_centroids", "centroid_shift", "boundary_spill", "cluster_params", "active_dims", "route_clusters", "clustered_candidates",
    "clustered_topk", "clustered_topk_nodedup", "baseline_topk", "inverted_overlap_topk", "minhash_first_200", "banded_topk", "recall_at_k", "satisfied_at_c", "spearman_proxy", "select_max_qps", "select_nearest",
    "parameter_roles", "paper_table", "monotonic_check", "space_decomposition", "dense_distances", "bit_distances", "csr_roundtrip",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, duck, name):
    from lodestone.plans.registry import ORACLES, QUERIES

    assert same_rows(QUERIES[name](spark, DATA), duck.sql(ORACLES[name])) > 0


def test_every_query_has_sql():
    from lodestone.plans.registry import ORACLES, QUERIES

    assert set(QUERIES) == set(ORACLES)
