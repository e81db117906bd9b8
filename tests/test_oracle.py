"""Registered queries against their DuckDB reference SQL on the smallest
scale (the driver runs the full set at sf0.01)."""

import pytest

from lakejoin.plans.compare import compare, duck
from lakejoin.plans.registry import QUERIES, SQL

from lake_paths import SF001

FAST = ["column_profile", "value_sample_budget", "column_text_default", "column_embeddings_hash",
        "column_links_topk", "table_search_columns", "metrics_at_k", "overall_metrics", "metrics_multi_k",
        "joinability_ratio", "table_search_rows_text", "row_search_no_token", "key_columns_a", "merge_tables_lake_wins", "load_tables_json", "load_truth_map", "key_rows",
        "truth_to_pairs", "shuffle_augment", "multi_key_samples", "key_loss", "centroid_loss", "sq_distance_stats"]


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", FAST)
def test_matches_reference_sql(spark, con, name):
    r = compare(spark, name, SF001, con)
    assert r["match"], r


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
    missing = sorted(set(QUERIES) - set(SQL))
    # only iterative / model-fitting queries go without SQL
    assert missing == ["affinity_clusters", "cluster_sizes", "fit_pairs"], missing
