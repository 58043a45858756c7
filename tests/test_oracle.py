"""Spark results equal the independent DuckDB SQL (value hash) for the SQL-expressible queries."""

import pytest

from conftest import SF_SMALL

FAST = [
    "recommend_canned_delivery", "recommend_empty", "recommend_zero_budget", "null_counts_listings", "duplicate_rows_documents",
    "corrupt_counts_documents", "zero_only_groups_cost", "box_stats_currency", "impute_zero_level2", "cost_relative_to_city",
    "city_cost_quartile", "row_features", "prepare_listings", "import_listings", "cluster_counts", "label_frequency",
    "filter_rare_labels", "tfidf_weights", "split_listings", "threshold_sweep", "multilabel_metrics_by_split", "per_label_metrics",
    "regression_metrics_by_split", "cumulative_importance", "upsert_listings", "load_listing_frame", "append_users",
    "preferences_log", "history_log", "prediction_sample", "upsert_repeated_ids", "cuisine_bridge_replace", "cuisine_bridge_accumulate",
    "type_dimension_upsert", "target_statistics", "median_std_fit", "one_hot_long", "fold_summary", "select_best_candidate",
]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, name):
    import __spark_entry__ as E
    import oracle_check as oc

    con = oc.duck(SF_SMALL)
    df = E.queries()[name](spark, SF_SMALL)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    rel = con.sql(E.oracle_sql()[name])
    h1, _ = oc.digest(cols, rows)
    h2, _ = oc.digest(rel.columns, rel.fetchall())
    assert sorted(cols) == sorted(rel.columns)
    assert h1 == h2


def test_every_query_has_oracle_or_is_model_flow():
    from tavola.plans import catalog, oracle

    missing = set(catalog.queries()) - set(oracle.oracle_sql())
    assert missing <= {
        "geo_clusters", "train_rating_base", "train_rating_engineered", "train_rating_without_votes", "train_rating_onehot",
        "rating_feature_importance", "rating_cv_best", "train_labels_logistic", "train_labels_mlp", "label_threshold_tuning", "label_top_features", "label_cv_best",
    }, missing
    assert set(oracle.oracle_sql()) <= set(catalog.queries())


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() >= 0 and "score" in df.columns


def test_all_oracle_sql_runs_in_duckdb():
    import __spark_entry__ as E
    import oracle_check as oc

    con = oc.duck(SF_SMALL)
    for name, sql in E.oracle_sql().items():
        con.sql(sql).fetchall()
