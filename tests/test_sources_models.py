"""CSV contract, sinks and model persistence."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tavola.operators import warehouse
from tavola.sources import files


def test_csv_null_tokens_and_contract(spark):
    d = tempfile.mkdtemp(prefix="tavola-csv-", dir="/tmp")
    p = os.path.join(d, "in.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write(' Listing ID ,Votes,Name,Note\n1,10,"a, b","multi\nline"\n2,NA,N/A,null\n3,x,c,\n')
    df = files.read_listings(spark, p, types={"Listing ID": "long", "Votes": "double"}, aliases={"Name": "listing_name"})
    rows = sorted(df.collect(), key=lambda r: r["Listing ID"])
    assert df.columns[:3] == ["Listing ID", "Votes", "listing_name"]
    assert rows[0]["Note"] == "multi\nline" and rows[0]["listing_name"] == "a, b"
    assert rows[1]["Votes"] is None and rows[1]["listing_name"] is None and rows[1]["Note"] is None
    assert rows[2]["Votes"] is None  # unparsable -> null
    assert "log_votes" not in df.columns  # only derived when "votes" exists
    with pytest.raises(ValueError):
        warehouse.require(df, ["listing_id"])


def test_defaults_and_import(spark):
    df = spark.createDataFrame([(1, "n", "A, B", None)], "listing_id long, listing_name string, cuisines string, votes long")
    out = warehouse.with_defaults(df)
    assert out.first()["location_cluster"] == -1 and out.first()["city_location_cluster"] == "Unknown"


def test_write_results(spark):
    d = tempfile.mkdtemp(prefix="tavola-out-", dir="/tmp")
    files.write_results({"t": spark.range(3).withColumn("x", F.col("id") * 1.5)}, d)
    assert any(n.endswith(".csv") for n in os.listdir(os.path.join(d, "t")))


def test_rating_model_roundtrip(spark):
    from tavola.plans import rating
    from tavola.plans.catalog import prepared_listings

    from conftest import SF_SMALL

    prepared = warehouse.with_defaults(prepared_listings(spark, SF_SMALL))
    model, metrics = rating.train_and_evaluate(prepared, "without_votes", max_iter=3)
    assert {r.split for r in metrics.collect()} == {"train", "val", "test"}
    d = tempfile.mkdtemp(prefix="tavola-model-", dir="/tmp")
    rating.save_model(model, d + "/m")
    again = rating.load_model(d + "/m")
    data = rating.prepare_features(prepared, "without_votes")
    a = rating.predict(model, data).select("_row_id", "prediction")
    b = rating.predict(again, data).select("_row_id", F.col("prediction").alias("p2"))
    assert a.join(b, "_row_id").filter(F.abs(F.col("prediction") - F.col("p2")) > 1e-12).count() == 0
    rows = lambda m: sorted((r.feature, round(r.importance, 9)) for r in rating.feature_importance(m).collect())
    assert rows(again) == rows(model)


def test_rating_encoders_see_training_rows_only(spark):
    from tavola.operators import split
    from tavola.plans import rating
    from tavola.plans.catalog import prepared_listings

    from conftest import SF_CHECK

    data = split.assign_split(rating.prepare_features(warehouse.with_defaults(prepared_listings(spark, SF_CHECK)), "base"), "_row_id")
    train = data.filter("split = 'train'")
    encoded, stages = rating._encode(train, "base", 42)
    assert encoded.count() == train.count()
    totals = stages[1].stats if hasattr(stages[1], "stats") else None
    if totals is not None:
        assert all(max(v[0] for v in per.values()) <= train.count() for per in totals)
    # The view's ratings are nearly noise: what a split shows is that training
    # rows fit no better than unseen ones by more than noise allows.
    model, metrics = rating.train_and_evaluate(warehouse.with_defaults(prepared_listings(spark, SF_CHECK)), "base", max_iter=25, params={"stepSize": 0.2, "maxDepth": 4})
    by = {r.split: r.r2 for r in metrics.collect()}
    assert by["val"] > by["train"] - 0.35 and by["test"] > by["train"] - 0.35, by


def test_rating_fit_lets_go_of_its_rows(spark):
    from tavola.plans import rating
    from tavola.plans.catalog import prepared_listings

    from conftest import SF_SMALL

    data = rating.prepare_features(warehouse.with_defaults(prepared_listings(spark, SF_SMALL)), "without_votes")
    kept = lambda: set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    before = kept()
    rating.fit(data, "without_votes", {"early_stop": False}, max_iter=1)
    assert kept() <= before


def test_rating_fit_reads_no_part_for_every_fold(spark, monkeypatch):
    from tavola.plans import rating
    from tavola.plans.catalog import prepared_listings

    from conftest import SF_SMALL

    data = rating.prepare_features(warehouse.with_defaults(prepared_listings(spark, SF_SMALL)), "without_votes").repartition(12, "_row_id")
    seen, fit = [], rating.GBTRegressor.fit
    monkeypatch.setattr(rating.GBTRegressor, "fit", lambda self, rows: seen.append((rows.rdd.getNumPartitions(), rows.count())) or fit(self, rows))
    rating.fit(data, "without_votes", {"early_stop": False}, max_iter=1)
    assert seen[0][0] <= max(12, spark.sparkContext.defaultParallelism) and seen[0][1] == data.count()


def rated(spark, n=90):
    """Prepared listings whose rating follows their cost, with some noise."""
    from tavola.plans import rating

    cats = set(rating._CATS)
    rows = [(i, round((i * 37 % 50) / 10 + (i * 7919 % 11) / 10, 2), *(f"v{(i + j) % 3}" if c in cats else float(i * 37 % 50 if c == "cost_for_two" else i * (j + 3) % 17) for j, c in enumerate(rating._BASE))) for i in range(n)]
    schema = "listing_id long, aggregate_rating double, " + ", ".join(f"{c} {'string' if c in cats else 'double'}" for c in rating._BASE)
    return spark.createDataFrame(rows, schema).repartition(2).persist()


def test_best_round_waits_before_it_ends():
    from tavola.plans.rating import best_round

    assert best_round([3.0, 3.1, 2.9, 3.0, 3.0], 3) == (3, False)
    assert best_round([3.0, 3.1, 2.9, 3.0, 3.0, 3.0, 1.0], 3) == (3, True)
    assert best_round([3.0, 4.0, 4.0, 2.0], 2) == (1, True) and best_round([3.0, 4.0, 4.0, 2.0], 3) == (4, False)


def test_rating_fit_goes_on_after_a_round_that_does_not_help(spark, monkeypatch):
    from tavola.operators import split
    from tavola.plans import rating

    monkeypatch.setattr(rating, "PATIENCE", 6)
    monkeypatch.setattr(rating, "FIRST_ROUNDS", 1)
    seen, boosted = [], rating._boosted
    monkeypatch.setattr(rating, "_boosted", lambda rows, params, rounds, seed: seen.append((rounds, boosted(rows, params, rounds, seed))) or seen[-1][1])
    data = split.assign_split(rating.prepare_features(rated(spark), "base"), "_row_id")
    train, val = data.filter("split = 'train'"), data.filter("split = 'val'")
    model = rating.fit(train, "base", {"maxDepth": 3}, 40, val=val)
    rounds, whole = seen[-1]
    assert seen[0][0] == 7 and all(b == min(40, 2 * a) for (a, _), (b, _) in zip(seen, seen[1:]))
    held = rating._held_vectors(model.pipeline.stages[:-1], model.medians, val)
    errors, kept = whole.evaluateEachIteration(held, "squared"), model.pipeline.stages[-1]
    best, ended = rating.best_round(errors, 6)
    assert kept.getNumTrees == best and kept.treeWeights == whole.treeWeights[:best] and (ended or rounds == 40)
    assert abs(kept.evaluateEachIteration(held, "squared")[-1] - errors[best - 1]) < 1e-12
    d = tempfile.mkdtemp(prefix="tavola-model-", dir="/tmp")
    rating.save_model(model, d + "/m")
    again = rating.load_model(d + "/m")
    both = rating.predict(model, val).join(rating.predict(again, val).select("_row_id", F.col("prediction").alias("p2")), "_row_id")
    assert both.filter("abs(prediction - p2) > 1e-12").count() == 0 and rating.feature_importance(again).count() > 0


def test_rating_candidates_share_a_folds_rows(spark):
    from tavola.operators import evaluate, split
    from tavola.plans import rating

    prepared = rated(spark)
    folds, summary = rating.cross_validate(prepared, "base", [rating.BASE_CANDIDATE, {"maxDepth": 2, "subsamplingRate": 0.8}], k=2, max_iter=3)
    got = {(r.candidate, r.fold): r for r in folds.collect()}
    assert sorted(got) == [(1, 0), (1, 1), (2, 0), (2, 1)] and summary.count() == 2
    data = split.assign_fold(split.assign_split(rating.prepare_features(prepared, "base"), "_row_id").filter("split = 'train'"), "_row_id", 2)
    one = rating.fit(data.filter("fold <> 1"), "base", {"early_stop": False}, 3)
    want = evaluate.regression_metrics(rating.predict(one, data.filter("fold = 1")), rating.TARGET, "prediction").first()
    assert abs(got[1, 1].rmse - want.rmse) < 1e-9 and abs(got[1, 1].mae - want.mae) < 1e-9


def test_rating_queries_run_their_full_budgets(spark, monkeypatch):
    from tavola.plans import catalog, rating

    seen = []
    monkeypatch.setattr(catalog, "prepared_listings", lambda *a, **k: None)
    monkeypatch.setattr(rating, "train_and_evaluate", lambda prepared, variant, max_iter=None: seen.append((variant, max_iter)) or (None, None))
    monkeypatch.setattr(rating, "feature_importance", lambda model: None)
    monkeypatch.setattr(catalog.IM, "cumulative_importance", lambda imp: None)
    queries = catalog.queries()
    for name in ("rating_feature_importance", "train_rating_base", "train_rating_engineered", "train_rating_without_votes"):
        queries[name](spark, "nowhere")
    assert [v for v, _ in seen] == ["onehot", "base", "engineered", "without_votes"]
    assert all(rounds in (None, rating.ITERATIONS[v]) for v, rounds in seen)


def test_rating_cv_query_runs_the_whole_grid_to_the_full_budget(spark, monkeypatch):
    import math

    from tavola.operators import split
    from tavola.plans import catalog, rating

    seen = {}
    monkeypatch.setattr(catalog, "prepared_listings", lambda *a, **k: None)
    monkeypatch.setattr(rating, "cross_validate", lambda prepared, variant, candidates, **how: seen.update(how, candidates=candidates) or (None, None))
    monkeypatch.setattr(split, "select_best", lambda summary, order: "best")
    assert catalog.queries()["rating_cv_best"](spark, "nowhere") == "best"
    points = {tuple(sorted(c.items())) for c in seen["candidates"]}
    assert len(points) == len(seen["candidates"]) == math.prod(len(v) for v in rating.TUNING_GRID["base"].values())
    assert seen.get("max_iter") in (None, rating.CV_ITERATIONS) and seen["k"] == 3


def test_out_of_fold_statistics_leave_the_own_fold_out(spark):
    from tavola.operators import mlfeatures

    rows = [("a", 0, 1.0), ("a", 0, 2.0), ("a", 1, 6.0), ("b", 1, 4.0)]
    got = {(r.c, r.f): round(r.c_ts, 6) for r in mlfeatures.target_statistics(spark.createDataFrame(rows, "c string, f int, y double"), "c", "y", "f", 3.0).collect()}
    assert got == {("a", 0): 4.5, ("a", 1): 2.0, ("b", 1): 3.0}
    fitted = mlfeatures.fit_median_std(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double"), ["x"])
    assert fitted["x"][0] == 2.5


def test_write_prepared_partitioned(spark):
    d = tempfile.mkdtemp(prefix="tavola-prep-", dir="/tmp")
    df = spark.createDataFrame([(1, 1, "a"), (2, 216, "b")], "listing_id long, country_code int, city string")
    files.write_prepared(df, d + "/p")
    back = spark.read.parquet(d + "/p")
    assert sorted(r.listing_id for r in back.filter("country_code = 216").collect()) == [2]
    assert any(n.startswith("country_code=") for n in os.listdir(d + "/p"))


def test_label_model_roundtrip(spark):
    from tavola.plans import labels as LP
    from tavola.plans.catalog import prepared_listings

    from conftest import SF_SMALL

    prepared = warehouse.with_defaults(prepared_listings(spark, SF_SMALL))
    model, out = LP.train_and_evaluate(prepared, "logistic", min_count=5, max_features=200, max_iter=5)
    preds = out["predictions"]
    # threshold fallback: every row predicts at least one label
    assert preds.groupBy("row_id").agg(F.sum("pred").alias("k")).filter("k = 0").count() == 0
    d = tempfile.mkdtemp(prefix="tavola-lmodel-", dir="/tmp")
    LP.save_model(model, d + "/m")
    again = LP.load_model(spark, d + "/m")
    data, _, _ = LP.build_dataset(prepared, 5)
    a = LP.predict_proba(model.models, LP.featurize(model, data)).select("row_id", "label_idx", "prob")
    b = LP.predict_proba(again.models, LP.featurize(again, data)).select("row_id", "label_idx", F.col("prob").alias("p2"))
    assert a.join(b, ["row_id", "label_idx"]).filter(F.abs(F.col("prob") - F.col("p2")) > 1e-9).count() == 0


def test_category_featurizer_uses_bigrams(spark):
    from tavola.plans import labels as LP
    from tavola.plans.catalog import prepared_listings

    from conftest import SF_SMALL

    prepared = warehouse.with_defaults(prepared_listings(spark, SF_SMALL))
    data, _, _ = LP.build_dataset(prepared, 5)
    fz, scaler, names = LP.fit_featurizer(data.filter("split = 'train'"), 200, 1, 2)
    bigram_slots = {i for i, n in enumerate(names) if n.startswith("name__") and " " in n}
    assert bigram_slots
    vecs = [r.features for r in LP.featurize(None, data, fz, scaler).collect()]
    assert any(set(v.indices.tolist()) & bigram_slots for v in vecs)
