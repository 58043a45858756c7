"""The shared solvers against plain NumPy and Spark's own per-label fits."""

import numpy as np
from conftest import SF_SMALL
from pyspark.sql import functions as F

from tavola.operators import assemble
from tavola.plans import labels as LP
from tavola.plans import solvers


def sample(n=400, slots=12, k=4, seed=3):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, slots)) < 0.3, rng.normal(size=(n, slots)), 0)
    y = (x @ rng.normal(size=(slots, k)) + rng.normal(size=(n, k)) > 0.4).astype(int)
    y[:, -1] = 0  # a label that no row has
    return x, y


def frame(spark, x, y, held=None):
    rows = [([int(s) for s in np.flatnonzero(r)], [float(v) for v in r[r != 0]], [int(j) for j in np.flatnonzero(t)], bool(held[i]) if held is not None else False) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "slots array<int>, values array<double>, label_set array<int>, held_out boolean").repartition(5).persist()


def test_logistic_equals_the_per_label_fits(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    x, y = sample()
    n = len(x)
    model = solvers.fit_logistic(frame(spark, x, y), n, y.sum(0).tolist(), x.shape[1], c=2.0)
    assert model.constant == {3: 0.0}
    for j in range(3):
        pos = int(y[:, j].sum())
        rows = [(x[i].tolist(), float(y[i, j]), n / (2.0 * pos) if y[i, j] else n / (2.0 * (n - pos))) for i in range(n)]
        df = spark.createDataFrame(rows, "x array<double>, y double, w double").select(array_to_vector("x").alias("features"), "y", "w")
        own = LogisticRegression(labelCol="y", weightCol="w", regParam=1.0 / (2.0 * n), standardization=False, maxIter=2000, tol=1e-12).fit(df)
        assert np.abs(model.weights[j] - np.append(own.coefficients.toArray(), own.intercept)).max() < 1e-4
    probs = solvers.predicted(model, frame(spark, x, y), x.shape[1], 4).collect()
    assert all(r.probs[3] == 0.0 for r in probs) and len(probs) == n


def test_passes_do_not_grow_with_the_labels(spark):
    x, y = sample()
    one = solvers.fit_logistic(frame(spark, x, y[:, :1]), len(x), y[:, :1].sum(0).tolist(), x.shape[1])
    wide = np.repeat(y[:, :1], 30, axis=1)
    many = solvers.fit_logistic(frame(spark, x, wide), len(x), wide.sum(0).tolist(), x.shape[1])
    assert many.passes == one.passes and np.abs(many.weights - one.weights[0]).max() < 1e-9


def plain_network(x, y, held, hidden, rounds, seed, alpha=1e-4, rate=0.01):
    """Whole-table Adam with dense matrices; the losses of every round."""
    layers = [[w.copy(), b.copy()] for w, b in solvers.initial_network([x.shape[1], *hidden, y.shape[1]], seed).layers]
    moments = [[[np.zeros_like(p), np.zeros_like(p)] for p in layer] for layer in layers]
    train, n, losses = ~held, int((~held).sum()), []
    for t in range(1, rounds + 1):
        acts = [x]
        for i, (w, b) in enumerate(layers):
            z = acts[-1] @ w + b
            acts.append(np.maximum(z, 0) if i < len(layers) - 1 else z)
        p = 1 / (1 + np.exp(-acts[-1]))
        loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum(1)
        losses.append((loss[train].sum() / n + 0.5 * alpha * sum((w**2).sum() for w, _ in layers) / n, loss[held].mean()))
        delta = (p - y) * train[:, None]
        grads = []
        for i in range(len(layers) - 1, -1, -1):
            grads.append(((acts[i].T @ delta + alpha * layers[i][0]) / n, delta.sum(0) / n))
            delta = (delta @ layers[i][0].T) * (acts[i] > 0)
        for layer, moment, gs in zip(layers, moments, grads[::-1]):
            for q, g in enumerate(gs):
                moment[q][0] = 0.9 * moment[q][0] + 0.1 * g
                moment[q][1] = 0.999 * moment[q][1] + 0.001 * g * g
                layer[q] -= rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * moment[q][0] / (np.sqrt(moment[q][1]) + 1e-8)
    return losses


def test_network_equals_numpy_round_by_round(spark):
    x, y = sample()
    held = np.arange(len(x)) % 8 == 0
    for hidden in ((16,), (12, 6)):
        model = solvers.fit_network(frame(spark, x, y, held), len(x), int(held.sum()), 4, x.shape[1], hidden, max_rounds=8, seed=5)
        want = plain_network(x, y, held, hidden, 8, 5)
        assert np.allclose(list(zip(model.train_losses, model.held_out_losses)), want, atol=1e-9)


def test_network_on_the_listings_equals_numpy(spark):
    from tavola.operators import warehouse
    from tavola.plans.catalog import prepared_listings

    data, vocab, _ = LP.build_dataset(warehouse.with_defaults(prepared_listings(spark, SF_SMALL)), 5)
    encoding = assemble.fit_encoding(data.filter("split = 'train'"), "row_id", LP.TEXT_COLUMN, LP.CATEGORICAL, LP.NUMERIC, 100)
    rows = LP.featurize(encoding, data).withColumn("held_out", F.col("split") == "val").select("slots", "values", "label_set", "held_out").persist()
    kept, k = rows.collect(), vocab.count()
    x, y, held = np.zeros((len(kept), encoding.n_slots)), np.zeros((len(kept), k)), np.array([r.held_out for r in kept])
    for i, r in enumerate(kept):
        x[i, r.slots], y[i, r.label_set] = r["values"], 1
    model = solvers.fit_network(rows, len(kept), int(held.sum()), k, encoding.n_slots, (32,), max_rounds=5)
    assert np.allclose(list(zip(model.train_losses, model.held_out_losses)), plain_network(x, y, held, (32,), 5, 42), atol=1e-8)


def test_wide_products_need_no_row_per_entry():
    import tracemalloc

    rng = np.random.default_rng(5)
    n, entries, slots, columns = 500, 20, 90, 256
    row = np.repeat(np.arange(n), entries)
    batch = solvers.Batch(n, row, rng.integers(0, slots, len(row)), rng.normal(size=len(row)), np.zeros((n, 1)), np.zeros(n, bool))  # slots repeat within rows
    x = np.zeros((n, slots + 7))
    np.add.at(x, (row, batch.slots), batch.values)
    w, r, out = rng.normal(size=(slots + 7, columns)), rng.normal(size=(n, columns)), np.ones((slots + 7, columns))
    tracemalloc.start()
    got = batch.times(w)
    batch.transposed_times(out, r)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, x @ w) and np.allclose(out, 1 + x.T @ r)
    assert peak < n * entries * columns * 8 / 4, peak


def test_products_of_mostly_empty_blocks_go_by_entries(monkeypatch):
    rng = np.random.default_rng(6)
    row = np.arange(300)
    batch = lambda: solvers.Batch(300, row, row * 3, rng.normal(size=300), np.zeros((300, 1)), np.zeros(300, bool))
    assert batch().dense is None
    monkeypatch.setattr(solvers, "CELLS_PER_ENTRY", 300)
    b = batch()
    w, r = rng.normal(size=(900, 40)), rng.normal(size=(300, 40))
    wide, out, plain = b.times(w), np.zeros_like(w), np.zeros_like(w)
    b.transposed_times(out, r)
    assert b.dense is not None
    monkeypatch.setattr(solvers, "WIDE", 41)
    b.transposed_times(plain, r)
    assert np.allclose(b.times(w), wide) and np.allclose(out, plain)


def test_network_stops_after_its_patience(spark):
    x, y = sample(120)
    held = np.arange(len(x)) % 5 == 0
    model = solvers.fit_network(frame(spark, x, y, held), len(x), int(held.sum()), 4, x.shape[1], (8,), rate=0.5, patience=3, max_rounds=60)
    assert model.rounds < 60 and min(model.held_out_losses) < model.held_out_losses[0]


def test_neural_model_roundtrip(spark, tmp_path):
    from tavola.operators import warehouse
    from tavola.plans.catalog import prepared_listings

    prepared = warehouse.with_defaults(prepared_listings(spark, SF_SMALL))
    model, out = LP.train_and_evaluate(prepared, "mlp", min_count=5, max_features=100, max_iter=3, hidden=(8,))
    LP.save_model(model, str(tmp_path / "m"))
    again = LP.load_model(spark, str(tmp_path / "m"))
    data, _, _ = LP.build_dataset(prepared, 5)
    rows = lambda m: sorted((r.row_id, r.label_idx, round(r.prob, 12)) for r in LP.predict_proba(m.models, LP.featurize(m, data)).collect())
    assert rows(model) == rows(again) and {r.split for r in out["metrics"].collect()} == {"train", "val", "test"}


def test_unseen_levels_and_terms_get_no_slot(spark):
    train = spark.createDataFrame([(1, "red cat", "a", 1.0), (2, "dog", "b", None), (3, None, None, 3.0)], "row_id long, t string, c string, x double")
    e = assemble.fit_encoding(train, "row_id", "t", ["c"], ["x"])
    names = {r.slot: r.feature for r in e.names().collect()}
    assert names == {0: "name__cat", 1: "name__dog", 2: "name__red", 3: "cat__c_a", 4: "cat__c_b", 5: "num__x"} and e.n_slots == 6
    new = spark.createDataFrame([(9, "cat bird", "z", None)], train.schema)
    assert {(r.slot, r.value > 0) for r in assemble.assembled(e, new).collect()} == {(0, True), (5, True)}


def odd_batch(seed=7, n=300, slots=40, k=5):
    rng = np.random.default_rng(seed)
    row = np.sort(np.append(np.arange(n), rng.integers(0, n, 5 * n)))
    return solvers.Batch(n, row, rng.integers(0, slots, len(row)) * 3, rng.normal(size=len(row)), (rng.random((n, k)) < 0.3).astype(float), rng.random(n) < 0.2)


def test_packed_batches_are_the_same_batches():
    import pickle

    for b in (odd_batch(), solvers.Batch(2, np.arange(2), np.full(2, 9), np.ones(2), np.zeros((2, 0)), np.zeros(2, bool))):
        again = pickle.loads(pickle.dumps(b))
        for name in ("row", "slots", "values", "labels", "held_out"):
            assert np.array_equal(getattr(again, name), getattr(b, name)) and getattr(again, name).dtype == getattr(b, name).dtype
    assert len(pickle.dumps(odd_batch())) < 300 * 6 * 16 + 3000  # value, row and place of every entry


def test_narrow_products_are_those_of_rows_of_columns():
    b = odd_batch()  # slots repeat within rows
    x = np.zeros((300, 120))
    np.add.at(x, (b.row, b.slots), b.values)
    rng = np.random.default_rng(8)
    w, r, out = rng.normal(size=(120, 5)), rng.normal(size=(300, 5)), np.zeros((120, 5))
    b.transposed_times(out, r)
    assert np.allclose(b.times(w), x @ w) and np.allclose(out, x.T @ r)
    # To the last bit the sums over entries x columns, so that many rounds end at the same weights.
    whole = np.add.reduceat(w[b.slots] * b.values[:, None], np.searchsorted(b.row, np.arange(300)), axis=0)
    slots, at = np.sort(b.slots), np.argsort(b.slots, kind="stable")
    first = np.flatnonzero(np.append(True, slots[1:] != slots[:-1]))
    assert np.array_equal(b.times(w), whole)
    assert np.array_equal(out[slots[first]], np.add.reduceat(b.values[at][:, None] * r[b.row[at]], first, axis=0))


def test_rounds_do_not_read_the_rows_again(spark):
    x, y = sample()
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    rows = frame(spark, x, y).select("slots", "values", "label_set", "held_out")
    rows = rows.mapInArrow(counted, rows.schema)
    model = solvers.fit_logistic(rows, len(x), y.sum(0).tolist(), x.shape[1], max_passes=6)
    assert model.passes == 6 and reads.value == len(x)
    network = solvers.fit_network(rows, len(x), 0, 4, x.shape[1], (8,), max_rounds=5)
    assert network.rounds == 5 and reads.value == 2 * len(x)


def test_penalties_side_by_side_equal_a_fit_each(spark, monkeypatch):
    x, y = sample()
    n, rows, positive, cs = len(x), frame(spark, x, y), y.sum(0).tolist(), [0.5, 1.0, 2.0]
    one = [solvers.fit_logistic(rows, n, positive, x.shape[1], c, relative=1e-4) for c in cs]
    in_a_task = solvers.fit_logistics(rows, n, positive, x.shape[1], cs, relative=1e-4)
    monkeypatch.setattr(solvers, "AT_ONCE", 0)
    by_jobs = solvers.fit_logistics(rows, n, positive, x.shape[1], cs, relative=1e-4)
    for models in (in_a_task, by_jobs):
        assert [m.constant for m in models] == [{3: 0.0}] * 3
        assert max(np.abs(a.weights - b.weights).max() for a, b in zip(models, one)) < 1e-6


def labelled(spark, n=60):
    rows = [
        (i, f"{'alpha' if i % 3 else 'beta'} word{i % 5}", ", ".join(c for c, d in (("A", 2), ("B", 3), ("C", 5)) if i % d) or "A", i % 2, f"city{i % 3}", f"place{i % 4}", "Yes", "No", "No",
         float(i % 7), float(i % 11), float(i % 13), i % 4, (i % 9) / 2, float(i % 6))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "listing_id long, listing_name string, cuisines string, country_code int, city string, locality string, has_table_booking string, has_online_delivery string, "
                                       "is_delivering_now string, longitude double, latitude double, log_average_cost_inr double, price_range int, aggregate_rating double, log_votes double")


def test_candidates_that_share_rows_get_the_metrics_of_a_fit_each(spark):
    from tavola.operators import evaluate, split

    base = {"min_count": 5, "max_features": 50, "ngram_max": 1, "min_df": 1, "c": 1.0}
    cands = [base, {**base, "ngram_max": 2}, {**base, "c": 0.5}]
    prepared = labelled(spark)
    folds, summary, best = LP.cross_validate(prepared, cands, k=2, max_iter=20)
    got = {(r.candidate, r.fold): r for r in folds.collect()}
    assert sorted(got) == [(c, f) for c in (1, 2, 3) for f in (0, 1)] and summary.count() == 3 and best.count() == 1
    data, vocab, _ = LP.build_dataset(prepared, 5)
    data = split.assign_fold(data.filter("split = 'train'"), "row_id", 2).persist()
    encoding = assemble.fit_encoding(data.filter("fold <> 1"), "row_id", LP.TEXT_COLUMN, LP.CATEGORICAL, LP.NUMERIC, 50, 1, 1)
    rows = LP.featurize(encoding, data).persist()
    model = LP.fit(rows.filter("fold <> 1"), vocab.count(), encoding.n_slots, "logistic", 0.5, 20)
    want = evaluate.threshold_sweep(LP.predict_proba(model, rows.filter("fold = 1")), vocab.count()).filter("is_best").first()
    assert got[3, 1].best_threshold == want.threshold and abs(got[3, 1].micro_f1 - want.micro_f1) < 1e-9 and abs(got[3, 1].macro_f1 - want.macro_f1) < 1e-9


def test_label_cv_query_runs_the_whole_grid_to_the_full_budget(spark, monkeypatch):
    from tavola.plans import catalog

    seen = {}
    monkeypatch.setattr(catalog, "prepared_listings", lambda *a, **k: None)
    monkeypatch.setattr(LP, "cross_validate", lambda prepared, candidates, **how: seen.update(how, candidates=candidates) or (None, None, "best"))
    assert catalog.queries()["label_cv_best"](spark, SF_SMALL) == "best"
    points = {tuple(sorted(c.items())) for c in seen["candidates"]}
    assert len(points) == len(seen["candidates"]) == np.prod([len(v) for v in LP.TUNING_GRID.values()]) and seen["candidates"][0] == LP.BASE_CANDIDATE
    assert seen.get("max_iter") in (None, LP.ITERATIONS["logistic"]) and seen["k"] == 3
