"""Multi-label category classification.

Features are sparse rows assembled from ranked slot tables; all labels are
solved at once (``tavola.plans.solvers``): one quasi-Newton solve for the
logistic kind, one shared network for the neural kind.  Probabilities come back
in long form ``(row_id, label_idx, prob)``; thresholding and all metrics are the
relational operators of ``tavola.operators.evaluate``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.operators import assemble, evaluate, importance, labels, mlfeatures, split, text
from tavola.plans import solvers
from tavola.session import cut_lineage, materialize_table

# Model inputs of the category classifier.
TEXT_COLUMN = "listing_name"
CATEGORICAL = ["country_code", "city", "locality", "has_table_booking", "has_online_delivery", "is_delivering_now"]
NUMERIC = ["longitude", "latitude", "log_average_cost_inr", "price_range", "aggregate_rating", "log_votes"]


@dataclass
class LabelModel:
    vocab: DataFrame
    n_labels: int
    encoding: assemble.Encoding
    models: solvers.LogisticModel | solvers.NetworkModel
    threshold: float = 0.5


def build_dataset(prepared: DataFrame, min_count: int, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """L1-L5 + P1: rows with at least one frequent label, their indicator array, split; plus vocabulary and frequency table."""
    long = labels.label_split(prepared, "listing_id")
    freq = labels.label_frequency(long, min_count)
    kept = labels.filter_rare(long, min_count)
    vocab = labels.vocabulary(kept)
    ind = labels.binarize(kept, vocab).groupBy("row_id").agg(F.collect_set("label_idx").alias("label_set"))
    base = prepared.select(F.col("listing_id").alias("row_id"), TEXT_COLUMN, *CATEGORICAL, *NUMERIC)
    data = base.join(ind, "row_id")
    data = mlfeatures.cast_features(data, CATEGORICAL, NUMERIC, trim=True).withColumn("tokens", text.tokens(F.coalesce(F.col(TEXT_COLUMN), F.lit(""))))
    return split.assign_split(data, "row_id", seed), vocab, freq


def fit_featurizer(train: DataFrame, max_features: int = 3000, min_df: int = 1, ngram_max: int = 1):
    """M1-M6 fitted on the training rows: TF-IDF of the name, one-hot categoricals, scaled numerics."""
    tf = cut_lineage(text.term_frequencies(train.select("row_id", TEXT_COLUMN), "row_id", TEXT_COLUMN, ngram_max))
    voc = text.fit_idf(text.fit_vocabulary(tf, min_df, max_features), train).orderBy("term_idx")
    rows = voc.collect()  # bounded by max_features: model parameters
    terms, idf = [r["term"] for r in rows], [float(r["idf"]) for r in rows]
    scaler = mlfeatures.fit_median_std(train, NUMERIC)
    idx = [f"{c}__idx" for c in CATEGORICAL]
    ohe = [f"{c}__ohe" for c in CATEGORICAL]
    stages = []
    terms_col = "tokens"
    if ngram_max > 1:
        # Same n-grams as the fitted vocabulary: word n-grams appended to the tokens.
        from pyspark.ml.feature import NGram, SQLTransformer

        grams = [f"_g{n}" for n in range(2, ngram_max + 1)]
        stages += [NGram(n=n, inputCol="tokens", outputCol=g) for n, g in zip(range(2, ngram_max + 1), grams)]
        stages.append(SQLTransformer(statement=f"SELECT *, concat(tokens, {', '.join(grams)}) AS _terms FROM __THIS__"))
        terms_col = "_terms"
    if terms:
        stages += text.vectorizer_stages(terms, idf, terms_col, "name_tfidf")
    stages += [
        StringIndexer(inputCols=CATEGORICAL, outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True, handleInvalid="keep"),
        VectorAssembler(inputCols=(["name_tfidf"] if terms else []) + ohe + NUMERIC, outputCol="features", handleInvalid="keep"),
    ]
    model = Pipeline(stages=stages).fit(mlfeatures.apply_median_std(train, scaler))
    # Slot names from the assembled vector's ML attributes (one row suffices).
    raw_names = importance.slot_names(model.transform(mlfeatures.apply_median_std(train.limit(1), scaler)))
    names = []
    for nm in raw_names:
        if nm.startswith("name_tfidf_") and nm[len("name_tfidf_"):].isdigit():
            names.append("name__" + terms[int(nm[len("name_tfidf_"):])])
        elif "__ohe_" in nm:
            c, level = nm.split("__ohe_", 1)
            names.append(f"cat__{c}_{level}")
        else:
            names.append(f"num__{nm}")
    return model, scaler, names


def featurize(model: LabelModel | assemble.Encoding | None, data: DataFrame, featurizer: PipelineModel | None = None, scaler: dict | None = None) -> DataFrame:
    """Rows with their features: sparse ``slots`` and ``values``, or the vectors of a Spark ML featurizer."""
    keep = ["row_id", "split", "label_set", *(["fold"] if "fold" in data.columns else [])]
    if featurizer is not None:
        return featurizer.transform(mlfeatures.apply_median_std(data, scaler)).select(*keep, "features")
    encoding = model.encoding if isinstance(model, LabelModel) else model
    cells = assemble.sparse_rows(assemble.assembled(encoding, data))
    out = data.select(*keep).join(cells, "row_id", "left")
    return out.withColumns({"slots": F.coalesce("slots", F.array().cast("array<int>")), "values": F.coalesce("values", F.array().cast("array<double>"))})


# Most rounds of the two kinds, the neural kind's hidden layers, its share of validation rows and its
# patience, and the logistic kind's tolerance relative to its first gradient.
ITERATIONS = {"logistic": 2000, "mlp": 250}
HIDDEN = (256,)
HELD_OUT_PERCENT = 12
TOLERANCE = 1e-4
PATIENCE = 12


def _train_rows(train: DataFrame, seed: int) -> DataFrame:
    held_out = split.mixed_hash(F.col("row_id"), f"held{seed}") % 100 < HELD_OUT_PERCENT
    return train.select("slots", "values", "label_set", held_out.alias("held_out"))


def _positive(rows: DataFrame, n_labels: int) -> list[float]:
    """Every label's number of rows."""
    counts = rows.select(F.explode("label_set").alias("j")).groupBy("j").count().collect()  # one number per label
    positive = {r["j"]: float(r["count"]) for r in counts}
    return [positive.get(j, 0.0) for j in range(n_labels)]


def fit(train: DataFrame, n_labels: int, n_slots: int, kind: str = "logistic", c: float = 1.0, max_iter: int | None = None, hidden: Sequence[int] = HIDDEN, seed: int = 42):
    """All labels' classifiers in one solve over sparse rows.

    Fits end by tolerance or at ``max_iter`` rounds, the kind's full budget by default.
    ``train`` is read for its counts and packed by the solver, so it should be a table.
    """
    max_iter = max_iter or ITERATIONS[kind]
    rows = _train_rows(train, seed)
    n, n_held = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("held_out"), 1))).first()
    if kind == "mlp":
        model = solvers.fit_network(rows, n, n_held, n_labels, n_slots, hidden, max_rounds=max_iter, patience=PATIENCE, seed=seed)
    else:
        model = solvers.fit_logistic(rows, n, _positive(rows, n_labels), n_slots, c, max_iter, relative=TOLERANCE)
    return model


def fit_candidates(train: DataFrame, n_labels: int, n_slots: int, candidates: Sequence[Mapping[str, object]], kind: str = "logistic", max_iter: int | None = None, seed: int = 42) -> list:
    """T5 / T6 for candidates over the same rows: a model each; the logistic kind solves every penalty once, all in one solve."""
    if kind == "mlp":
        return [fit(train, n_labels, n_slots, kind, float(cand["c"]), max_iter, cand.get("hidden", HIDDEN), seed) for cand in candidates]
    rows, cs = _train_rows(train, seed), list(dict.fromkeys(float(cand["c"]) for cand in candidates))
    solved = dict(zip(cs, solvers.fit_logistics(rows, rows.count(), _positive(rows, n_labels), n_slots, cs, max_iter or ITERATIONS[kind], relative=TOLERANCE)))
    return [solved[float(cand["c"])] for cand in candidates]


def predict_proba(models, data_rows: DataFrame) -> DataFrame:
    """``(row_id, label_idx, prob, truth)`` in long form: all labels' probabilities in one pass over the rows."""
    layers = [models.weights.T] if isinstance(models, solvers.LogisticModel) else [models.layers[0][0], models.layers[-1][1][None, :]]
    n_slots = layers[0].shape[0] - isinstance(models, solvers.LogisticModel)
    out = solvers.predicted(models, data_rows.select("row_id", "split", "label_set", "slots", "values"), n_slots, layers[-1].shape[1])
    long = out.select("row_id", "split", "label_set", F.posexplode("probs").alias("label_idx", "prob"))
    return long.select("row_id", "split", "label_idx", "prob", F.array_contains("label_set", F.col("label_idx")).cast("int").alias("truth"))


def coefficients(model: LabelModel) -> DataFrame:
    """I3 / I4 input: ``(label, feature, coefficient)`` of the logistic models, zeros left out."""
    spark, weights = model.vocab.sparkSession, model.models.weights
    live = [j for j in range(len(weights)) if j not in model.models.constant]
    rows = [(j, weights[j, :-1].tolist()) for j in live]
    long = spark.createDataFrame(rows, "label_idx int, w array<double>").select("label_idx", F.posexplode("w").alias("slot", "coefficient")).filter("coefficient <> 0")
    names = model.encoding.names().withColumn("feature", importance.clean_feature_name(F.col("feature")))
    return long.join(names, "slot").join(model.vocab, "label_idx").select("label", "feature", "coefficient")


def train_and_evaluate(prepared: DataFrame, kind: str = "logistic", min_count: int = 10, max_features: int = 3000, c: float = 1.0,
                       max_iter: int | None = None, hidden: Sequence[int] = HIDDEN, seed: int = 42, fixed_threshold: float | None = None,
                       ngram_max: int = 2, min_df: int = 2):
    """Full flow: dataset -> featurize -> fit -> tune threshold on val (T9) -> metrics per split (E*)."""
    data, vocab, freq = build_dataset(prepared, min_count, seed)
    data = materialize_table(data, "label-data")
    vocab = vocab.persist()
    n_labels = vocab.count()
    train = data.filter("split = 'train'")
    encoding = assemble.fit_encoding(train, "row_id", TEXT_COLUMN, CATEGORICAL, NUMERIC, max_features, min_df, ngram_max)
    rows = materialize_table(featurize(encoding, data), "label-rows")
    models = fit(rows.filter("split = 'train'"), n_labels, encoding.n_slots, kind, c, max_iter, hidden, seed)
    probs = predict_proba(models, rows).persist(StorageLevel.MEMORY_AND_DISK)
    sweep = evaluate.threshold_sweep(probs.filter("split = 'val'"), n_labels)
    best = fixed_threshold if fixed_threshold is not None else sweep.filter("is_best").select("threshold").first()[0]
    preds = evaluate.apply_threshold(probs, best)
    metrics = evaluate.multilabel_metrics(preds, n_labels, ["split"])
    per_label = evaluate.per_label_table(preds.filter("split = 'test'"), vocab)
    model = LabelModel(vocab, n_labels, encoding, models, best)
    return model, {"metrics": metrics, "threshold_tuning": sweep, "per_label": per_label, "frequency": freq, "predictions": preds}


# Search space of the category model (candidate grid, P3).
TUNING_GRID = {
    "min_count": [10, 20, 30],
    "max_features": [2000, 3000, 5000],
    "ngram_max": [1, 2],
    "min_df": [1, 2],
    "c": [0.5, 1.0, 2.0],
}
NEURAL_GRID = {**TUNING_GRID, "hidden": [(128,), (256,), (128, 64)]}
BASE_CANDIDATE = {"min_count": 10, "max_features": 3000, "ngram_max": 2, "min_df": 2, "c": 1.0}


# Parameters of a candidate that its rows depend on, and folds that are worked on at the same time.
ROW_PARAMS = ("min_count", "max_features", "min_df", "ngram_max")
FOLDS_AT_ONCE = 6


def cross_validate(prepared: DataFrame, candidates, k: int = 3, kind: str = "logistic", max_iter: int | None = None, seed: int = 42):
    """P4-P6 for the category model: per candidate x fold, fit on the other folds,
    tune the threshold on the held-out fold (T9), record its metrics; then
    mean / population std per candidate and the best by (micro, sample, macro F1).

    Candidates with the same rows share them: a fold is encoded once for all of
    them.  Some folds run side by side, as their jobs are small on small tables."""
    groups: dict[tuple, list[int]] = {}
    for ci, cand in enumerate(candidates):
        groups.setdefault(tuple(int(cand[p]) for p in ROW_PARAMS), []).append(ci)
    spark, records, kinds = prepared.sparkSession, [], None

    def run_fold(data: DataFrame, n_labels: int, group: tuple, own: list[int], f: int) -> list[tuple]:
        _, max_features, min_df, ngram_max = group
        encoding = assemble.fit_encoding(data.filter(F.col("fold") != f), "row_id", TEXT_COLUMN, CATEGORICAL, NUMERIC, max_features, min_df, ngram_max)
        rows = featurize(encoding, data).persist(StorageLevel.MEMORY_AND_DISK)
        models = fit_candidates(rows.filter(F.col("fold") != f), n_labels, encoding.n_slots, [candidates[ci] for ci in own], kind, max_iter, seed)
        held, out = rows.filter(F.col("fold") == f), []
        for ci, model in zip(own, models):
            sweep = evaluate.threshold_sweep(predict_proba(model, held), n_labels).filter("is_best")
            rec = sweep.select(
                F.lit(ci + 1).alias("candidate"), F.lit(f).alias("fold"), F.col("threshold").alias("best_threshold"),
                "micro_f1", "macro_f1", "sample_f1", "hamming_loss", "exact_match",
            )
            out.append((rec.schema, rec.collect()))  # a row per fit
        rows.unpersist()
        return out

    for min_count in dict.fromkeys(group[0] for group in groups):
        data, vocab, _ = build_dataset(prepared, min_count, seed)
        data = split.assign_fold(data.filter("split = 'train'"), "row_id", k, seed).persist(StorageLevel.MEMORY_AND_DISK)
        n_labels = vocab.count()
        data.count()
        with ThreadPoolExecutor(FOLDS_AT_ONCE) as pool:
            work = [pool.submit(inheritable_thread_target(spark)(run_fold), data, n_labels, group, own, f) for group, own in groups.items() if group[0] == min_count for f in range(k)]
            for done in work:
                for kinds, rec in done.result():
                    records += rec
        data.unpersist()
    records = spark.createDataFrame(sorted(records, key=lambda r: (r["candidate"], r["fold"])), kinds)
    summary = split.summarize_folds(records, ["micro_f1", "macro_f1", "sample_f1", "hamming_loss", "exact_match"])
    best = split.select_best(summary, [F.col("mean_micro_f1").desc(), F.col("mean_sample_f1").desc(), F.col("mean_macro_f1").desc()])
    return records, summary, best


def save_model(model: LabelModel, path: str) -> None:
    """Encoding tables, weights, vocabulary and threshold, as Parquet and JSON."""
    import json

    base = path.rstrip("/")
    spark, m = model.vocab.sparkSession, model.models
    assemble.save_encoding(model.encoding, base)
    model.vocab.write.mode("overwrite").parquet(f"{base}/vocabulary")
    arrays = [m.weights] if m.kind == "logistic" else [x for layer in m.layers for x in layer]
    rows = [(i, list(x.shape), x.ravel().tolist()) for i, x in enumerate(arrays)]
    spark.createDataFrame(rows, "i int, shape array<int>, x array<double>").write.mode("overwrite").parquet(f"{base}/weights")
    meta = {"kind": m.kind, "n_labels": model.n_labels, "threshold": model.threshold, "constants": getattr(m, "constant", {})}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").text(f"{base}/meta")


def load_model(spark, path: str) -> LabelModel:
    import json

    base = path.rstrip("/")
    meta = json.loads(spark.read.text(f"{base}/meta").first()[0])
    arrays = [np.array(r["x"]).reshape(r["shape"]) for r in spark.read.parquet(f"{base}/weights").orderBy("i").collect()]
    if meta["kind"] == "logistic":
        models = solvers.LogisticModel(arrays[0], {int(j): p for j, p in meta["constants"].items()})
    else:
        models = solvers.NetworkModel(list(zip(arrays[::2], arrays[1::2])))
    return LabelModel(spark.read.parquet(f"{base}/vocabulary"), meta["n_labels"], assemble.load_encoding(spark, base), models, meta["threshold"])
