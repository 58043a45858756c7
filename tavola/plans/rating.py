"""Rating regression (T1-T4 with P1, P3-P6, E1-E3, E13, I1, I2, S16).

The boosted solvers of the reference are re-aimed as Spark ML
``GBTRegressor`` fits: trees are built from distributed histograms over the
partitions, so the fit scales with the cluster.  Quality differs from the
reference's boosters (no L2 leaf penalty, no ordered boosting); results are
our own and are reported, not tuned to match.

Every encoder is fitted on the training rows alone.  Training rows get
out-of-fold target statistics (their own fold's labels are left out), all
other rows the statistics of the whole training split.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import SparkContext, StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, TargetEncoder, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.operators import clean, evaluate, importance, mlfeatures, split
from tavola.session import ensure_checkpoint_dir

TARGET = "aggregate_rating"

# Feature lists of the four rating variants.
_BASE = [
    "country_code", "city", "longitude", "latitude", "cuisines", "cost_for_two", "has_table_booking",
    "has_online_delivery", "is_delivering_now", "price_range", "log_votes", "average_cost_inr",
    "log_average_cost_inr", "cost_relative_to_city", "cuisine_count", "city_wise_cost_category",
    "restaurant_cost_category", "popularity_category", "city_restaurant_count", "is_expensive",
    "has_delivery_or_booking", "location_cluster", "city_location_cluster",
]
_CATS = [
    "country_code", "city", "cuisines", "has_table_booking", "has_online_delivery", "is_delivering_now",
    "city_wise_cost_category", "restaurant_cost_category", "popularity_category", "location_cluster",
    "city_location_cluster",
]
FEATURES = {
    "base": _BASE,
    "engineered": [c for c in _BASE if c != "has_delivery_or_booking"],
    "without_votes": [
        "country_code", "city", "longitude", "latitude", "cuisines", "cost_for_two", "has_table_booking",
        "has_online_delivery", "is_delivering_now", "price_range", "average_cost_inr", "log_average_cost_inr",
        "cost_relative_to_city", "cuisine_count",
    ],
    "onehot": [c for c in _BASE if c != "has_delivery_or_booking"],
}
CATEGORICAL = {
    "base": _CATS,
    "engineered": _CATS,
    "without_votes": ["country_code", "city", "cuisines", "has_table_booking", "has_online_delivery", "is_delivering_now"],
    "onehot": _CATS,
}
# Base boosting settings per variant.
BASE_PARAMS = {
    "base": {"maxDepth": 8, "stepSize": 0.03, "subsamplingRate": 1.0, "early_stop": True},
    "engineered": {"maxDepth": 8, "stepSize": 0.03, "subsamplingRate": 1.0, "early_stop": True},
    "without_votes": {"maxDepth": 8, "stepSize": 0.03, "subsamplingRate": 1.0, "early_stop": True},
    "onehot": {"maxDepth": 8, "stepSize": 0.03, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.9", "early_stop": False},
}
# Most boosting rounds per variant, and in cross validation.
ITERATIONS = {"base": 3000, "engineered": 3000, "without_votes": 3000, "onehot": 1200}
CV_ITERATIONS = 800
# Rounds without a lower validation error that end a fit, and those a first fit runs beside them.
PATIENCE = 150
FIRST_ROUNDS = 50
# Fits of a cross validation that run at the same time.
FITS_AT_ONCE = 6
# Folds of the out-of-fold target statistics.
ENCODING_FOLDS = 5
TUNING_GRID = {
    "base": {"maxDepth": [6, 8, 10], "stepSize": [0.02, 0.03, 0.05], "subsamplingRate": [0.8, 0.9, 1.0], "minInstancesPerNode": [1, 3, 5]},
    "engineered": {"maxDepth": [6, 8, 10], "stepSize": [0.02, 0.03, 0.05], "subsamplingRate": [0.8, 0.9, 1.0], "minInstancesPerNode": [1, 3, 5]},
    "onehot": {"maxDepth": [4, 6, 8], "stepSize": [0.02, 0.03, 0.05], "subsamplingRate": [0.8, 0.9, 1.0], "featureSubsetStrategy": ["0.8", "0.9", "1.0"]},
}

# The base settings as a point of the grid of variants that stop early.
BASE_CANDIDATE = {"maxDepth": 8, "stepSize": 0.03, "subsamplingRate": 1.0, "minInstancesPerNode": 1}


def prepare_features(prepared: DataFrame, variant: str) -> DataFrame:
    """Rows with a numeric target, leakage dropped, features typed (no imputation yet)."""
    feats, cats = FEATURES[variant], CATEGORICAL[variant]
    nums = [c for c in feats if c not in cats]
    df = clean.drop_leakage(prepared.withColumn("_row_id", F.col("listing_id")), variant)
    df = df.withColumn(TARGET, F.col(TARGET).cast("string").try_cast("double")).filter(F.col(TARGET).isNotNull())
    return mlfeatures.cast_features(df.select("_row_id", TARGET, *feats), cats, nums, trim=variant == "onehot")


@dataclass
class RatingModel:
    variant: str
    pipeline: PipelineModel
    medians: dict
    feature_names: list[str]
    slot_names: list[str] = None


def _plain(cats: Sequence[str]) -> SQLTransformer:
    # The encoder keeps the indexer's nominal metadata; re-derive plain
    # numeric columns so the trees treat the statistics as continuous.
    return SQLTransformer(statement="SELECT *, " + ", ".join(f"`{c}__te` * 1.0 AS `{c}__tev`" for c in cats) + " FROM __THIS__")


def _encode(train: DataFrame, variant: str, seed: int, kept: list[DataFrame] | None = None) -> tuple[DataFrame, list]:
    """(training rows with encoded categoricals, fitted stages that encode any other row).

    ``kept`` receives what was persisted, to be let go when the encoded rows have been read.
    """
    cats = CATEGORICAL[variant]
    idx = [f"{c}__idx" for c in cats]
    indexer = StringIndexer(inputCols=cats, outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc").fit(train)
    indexed = indexer.transform(train)
    if variant == "onehot":
        ohe = OneHotEncoder(inputCols=idx, outputCols=[f"{c}__ohe" for c in cats], dropLast=True, handleInvalid="keep").fit(indexed)
        return ohe.transform(indexed), [indexer, ohe]
    encoder = TargetEncoder(inputCols=idx, outputCols=[f"{c}__te" for c in cats], labelCol=TARGET, targetType="continuous", smoothing=1.0, handleInvalid="keep")
    indexed = split.assign_fold(indexed, "_row_id", ENCODING_FOLDS, seed + 1).withColumnRenamed("fold", "_te_fold").persist()
    if kept is not None:
        kept.append(indexed)
    parts = None
    for f in range(ENCODING_FOLDS):
        rest, own = indexed.filter(F.col("_te_fold") != f), indexed.filter(F.col("_te_fold") == f)
        part = (encoder.fit(rest) if not rest.isEmpty() else encoder.fit(indexed)).transform(own)
        parts = part if parts is None else parts.unionByName(part)
    whole = encoder.fit(indexed)
    return _plain(cats).transform(parts), [indexer, whole, _plain(cats)]


def _vectors(train: DataFrame, variant: str, seed: int) -> tuple[DataFrame, list, dict, list[DataFrame]]:
    """(training rows as vectors, fitted stages that make them of any other row, medians, what was persisted)."""
    cats = CATEGORICAL[variant]
    nums = [c for c in FEATURES[variant] if c not in cats]
    medians = mlfeatures.fit_median_std(train, nums)
    kept: list[DataFrame] = []
    encoded, stages = _encode(mlfeatures.apply_median_std(train, medians, scale=False), variant, seed, kept)
    cat_out = [f"{c}__ohe" if variant == "onehot" else f"{c}__tev" for c in cats]
    assembler = VectorAssembler(inputCols=nums + cat_out, outputCol="features", handleInvalid="keep")
    return assembler.transform(encoded).select("features", TARGET), [*stages, assembler], medians, kept


def _held_vectors(stages: list, medians: dict, held: DataFrame) -> DataFrame:
    return PipelineModel(stages).transform(mlfeatures.apply_median_std(held, medians, scale=False)).select("features", TARGET)


def _laid_out(rows: DataFrame, parts: int, params: Mapping[str, object]) -> DataFrame:
    if params["subsamplingRate"] != 1.0:
        # Draws of rows are seeded by part, so fits that draw keep theirs.
        return rows
    # Every fold brings its own parts, and every level of every tree would pay for a task of each.
    return rows.coalesce(parts)


def _parts(train: DataFrame) -> int:
    return max(train.rdd.getNumPartitions(), train.sparkSession.sparkContext.defaultParallelism)


def _boosted(rows: DataFrame, params: Mapping[str, object], max_iter: int, seed: int) -> GBTRegressionModel:
    """``max_iter`` rounds of boosting over vectors."""
    # Hundreds of rounds need their running predictions cut off from the rounds before.
    ensure_checkpoint_dir(rows.sparkSession, local_fallback=True)
    gbt_params = {k: v for k, v in params.items() if k in ("maxDepth", "stepSize", "subsamplingRate", "featureSubsetStrategy", "minInstancesPerNode")}
    gbt = GBTRegressor(featuresCol="features", labelCol=TARGET, maxIter=max_iter, seed=seed, maxBins=64, maxMemoryInMB=1024, checkpointInterval=20, **gbt_params)
    return gbt.fit(rows)


def best_round(errors: Sequence[float], patience: int) -> tuple[int, bool]:
    """(number of rounds up to the least error, whether ``patience`` rounds have gone by since); rounds after that are not looked at."""
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def _first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The model after its first ``n`` rounds."""
    java, gateway = model._java_obj, SparkContext._active_spark_context._gateway
    ml = gateway.jvm.org.apache.spark.ml
    trees, weights = gateway.new_array(ml.regression.DecisionTreeRegressionModel, n), gateway.new_array(gateway.jvm.double, n)
    all_trees, all_weights = java.trees(), java.treeWeights()
    for i in range(n):
        trees[i], weights[i] = all_trees[i], all_weights[i]
    first = ml.regression.GBTRegressionModel(java.uid(), trees, weights, java.numFeatures())
    out = model.copy()
    out._java_obj = java.copyValues(first, ml.param.ParamMap())
    return out


def _boosted_until(rows: DataFrame, held: DataFrame, params: Mapping[str, object], max_iter: int, seed: int) -> GBTRegressionModel:
    """Boosting that ends when the error over ``held`` has not fallen for ``PATIENCE`` rounds; the rounds up to its least value are kept.

    Spark ends at the first round that does not help, so fits run for a number of
    rounds, are judged round by round, and are made twice as long while undecided.
    """
    rounds = min(max_iter, PATIENCE + FIRST_ROUNDS)
    while True:
        trees = _boosted(rows, params, rounds, seed)
        best, ended = best_round(trees.evaluateEachIteration(held, "squared"), PATIENCE)
        if ended or rounds == max_iter:
            return _first_trees(trees, best)
        rounds = min(max_iter, 2 * rounds)


def fit(train: DataFrame, variant: str, params: Mapping[str, object] | None = None, max_iter: int | None = None, seed: int = 42, val: DataFrame | None = None) -> RatingModel:
    """Fit on ``train``; ``val`` rows only say when to stop and are never seen by an encoder.

    ``max_iter`` defaults to the variant's full budget; variants that stop early
    end when the validation error has not fallen for ``PATIENCE`` rounds.
    """
    params = {**BASE_PARAMS[variant], **(params or {})}
    vectors, stages, medians, kept = _vectors(train, variant, seed)
    # Only the assembled vectors are read round after round.
    rows = _laid_out(vectors, _parts(train), params).persist(StorageLevel.MEMORY_AND_DISK)
    kept.append(rows)
    slots = importance.slot_names(rows.limit(1))
    most, held = max_iter or ITERATIONS[variant], None
    if params.get("early_stop") and val is not None:
        held = _held_vectors(stages, medians, val).persist(StorageLevel.MEMORY_AND_DISK)
        kept.append(held)
    stop = held is not None and not held.isEmpty()
    trees = _boosted_until(rows, held, params, most, seed) if stop else _boosted(rows, params, most, seed)
    for df in kept:
        df.unpersist()
    return RatingModel(variant, PipelineModel([*stages, trees]), medians, [c for c in FEATURES[variant] if c not in CATEGORICAL[variant]] + CATEGORICAL[variant], slots)


def predict(model: RatingModel, df: DataFrame) -> DataFrame:
    out = model.pipeline.transform(mlfeatures.apply_median_std(df, model.medians, scale=False))
    return out.select("_row_id", TARGET, F.col("prediction"), *([c for c in ("split", "fold") if c in df.columns]))


def feature_importance(model: RatingModel) -> DataFrame:
    """I1 (and I2 for one-hot): importance per source feature, from the fitted trees."""
    gbt = model.pipeline.stages[-1]
    vec = gbt.featureImportances.toArray().tolist()
    names = []
    for nm in model.slot_names:
        if "__ohe_" in nm:
            c, level = nm.split("__ohe_", 1)
            names.append(f"cat__{c}_{level}")
        elif nm.endswith("__tev"):
            names.append(f"num__{nm[:-5]}")
        else:
            names.append(f"num__{nm}")
    ss = SparkSession.getActiveSession()
    tbl = importance.importance_table(ss, names, vec)
    return importance.sum_to_source(tbl, CATEGORICAL[model.variant])


def train_and_evaluate(prepared: DataFrame, variant: str, max_iter: int | None = None, seed: int = 42, params: Mapping[str, object] | None = None) -> tuple[RatingModel, DataFrame]:
    """Split (P1) -> fit (T*) -> metrics per split."""
    # Read a dozen times by the encoders: typed and split once.
    data = split.assign_split(prepare_features(prepared, variant), "_row_id", seed).persist(StorageLevel.MEMORY_AND_DISK)
    train, val = data.filter("split = 'train'"), data.filter("split = 'val'")
    model = fit(train, variant, params, max_iter, seed, val=val)
    data.unpersist()
    preds = predict(model, data)
    return model, evaluate.regression_metrics(preds, TARGET, "prediction", ["split"])


def cross_validate(prepared: DataFrame, variant: str, candidates: Sequence[Mapping[str, object]], k: int = 3, max_iter: int = CV_ITERATIONS, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Per candidate x fold metrics on the training split, then mean / population std.

    A fold's rows are encoded once for all candidates.  Each fit is a
    distributed Spark job; some run side by side, as a level of a tree is a small
    job on small tables.  The candidate loop is a small driver-side parameter
    loop (its size is the number of trials).
    """
    data = split.assign_fold(split.assign_split(prepare_features(prepared, variant), "_row_id", seed).filter("split = 'train'"), "_row_id", k, seed)
    data = data.persist()
    spark, records, kinds = prepared.sparkSession, [], None

    def run_fit(rows: DataFrame, parts: int, held: DataFrame, ci: int, f: int) -> tuple:
        params = {**BASE_PARAMS[variant], **candidates[ci]}
        trees = _boosted(_laid_out(rows, parts, params), params, max_iter, seed)
        met = evaluate.regression_metrics(trees.transform(held), TARGET, "prediction")
        rec = met.select(F.lit(ci + 1).alias("candidate"), F.lit(f).alias("fold"), "rmse", "mae", "r2")
        return rec.schema, rec.collect()  # a row per fit

    for f in range(k):
        train = data.filter(F.col("fold") != f)
        rows, stages, medians, kept = _vectors(train, variant, seed)
        held = _held_vectors(stages, medians, data.filter(F.col("fold") == f))
        for df in (rows, held):
            kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
            df.count()
        parts = _parts(train)
        with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
            work = [pool.submit(inheritable_thread_target(spark)(run_fit), rows, parts, held, ci, f) for ci in range(len(candidates))]
            for done in work:
                kinds, rec = done.result()
                records += rec
        for df in kept:
            df.unpersist()
    data.unpersist()
    folds = spark.createDataFrame(sorted(records, key=lambda r: (r["candidate"], r["fold"])), kinds)
    return folds, split.summarize_folds(folds, ["rmse", "mae", "r2"])


def save_model(model: RatingModel, path: str) -> None:
    """The fitted pipeline (Spark ML format) and all that prediction and importance need beside it."""
    base = path.rstrip("/")
    model.pipeline.write().overwrite().save(f"{base}/pipeline")
    meta = {"variant": model.variant, "medians": model.medians, "feature_names": model.feature_names, "slot_names": model.slot_names}
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").text(f"{base}/meta")


def load_model(path: str) -> RatingModel:
    base = path.rstrip("/")
    meta = json.loads(SparkSession.getActiveSession().read.text(f"{base}/meta").first()[0])
    medians = {c: tuple(v) for c, v in meta["medians"].items()}
    return RatingModel(meta["variant"], PipelineModel.load(f"{base}/pipeline"), medians, meta["feature_names"], meta["slot_names"])
