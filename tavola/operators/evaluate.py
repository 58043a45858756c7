"""Thresholding and evaluation metrics.

Multi-label results are one long table ``(row_id, label_idx, truth, pred)``;
every metric comes from two grouped aggregates over it: per label (TP/FP/FN,
support) and per row (subset accuracy, sample F1), so no matrix is ever
collected.  Extra ``group_cols`` (split, threshold, fold) evaluate many
settings in the same job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.functions.stats import group_rank, join_group_stats

# The swept thresholds 0.10, 0.15, ..., 0.80 (k / 20 for k = 2..16).
SWEEP_THRESHOLDS = [k / 20 for k in range(2, 17)]


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def row_argmax(probs: DataFrame) -> DataFrame:
    """Per row: highest probability and its label (lowest index on ties)."""
    best = F.min(F.struct((-F.col("prob")).alias("neg"), F.col("label_idx").alias("idx")))
    return probs.groupBy("row_id").agg(F.max("prob").alias("_row_max"), best["idx"].alias("_best_idx"))


def apply_threshold(probs: DataFrame, t: float | Column) -> DataFrame:
    """``pred = prob >= t``; a row with no label at ``t`` gets its arg-max label."""
    t = F.lit(float(t)) if not isinstance(t, Column) else t
    j = join_group_stats(probs, row_argmax(probs), ["row_id"])
    pred = (F.col("prob") >= t) | ((F.col("_row_max") < t) & (F.col("label_idx") == F.col("_best_idx")))
    return j.withColumn("pred", pred.cast("int")).drop("_row_max", "_best_idx")


def multilabel_metrics(long: DataFrame, n_labels: int, group_cols: Sequence[str] = ()) -> DataFrame:
    """One row of multi-label metrics per group.

    Macro averages run over all ``n_labels`` vocabulary labels (labels with no
    rows count as 0); Hamming loss divides by rows x ``n_labels``.
    """
    g = list(group_cols)
    t, p = F.col("truth"), F.col("pred")
    tp, fp, fn = (t * p), ((1 - t) * p), (t * (1 - p))
    per_label = long.groupBy(*g, "label_idx").agg(
        F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"), F.sum(t).alias("support")
    )
    f1_l = _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    lab = per_label.groupBy(*g).agg(
        F.sum("tp").alias("TP"), F.sum("fp").alias("FP"), F.sum("fn").alias("FN"),
        (F.sum(_ratio(F.col("tp"), F.col("tp") + F.col("fp"))) / n_labels).alias("macro_precision"),
        (F.sum(_ratio(F.col("tp"), F.col("tp") + F.col("fn"))) / n_labels).alias("macro_recall"),
        (F.sum(f1_l) / n_labels).alias("macro_f1"),
        _ratio(F.sum(f1_l * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )
    per_row = long.groupBy(*g, "row_id").agg(
        F.sum(tp).alias("tp"), F.sum(fp + fn).alias("err"), F.sum(t).alias("n_true"), F.sum(p).alias("n_pred")
    )
    rows = per_row.groupBy(*g).agg(
        F.avg((F.col("err") == 0).cast("double")).alias("exact_match"),
        (F.sum("err") / (F.count(F.lit(1)) * F.lit(float(n_labels)))).alias("hamming_loss"),
        F.avg(_ratio(2 * F.col("tp"), F.col("n_true") + F.col("n_pred"))).alias("sample_f1"),
        F.avg("n_true").alias("avg_true_labels"),
        F.avg("n_pred").alias("avg_pred_labels"),
        F.count(F.lit(1)).cast("long").alias("rows"),
    )
    if g:
        out = lab.join(rows, g)
    else:
        # Both sides are single-row aggregates: attach the row metrics as scalar subqueries.
        out = lab
        for c in ["exact_match", "hamming_loss", "sample_f1", "avg_true_labels", "avg_pred_labels", "rows"]:
            out = out.withColumn(c, rows.select(c).scalar())
    return out.select(
        *g,
        "exact_match",
        "hamming_loss",
        _ratio(F.col("TP"), F.col("TP") + F.col("FP")).alias("micro_precision"),
        _ratio(F.col("TP"), F.col("TP") + F.col("FN")).alias("micro_recall"),
        _ratio(2 * F.col("TP"), 2 * F.col("TP") + F.col("FP") + F.col("FN")).alias("micro_f1"),
        "macro_precision",
        "macro_recall",
        "macro_f1",
        "weighted_f1",
        "sample_f1",
        "avg_true_labels",
        "avg_pred_labels",
        "rows",
    )


def per_label_table(long: DataFrame, vocab: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1, support per vocabulary label, ranked by F1 desc, support desc, label asc."""
    g = list(group_cols)
    t, p = F.col("truth"), F.col("pred")
    per = long.groupBy(*g, "label_idx").agg(
        F.sum(t * p).alias("tp"), F.sum((1 - t) * p).alias("fp"), F.sum(t * (1 - p)).alias("fn"), F.sum(t).alias("support")
    )
    per = per.join(vocab, "label_idx", "right") if not g else per.join(vocab, "label_idx")
    out = per.select(
        *g,
        "label",
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        F.coalesce(F.col("support"), F.lit(0)).cast("long").alias("support"),
    )
    ranked = group_rank(out, g, [F.col("f1").desc(), F.col("support").desc(), F.col("label").asc()], rank_col="rank")
    return ranked.withColumn("rank", F.col("rank").cast("int"))


def extreme_labels(table: DataFrame, k: int = 15) -> DataFrame:
    """The k lowest and k highest labels of the per-label table."""
    n = table.select(F.max("rank")).scalar()
    return table.withColumn(
        "band", F.when(F.col("rank") <= k, F.lit("highest")).when(F.col("rank") > n - k, F.lit("lowest"))
    ).filter(F.col("band").isNotNull())


def threshold_sweep(probs: DataFrame, n_labels: int, thresholds: Sequence[float] = SWEEP_THRESHOLDS) -> DataFrame:
    """Metrics for every threshold in one job, with the winner flagged.

    The threshold list is a fixed parameter (15 values), exploded onto each
    prediction row; the arg-max fallback needs the row maximum only, computed
    once and joined back.
    """
    j = join_group_stats(probs, row_argmax(probs), ["row_id"])
    ts = F.array(*[F.lit(float(x)) for x in thresholds])
    x = j.withColumn("threshold", F.explode(ts))
    t = F.col("threshold")
    pred = (F.col("prob") >= t) | ((F.col("_row_max") < t) & (F.col("label_idx") == F.col("_best_idx")))
    long = x.withColumn("pred", pred.cast("int"))
    m = multilabel_metrics(long, n_labels, ["threshold"])
    # 15 rows: the ordering window is tiny.
    best = Window.orderBy(F.col("micro_f1").desc(), F.col("sample_f1").desc(), F.col("macro_f1").desc(), F.col("threshold").asc())
    return m.withColumn("is_best", F.row_number().over(best) == 1)


def regression_metrics(df: DataFrame, label: str, prediction: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """E1-E3 (+E13 by group): MAE, RMSE, R2, within 0.25 / 0.50 (percent), rating-scale accuracy."""
    g = list(group_cols)
    err = F.col(prediction) - F.col(label)
    means = df.groupBy(*g).agg(F.avg(label).alias("_mean")) if g else None
    base = join_group_stats(df, means, g) if g else df.withColumn("_mean", df.select(F.avg(label)).scalar())
    agg = base.groupBy(*g).agg(
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.lit(1.0) - F.sum(err * err) / F.sum((F.col(label) - F.col("_mean")) ** 2)).alias("r2"),
        (F.avg((F.abs(err) <= F.lit(0.25)).cast("double")) * 100).alias("within_025"),
        (F.avg((F.abs(err) <= F.lit(0.5)).cast("double")) * 100).alias("within_050"),
        F.count(F.lit(1)).cast("long").alias("rows"),
    )
    return agg.withColumn("rating_scale_accuracy", F.greatest(F.lit(0.0), (F.lit(1.0) - F.col("mae") / F.lit(5.0)) * 100))
