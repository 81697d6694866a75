"""The evaluation of all models on another cohort, at the cut-offs that were found on their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import keep_table
from .evaluate import bootstrap_ci, roc_points, youden

METRICS = ("auc", "average_precision", "brier")


def cutoffs(scored: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """(by, threshold): the cut-off of each model and outcome, to be published for the scoring job."""
    return youden(scored, y, p, by).select(*by, F.col("cutoff").alias("threshold"))


def _curve_metrics(points: DataFrame, by: list[str], cut: Column) -> DataFrame:
    """All metrics of a group from its curve, in one aggregation: nothing here goes back to the rows."""
    t, pos, neg = F.col("threshold"), F.col("pos"), F.col("neg")
    area = F.sum(neg * (F.col("cum_pos") - pos / 2))
    step = F.try_divide(pos, F.col("n_pos")) * F.try_divide(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))
    error = F.sum(pos * (t - 1) * (t - 1) + neg * t * t)
    hit = lambda c: F.coalesce(F.sum(F.when(t >= cut, c)), F.lit(0))
    found = points.groupBy(*by).agg(
        F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"), F.try_divide(area, F.max("n_pos") * F.max("n_neg")).alias("auc"),
        F.sum(step).alias("average_precision"), F.try_divide(error, F.sum(pos + neg)).alias("brier"), hit(pos).alias("tp"), hit(neg).alias("fp"), F.max(cut).alias("cut"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, n_pos, n_neg = (F.col(c) for c in ("tp", "fp", "n_pos", "n_neg"))
    return found.select(*by, (n_pos + n_neg).alias("n"), "n_pos", *METRICS, F.col("cut").alias("threshold"), share(tp, n_pos).alias("sensitivity"), share(n_neg - fp, n_neg).alias("specificity"), share(tp, tp + fp).alias("ppv"), share(n_neg - fp, n_neg - fp + n_pos - tp).alias("npv"))


def validate(scored: DataFrame, y: str, p: str, key: str, by: list[str], thresholds: DataFrame, replicates: int = 1000, vectorised: bool = True, own: DataFrame | None = None) -> DataFrame:
    """One row for each group of `by` (model and outcome): n, n_pos, auc, average_precision and brier with their bootstrap intervals
    (<metric>_lo, _hi), and sensitivity, specificity, ppv and npv at the group's threshold (0.5 where there is none).

    own: (by, auc) of the cohort where the models were made; adds auc_own and auc_change. Groups of a single class have no auc and
    no interval. Rows without a score or an outcome are left out. Names in `by` are the same in all tables and not null."""
    kept = scored.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(*by, key, y, p)
    kept = keep_table(kept, "scored")  # the curve and the intervals read it, and the intervals its scores before
    points = roc_points(kept, y, p, by)
    stored = thresholds.select(*by, F.col("threshold").alias("_cut"))  # a row for each model
    out = _curve_metrics(points.join(stored, by, "left"), by, F.coalesce("_cut", F.lit(0.5)))
    ends = bootstrap_ci(kept, y, p, key, replicates, by, vectorised)
    pick = lambda m, e: F.max(F.when(F.col("metric") == m, F.col(e))).alias(f"{m}_{e}")
    out = out.join(ends.groupBy(*by).agg(*[pick(m, e) for m in METRICS for e in ("lo", "hi")]), by, "left")
    if own is not None:
        out = out.join(own.select(*by, F.col("auc").alias("auc_own")), by, "left").withColumn("auc_change", F.col("auc") - F.col("auc_own"))
    return out
