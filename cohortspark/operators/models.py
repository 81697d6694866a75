"""Model selection, fitting, calibration, scoring and attribution on Spark ML."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import keep_table
from .cleaning import hash_number
from .cumulative import placed
from .evaluate import auc
from .l1path import held_out_scores, l1_path
from .replicates import logistic_replicates, stratified_leaves

#: Rows of a part that tune() keeps, and up to which it fits more than two models at once.
PART, MANY = 250_000, 4_000_000


def with_folds(df: DataFrame, y: str, key: str, k: int, salt: str = "fold") -> DataFrame:
    """fold 0 .. k-1, dealt in turn within each outcome in the order of a hash."""
    dealt = placed(df, y, hash_number(F.col(key), salt=salt), key)
    return dealt.withColumn("fold", F.pmod("_place", F.lit(k)).cast("int")).drop("_place", "_size")


def with_vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error").transform(df)


def balanced(df: DataFrame, y: str) -> DataFrame:
    """weight n / (2 n_c), from one small aggregation."""
    n = {r[y]: r["count"] for r in df.groupBy(y).count().collect()}
    weight = reduce(lambda c, kv: F.when(F.col(y) == kv[0], sum(n.values()) / (len(n) * kv[1])).otherwise(c), n.items(), F.lit(1.0))
    return df.withColumn("weight", weight)


def probability(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("p", vector_to_array("probability")[1])


def l1_select(df: DataFrame, y: str, columns: list[str], key: str, grid: tuple[float, ...], k: int = 5, most: int = 12, max_iter: int = 500, bins: int | None = None) -> DataFrame:
    """(feature, coef, best_c, mean_auc): L1 logistic path over C, k folds, the smallest C within one standard error of the best
    mean AUC, with the weights of all rows; the features with coefficients, at most `most` by weight. lambda is 1 / (C n). All
    strengths and folds are fitted together, a pass over the rows for each step (l1_path). bins: see held_out_scores()."""
    data = with_folds(df.select(key, y, *columns).dropna(), y, key, k).persist()
    path = l1_path(data, y, columns, list(grid), k, max_iter=max_iter)
    found = auc(held_out_scores(data, path, y, columns, bins=bins), "y", "p", ["c", "fold"]).collect()  # a row for each strength and fold
    data.unpersist()
    scores = {c: [r["auc"] for r in found if r["c"] == c and r["auc"] is not None] for c in grid}
    mean = {c: float(np.mean(s)) if s else 0.5 for c, s in scores.items()}
    best = max(grid, key=lambda c: (mean[c], -c))
    spread = float(np.std(scores[best], ddof=1) / np.sqrt(len(scores[best]))) if len(scores[best]) > 1 else 0.0
    chosen = min(c for c in grid if mean[c] >= mean[best] - spread)
    coef = path.weights[path.grid.index(chosen), k]
    kept = sorted(((f, float(w)) for f, w in zip(columns, coef, strict=True) if w), key=lambda x: (-abs(x[1]), x[0]))[:most]
    return df.sparkSession.createDataFrame([(f, w, float(chosen), mean[chosen]) for f, w in kept], "feature string, coef double, best_c double, mean_auc double")


def learners(y: str, seed: int = 42) -> dict[str, tuple]:
    """Estimators with small default grids."""
    common = {"labelCol": y, "weightCol": "weight"}
    lr, dt = LogisticRegression(**common, maxIter=50), DecisionTreeClassifier(**common, seed=seed)
    rf, gb = RandomForestClassifier(**common, seed=seed), GBTClassifier(**common, seed=seed, maxIter=10)
    grid = lambda e, **ps: (lambda g: g.build())(reduce(lambda g, kv: g.addGrid(getattr(e, kv[0]), kv[1]), ps.items(), ParamGridBuilder()))
    return {"logistic": (lr, grid(lr, regParam=[0.001, 0.1])), "tree": (dt, grid(dt, maxDepth=[3, 5])), "forest": (rf, grid(rf, numTrees=[10, 20])), "boosting": (gb, grid(gb, maxDepth=[2, 3]))}


def tune(df: DataFrame, y: str, columns: list[str], key: str, names: tuple[str, ...] = ("logistic", "tree", "forest", "boosting"), k: int = 5, parallelism: int = 4) -> tuple[DataFrame, dict]:
    """((model, mean_auc), fitted models): each learner's grid by k-fold AUC with balanced weights, the best of it fitted to all rows.

    The rows are stored and kept once, in parts of PART in the order of fold and key; a fold is a filter over them that skips what it
    leaves out. All models of a fold are scored in one pass, and their areas are exact and by the probability (raw predictions of trees are
    the weights of leaves, which don't rank rows). MLlib keeps a copy of the rows for each fit, so `parallelism` fits run at once up to
    MANY rows and two beyond."""
    spark = df.sparkSession
    rows = keep_table(df.select(key, y, *columns).dropna(), "tuned")
    n = rows.count()  # from the files' footers
    dealt = with_folds(balanced(rows, y), y, key, k).repartition(max(spark.sparkContext.defaultParallelism, n // PART + 1), key)
    data = with_vectors(dealt.sortWithinPartitions("fold", key), columns).select(y, "fold", "weight", "features").persist()
    tried = {f"{name}:{i}": (name, estimator, ps) for name in names for estimator, grid in [learners(y)[name]] for i, ps in enumerate(grid)}
    areas: dict[str, list[float]] = {t: [] for t in tried}
    with ThreadPool(parallelism if n <= MANY else min(parallelism, 2)) as pool:

        def fitted(train: DataFrame, which: list[str]) -> dict:
            fit = inheritable_thread_target(spark)(lambda t: tried[t][1].fit(train, tried[t][2]))
            return dict(zip(which, pool.map(fit, which, chunksize=1), strict=True))

        for f in range(k):
            long = score(data.where(F.col("fold") == f), fitted(data.where(F.col("fold") != f), list(tried)), None, [y])
            for r in auc(long, y, "p", ["model"]).collect():  # a row for each model
                if r["auc"] is not None:
                    areas[r["model"]].append(r["auc"])
        mean = {t: float(np.mean(a)) if a else 0.5 for t, a in areas.items()}
        best = {name: max((t for t in tried if tried[t][0] == name), key=mean.__getitem__) for name in names}
        models = fitted(data, list(best.values()))
    data.unpersist()
    out = spark.createDataFrame([(name, mean[t]) for name, t in best.items()], "model string, mean_auc double")
    return out, {name: models[t] for name, t in best.items()}


def calibrate(df: DataFrame, y: str, columns: list[str], key: str, k: int = 3, estimator=None) -> tuple[DataFrame, list]:
    """((key, y, p) averaged over k cross-fitted pairs, the pairs): a model is fitted on the other folds and its scores are
    made isotonic on the fold itself. estimator: any classifier of MLlib that gives a probability; logistic by default."""
    estimator = estimator or LogisticRegression(labelCol=y, maxIter=50)
    data = with_folds(with_vectors(df.select(key, y, *columns).dropna(), columns), y, key, k).persist()
    pairs = []
    for f in range(k):
        model = estimator.fit(data.where(F.col("fold") != f))
        pairs.append((model, IsotonicRegression(labelCol=y, featuresCol="p").fit(probability(model, data.where(F.col("fold") == f)).select("p", F.col(y).cast("double")))))
    out = data
    for f, (model, iso) in enumerate(pairs):
        raw = probability(model, out).drop("rawPrediction", "probability", "prediction")
        out = iso.transform(raw).withColumnRenamed("prediction", f"_c{f}").drop("p")
    mean = reduce(lambda a, b: a + b, [F.col(f"_c{f}") for f in range(k)]) / k
    out = keep_table(out.select(key, y, mean.alias("p")), "calibrated")  # before the folds are let go
    data.unpersist()
    return out, pairs


def linear_score(coefficients: dict[str, float], intercept: float) -> Column:
    z = reduce(lambda a, kv: a + F.coalesce(F.col(kv[0]).cast("double"), F.lit(0.0)) * kv[1], coefficients.items(), F.lit(intercept))
    return 1 / (1 + F.exp(-z))


def score(df: DataFrame, models: dict[str, Column | PipelineModel], thresholds: DataFrame | None, ids: list[str]) -> DataFrame:
    """(ids, model, p, predicted): all models' scores in long form, at the stored thresholds (0.5 where there is none)."""
    wide = df
    for name, m in models.items():
        wide = wide.withColumn(name, m) if isinstance(m, Column) else probability(m, wide).withColumnRenamed("p", name).drop("rawPrediction", "probability", "prediction")
    long = wide.select(*ids, *models).unpivot(ids, list(models), "model", "p")
    if thresholds is not None:
        long = long.join(thresholds.select("model", "threshold"), "model", "left")
    else:
        long = long.withColumn("threshold", F.lit(None).cast("double"))
    t = F.coalesce("threshold", F.lit(0.5))
    return long.select(*ids, "model", "p", (F.col("p") >= t).cast("int").alias("predicted"))


def attribute(df: DataFrame, coefficients: dict[str, float], key: str) -> tuple[DataFrame, DataFrame]:
    """((key, a contribution coef * (x - mean) for each feature), (feature, mean_abs, rank)); means come from one pass."""
    means = df.agg(*[F.avg(c).alias(c) for c in coefficients]).first().asDict()
    shares = df.select(key, *[((F.col(c) - F.lit(float(means[c] or 0.0))) * w).alias(c) for c, w in coefficients.items()])
    ranks = shares.select([F.avg(F.abs(c)).alias(c) for c in coefficients]).unpivot([], list(coefficients), "feature", "mean_abs")
    return shares, ranks.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("mean_abs"), "feature")))


def attribution_report(df: DataFrame, coefficients: dict[str, float], key: str, top: int = 3) -> DataFrame:
    """(place, feature, mean_abs, key, total, contribution, value): the `top` features by mean absolute contribution, with what
    they add for the row of the highest risk (the least key of equal ones) and its raw values."""
    shares, ranks = attribute(df, coefficients, key)
    total = reduce(lambda a, b: a + b, [F.col(c) for c in coefficients])
    worst = shares.withColumn("total", total).where("total is not null").orderBy(F.desc("total"), key).limit(1)
    own = worst.select(key, "total", F.explode(F.create_map(*[x for c in coefficients for x in (F.lit(c), F.col(c))])).alias("feature", "contribution"))
    raw = df.join(worst.select(key), key, "left_semi").select(F.explode(F.create_map(*[x for c in coefficients for x in (F.lit(c), F.col(c).cast("double"))])).alias("feature", "value"))
    # one row for each feature
    return ranks.where(F.col("rank") <= top).join(own, "feature").join(raw, "feature").select(F.col("rank").alias("place"), "feature", "mean_abs", key, "total", "contribution", "value")


def odds_ratios(df: DataFrame, y: str, columns: list[str], key: str, replicates: int = 500, steps: int = 12, ridge: float = 1e-3, seed: int = 42) -> DataFrame:
    """(feature, coef, odds_ratio, lo, hi): logistic fit with bootstrap intervals (2.5 and 97.5 %, interpolated).

    A replicate draws as many rows of each class as the table has, with replacement (see replicates.py); rows with a NULL are left
    out. All rows are fitted first, and the replicates start from there. A table of no rows has no odds ratios."""
    leaves, classes, depth = stratified_leaves(df, y, columns, key)
    out: list[tuple] = []
    if classes:
        whole = logistic_replicates(leaves, classes, depth, len(columns), 0, np.zeros(len(columns) + 1), steps, ridge, seed)[0]
        drawn = logistic_replicates(leaves, classes, depth, len(columns), replicates, whole, steps, ridge, seed)[1:]
        lo, hi = np.percentile(np.exp(drawn), [2.5, 97.5], axis=0)
        out = [(c, float(w), float(np.exp(w)), float(lo[i]), float(hi[i])) for i, (c, w) in enumerate(zip(columns, whole[1:], strict=True), 1)]
    return df.sparkSession.createDataFrame(out, "feature string, coef double, odds_ratio double, lo double, hi double")


def thresholds_table(spark: SparkSession, thresholds: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(list(thresholds.items()), "model string, threshold double")
