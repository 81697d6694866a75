"""Evaluation of scored tables: curves, cut-offs, calibration, net benefit, intervals, nomograms and reports.

Scores are summed to distinct values first, so that what is sorted is bounded by the number of distinct scores."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bootstrap import replicate_metrics
from .cleaning import RANGES, column_quantiles, hash_number, quantiles_of
from .cumulative import collapsed, ranges_for, running


def roc_points(df: DataFrame, y: str, p: str, by: list[str], weight: str | None = None, ranges: int | None = None) -> DataFrame:
    """(by, threshold, pos, neg, cum_pos, cum_neg, n_pos, n_neg, tpr, fpr) at each distinct score, from the greatest down.

    ranges: see running(); where it is None, the distinct scores are stored and counted meanwhile."""
    w = F.col(weight) if weight else F.lit(1)
    counts = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(p).alias("threshold")).agg(F.sum(w * F.col(y)).alias("pos"), F.sum(w * (1 - F.col(y))).alias("neg"))
    if ranges is None:
        counts, ranges = collapsed(counts)
    out = running(counts, by, "threshold", ["pos", "neg"], descending=True, ranges=ranges)
    if ranges == 1:
        part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
        out = out.withColumns({"n_pos": F.sum("pos").over(part), "n_neg": F.sum("neg").over(part)})
    else:  # no task holds a whole group
        keys = {f"_n_{b}": F.col(b) for b in by} or {"_n_": F.lit(1)}
        totals = counts.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
        out = out.join(totals, [c.eqNullSafe(F.col(n)) for n, c in keys.items()]).drop(*keys)
    return out.withColumns({"tpr": F.try_divide("cum_pos", "n_pos"), "fpr": F.try_divide("cum_neg", "n_neg")})


def auc(df: DataFrame, y: str, p: str, by: list[str], weight: str | None = None, ranges: int | None = None) -> DataFrame:
    """(by, auc): the chance that a positive row scores above a negative one, ties counting half; NULL for a single class."""
    points = roc_points(df, y, p, by, weight, ranges)
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2))
    return points.groupBy(*by).agg(F.try_divide(area, F.max("n_pos") * F.max("n_neg")).alias("auc"))


def average_precision(df: DataFrame, y: str, p: str, by: list[str], weight: str | None = None, ranges: int | None = None) -> DataFrame:
    points = roc_points(df, y, p, by, weight, ranges)
    step = F.try_divide(F.col("pos"), F.col("n_pos")) * F.try_divide(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))
    return points.groupBy(*by).agg(F.sum(step).alias("average_precision"))


def brier(df: DataFrame, y: str, p: str, by: list[str], weight: str | None = None) -> DataFrame:
    e = F.pow(F.col(p) - F.col(y), F.lit(2))
    return df.groupBy(*by).agg((F.avg(e) if weight is None else F.try_divide(F.sum(e * F.col(weight)), F.sum(weight))).alias("brier"))


def youden(df: DataFrame, y: str, p: str, by: list[str], ranges: int | None = None) -> DataFrame:
    """(by, cutoff, j): the greatest score of the greatest tpr - fpr, at most 1; 0.5 where there is a single class."""
    points = roc_points(df, y, p, by, ranges=ranges).withColumn("j", F.col("tpr") - F.col("fpr"))
    best = points.groupBy(*by).agg(F.max(F.struct("j", "threshold")).alias("best"))
    cutoff = F.when(F.col("best.j").isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.col("best.threshold")))
    return best.select(*by, cutoff.alias("cutoff"), F.col("best.j").alias("j"))


def metrics_at(df: DataFrame, y: str, p: str, by: list[str], threshold: Column) -> DataFrame:
    """(by, tp, fp, tn, fn, sensitivity, specificity, ppv, npv, f1, accuracy); 0 for an empty denominator."""
    hit, pos = F.col(p) >= threshold, F.col(y) == 1
    cells = df.groupBy(*by).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & ~pos).alias("tn"), F.count_if(~hit & pos).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return cells.withColumns({"sensitivity": part(tp, tp + fn), "specificity": part(tn, tn + fp), "ppv": part(tp, tp + fp), "npv": part(tn, tn + fn), "f1": part(2 * tp, 2 * tp + fp + fn), "accuracy": part(tp + tn, tp + fp + tn + fn)})


def metrics_by_group(df: DataFrame, y: str, p: str, in_subgroup: Column, by: list[str], least: int = 10) -> DataFrame:
    """Metrics at each population's own cut-off, for all rows ("full") and the subgroup ("sub"); a population of `least` rows or
    fewer, or of a single class, is left out."""
    parts = df.withColumn("population", F.explode(F.when(in_subgroup, F.array(F.lit("full"), F.lit("sub"))).otherwise(F.array(F.lit("full")))))
    keys = [*by, "population"]
    ok = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos")).where((F.col("n") > least) & (F.col("pos") > 0) & (F.col("pos") < F.col("n")))
    parts = parts.join(ok.select(*keys), keys, "left_semi")
    cut = youden(parts, y, p, keys).drop("j")
    scored = parts.join(cut, keys)
    return metrics_at(scored, y, p, [*keys, "cutoff"], F.col("cutoff")).join(auc(parts, y, p, keys), keys)


def poisson1(u: Column) -> Column:
    """A Poisson(1) count from a uniform number."""
    total, out = 0.0, F.lit(0)
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        out = out + (u >= F.lit(total)).cast("int")
    return out


def poisson1_of_hash(*columns: Column, salt: str = "") -> Column:
    """poisson1(hash_number(*columns)), from the hash's eight digits: u >= t where they are no less than those of t * 2^32, rounded up."""
    text = F.concat_ws(":", *[c.cast("string") for c in columns], F.lit(salt))
    steps, total = [], 0.0
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        steps.append(math.ceil(total * 2.0**32))
    digits = F.array(F.substring(F.md5(text.cast("binary")), 1, 8))  # a lambda's variable is worked out once
    count = lambda h: reduce(lambda out, k: F.when(h < f"{steps[k]:08x}", k).otherwise(out), reversed([k for k in range(12) if steps[k] < 1 << 32]), F.lit(sum(s < 1 << 32 for s in steps)))
    return F.transform(digits, count)[0]


def bootstrap_ci(df: DataFrame, y: str, p: str, key: str, replicates: int, by: list[str] | None = None, vectorised: bool = False, seed: int = 42) -> DataFrame:
    """(by, metric, lo, hi) of auc, average_precision and brier: index percentiles int(.025 B) and int(.975 B) of the sorted
    replicates; single-class replicates are left out. Rows count Poisson(1) times, drawn by a hash of key and replicate (columns,
    exact in SQL), or by a hash of the key for all replicates at once in ranges of the score (vectorised, see bootstrap.py).
    All three metrics come from one curve of each replicate. Rows without a score or an outcome are left out."""
    by = by or []
    df = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    keys = [*by, "rep"]
    if vectorised:
        found = replicate_metrics(df, y, p, key, replicates, by, seed)
    else:
        # rows that aren't drawn weigh 0 and add nothing to a curve: a filter would work the hash out twice
        each = df.select(*by, key, y, p, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
        drawn = each.select(*by, y, p, "rep", poisson1_of_hash(F.col(key), F.col("rep"), salt=str(seed)).alias("w"))
        points = roc_points(drawn, y, p, keys, "w", ranges_for(df, p))  # replicates have no other scores
        t, pos, neg = F.col("threshold"), F.col("pos"), F.col("neg")
        area = F.sum(neg * (F.col("cum_pos") - pos / 2))
        step = F.try_divide(pos, F.col("n_pos")) * F.try_divide(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))
        found = points.groupBy(*keys).agg(
            F.try_divide(area, F.max("n_pos") * F.max("n_neg")).alias("auc"), F.sum(step).alias("average_precision"),
            F.try_divide(F.sum(pos * (t - 1) * (t - 1) + neg * t * t), F.sum(pos + neg)).alias("brier"),
        ).where("auc is not null")
    long = found.unpivot(keys, ["auc", "average_precision", "brier"], "metric", "score")
    lists = long.groupBy(*by, "metric").agg(F.sort_array(F.collect_list("score")).alias("s"))
    at = lambda q: F.try_element_at("s", (F.size("s") * F.lit(q)).cast("int") + 1)
    return lists.select(*by, "metric", F.size("s").alias("n_reps"), at(0.025).alias("lo"), F.coalesce(at(0.975), F.array_max("s")).alias("hi"))


def calibration_bins(df: DataFrame, y: str, p: str, by: list[str], n: int = 10) -> DataFrame:
    """(by, bin, n, mean_predicted, observed) of n equal bins of the score; empty ones are left out."""
    b = F.least(F.floor(F.col(p) * n), F.lit(n - 1)).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_predicted"), F.avg(y).alias("observed"))


def decision_curve(df: DataFrame, y: str, p: str, by: list[str], steps: int = 76, step: float = 0.01) -> DataFrame:
    """(by, k, threshold, model, treat_all): net benefit at thresholds 0, step, ... Scores are put into the grid's cells once and
    counted from the top, so that no row meets every threshold. treat_none is 0 everywhere."""
    cell = F.least(F.floor(F.round(F.col(p) / step, 9)), F.lit(steps - 1)).cast("int")
    counts = df.groupBy(*by, cell.alias("k")).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    groups = counts.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    grid = groups.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    full = grid.join(counts, [*by, "k"], "left").fillna(0, ["pos", "neg"])
    out = running(full, by, "k", ["pos", "neg"], descending=True, ranges=1)
    t, n = F.col("k") * F.lit(step), F.col("n_pos") + F.col("n_neg")
    odds = t / (1 - t)
    return out.select(*by, "k", t.alias("threshold"), (F.col("cum_pos") / n - F.col("cum_neg") / n * odds).alias("model"), (F.col("n_pos") / n - F.col("n_neg") / n * odds).alias("treat_all"))


def nomogram(df: DataFrame, coefficients: dict[str, float], top: int = 10, ticks: int = 5, approximate: int | str | None = None) -> DataFrame:
    """(feature, coef, points_max, tick, value, points): the top features by weight, ticks over their 1 to 99 % range; a negative
    weight's points fall with the value."""
    chosen = sorted(coefficients.items(), key=lambda x: (-abs(x[1]), x[0]))[:top]
    most = max(abs(c) for _, c in chosen)
    if approximate == RANGES:
        q = column_quantiles(df, [f for f, _ in chosen], [0.01, 0.99]).groupBy().pivot("feature", [f for f, _ in chosen]).agg(F.first("q"))
    else:
        q = df.agg(*[quantiles_of(f, [0.01, 0.99], approximate).alias(f) for f, _ in chosen])
    rows = q.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(c).alias("coef"), F.lit(abs(c) / most * 100).alias("points_max"), F.col(f).alias("q")) for f, c in chosen])).alias("x")).select("x.*")
    rows = rows.withColumn("tick", F.explode(F.sequence(F.lit(0), F.lit(ticks - 1))))
    share = F.col("tick") / F.lit(float(ticks - 1))
    value = F.col("q")[0] + (F.col("q")[1] - F.col("q")[0]) * share
    return rows.select("feature", "coef", "points_max", "tick", value.alias("value"), (F.col("points_max") * F.when(F.col("coef") < 0, 1 - share).otherwise(share)).alias("points"))


#: The risk levels marked on the total axis.
RISKS = (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)


def risk_points(spark, intercept: float, max_coef: float, risks: tuple[float, ...] = RISKS) -> DataFrame:
    """(risk, total_points) of the risks whose points are within 0 to 100."""
    rows = spark.createDataFrame([(r,) for r in risks], "risk double")
    total = (F.log(F.col("risk") / (1 - F.col("risk"))) - intercept) / max_coef * 100
    return rows.withColumn("total_points", total).where(F.col("total_points").between(0, 100))


def rows_above(df: DataFrame, points: Column, marks: DataFrame, mark: str) -> DataFrame:
    """marks (a few rows) with n_above: how many rows of df have at least so many points. Each row is put between two marks once."""
    at = sorted(r[mark] for r in marks.select(mark).collect())  # the marks of an axis
    passed = F.size(F.filter(F.lit(at), lambda m: points >= m)) if at else F.lit(0)
    counts = {r["k"]: r["count"] for r in df.select(passed.alias("k")).groupBy("k").count().collect()}  # at most one row a mark
    above = F.create_map(*[x for i, m in enumerate(at) for x in (F.lit(m), F.lit(sum(n for k, n in counts.items() if k is not None and k > i)))]) if at else F.lit(None)
    return marks.withColumn("n_above", F.try_element_at(above, F.col(mark)).cast("long")) if at else marks.withColumn("n_above", F.lit(None).cast("long"))


def best_model(metrics: DataFrame, by: str, model: str, score: str) -> DataFrame:
    """The model with the greatest score of each outcome; the first by name of equal ones."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc_nulls_last(score), model))
    return metrics.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_by(df: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group in a total order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rank") <= most).drop("_rank")


def ranked_report(df: DataFrame, order: list[Column], formats: dict[str, str]) -> DataFrame:
    """Rows in report order with their place and formatted columns."""
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))
    return df.withColumn("place", rank).withColumns({c: F.format_string(f, F.col(c)) for c, f in formats.items()}).orderBy("place")


def feature_sets(df: DataFrame, group: str, feature: str) -> DataFrame:
    """(feature, n_groups, in_all): the union of the groups' sets and what is common to all of them."""
    pairs = df.select(group, feature).distinct()
    total = pairs.select(group).distinct().count()
    return pairs.groupBy(F.col(feature).alias("feature")).agg(F.count(F.lit(1)).alias("n_groups")).withColumn("in_all", (F.col("n_groups") == total).cast("int"))


def union_all(dfs: list[DataFrame]) -> DataFrame:
    """Tables stacked by name; a column that one lacks is NULL there."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
