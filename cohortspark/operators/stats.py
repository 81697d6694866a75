"""Baseline tables, tests and drift between cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import chi2_tail, exact_kolmogorov, kolmogorov_tail
from .cleaning import RANGES, quantiles_of
from .cumulative import collapsed, running
from .quantiles import exact_quantiles

OVERALL = "overall"


def melt(df: DataFrame, ids: list[str], values: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long; values as doubles."""
    return df.select(*ids, *[F.col(v).cast("double") for v in values]).unpivot(ids, values, name, value)


def _grouped(df: DataFrame, group: str) -> DataFrame:
    """Each row in its group and in the whole."""
    return df.withColumn("grp", F.explode(F.array(F.lit(OVERALL), F.col(group).cast("string"))))


def table1_continuous(df: DataFrame, columns: list[str], group: str, approximate: int | str | None = None) -> DataFrame:
    """(feature, grp, n, missing, median, q1, q3) overall and by group."""
    long, qs = _grouped(melt(df, [group], columns), group), [0.5, 0.25, 0.75]
    counts = F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("missing")
    if approximate == RANGES:
        found = exact_quantiles(long, ["feature", "grp"], "value", qs).select(F.col("feature").alias("_f"), F.col("grp").alias("_g"), "q")
        own = long.groupBy("feature", "grp").agg(*counts)
        out = own.join(found, (F.col("feature") == F.col("_f")) & F.col("grp").eqNullSafe(F.col("_g")))
    else:
        out = long.groupBy("feature", "grp").agg(*counts, quantiles_of("value", qs, approximate).alias("q"))
    return out.select("feature", "grp", "n", "missing", *[F.try_element_at("q", F.lit(i + 1)).alias(c) for i, c in enumerate(("median", "q1", "q3"))])


def table1_categorical(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """(feature, level, grp, n, pct): levels by group; NULL is a level of its own and doesn't count in the per cent."""
    long = df.select(F.col(group).alias("_g"), *[F.col(c).cast("string") for c in columns]).unpivot(["_g"], columns, "feature", "level")
    counts = _grouped(long, "_g").groupBy("feature", "level", "grp").agg(F.count(F.lit(1)).alias("n"))
    known = F.sum(F.when(F.col("level").isNotNull(), F.col("n"))).over(Window.partitionBy("feature", "grp"))
    return counts.withColumn("pct", F.when(F.col("level").isNotNull(), F.col("n") * F.lit(100.0) / known))


def kruskal(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """(feature, n, groups, h, p): rank test with mid-ranks and the correction for ties."""
    long = melt(df.where(F.col(group).isNotNull()), [group], columns).where("value is not null")
    cells = long.groupBy("feature", "value", F.col(group).alias("grp")).agg(F.count(F.lit(1)).alias("c"))
    cells, ranges = collapsed(cells)
    values = cells.groupBy("feature", "value").agg(F.sum("c").alias("t"))
    ranks = running(values, ["feature"], "value", ["t"], ranges=ranges).withColumn("rank", F.col("cum_t") - (F.col("t") - 1) / 2)
    ties = ranks.groupBy("feature").agg(F.sum("t").alias("n"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    sums = cells.join(ranks.select("feature", "value", "rank"), ["feature", "value"]).groupBy("feature", "grp").agg(F.sum(F.col("rank") * F.col("c")).alias("r"), F.sum("c").alias("m"))
    parts = sums.groupBy("feature").agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"), F.count(F.lit(1)).alias("groups"))
    n = F.col("n")
    raw = 12.0 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    fix = 1 - F.col("ties") / (F.pow(n, F.lit(3)) - n)
    out = parts.join(ties, "feature").select("feature", "n", "groups", F.when(fix > 0, raw / fix).alias("h"))
    return out.withColumn("p", chi2_tail(F.col("h"), F.col("groups") - 1))


def chi2(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """(feature, statistic, dof, p): independence of each column and the group; rows with NULLs in either are left out."""
    long = df.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("g"), *[F.col(c).cast("string") for c in columns]).unpivot(["g"], columns, "feature", "level").where("level is not null")
    cells = long.groupBy("feature", "level", "g").agg(F.count(F.lit(1)).alias("o"))
    over = lambda *by: F.sum("o").over(Window.partitionBy("feature", *by))
    cells = cells.withColumns({"row_n": over("level"), "col_n": over("g"), "n": over()})
    expected = F.col("row_n") * F.col("col_n") / F.col("n")
    # cells without rows aren't there: they add their expectation, so that all of them make sum(o^2 / e) - n
    out = cells.groupBy("feature").agg((F.sum(F.col("o") * F.col("o") / expected) - F.first("n")).alias("statistic"), ((F.count_distinct("level") - 1) * (F.count_distinct("g") - 1)).alias("dof"))
    return out.withColumn("p", chi2_tail(F.col("statistic"), F.col("dof")))


def ks_drift(a: DataFrame, b: DataFrame, features: list[str], alpha: float = 0.05, least: int = 5, exact_to: int = 0) -> DataFrame:
    """(feature, n_a, n_b, statistic, p, significant): two-sample test for each feature; under `least` values in either cohort
    the statistic and p are NULL and nothing is significant.

    exact_to: where neither cohort has more values of a feature than this, p is exact (that of samples without ties), else
    asymptotic; its work grows with the product of the two numbers, once for each feature."""
    long = melt(a, [], features).withColumn("in_a", F.lit(1)).union(melt(b, [], features).withColumn("in_a", F.lit(0))).where("value is not null")
    values = long.groupBy("feature", "value").agg(F.sum("in_a").alias("a"), F.sum(1 - F.col("in_a")).alias("b"))
    values, ranges = collapsed(values)
    n = values.groupBy("feature").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    curves = running(values, ["feature"], "value", ["a", "b"], ranges=ranges).join(n, "feature")
    gap = F.max(F.abs(F.try_divide("cum_a", "n_a") - F.try_divide("cum_b", "n_b")))
    out = curves.groupBy("feature", "n_a", "n_b").agg(gap.alias("gap"))
    enough = (F.col("n_a") >= least) & (F.col("n_b") >= least)
    out = out.select("feature", "n_a", "n_b", F.when(enough, F.col("gap")).alias("statistic"))
    p = F.when(F.col("statistic").isNotNull(), kolmogorov_tail(F.col("statistic"), F.col("n_a"), F.col("n_b")))
    if exact_to:
        small = F.greatest("n_a", "n_b") <= exact_to
        out = out.withColumn("_p", exact_kolmogorov(F.when(small, F.col("statistic")), F.col("n_a"), F.col("n_b")))
        return out.withColumn("p", F.when(small, F.col("_p")).otherwise(p)).drop("_p").withColumn("significant", F.coalesce(F.col("p") < alpha, F.lit(False)).cast("int"))
    return out.withColumn("p", p).withColumn("significant", F.coalesce(F.col("p") < alpha, F.lit(False)).cast("int"))


def drift_summary(ks: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """(totals, the features with the greatest statistics)."""
    totals = ks.agg(F.count(F.lit(1)).alias("n_features"), F.sum("significant").alias("n_significant"), F.max("statistic").alias("max_statistic"))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("statistic"), "feature"))
    return totals, ks.withColumn("rank", rank).where(F.col("rank") <= top)
