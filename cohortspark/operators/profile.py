"""Profiles and audits of wide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cleaning import long_form, median_of


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, fill_rate): rows that have a value, and their per cent."""
    return long_form(df, {c: {"n": F.count(c), "fill_rate": F.count(c) * F.lit(100.0) / F.count(F.lit(1))} for c in columns})


def cohort_audit(df: DataFrame, labels: list[str], numbers: list[str], key: str, approximate: int | None = None) -> DataFrame:
    """One row: rows, entities, per cent of each label, and mean, least, greatest and median of each number."""
    made = [F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_entities"), *[(F.avg(c) * 100).alias(f"{c}_pct") for c in labels]]
    for c in numbers:
        made += [F.avg(c).alias(f"{c}_mean"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), median_of(c, approximate).alias(f"{c}_median")]
    return df.agg(*made)


def numeric_profile(df: DataFrame, columns: list[str], approximate: int | None = None) -> DataFrame:
    """(feature, missing_pct, median, mean, max); 0 where all is missing."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return long_form(df, {c: {"missing_pct": F.avg(F.col(c).isNull().cast("int")) * 100, "median": zero(median_of(c, approximate)), "mean": zero(F.avg(c)), "max": zero(F.max(c).cast("double"))} for c in columns})


def standardisation_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, std, is_binary, abs_mean, abs_std_off): what a standardised column should have as 0, 1, 0, 0."""
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    # two values at most: none between the least and the greatest
    two = lambda c: (F.count_if((F.col(c) != F.lit(ends[f"lo_{c}"])) & (F.col(c) != F.lit(ends[f"hi_{c}"]))) == 0).cast("int")
    return long_form(df, {c: {"mean": F.avg(c), "std": F.stddev_samp(c), "is_binary": two(c)} for c in columns}).withColumns({"abs_mean": F.abs("mean"), "abs_std_off": F.abs(F.col("std") - 1)})


def class_balance(df: DataFrame, y: str) -> DataFrame:
    """(class, n, rate, weight): balanced weights n / (classes * n of the class)."""
    counts = df.where(F.col(y).isNotNull()).groupBy(F.col(y).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(1))
    total = F.sum("n").over(every)
    return counts.select("class", "n", (F.col("n") / total).alias("rate"), (total / (F.count(F.lit(1)).over(every) * F.col("n"))).alias("weight"))


def missing_patterns(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """((feature, missing_rate, rank), (pattern, n)): a pattern has 1 for each missing column, in order."""
    rates = long_form(df, {c: {"missing_rate": F.avg(F.col(c).isNull().cast("int"))} for c in columns})
    rates = rates.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("missing_rate"), "feature")))
    pattern = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in columns])
    return rates, df.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def importance_pivot(df: DataFrame, feature: str, outcome: str, importance: str, outcomes: list[str], n: int) -> DataFrame:
    """Mean importance by feature, a column for each outcome, and their mean; the n greatest."""
    wide = df.groupBy(F.col(feature).alias("feature")).pivot(outcome, outcomes).agg(F.avg(importance))
    parts = [F.coalesce(F.col(f"`{o}`"), F.lit(0.0)) for o in outcomes]
    mean = sum(parts[1:], parts[0]) / len(parts)
    return wide.withColumn("mean_importance", mean).orderBy(F.desc("mean_importance"), "feature").limit(n)
