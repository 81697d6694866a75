"""Joins of a cohort with its facts and feature blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import keep_table


def build_cohort(stays: DataFrame, lookups: list[tuple[DataFrame, str, str]], inner: list[tuple[DataFrame, str]], where: Column) -> DataFrame:
    """Stays joined with the tables that a stay must have (table, key) and with optional lookups (table, key, "left")."""
    out = stays
    for table, key in inner:
        out = out.join(table, key)
    for table, key, how in lookups:
        out = out.join(table, key, how)
    return out.where(where)


def gathered(blocks: list[DataFrame], key: str) -> DataFrame:
    """Blocks with one row for each key as one such block. They are stored one by one and put together by one aggregation: as a chain of
    joins they would all be worked out in one task, which holds the sorts of all of them at once."""
    names = [c for b in blocks for c in b.columns if c != key]
    if len(set(names)) < len(names):
        raise ValueError(f"columns of several blocks: {sorted({c for c in names if names.count(c) > 1})}")
    stored = [keep_table(b.where(F.col(key).isNotNull()), "block") for b in blocks]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stored)
    # dealt first: summed before the shuffle, as many rows as there are would be held, and none saved
    return rows.repartition(key).groupBy(key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])


def assemble(cohort: DataFrame, blocks: list[DataFrame], key: str, zero_fill: list[str]) -> DataFrame:
    """The cohort with the columns of blocks with one row for each key; the flags in zero_fill are 0 where a block has no row."""
    if not blocks:
        return cohort.fillna(0, zero_fill)
    return cohort.join(gathered(blocks, key) if len(blocks) > 1 else blocks[0], key, "left").fillna(0, zero_fill)


def semi(fact: DataFrame, cohort: DataFrame, key: str) -> DataFrame:
    """Rows of fact whose key is in the cohort."""
    return fact.join(cohort.select(key), key, "left_semi")


def exists_in_window(cohort: DataFrame, fact_in_window: DataFrame, key: str, flag: str, predicate: Column | None = None) -> DataFrame:
    """The cohort with a 0/1 flag for an event that satisfies the predicate; events are reduced to keys before the join."""
    rows = fact_in_window if predicate is None else fact_in_window.where(predicate)
    hits = rows.groupBy(key).agg(F.lit(1).alias(flag))
    return cohort.join(hits, key, "left").fillna(0, [flag])


def join_same_time(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of two streams at the same entity and time; both are expected to have one row for each."""
    return a.join(b, keys, "left")


def combine_reduced(cohort: DataFrame, a: DataFrame, b: DataFrame, key: str, value_a: str, value_b: str, factor: float, out: str) -> DataFrame:
    """COALESCE(MIN a, MIN b * factor) for each cohort row; each side is reduced first, so that no n x m product arises."""
    least_a = a.groupBy(key).agg(F.min(value_a).alias("least_a"))
    least_b = b.groupBy(key).agg((F.min(value_b) * factor).alias("least_b"))
    joined = cohort.join(least_a, key, "left").join(least_b, key, "left")
    return joined.withColumn(out, F.coalesce("least_a", "least_b")).drop("least_a", "least_b")
