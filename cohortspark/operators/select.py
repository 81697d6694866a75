"""Cohort selection, predicates and projections."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def code_cohort(dx: DataFrame, rules: list[tuple[str, str, str]], keys: list[str], version: str = "version", code: str = "code") -> DataFrame:
    """Distinct keys of the rows that match a rule (version, "is" or "starts", code)."""
    match = {"is": lambda c: F.col(code) == c, "starts": lambda c: F.col(code).startswith(c)}
    return dx.where(reduce(lambda a, b: a | b, [(F.col(version) == v) & match[kind](c) for v, kind, c in rules])).select(keys).distinct()


def ilike_any(column: Column, patterns: Iterable[str], but: Iterable[str] = ()) -> Column:
    """True if the column matches any of the patterns, ignoring case, and none of `but`; NULL for NULL."""
    found = reduce(lambda a, b: a | b, [F.ilike(column, F.lit(p)) for p in patterns])
    return reduce(lambda a, p: a & ~F.ilike(column, F.lit(p)), but, found)


def text_cohort(df: DataFrame, column: str, include: list[str], exclude: list[str], key: str) -> DataFrame:
    """Distinct keys of the rows whose text holds one of `include` and none of `exclude`."""
    wild = lambda xs: [f"%{x}%" for x in xs]
    return df.where(ilike_any(F.col(column), wild(include), wild(exclude))).select(key).distinct()


def in_window(fact: DataFrame, anchor: DataFrame, key: str, ts: str, t0: str, lo: str, hi: str, closed: bool = True) -> DataFrame:
    """Rows of fact between t0 + lo and t0 + hi of their entity (interval texts, lo may be negative); with closed=False the
    end doesn't belong. The anchor keeps its columns; the join is by key alone, so that its size decides how it runs."""
    after = F.col(ts) >= F.col(t0) + F.expr(f"interval '{lo}'")
    end = F.col(t0) + F.expr(f"interval '{hi}'")
    return fact.join(anchor, key).where(after & ((F.col(ts) <= end) if closed else (F.col(ts) < end)))


def plausible(column: Column, lo: float, hi: float, not_in: Iterable[float] = ()) -> Column:
    """The value if it is within [lo, hi] and not a sentinel, else NULL."""
    ok = column.between(lo, hi)
    bad = [F.lit(x) for x in not_in]
    return F.when(ok & ~column.isin(*bad) if bad else ok, column)


def align_columns(df: DataFrame, renames: dict[str, str], allowed: list[str]) -> DataFrame:
    """Renames, then keeps the allowed columns that exist, in the order of `allowed`."""
    renamed = df.withColumnsRenamed(renames)
    return renamed.select([c for c in allowed if c in renamed.columns])


def drop_sparse(df: DataFrame, max_missing: float = 0.3, keep: Iterable[str] = ()) -> DataFrame:
    """Drops columns of which more than max_missing is NULL, but for those in keep; one pass over the data."""
    kept = set(keep)
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns]).first()
    return df.select([c for c in df.columns if c in kept or (shares[c] or 0) <= max_missing])


def align_space(df: DataFrame, features: list[str], fill: float | None = None, keep: list[str] | None = None) -> DataFrame:
    """The training features in their order, as doubles; an absent one is NULL (imputer) or `fill` (model)."""
    absent = F.lit(fill).cast("double")
    return df.select(*(keep or []), *[(F.col(c).cast("double") if c in df.columns else absent).alias(c) for c in features])


_NUMBERS = ("int", "bigint", "double", "float", "smallint", "tinyint")


def model_matrix(df: DataFrame, drop: Iterable[str], protected: Iterable[str]) -> DataFrame:
    """Numeric columns without ids; protected flags are integers with NULL as 0."""
    gone, flags = set(drop), set(protected)
    kept = [c for c, t in df.dtypes if c not in gone and (t in _NUMBERS or t.startswith("decimal") or c in flags)]
    return df.select([F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) if c in flags else F.col(c) for c in kept])
