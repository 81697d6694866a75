"""Aggregations of event tables to one row for each entity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import Registry
from .select import ilike_any

HOUR = 3_600_000_000


def hours(later: Column, earlier: Column) -> Column:
    """Fractional hours between two timestamps."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(float(HOUR))


def attrition_counts(df: DataFrame, keys: list[str], approximate: bool = False) -> DataFrame:
    """Rows, and distinct entities at each grain (exact, or HyperLogLog++ estimates)."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[count(k).alias(f"n_{k}") for k in keys])


_PICK = {"min": F.min, "max": F.max, "avg": F.avg, "sum": F.sum, "count": F.count}


def pivot_codes(fact: DataFrame, key: str, item: str, value: str, spec: dict[str, tuple[list[str], str]]) -> DataFrame:
    """One row for each key; spec: column -> (item codes, min | max | avg | sum | count)."""
    return fact.groupBy(key).agg(*[_PICK[how](F.when(F.col(item).isin(codes), F.col(value))).alias(name) for name, (codes, how) in spec.items()])


def entity_median(df: DataFrame, key: str, column: str, out: str = "median") -> DataFrame:
    """Exact interpolated median for each key; NULLs don't count."""
    return df.groupBy(key).agg(F.percentile(column, F.lit(0.5)).alias(out))


def range_slope(fact: DataFrame, keys: list[str], ts: str, value: str, min_n: int = 3, min_h: float = 0.5) -> DataFrame:
    """(max - min of the value) an hour between the first and last time; NULL under min_n samples or at min_h hours or less."""
    found = fact.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(value).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"), (F.max(value) - F.min(value)).alias("span"))
    h = hours(F.col("last"), F.col("first"))
    return found.select(*keys, "n", F.when((F.col("n") >= min_n) & (h > min_h), F.col("span") / h).alias("slope"))


def signed_slope(fact: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """(last - first value) an hour; 0 where the times are one. Equal times take the greatest value last and the least first."""
    found = fact.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min(F.struct(ts, value)).alias("first"), F.max(F.struct(ts, value)).alias("last")
    )
    h = hours(F.col(f"last.{ts}"), F.col(f"first.{ts}"))
    return found.select(*keys, F.when(h > 0, (F.col(f"last.{value}") - F.col(f"first.{value}")) / h).otherwise(0.0).alias("slope"))


def window_endpoints(fact: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """The window form of signed_slope's pieces: first and last value and the hours between, once for each entity."""
    part = Window.partitionBy(*keys)
    first = part.orderBy(F.asc(ts), F.asc(value)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = fact.where(F.col(value).isNotNull())
    return rows.select(*keys, F.first_value(value).over(first).alias("first_value"), F.last_value(value).over(first).alias("last_value"), hours(F.max(ts).over(part), F.min(ts).over(part)).alias("span_h")).dropDuplicates()


def daily_max(fact: DataFrame, key: str, ts: str, columns: dict[str, Column]) -> DataFrame:
    """Maxima for each entity and day."""
    return fact.groupBy(key, F.date_trunc("day", F.col(ts)).cast("date").alias("day")).agg(*[F.max(c).alias(n) for n, c in columns.items()])


def persistence(daily: DataFrame, key: str, thresholds: dict[str, float], days: int, cohort: DataFrame | None = None) -> DataFrame:
    """persistent_<column>: at least `days` days at the threshold or more; persistent_any; entities without days have 0."""
    flags = [(F.count_if(F.col(c) >= t) >= days).cast("int").alias(f"persistent_{c}") for c, t in thresholds.items()]
    out = daily.groupBy(key).agg(*flags)
    names = [f"persistent_{c}" for c in thresholds]
    if cohort is not None:
        out = cohort.select(key).join(out, key, "left").fillna(0, names)
    return out.withColumn("persistent_any", F.greatest(*names, F.lit(0)))


def prefix_flags(dx: DataFrame, key: str, code: str, groups: dict[str, list[str]]) -> DataFrame:
    """0/1 flags for each key: a code of the group's prefixes is there. Other columns of dx aren't read."""
    any_of = lambda ps: F.coalesce(F.max(F.greatest(*[F.col(code).startswith(p).cast("int") for p in ps], F.lit(0))), F.lit(0))
    return dx.groupBy(key).agg(*[any_of(ps).alias(n) for n, ps in groups.items()])


def text_flags(df: DataFrame, key: str, column: str, groups: dict[str, list[str]], within: Column | None = None) -> DataFrame:
    """0/1 flags for each key: a text of the group's patterns is there, within the condition if one is given."""
    on = lambda ps: ilike_any(F.col(column), ps) if within is None else ilike_any(F.col(column), ps) & within
    return df.groupBy(key).agg(*[F.coalesce(F.max(on(ps).cast("int")), F.lit(0)).alias(n) for n, ps in groups.items()])


def outcome_summary(df: DataFrame, outcomes: list[str]) -> DataFrame:
    """Total of each outcome, and rows with both of each two."""
    both = [F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias(f"{a}_and_{b}") for i, a in enumerate(outcomes) for b in outcomes[i + 1 :]]
    only = [F.count_if((F.col(a) == 1) & ~(F.coalesce(F.col(b), F.lit(0)) == 1)).alias(f"{a}_not_{b}") for a in outcomes for b in outcomes if a != b]
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).cast("long").alias(f"n_{c}") for c in outcomes], *both, *only)


def temporal_aggregate(fact: DataFrame, cohort: DataFrame, key: str, ts: str, t0: str, item: str, value: str, specs: list[dict]) -> DataFrame:
    """One column for each spec (name, item, how, hours): first, last, min, max, mean, median, slope (last - first an hour),
    trend (least squares an hour) or count of the item's values within the hours after the anchor. Ties in time go by value.

    A spec may name its anchor, a column of the cohort, t0 by default. All anchors go through one join and one shuffle of the facts;
    facts in no spec's window are left out before it. A null anchor has no window."""
    anchors = sorted({s.get("anchor") or t0 for s in specs})
    h = {a: f"_h{i}" for i, a in enumerate(anchors)}
    within = lambda s: (F.col(item) == s["item"]) & F.col(h[s.get("anchor") or t0]).between(0, s["hours"])
    rows = fact.join(cohort.select(key, *anchors), key).withColumns({n: hours(F.col(ts), F.col(a)) for a, n in h.items()}).where(F.col(value).isNotNull())
    rows = rows.where(reduce(lambda a, b: a | b, [within(s) for s in {(s["item"], s.get("anchor")): s for s in sorted(specs, key=lambda s: s["hours"])}.values()]))

    def column(s: dict) -> Column:
        on, at = within(s), h[s.get("anchor") or t0]
        v, t = F.when(on, F.col(value)), F.when(on, F.struct(at, value))
        first, last = F.min(t), F.max(t)
        span = last[at] - first[at]
        made = {
            "first": lambda: first[value], "last": lambda: last[value], "min": lambda: F.min(v), "max": lambda: F.max(v), "mean": lambda: F.avg(v),
            "median": lambda: F.percentile(v, F.lit(0.5)), "count": lambda: F.count(v), "slope": lambda: F.when(span > 0, (last[value] - first[value]) / span),
            "trend": lambda: F.regr_slope(v, F.when(on, F.col(at))),
        }
        return made[s["how"]]().alias(s["name"])

    return cohort.select(key).join(rows.groupBy(key).agg(*[column(s) for s in specs]), key, "left")


def aggregate_registry(fact: DataFrame, cohort: DataFrame, key: str, ts: str, anchor: str, item: str, value: str, registry: Registry, items: dict[str, str] | None = None) -> DataFrame:
    """temporal_aggregate() of the registry's features that have an aggregation and a window, from the cohort's column `anchor` on, or from
    the one that the feature names.

    items: feature -> its item in the facts; a feature that isn't there goes by its own name."""
    timed = [s for s in registry.values() if s.use.role == "feature" and s.measure.how and s.measure.hours is not None]
    specs = [{"name": s.name, "item": (items or {}).get(s.name, s.name), "how": s.measure.how, "hours": s.measure.hours, "anchor": s.measure.anchor} for s in timed]
    return temporal_aggregate(fact, cohort, key, ts, anchor, item, value, specs)


def first_event(df: DataFrame, entity: str, order: list[Column], where: Column | None = None, having: Column | None = None) -> DataFrame:
    """The first row of each entity in the order given. where: filters before ranking; having: filters after it, so that an
    entity is lost if its first row fails. The order has to be total."""
    rows = df if where is None else df.where(where)
    first = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(entity).orderBy(*order))).where("_rank = 1").drop("_rank")
    return first if having is None else first.where(having)
