"""Running totals and ranks over an ordered key, without one task for all rows.

Curves, ranks and drift statistics need counts of all smaller (or greater) values. The rows are summed to distinct values
first; the running total is then taken in ranges of the value and shifted by the totals of the ranges before. Splits and folds
need places in the order of a hash: rows are ranked in buckets of the hash and shifted by the buckets before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import keep_table

#: distinct values that one task may order
MOST = 1_000_000


def ranges_for(df: DataFrame, value: str, most: int = MOST) -> int:
    """How many ranges the values have to be split into for at most about `most` distinct ones in each; one pass over df."""
    return df.agg(F.approx_count_distinct(value).alias("n")).first()["n"] // most + 1


def collapsed(counts: DataFrame, name: str = "distinct") -> tuple[DataFrame, int]:
    """(counts stored, how many ranges they have to be split into): what the rows were summed from is read once, and the stored rows are
    counted from the files' footers. An Observation would count them too, but it stays in the session, which MLlib's fitted models carry
    into their tasks: those can't be sent then."""
    out = keep_table(counts, name)
    return out, out.count() // MOST + 1


def cuts_below(cuts: list[float], value: Column) -> Column:
    """How many of the ascending cuts are less than the value, by halving: a comparison with every cut would cost rows times ranges."""
    if not cuts:
        return F.lit(0)
    steps, held = F.lit([1 << b for b in reversed(range(len(cuts).bit_length()))]), F.lit(cuts)
    further = lambda at, s: (at + s <= len(cuts)) & (value > F.get(held, at + s - 1))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(further(at, s), at + s).otherwise(at))


def running(df: DataFrame, by: list[str], value: str, sums: list[str], descending: bool = False, ranges: int | None = None) -> DataFrame:
    """df (one row for each by and value) with cum_<s> for each s: the total of the rows up to and with this one.

    ranges: into how many parts values are split, by approximate quantiles of the whole table, so that only the parts' totals and
    the rows of one part of a group are windowed at once; with 1 a group is one window partition. None measures what it takes."""
    order = F.desc(value) if descending else F.asc(value)
    ranges = ranges_for(df, value) if ranges is None else ranges
    if ranges == 1:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({f"cum_{s}": F.sum(s).over(w) for s in sums})
    cuts = df.agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 10 * ranges).alias("c")).first()["c"] or []
    part = cuts_below(sorted(set(cuts)), F.col(value))
    parted = df.withColumn("_part", -part if descending else part)
    totals = parted.groupBy(*by, "_part").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(*[F.col(b).alias(f"_b_{b}") for b in by], F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_s_{s}") for s in sums])
    on = [F.col(b).eqNullSafe(F.col(f"_b_{b}")) for b in by] + [F.col("_part") == F.col("_p")]
    w = Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = parted.join(shift, on).withColumns({f"cum_{s}": F.sum(s).over(w) + F.col(f"_s_{s}") for s in sums})
    return out.select(*df.columns, *[f"cum_{s}" for s in sums])


def placed(df: DataFrame, by: str, number: Column, key: str, buckets: int = 4096) -> DataFrame:
    """df with _place (1, 2, ... in the order of number, then key) and _size of each row's group.

    number is a hash in [0, 1). A task ranks the rows of one bucket of a group; what lies before it is a window over the counts,
    `buckets` rows a group at most."""
    parted = df.withColumn("_number", number).withColumn("_bucket", F.floor(F.col("_number") * buckets).cast("int"))
    counts = parted.groupBy(F.col(by).alias("_by"), F.col("_bucket").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("_by")
    before = F.coalesce(F.sum("_n").over(group.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select("_by", "_at", before.alias("_before"), F.sum("_n").over(group).alias("_size"))
    own = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy("_number", key))
    both = parted.join(shift, F.col(by).eqNullSafe(F.col("_by")) & F.col("_bucket").eqNullSafe(F.col("_at")))
    return both.withColumn("_place", own + F.col("_before")).select(*df.columns, "_place", "_size")
