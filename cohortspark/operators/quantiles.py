"""Exact quantiles without a buffer of a column: selection by counts of ranges.

A first pass gives each group's count and, from sketches, a range of values that each wanted place lies in. Each further pass counts
what lies below and inside the ranges and cuts them at sketched places inside, until they hold few values or can't be cut further;
a last pass sums those to distinct values. All groups and quantiles go through the passes together; buffers have a fixed size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import keep_table

#: Values of a range that aren't cut again, and cuts of a range in a pass.
FEW, CUTS = 10_000, 32


def _place(q: float, n: Column) -> Column:
    return F.lit(q) * (n - 1)


def exact_quantiles(df: DataFrame, by: list[str], value: str, qs: list[float], few: int = FEW, accuracy: int = 10_000) -> DataFrame:
    """(by, q array<double>): for each group the interpolated quantiles of its values that aren't null, as `percentile` gives them;
    null for a group without values. `by` isn't empty. few, accuracy: of an uncut range and of the sketches; they change
    the work only.

    The ranges are stored between passes; a table of less than `few` values a range takes three passes."""
    rows = df.select(*by, F.col(value).cast("double").alias("_v"))
    wide = 3.0 / accuracy
    spots = [x for q in qs for x in (max(q - wide, 0.0), min(q + wide, 1.0))]
    sketch = F.percentile_approx("_v", spots, accuracy)
    found = rows.groupBy(*by).agg(F.count("_v").alias("_n"), sketch.alias("_s"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    # a sketch of few values may be off by a whole one: the ends are widened to the extremes there
    end = lambda i, spot, edge: F.when(F.col("_n") * wide < 2, F.col(edge)).otherwise(F.col("_s")[i]) if 0 < spot < 1 else F.col(edge)
    at = {f"_lo{i}": end(2 * i, spots[2 * i], "_min") for i in range(len(qs))} | {f"_hi{i}": end(2 * i + 1, spots[2 * i + 1], "_max") for i in range(len(qs))}
    ranges = keep_table(found.withColumns(at | {f"_was{i}": F.lit(None).cast("long") for i in range(len(qs))}).drop("_s"), "ranges")
    keys = {f"_k_{b}": F.col(b) for b in by}
    meet = lambda right: rows.join(right.select(*[c.alias(n) for n, c in keys.items()], *[c for c in right.columns if c not in by]), [F.col(b).eqNullSafe(F.col(f"_k_{b}")) for b in by]).drop(*keys)

    while True:
        inside = {i: F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i in range(len(qs))}
        counts = [c for i, x in inside.items() for c in (
            F.count_if(F.col("_v") < F.col(f"_lo{i}")).alias(f"_below{i}"), F.count_if(x).alias(f"_in{i}"),
            F.percentile_approx(F.when(x, F.col("_v")), [k / CUTS for k in range(CUTS + 1)], accuracy).alias(f"_cuts{i}"),
        )]
        first = [F.first(c).alias(c) for c in ("_n", *[f"_{e}{i}" for i in range(len(qs)) for e in ("lo", "hi", "was")])]
        counted = keep_table(meet(ranges).groupBy(*by).agg(*first, *counts), "ranges")
        large = [(F.col(f"_in{i}") > few) & (F.col(f"_lo{i}") < F.col(f"_hi{i}")) & (F.col(f"_was{i}").isNull() | (F.col(f"_in{i}") < F.col(f"_was{i}"))) for i in range(len(qs))]
        still = counted.where(F.greatest(*[x.cast("int") for x in large], F.lit(0)) == 1)
        if still.isEmpty():
            break
        new, room = {}, 1 + 2 * CUTS / accuracy
        for i, q in enumerate(qs):
            # places inside the range of the two values that the quantile lies between, with room for the sketch's error
            share = lambda place, i=i: (place - F.col(f"_below{i}")) / F.greatest(F.col(f"_in{i}") - 1, F.lit(1)) * CUTS
            lo = F.greatest(F.floor(share(F.floor(_place(q, F.col("_n")))) - room), F.lit(0)).cast("int")
            hi = F.least(F.ceil(share(F.ceil(_place(q, F.col("_n")))) + room), F.lit(CUTS)).cast("int")
            new |= {f"_lo{i}": F.when(large[i], F.col(f"_cuts{i}")[lo]).otherwise(F.col(f"_lo{i}")), f"_hi{i}": F.when(large[i], F.col(f"_cuts{i}")[hi]).otherwise(F.col(f"_hi{i}")), f"_was{i}": F.col(f"_in{i}")}
        ranges = keep_table(counted.withColumns(new).select(*by, "_n", *new), "ranges")

    # (group, quantile, distinct value, count) of what is left, and the values at the two places
    own = meet(counted.drop(*[f"_cuts{i}" for i in range(len(qs))]))
    lower = {i: F.floor(_place(q, F.col("_n"))) - F.col(f"_below{i}") for i, q in enumerate(qs)}
    upper = {i: F.ceil(_place(q, F.col("_n"))) - F.col(f"_below{i}") for i, q in enumerate(qs)}
    of = F.explode(F.filter(F.array(*[F.when(inside[i], F.struct(F.lit(i).alias("i"), lower[i].alias("lower"), upper[i].alias("upper"))) for i in range(len(qs))]), lambda x: x.isNotNull()))
    values = own.select(*by, "_v", of.alias("x")).groupBy(*by, "x.i", "_v").agg(F.count(F.lit(1)).alias("c"), F.first("x.lower").alias("lower"), F.first("x.upper").alias("upper"))
    upto = F.sum("c").over(Window.partitionBy(*by, "i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    at_place = lambda c: F.min(F.when(F.col("upto") > F.col(c), F.col("_v")))
    ends = values.withColumn("upto", upto).groupBy(*by, "i").agg(at_place("lower").alias("a"), at_place("upper").alias("b"))
    pairs = ends.groupBy(*by).agg(*[F.max(F.when(F.col("i") == i, F.struct("a", "b"))).alias(f"_x{i}") for i in range(len(qs))])
    right = pairs.select(*[c.alias(n) for n, c in keys.items()], *[f"_x{i}" for i in range(len(qs))])
    out = counted.join(right, [F.col(b).eqNullSafe(F.col(f"_k_{b}")) for b in by], "left")

    def interpolated(i: int, q: float) -> Column:
        place, a, b = _place(q, F.col("_n")), F.col(f"_x{i}.a"), F.col(f"_x{i}.b")
        return F.when((F.floor(place) == F.ceil(place)) | (a == b), a).otherwise((F.ceil(place) - place) * a + (place - F.floor(place)) * b)

    return out.select(*by, F.array(*[interpolated(i, q) for i, q in enumerate(qs)]).alias("q"))
