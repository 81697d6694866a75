"""Mixing sources to target weights by Poisson replication; DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, stash, uniform

#: the greatest mean of one Poisson draw
BLOCK = 50.0


def poisson_table(mean: Column, most: float) -> Column:
    """P(X <= 0), P(X <= 1), ... for X ~ Poisson(mean), up to where what is left out is under 1e-16 for a mean of `most`."""
    steps = int(most + 12 * math.sqrt(most) + 30)
    first = F.exp(-mean)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(first.alias("term"), first.alias("total"), F.array(first).alias("table")),
        lambda s, i: F.struct(
            (s["term"] * mean / i).alias("term"),
            (s["total"] + s["term"] * mean / i).alias("total"),
            F.concat(s["table"], F.array(s["total"] + s["term"] * mean / i)).alias("table"),
        ),
        lambda s: s["table"],
    )


def source_rates(docs: DataFrame, source: str = "source", weights: dict[str | None, float] | None = None, temperature: float = 2.0, total: float | None = None) -> DataFrame:
    """(source, n_rows, rate) for each source: the mean number of copies of each of its documents.

    weights: target shares by source (a source that isn't listed gets 0); without weights the share of a source of n
    documents is n ** (1 / temperature). total: documents wanted, by default as many as there are.
    A null source is a source of its own; an empty table has no sources."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n_rows"))
    if weights is None:
        share = F.pow(F.col("n_rows").cast("double"), F.lit(1.0 / temperature))
    else:
        share = F.lit(0.0)
        for k, w in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(w))).otherwise(share)
    weighed = stash(counts.withColumn("share", share), "shares")
    sums = weighed.agg(F.sum("share").alias("shares"), F.sum("n_rows").alias("n")).first()
    wanted = float(total if total is not None else sums["n"] or 0)
    rate = F.col("share") / F.lit(float(sums["shares"] or 1)) * F.lit(wanted) / F.col("n_rows")
    return weighed.select("source", "n_rows", rate.alias("rate"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source: str = "source", weights: dict[str | None, float] | None = None, temperature: float = 2.0, total: float | None = None, seed: int = 7, broadcast_rows: int = 10_000) -> DataFrame:
    """docs with each row as often as a Poisson variable of its source's rate says, in a globally shuffled order.

    Adds `copy` (1, 2, ...) and `mix_key` (0 to 1; rows are dealt to partitions by a hash and sorted by it). The variable is
    inverted from a hash of seed and id, so that a rerun gives the same rows; repeated rows of one id get equal counts. Rates
    have no bound: one above `BLOCK` is drawn as the sum of equal Poisson variables with means of at most that. A null
    id hashes as the word null. Columns of docs that are named copy or mix_key are replaced. The rates are broadcast up to
    `broadcast_rows` sources, and joined by a shuffle beyond."""
    docs = docs.drop("copy", "mix_key")
    rates = source_rates(docs, source, weights, temperature, total)
    key, table, blocks, times = fresh_name(docs, "rate_source", "rate_table", "rate_blocks", "times")
    rates = rates.withColumn(blocks, F.greatest(F.ceil(F.col("rate") / BLOCK), F.lit(1)).cast("int"))
    rates = stash(rates.select(F.col("source").alias(key), blocks, poisson_table(F.col("rate") / F.col(blocks), BLOCK).alias(table)), "rates")
    if rates.limit(broadcast_rows + 1).count() <= broadcast_rows:
        rates = F.broadcast(rates)
    u = F.array(uniform(seed, F.col(id_col)))
    more = F.transform(F.sequence(F.lit(2), F.col(blocks)), lambda b: uniform(seed, F.col(id_col), b))
    draws = F.when(F.col(blocks) > 1, F.concat(u, more)).otherwise(u)
    drawn = F.aggregate(draws, F.lit(0), lambda n, x: n + F.size(F.filter(table, lambda p: p <= x)))
    counted = docs.join(rates, F.col(source).eqNullSafe(F.col(key))).withColumn(times, drawn)
    copies = counted.where(F.col(times) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(times))))
    copies = copies.withColumn("mix_key", uniform(seed + 1, F.col(id_col), F.col("copy"))).select(*docs.columns, "copy", "mix_key")
    return copies.repartition("mix_key").sortWithinPartitions("mix_key")
