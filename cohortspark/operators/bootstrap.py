"""Bootstrap intervals of all replicates at once, without a table of rows and replicates.

Rows are dealt into ranges of the score. A task keeps the weights of all replicates for some rows of its range as a matrix, adds them
up by score and goes down the range once for what it holds of each replicate. A range's share of the area needs only the totals of
the ranges above, and so do the terms of precision when the range is gone through again with them. What is shuffled is the input,
twice, and a few numbers for each range and replicate.

A score that fills several ranges by itself, or that many rows share where there are few scores, is a part of its own and is dealt
over several tasks: ties need nothing but their totals, so their weights are drawn once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import keep_table

#: Rows of a range, of a matrix of weights, and of what is drawn at once (a processor's cache holds it).
RANGE, CHUNK, BLOCK = 40_000, 2_000, 64
#: Up to how many distinct scores are counted, and rows of one from which it is a part of its own (its totals then cost less than a
#: second drawing of its weights).
COUNTED, TIED = 4_000, 500
_STEPS = np.array([math.ceil(x * 2.0**53) for x in np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])], np.uint64)
_CELLS = np.arange(4096, dtype=np.uint64) << np.uint64(41)
#: Poisson counts by the first 12 of 53 bits; _EDGE where a step lies inside a cell.
_COUNT, _EDGE = np.searchsorted(_STEPS, _CELLS, "right").astype(np.uint8), np.uint8(255)
_COUNT[np.searchsorted(_STEPS, _CELLS + np.uint64((1 << 41) - 1), "right") != _COUNT] = _EDGE


def scatter(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with every bit spread (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def poisson_weights(own: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """(row, replicate) Poisson(1) counts that depend on the row's number, the replicate and the seed only."""
    reps = scatter(np.arange(replicates, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    out, u, half = np.empty((len(own), replicates), np.uint8), *(np.empty((BLOCK, replicates), np.uint64) for _ in range(2))
    for lo in range(0, len(own), BLOCK):
        rows, w = own[lo : lo + BLOCK, None], out[lo : lo + BLOCK]
        x, t = u[: len(rows)], half[: len(rows)]
        # scatter() in place; its last step leaves the first 31 bits as they are
        np.bitwise_xor(rows, reps[None, :], out=x)
        np.bitwise_xor(x, np.right_shift(x, np.uint64(30), out=t), out=x)
        np.multiply(x, np.uint64(0xBF58476D1CE4E5B9), out=x)
        np.bitwise_xor(x, np.right_shift(x, np.uint64(27), out=t), out=x)
        np.multiply(x, np.uint64(0x94D049BB133111EB), out=x)
        np.take(_COUNT, np.right_shift(x, np.uint64(52), out=t).view(np.int64), out=w, mode="clip")
        edge = np.nonzero(w == _EDGE)
        last = x[edge]
        w[edge] = np.searchsorted(_STEPS, (last ^ (last >> np.uint64(31))) >> np.uint64(11), "right")
    return out


def _by_score(rows: pd.DataFrame, replicates: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(scores, positive weights, negative weights) of some scores (score, replicate), each score once, from the greatest down."""
    rows = rows.sort_values(["_p", "_y"], ascending=False)
    p, y, own = rows["_p"].to_numpy(float), rows["_y"].to_numpy(float) > 0, rows["_own"].to_numpy(np.int64).view(np.uint64)
    held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    for lo in range(0, len(p), CHUNK):
        t, pos = p[lo : lo + CHUNK], y[lo : lo + CHUNK]
        w = poisson_weights(own[lo : lo + CHUNK], -(-replicates // 8) * 8, seed)
        new = np.append(True, t[1:] != t[:-1])
        # rows of one score and outcome are added up as bytes, eight replicates in a word: 16 rows of at most 12 don't overflow
        runs = np.flatnonzero(new | np.append(True, pos[1:] != pos[:-1]) | (np.arange(len(t)) % 16 == 0))
        w = np.add.reduceat(w.view(np.uint64), runs, axis=0).view(np.uint8)[:, :replicates]
        starts, t = np.flatnonzero(new[runs]), t[new]
        n = np.add.reduceat(w, starts, axis=0, dtype=np.int64).astype(float)
        up = np.add.reduceat(w * pos[runs][:, None], starts, axis=0, dtype=np.int64).astype(float)
        down = n - up
        if held is not None and held[0][0] == t[0]:
            up[0] += held[1][0]
            down[0] += held[2][0]
        elif held is not None:
            yield held
        held = t[-1:], up[-1:], down[-1:]
        if len(t) > 1:
            yield t[:-1], up[:-1], down[:-1]
    if held is not None:
        yield held


def _totals(rows: pd.DataFrame, by: list[str], replicates: int, seed: int) -> pd.DataFrame:
    pos, neg, area, brier = (np.zeros(replicates) for _ in range(4))
    for t, up, down in _by_score(rows, replicates, seed):
        above = pos + np.cumsum(up, axis=0)
        area += (down * (above - up / 2)).sum(axis=0)
        brier += (up * ((t - 1) ** 2)[:, None] + down * (t**2)[:, None]).sum(axis=0)
        pos, neg = above[-1], neg + down.sum(axis=0)
    head = rows.iloc[:1][[*by, "_part", "_hot"]]
    return head.assign(pos=[pos], neg=[neg], area=[area], brier=[brier])


def _precision(rows: pd.DataFrame, above: pd.DataFrame, by: list[str], replicates: int, seed: int) -> pd.DataFrame:
    """The sum of up * precision over the scores of a range, not yet divided by the number of positives."""
    if rows.empty or above.empty:
        return rows.iloc[:0][[*by, "_part"]].assign(step=[])
    pos, neg, step = np.array(above["above_pos"].iloc[0], float), np.array(above["above_neg"].iloc[0], float), np.zeros(replicates)
    for _, up, down in _by_score(rows, replicates, seed):
        cum_pos, cum_neg = pos + np.cumsum(up, axis=0), neg + np.cumsum(down, axis=0)
        step += (up * cum_pos / np.maximum(cum_pos + cum_neg, 1)).sum(axis=0)
        pos, neg = cum_pos[-1], cum_neg[-1]
    return rows.iloc[:1][[*by, "_part"]].assign(step=[step])


def _ranged(df: DataFrame, rows: int) -> DataFrame:
    """df with _part, _hot and _salt: ranges of _p of about `rows` rows, by cuts of the whole table; a score that is several cuts, or
    one of few that many rows share, is a part of its own, dealt by _own into as many as it has `rows`."""
    size = df.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("_p").alias("scores")).first()
    ranges = size["n"] // rows + 1
    cuts = df.agg(F.percentile_approx("_p", [k / ranges for k in range(1, ranges)], 10 * ranges).alias("c")).first()["c"] or [] if ranges > 1 else []
    often = {c: cuts.count(c) + 1 for c in set(cuts) if cuts.count(c) > 1}
    if size["scores"] <= COUNTED:
        shared = df.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(TIED, rows))
        often |= {r["_p"]: r["n"] // rows + 1 for r in shared.collect()}  # about COUNTED rows at most
    bounds = sorted({*cuts, *often})
    if not bounds:
        return df.withColumns({"_part": F.lit(0), "_hot": F.lit(False), "_salt": F.lit(0)})
    held, parts = np.array(bounds), np.array([often.get(c, 0) for c in bounds] + [0])  # 0 for a bound that isn't a part of its own

    @F.pandas_udf("_part int, _hot boolean, _salt int")
    def place(p: pd.Series, own: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(held, p.to_numpy())
        dealt = np.where(held[np.minimum(at, len(held) - 1)] == p.to_numpy(), parts[at], 0)
        return pd.DataFrame({"_part": 2 * at + (dealt > 0), "_hot": dealt > 0, "_salt": own.to_numpy() % np.maximum(dealt, 1)})

    return df.withColumn("_at", place("_p", "_own")).select(*df.columns, "_at.*")


def replicate_metrics(df: DataFrame, y: str, p: str, key: str, replicates: int, by: list[str], seed: int = 42, rows: int = RANGE) -> DataFrame:
    """(by, rep, auc, average_precision, brier) of replicates whose rows count Poisson(1) times, drawn by a hash of the key;
    replicates of a single class are left out. df has no nulls in y and p; rows: of a range, which changes the work only."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = "".join(f"`{b}` {kinds[b]}, " for b in by)
    parted = _ranged(df.select(*by, F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_p"), F.xxhash64(key).alias("_own")), rows)
    arrays = ", ".join(f"{c} array<double>" for c in ("pos", "neg", "area", "brier"))
    found = parted.groupBy(*by, "_part", "_salt").applyInPandas(lambda x: _totals(x, by, replicates, seed), f"{names}_part int, _hot boolean, {arrays}")
    zipped = F.posexplode(F.arrays_zip("pos", "neg", "area", "brier")).alias("rep", "x")
    cells = found.select(*by, "_part", "_hot", zipped).groupBy(*by, "_part", "_hot", "rep").agg(*[F.sum(f"x.{c}").alias(c) for c in ("pos", "neg", "area", "brier")])
    higher = Window.partitionBy(*by, "rep").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(higher), F.lit(0.0)).alias(f"above_{c}")
    cells = keep_table(cells.select("*", before("pos"), before("neg")), "replicates")

    listed = F.sort_array(F.collect_list(F.struct("rep", "above_pos", "above_neg")))
    above = cells.where("not _hot").groupBy(*by, "_part").agg(listed.alias("x")).select(*by, "_part", "x.above_pos", "x.above_neg")
    own = parted.where("not _hot").drop("_hot", "_salt").groupBy(*by, "_part")
    steps = own.cogroup(above.groupBy(*by, "_part")).applyInPandas(lambda a, b: _precision(a, b, by, replicates, seed), f"{names}_part int, step array<double>")
    steps = steps.select(*by, F.posexplode("step").alias("rep", "step"))
    cum_pos, cum_neg = F.col("above_pos") + F.col("pos"), F.col("above_neg") + F.col("neg")
    tied = cells.where("_hot").select(*by, "rep", F.coalesce(F.col("pos") * F.try_divide(cum_pos, cum_pos + cum_neg), F.lit(0.0)).alias("step"))
    steps = steps.union(tied).groupBy(*by, "rep").agg(F.sum("step").alias("step"))

    # pairs with what lies above; those within a score of its own part count half
    area: Column = F.when(F.col("_hot"), F.col("pos") * F.col("neg") / 2).otherwise(F.col("area")) + F.col("above_pos") * F.col("neg")
    sums = cells.groupBy(*by, "rep").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(area).alias("area"), F.sum("brier").alias("brier")).where("n_pos > 0 and n_neg > 0")
    names = {f"_k_{c}": F.col(c) for c in [*by, "rep"]}
    right = steps.select(*[c.alias(n) for n, c in names.items()], "step")
    both = sums.join(right, [c.eqNullSafe(F.col(n)) for n, c in names.items()]).drop(*names)
    return both.select(*by, "rep", (F.col("area") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"), (F.col("step") / F.col("n_pos")).alias("average_precision"), (F.col("brier") / (F.col("n_pos") + F.col("n_neg"))).alias("brier"))
