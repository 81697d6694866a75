"""L1 logistic paths of all strengths and folds at once.

A step is one pass over the rows: a task works out the losses, gradients and curvatures of all problems from one product of its rows
and all weights, and returns their sums. The driver moves all problems (proximal Newton steps, halved where the loss doesn't fall
enough, columns scaled), so that ten passes or so do, however rows and columns look. Some strengths are solved first; the others
start from the nearest of them. Problems that no longer move leave the passes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 1024
#: Sums that a task returns in one pass; more problems than that go in turns.
SUMS = 1 << 18


@dataclass
class Path:
    """grid; weights (strength, fold, feature) and intercepts (strength, fold), the last fold being all rows; passes over the data."""

    grid: list[float]
    weights: np.ndarray
    intercepts: np.ndarray
    passes: int


def _arrays(batches: Iterator[pa.RecordBatch], p: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for lo in range(0, len(batch), ROWS):
            part = batch.slice(lo, ROWS)
            x = np.column_stack([np.ones(len(part)), *[part.column(2 + j).to_numpy(zero_copy_only=False) for j in range(p)]]) if p else np.ones((len(part), 1))
            yield part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False), x


def _summed(rows: DataFrame, task, size: int) -> np.ndarray:
    """Sums over all tasks of the arrays of `size` numbers that task(batches) returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = task(batches)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(got)], ["place", "value"])

    total, found = np.zeros(size), rows.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    total[found["place"].to_numpy()] = found["value"].to_numpy()
    return total


def _nearby(now: np.ndarray, slope: np.ndarray, curved: np.ndarray, shrink: np.ndarray, sweeps: int = 500, tolerance: float = 1e-9) -> np.ndarray:
    """The weights that minimise each problem's quadratic model around `now` plus shrink |w|: coordinate descent, all problems together."""
    w, slope = now.copy(), slope.copy()
    steep = np.maximum(np.einsum("mjj->mj", curved), 1e-12)
    for _ in range(sweeps):
        most = 0.0
        for j in range(w.shape[1]):
            moved = steep[:, j] * w[:, j] - slope[:, j]
            new = np.sign(moved) * np.maximum(np.abs(moved) - shrink[:, j], 0) / steep[:, j]
            change = new - w[:, j]
            slope += curved[:, :, j] * change[:, None]
            w[:, j] = new
            most = max(most, float(np.abs(change).max()))
        if most <= tolerance:
            break
    return w


def l1_path(rows: DataFrame, y: str, columns: list[str], grid: list[float], k: int, fold: str = "fold", max_iter: int = 500, tolerance: float = 1e-5, coarse: int = 8) -> Path:
    """For each C of the grid and each fold that is left out (and for all rows): the weights that minimise the mean log loss plus
    |w|_1 / (C n), n being the rows that are learned from; the intercept isn't penalised.

    rows: fold 0 .. k-1, y 0/1 and columns without nulls; persisted by the caller. A constant column has weight 0."""
    p, m = len(columns), len(grid) * (k + 1)
    data = rows.select(F.col(fold).cast("int").alias("fold"), F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns)])
    q = p + 1

    def gram(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((k, q, q))
        for f, _, x in _arrays(batches, p):
            for i in np.unique(f):
                own = x[f == i]
                out[i] += own.T @ own
        return out.ravel()

    grams = _summed(data, gram, k * q * q).reshape(k, q, q)
    whole = grams.sum(axis=0)
    n = whole[0, 0]
    mean = whole[0, 1:] / max(n, 1)
    spread = np.sqrt(np.maximum(np.diag(whole)[1:] / max(n, 1) - mean**2, 0))
    constant = spread <= 1e-9 * np.maximum(np.abs(mean), 1e-300)
    scale = np.where(constant, 1.0, spread)
    left_out = np.tile(np.append(np.arange(k), -1), len(grid))
    sizes = np.append(whole[0, 0] - grams[:, 0, 0], whole[0, 0])
    trained = np.maximum(np.tile(sizes, len(grid)), 1)
    shrink = np.concatenate([np.zeros((m, 1)), 1 / (np.repeat(np.asarray(grid, float), k + 1) * trained)[:, None] / scale[None, :]], axis=1)
    shrink[:, 1:][:, constant] = np.inf
    upper = np.triu_indices(q)
    at, passes = np.zeros((m, q)), 0

    def sums(models: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean log losses, their gradients and Hessians at the weights."""
        nonlocal passes
        passes += 1
        folds = left_out[models]

        def task(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros((len(models), 1 + q + len(upper[0])))
            for f, target, x in _arrays(batches, p):
                z = np.column_stack([x[:, :1], (x[:, 1:] - mean) / scale]) if p else x
                at = z @ weights.T
                learned = f[:, None] != folds[None, :]
                small = np.exp(-np.abs(at))
                out[:, 0] += np.einsum("rm,rm->m", np.maximum(at, 0) - target[:, None] * at + np.log(1 + small), learned)
                risk = np.where(at >= 0, 1, small) / (1 + small)
                out[:, 1 : q + 1] += ((risk - target[:, None]) * learned).T @ z
                out[:, q + 1 :] += (risk * (1 - risk) * learned).T @ (z[:, upper[0]] * z[:, upper[1]])
            return out.ravel()

        got = _summed(data, task, len(models) * (1 + q + len(upper[0]))).reshape(len(models), -1) / trained[models][:, None]
        curved = np.zeros((len(models), q, q))
        curved[:, upper[0], upper[1]] = curved[:, upper[1], upper[0]] = got[:, q + 1 :]
        return got[:, 0], got[:, 1 : q + 1], curved

    def penalty(models: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.where(weights == 0, 0, np.where(np.isinf(shrink[models]), 0, shrink[models]) * np.abs(weights)).sum(axis=1)

    def solve(models: np.ndarray) -> None:
        now = at[models].copy()
        trial, value, bar, target = now, np.full(len(models), np.inf), np.full(len(models), np.inf), now.copy()
        for _ in range(max_iter):
            if not len(models):
                return
            loss, slope, curved = sums(models, trial)
            found = loss + penalty(models, trial)
            good = found <= value + 1e-4 * bar + 1e-12
            now = np.where(good[:, None], trial, now)
            value = np.where(good, found, value)
            target = np.where(good[:, None], target, (now + trial) / 2)
            bar = np.where(good, bar, bar / 2)
            if good.any():
                own = models[good]
                target[good] = _nearby(now[good], slope[good], curved[good], shrink[own])
                bar[good] = (slope[good] * (target[good] - now[good])).sum(axis=1) + penalty(own, target[good]) - penalty(own, now[good])
            at[models] = target
            going = np.abs(target - now).max(axis=1) > tolerance * np.maximum(1, np.abs(target).max(axis=1))
            models, now, value, bar, target = models[going], now[going], value[going], bar[going], target[going]
            trial = target

    def in_turns(models: np.ndarray) -> None:
        most = max(SUMS // (1 + q + len(upper[0])), 1)
        for lo in range(0, len(models), most):
            solve(models[lo : lo + most])

    strengths = np.repeat(np.arange(len(grid)), k + 1)
    order = np.argsort(np.argsort(grid, kind="stable"), kind="stable")[strengths]
    first = order % coarse == coarse // 2 if len(grid) > coarse else np.zeros(m, bool)
    in_turns(np.flatnonzero(first))
    if first.any():
        for i in np.flatnonzero(~first):  # from the nearest strength of the same fold
            near = np.flatnonzero(first & (left_out == left_out[i]))
            at[i] = at[near[np.argmin(np.abs(order[near] - order[i]))]]
    in_turns(np.flatnonzero(~first))
    weights = at[:, 1:] / scale
    intercepts = at[:, 0] - weights @ mean
    return Path(list(grid), weights.reshape(len(grid), k + 1, p), intercepts.reshape(len(grid), k + 1), passes)


def held_out_scores(rows: DataFrame, path: Path, y: str, columns: list[str], fold: str = "fold", bins: int | None = None) -> DataFrame:
    """(c, fold, y, p) of each row under the weights that it wasn't learned with, a row for each strength. bins: rounds scores down to
    so many steps, so that they add up before they are shuffled; scores of one step are tied."""
    p, grid = len(columns), path.grid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f, target, x in _arrays(batches, p):
            z = np.einsum("rj,crj->rc", x[:, 1:], path.weights[:, f, :]) + path.intercepts[:, f].T
            score = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            score = np.floor(score * bins) / bins if bins else score
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.asarray(grid, float), len(f))), pa.array(np.repeat(f, len(grid)).astype(np.int32)), pa.array(np.repeat(target, len(grid)).astype(np.int32)), pa.array(score.ravel())], ["c", "fold", "y", "p"])

    data = rows.select(F.col(fold).cast("int").alias("fold"), F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns)])
    return data.mapInArrow(run, "c double, fold int, y int, p double")
