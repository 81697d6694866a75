"""The l1 path in few passes: its weights meet the conditions of the optimum."""

from __future__ import annotations

import numpy as np

from cohortspark.operators.l1path import l1_path


def test_few_passes_reach_the_optimum(spark):
    rng = np.random.default_rng(11)
    a = rng.normal(size=400)
    x = np.column_stack([a, a + 0.05 * rng.normal(size=400), 50 * rng.normal(size=400) + 900])  # two columns nearly alike, one far off
    y = (rng.random(400) < 1 / (1 + np.exp(3 - 2 * x[:, 0] - x[:, 2] / 900))).astype(int)
    fold = np.arange(400) % 4
    rows = spark.createDataFrame([(int(f), int(t), *map(float, r)) for f, t, r in zip(fold, y, x, strict=True)], "fold int, y int, a double, b double, c double").persist()
    grid = [10 ** (-2 + i / 4) for i in range(20)]
    path = l1_path(rows, "y", ["a", "b", "c"], grid, 4)
    assert path.passes <= 30
    for i, c in enumerate(grid):
        for f in range(5):
            own = fold != f
            w = path.weights[i, f]
            off = 1 / (1 + np.exp(-(x[own] @ w + path.intercepts[i, f]))) - y[own]
            slope, size = off @ x[own] * c, x[own].std(axis=0) * c * own.sum()
            assert abs(off.sum()) < 1e-4 * own.sum()
            assert (np.where(w == 0, np.maximum(np.abs(slope) - 1, 0), np.abs(slope + np.sign(w))) < 1e-4 * np.maximum(size, 1)).all()
    rows.unpersist()
