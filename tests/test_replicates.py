"""Stratified replicates: exact totals, the same counts in any partitions, and intervals beside a plain bootstrap."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import models, replicates


def table(n=1500, seed=5):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.8 * a - 0.5 * b - 0.7)))).astype(int)
    return [(i, int(y[i]), float(a[i]), float(b[i])) for i in range(n)]


def counts(leaves, classes, depth, reps, seed=42):
    """{(class, first column, replicate): count} of all leaves."""
    out, order = {}, sorted(classes)
    for leaf in leaves.collect():
        w = replicates.leaf_weights(order.index(leaf["_y"]), classes[leaf["_y"]], leaf["_leaf"], depth, np.array(leaf["lefts"]), np.array(leaf["nodes"]), np.array(leaf["_n"]), reps, seed)
        for k, x in enumerate(leaf["_x0"]):
            for r in range(reps):
                out[leaf["_y"], x, r] = int(w[r, k])
    return out


@pytest.mark.parametrize("top", [12, 2])
def test_totals_and_partitions(spark, monkeypatch, top):
    monkeypatch.setattr(replicates, "TOP", top)  # deeper levels than the broadcast ones
    df = spark.createDataFrame(table(600), "id long, y int, a double, b double")
    one = counts(*replicates.stratified_leaves(df, "y", ["a", "b"], "id", rows=20), 30)
    two = counts(*replicates.stratified_leaves(df.repartition(7, "b").orderBy(F.desc("a")), "y", ["a", "b"], "id", rows=20), 30)
    assert one == two
    n = {0.0: 0, 1.0: 0}
    for _, y, _, _ in table(600):
        n[float(y)] += 1
    for r in range(30):
        assert {c: sum(v for (y, _, k), v in one.items() if y == c and k == r) for c in n} == n
    drawn = np.array(list(one.values()))
    assert abs(drawn.var() - 1) < 0.05 and abs((drawn == 0).mean() - np.exp(-1)) < 0.02  # about Poisson(1)


def test_repeated_rows_count_as_often_as_they_stand(spark):
    rows = [(1, 1, 0.5, 1.0)] * 300 + [(i, i % 2, float(i), 2.0) for i in range(2, 102)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    leaves, classes, depth = replicates.stratified_leaves(df, "y", ["a", "b"], "id", rows=10)
    assert classes == {0.0: 50, 1.0: 350}
    got = counts(leaves, classes, depth, 200)
    hot = np.array([v for (_, a, _), v in got.items() if a == 0.5])
    assert abs(hot.mean() - 300) < 3 and abs(hot.var() - 300 * 50 / 350) < 15  # binomial(350, 300 / 350)


def test_intervals_beside_a_plain_bootstrap(spark):
    rows = table()
    df = spark.createDataFrame([*rows, (9999, 1, None, 0.0)], "id long, y int, a double, b double")
    got = {r["feature"]: r for r in models.odds_ratios(df, "y", ["a", "b"], "id", replicates=400).collect()}
    x = np.array([[1.0, a, b] for _, _, a, b in rows])
    y = np.array([r[1] for r in rows], float)
    parts, rng, drawn = [np.flatnonzero(y == c) for c in (0, 1)], np.random.default_rng(1), []
    for k in range(401):
        i = np.concatenate([rng.choice(p, len(p)) for p in parts]) if k else np.arange(len(y))
        beta = np.zeros(3)
        for _ in range(12):
            mu = 1 / (1 + np.exp(-x[i] @ beta))
            beta += np.linalg.solve((x[i] * (mu * (1 - mu))[:, None]).T @ x[i] + 1e-3 * np.eye(3), x[i].T @ (y[i] - mu) - 1e-3 * beta)
        drawn.append(beta)
    lo, hi = np.percentile(np.exp(drawn[1:]), [2.5, 97.5], axis=0)
    for k, c in enumerate("ab", 1):
        assert got[c]["coef"] == pytest.approx(drawn[0][k], abs=1e-6)
        assert got[c]["lo"] == pytest.approx(lo[k], rel=0.04) and got[c]["hi"] == pytest.approx(hi[k], rel=0.04)


def test_no_rows(spark):
    df = spark.createDataFrame([], "id long, y int, a double")
    assert models.odds_ratios(df, "y", ["a"], "id", replicates=5).collect() == []
