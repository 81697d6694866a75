"""Forms that scale, beside the plain ones: bootstrap by one sort, quantiles by selection, the l1 path, staged tables and others."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pyspark.ml.classification import LogisticRegression

from cohortspark.functions import derive
from cohortspark.functions.tails import lattice_tail
from cohortspark.operators import bootstrap, cleaning, cumulative, evaluate, models, quantiles, stats
from cohortspark.operators.l1path import held_out_scores, l1_path
from cohortspark.sources import tables


def plain_replicates(rows, replicates, seed=42):
    """auc, average precision and brier of each replicate of (y, p, own) rows, from one sorted pass each."""
    y, p, own = (np.array(x) for x in zip(*rows, strict=True))
    w = bootstrap.poisson_weights(own.astype(np.int64).view(np.uint64), replicates, seed).astype(float)
    out = {}
    for r in range(replicates):
        pos, neg = w[:, r] * y, w[:, r] * (1 - y)
        if not pos.sum() or not neg.sum():
            continue
        cum_pos = cum_neg = area = step = 0.0
        for t in sorted(set(p), reverse=True):
            a, b = pos[p == t].sum(), neg[p == t].sum()
            area += b * (cum_pos + a / 2)
            cum_pos, cum_neg = cum_pos + a, cum_neg + b
            step += a * cum_pos / max(cum_pos + cum_neg, 1)
        out[r] = area / pos.sum() / neg.sum(), step / pos.sum(), (pos * (p - 1) ** 2 + neg * p**2).sum() / (pos + neg).sum()
    return out


@pytest.mark.parametrize("rows", [10**6, 37])
def test_bootstrap_by_one_sort(spark, rows):
    rng = np.random.default_rng(3)
    held = [(i, int(rng.random() < 0.4), float(rng.choice([0.5, round(rng.random(), 2), rng.random()])), [None, "a", "b"][i % 3]) for i in range(400)] + [(1000, 1, 0.2, "single")]
    df = spark.createDataFrame(held, "id long, y int, p double, g string").repartition(3)
    got = {(r["g"], r["rep"]): (r["auc"], r["average_precision"], r["brier"]) for r in bootstrap.replicate_metrics(df, "y", "p", "id", 25, ["g"], rows=rows).collect()}
    own = {r["id"]: r["h"] for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    want = {(g, r): v for g in (None, "a", "b") for r, v in plain_replicates([(y, p, own[i]) for i, y, p, x in held if x == g], 25).items()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    assert bootstrap.replicate_metrics(df.limit(0), "y", "p", "id", 5, []).count() == 0


def test_scores_that_many_rows_share_are_drawn_once(spark):
    rng = np.random.default_rng(4)
    held = [(i, int(rng.random() < 0.3), float(rng.choice([0.2, 0.4, 0.8]))) for i in range(2400)] + [(3000 + i, i % 2, p) for i, p in enumerate([0.1, 0.3, 0.3, 0.9, 0.5])]
    df = spark.createDataFrame(held, "id long, y int, p double").repartition(3)
    own = {r["id"]: r["h"] for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    rows = [(y, p, own[i]) for i, y, p in held]
    parted = bootstrap._ranged(spark.createDataFrame(rows, "_y int, _p double, _own long"), bootstrap.RANGE)
    got = sorted(tuple(r) for r in parted.groupBy("_p").agg(F.max("_part").alias("part"), F.max("_hot").alias("hot"), F.count_distinct("_salt").alias("n")).collect())
    # totals are enough for those that many rows share: no task goes through their rows again
    assert got == [(0.1, 0, False, 1), (0.2, 1, True, 1), (0.3, 2, False, 1), (0.4, 3, True, 1), (0.5, 4, False, 1), (0.8, 5, True, 1), (0.9, 6, False, 1)]
    found = {r["rep"]: (r["auc"], r["average_precision"], r["brier"]) for r in bootstrap.replicate_metrics(df, "y", "p", "id", 21, []).collect()}
    want = plain_replicates(rows, 21)
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_poisson_weights_are_the_steps_of_the_distribution():
    own = np.arange(20_000, dtype=np.uint64)
    w = bootstrap.poisson_weights(own, 3, 7)
    reps = bootstrap.scatter(np.arange(3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7))
    u = (bootstrap.scatter(own[:, None] ^ reps[None, :]) >> np.uint64(11)) * 2.0**-53
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    assert (w == np.searchsorted(steps, u, "right")).all() and abs(w.mean() - 1) < 0.02


@pytest.mark.parametrize(("few", "accuracy"), [(10_000, 10_000), (20, 50), (1, 20)])
def test_quantiles_by_selection(spark, few, accuracy):
    rng = np.random.default_rng(few)
    rows = [("a", float(x)) for x in rng.normal(size=3001)] + [("ties", float(x)) for x in rng.integers(0, 4, 2000)] + [(None, 7.0)] * 500 + [("one", -0.0), ("none", None), ("two", 1.0), ("two", 4.0), ("huge", 1e300), ("huge", -1e300), ("huge", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    qs = [0.0, 0.01, 0.25, 0.5, 0.975, 1.0]
    got = {r["g"]: r["q"] for r in quantiles.exact_quantiles(df, ["g"], "v", qs, few, accuracy).collect()}
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, qs))).alias("q")).collect()}
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == (want[g] if want[g] is not None else [None] * len(qs)), g
    assert quantiles.exact_quantiles(df.limit(0), ["g"], "v", qs).count() == 0


def test_operators_with_quantiles_by_selection(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal()), None if i % 3 else float(i % 7), None, ["x", None][i % 2]) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, a double, b double, none double, g string")
    same = lambda f: [sorted(map(repr, f(m).collect())) for m in (None, cleaning.RANGES)]
    for a, b in (
        same(lambda m: cleaning.winsorize(df, ["a", "b", "none"], approximate=m)), same(lambda m: cleaning.plausibility_audit(df, {"a": (-1, 1), "b": (0, 9), "none": (0, 1)}, approximate=m)),
        same(lambda m: stats.table1_continuous(df, ["a", "b", "none"], "g", m)), same(lambda m: evaluate.nomogram(df, {"a": 1.0, "b": -2.0}, approximate=m)),
        same(lambda m: cleaning.repair_units(df, {"a": (5.0, 10.0), "none": (1.0, 2.0)}, approximate=m)), same(lambda m: cleaning.apply_imputer(df, cleaning.fit_imputer(df, {"a": "median", "b": "mean", "none": "median"}, m))),
    ):
        assert a == b
    plan = quantiles.exact_quantiles(df, ["g"], "a", [0.5])._jdf.queryExecution().toString()
    assert " percentile(" not in plan.lower() and "collect_list" not in plan.lower()


def test_l1_path_as_single_fits(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 4)) * [1.0, 20.0, 0.1, 1.0] + [0, 100, 3, 0]
    x[:, 3] = 7.0
    y = (rng.random(800) < 1 / (1 + np.exp(-(x[:, 0] - (x[:, 1] - 100) / 15 - 1)))).astype(int)
    df = spark.createDataFrame([(i, int(t), *map(float, r)) for i, (t, r) in enumerate(zip(y, x, strict=True))], "id long, y int, a double, b double, c double, d double")
    names, grid, k = ["a", "b", "c", "d"], [0.002, 0.01, 0.05, 0.2, 1.0, 3.0, 10.0, 30.0, 100.0], 3
    rows = models.with_folds(df, "y", "id", k).persist()
    path = l1_path(rows, "y", names, grid, k)
    for c, f in ((0.01, 0), (0.2, 2), (10.0, 3)):
        part = models.with_vectors(rows.where(F.col("fold") != f), names)
        fit = LogisticRegression(labelCol="y", elasticNetParam=1.0, regParam=1 / (c * part.count()), maxIter=500, tol=1e-10, standardization=False).fit(part)
        at = grid.index(c)
        assert path.weights[at, f] == pytest.approx(fit.coefficients.toArray(), abs=1e-3) and path.intercepts[at, f] == pytest.approx(fit.intercept, abs=2e-2)
    assert (path.weights[..., 3] == 0).all()
    scored = held_out_scores(rows, path, "y", names)
    assert scored.count() == 800 * len(grid) and set(scored.groupBy("c").agg(F.count_distinct("fold").alias("k")).select("k").toPandas()["k"]) == {k}
    picked = {r["feature"]: r for r in models.l1_select(df, "y", names, "id", tuple(grid), k=k).collect()}
    assert {"a", "b"} <= picked.keys() and "d" not in picked and picked["a"]["coef"] > 0 > picked["b"]["coef"]


@pytest.mark.parametrize(("n", "m"), [(1, 1), (2, 5), (4, 4), (6, 3), (7, 8)])
def test_exact_tails_as_enumerated(n, m):
    gaps = []
    for places in itertools.combinations(range(n + m), n):
        i, worst = 0, 0.0
        for t in range(n + m):
            i += t in places
            worst = max(worst, abs(i / n - (t + 1 - i) / m))
        gaps.append(worst)
    for d in sorted(set(gaps)):
        assert lattice_tail(d, n, m) == pytest.approx(sum(g >= d - 1e-12 for g in gaps) / len(gaps), rel=1e-12)


def test_exact_drift(spark):
    a = spark.createDataFrame([(float(i), None) for i in range(6)], "f double, empty double")
    b = spark.createDataFrame([(i + 3.5, 1.0) for i in range(7)], "f double, empty double")
    exact, plain = ({r["feature"]: r for r in stats.ks_drift(a, b, ["f", "empty"], exact_to=n).collect()} for n in (10, 6))
    assert exact["f"]["p"] == pytest.approx(lattice_tail(5 / 7, 6, 7)) and exact["f"]["statistic"] == plain["f"]["statistic"]
    assert plain["f"]["p"] != exact["f"]["p"] and exact["empty"]["p"] is None and exact["empty"]["significant"] == 0


def test_bayesian_ridge():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 3))
    y = 2 + x @ [1.0, -2.0, 0.0] + 0.1 * rng.normal(size=400)

    def of(rows):
        one = np.column_stack([np.ones(rows), x[:rows]])
        return cleaning.bayesian_ridge(one.T @ one, one.T @ y[:rows], float(y[:rows] @ y[:rows]), tolerance=1e-10)

    # the plain form, with the rows at hand
    xc, yc = x - x.mean(axis=0), y - y.mean()
    noise, weight = 1 / y.var(), 1.0
    for _ in range(500):
        inverse = np.linalg.inv(noise * xc.T @ xc + weight * np.eye(3))
        coef = noise * inverse @ xc.T @ yc
        known = 3 - weight * np.trace(inverse)
        weight, noise = (known + 2e-6) / (coef @ coef + 2e-6), (400 - known + 2e-6) / (((yc - xc @ coef) ** 2).sum() + 2e-6)
    assert of(400)[1:] == pytest.approx(coef, abs=1e-6) and of(400)[0] == pytest.approx(y.mean() - x.mean(axis=0) @ coef, abs=1e-6)
    y = rng.normal(size=400)  # nothing to learn from few rows: weights shrink
    few, least = of(8)[1:], np.linalg.lstsq(np.column_stack([np.ones(8), x[:8]]), y[:8], rcond=None)[0][1:]
    assert np.abs(few).sum() < 0.95 * np.abs(least).sum()


def test_rules_meet_each_name_once(spark):
    rules = [{"patterns": ["%ab%"], "lo": 1, "hi": 5}, {"patterns": ["%a%"], "but": ["%x%"], "passes": False, "lo": 0, "hi": 9, "step": {"divide": 10, "over": 20}}]
    rows = [(i, n, float(i % 40)) for i, n in enumerate(["ABc", "cab", "axe", "a", None, "none", "A"] * 30)]
    df = spark.createDataFrame(rows, "id long, name string, v double")
    want = sorted(map(tuple, df.select("id", derive.clean_by_rules(F.col("name"), F.col("v"), rules)).collect()))
    for most in (100, 1):
        out = derive.clean_by_names(df, "name", "v", rules, most=most)
        assert sorted(map(tuple, out.select("id", "clean").collect())) == want and out.columns == ["id", "name", "v", "clean"]
        plan = out._jdf.queryExecution().executedPlan().toString().lower()
        assert "ilike" not in plan and "like" not in plan and "contains(" not in plan


def test_a_failed_replacement_leaves_the_table(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    with pytest.raises(FileNotFoundError):
        tables.read_published(spark, path)
    first = spark.range(10).withColumn("g", F.col("id") % 2)
    assert tables.publish_table(first, path, ["g"]).count() == 10
    bad = first.withColumn("id", F.when(F.col("id") == 9, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="no"):
        tables.publish_table(bad, path)
    old = tables.read_published(spark, path, first.schema)
    assert old.count() == 10
    # read and replaced in one job; who has begun to read keeps the old rows
    tables.publish_table(old.where("id < 3"), path)
    assert tables.read_published(spark, path).count() == 3 and old.count() == 10
    for n in (4, 5):
        tables.publish_table(spark.range(n), path)
    assert tables.read_published(spark, path).count() == 5 and len(tables._pointers(spark, path)) == 2


def test_models_fit_after_curves_in_one_session(spark):
    """What a curve leaves in the session must not keep MLlib's models from being sent to tasks."""
    df = spark.createDataFrame([(i, i % 2, float((i * 7) % 11) + i % 2, i / 60) for i in range(60)], "id long, y int, x double, p double")
    assert evaluate.auc(df, "y", "p", []).count() == 1
    assert models.calibrate(df, "y", ["x"], "id", k=2)[0].count() == 60
    assert models.tune(df, "y", ["x"], "id", ("logistic",), k=2)[0].count() == 1


def test_ranges_are_found_by_halving(spark):
    values = [-1.0, 0.0, 0.5, 1.0, 2.5, 7.0, 8.0, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for n in (0, 1, 2, 3, 7, 8, 9, 1000):
        cuts = [i / 2 for i in range(n)]
        got = [r["k"] for r in df.select(cumulative.cuts_below(cuts, F.col("v")).alias("k")).collect()]
        assert got == [0 if v is None else n if math.isnan(v) else sum(c < v for c in cuts) for v in values]
