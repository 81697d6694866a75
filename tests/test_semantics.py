"""Edge cases that the cohort scripts depend on, and numeric helpers beside plain numpy."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortspark.functions import derive, units
from cohortspark.functions.tails import chi2_tail
from cohortspark.operators import cleaning, cumulative, evaluate, events, joins, models, profile, select, stats

T0 = datetime(2150, 1, 1, 12)


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_window_edges(spark):
    rows = [(1, T0 + timedelta(hours=h, microseconds=u)) for h, u in ((-6, 0), (-6, -1), (24, 0), (24, 1), (0, 0))]
    fact = spark.createDataFrame(rows, "k long, ts timestamp_ntz")
    anchor = spark.createDataFrame([(1, T0)], "k long, t0 timestamp_ntz")
    count = lambda closed: select.in_window(fact, anchor, "k", "ts", "t0", "-6 hours", "24 hours", closed).count()
    assert (count(True), count(False)) == (3, 2)


def test_slopes(spark):
    at = lambda h: T0 + timedelta(hours=h)
    rows = [(1, at(0), 1.0), (1, at(1), 5.0), (1, at(2), 2.0), (2, at(0), 1.0), (2, at(3), 9.0), (3, at(0), 1.0), (3, at(0.25), 2.0), (3, at(0.5), 3.0), (4, at(0), 7.0), (5, at(0), 3.0), (5, at(1), 4.0), (5, at(1), 8.0)]
    fact = spark.createDataFrame(rows, "k long, ts timestamp_ntz, v double")
    unsigned = {r["k"]: r["slope"] for r in events.range_slope(fact, ["k"], "ts", "v").collect()}
    assert unsigned[1] == 2.0 and unsigned[2] is None and unsigned[3] is None and unsigned[5] == 5.0
    signed = {r["k"]: r["slope"] for r in events.signed_slope(fact, ["k"], "ts", "v").collect()}
    assert signed[1] == 0.5 and signed[4] == 0.0 and signed[5] == 5.0


def test_rank_before_and_after_the_filter(spark):
    stays = spark.createDataFrame([(1, 1, 0.5), (1, 2, 3.0), (2, 3, 2.0)], "k long, t long, los double")
    order, ok = [F.asc("t")], F.col("los") >= 1
    assert {r["t"] for r in events.first_event(stays, "k", order, where=ok).collect()} == {2, 3}
    assert {r["t"] for r in events.first_event(stays, "k", order, having=ok).collect()} == {3}


@pytest.mark.parametrize(("text", "age"), [("> 89", 90), ("", 0), ("abc", 0), (None, 0), ("64", 64)])
def test_age(spark, text, age):
    assert one(spark, derive.parse_age(F.col("t")), t=text) == age if text is not None else one(spark, derive.parse_age(F.lit(None).cast("string"))) == age


def test_ladder_of_units(spark):
    rules = [
        {"patterns": ["%creatinine%"], "passes": False, "lo": 0.1, "hi": 30, "step": {"divide": 88.4, "over": 30}},
        {"patterns": ["%pH%"], "but": ["%urine%"], "lo": 6.7, "hi": 7.8, "not_in": [7.0, 8.0]},
        {"patterns": ["%albumin%"], "passes": False, "lo": 1.0, "hi": 6.0, "step": {"divide": 10.0, "over": 10, "lo": 1.0, "hi": 6.0}},
        {"patterns": ["%alkaline phos%"], "lo": 5, "hi": 2500},
    ]
    rows = [("Creatinine", 88.4, 1.0), ("creatinine", 30.0, 30.0), ("creatinine", 0.05, None), ("pH", 7.0, None), ("pH", 7.4, 7.4), ("urine pH", 7.4, None), ("albumin", 35.0, 3.5), ("albumin", 61.0, None), ("alkaline phos.", 100.0, 100.0), ("alkaline phos.", 7.2, 7.2)]
    got = spark.createDataFrame(rows, "n string, v double, want double").select("want", derive.clean_by_rules(F.col("n"), F.col("v"), rules).alias("x")).collect()
    assert all(r["x"] == r["want"] for r in got)


def test_label_is_null_without_evidence(spark):
    rows = spark.createDataFrame([(None, None, None), (None, None, 1), (0, None, 0), (1, 1, 0)], "a int, b int, c int")
    label = derive.label3([F.col("a") == 1, F.col("c") == 1], [F.col("a"), F.col("b")])
    assert [r[0] for r in rows.select(label).collect()] == [None, 1, 0, 1]


def test_oxygen_and_ph(spark):
    values = spark.createDataFrame([(None,), (0.5,), (21.0,), (100.0,)], "f double").select(derive.fio2(F.col("f")), derive.fio2(F.col("f"), True)).collect()
    assert [tuple(r) for r in values] == [(0.21, 0.21), (0.21, 0.5), (0.21, 0.21), (1.0, 1.0)]
    assert one(spark, derive.derived_ph(F.col("a"), F.col("b")), a=24.0, b=40.0) == pytest.approx(7.4, abs=0.01)
    assert one(spark, derive.derived_ph(F.col("a"), F.col("b")), a=0.0, b=40.0) is None


def test_ci_text(spark):
    text = one(spark, derive.format_ci(F.col("a"), F.col("b"), F.col("c")), a=0.8821, b=0.84, c=0.9)
    assert text == "0.882 (0.840-0.900)"
    assert tuple(one(spark, derive.parse_ci(F.col("t")), t=text)) == (0.882, 0.84, 0.9)
    assert tuple(one(spark, derive.parse_ci(F.col("t")), t="none")) == (None, None, None)


def test_conversions(spark):
    assert one(spark, units.convert(F.col("x"), "fahrenheit_to_celsius"), x=212.0) == 100
    with pytest.raises(KeyError):
        units.convert(F.col("x"), "nothing", strict=True)
    with pytest.warns(UserWarning):
        units.convert(F.col("x"), "nothing")
    more = units.with_conversion(units.CONVERSIONS, "feet_to_m", units.Line(0.3048))
    assert one(spark, units.convert(F.col("x"), "feet_to_m", table=more), x=10.0) == pytest.approx(3.048) and "feet_to_m" not in units.CONVERSIONS
    with pytest.raises(ValueError):
        units.with_conversion(units.CONVERSIONS, "identity", units.Line(2.0))
    with pytest.raises(ValueError):
        units.Prepare(impute="normal")


def test_no_product_of_facts(spark):
    cohort = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    a = spark.createDataFrame([(1, 5.0), (1, 3.0)], "k long, a double")
    b = spark.createDataFrame([(1, 1.0), (2, 10.0), (2, 20.0)], "k long, b double")
    got = {r["k"]: r["x"] for r in joins.combine_reduced(cohort, a, b, "k", "a", "b", 0.9, "x").collect()}
    assert got == {1: 3.0, 2: 9.0, 3: None}


def test_winsorising_spares_flags_and_is_stable(spark):
    rows = [(float(i), int(i == 7)) for i in range(1000)]
    df = spark.createDataFrame(rows, "x double, flag int")
    once = cleaning.winsorize(df, ["x", "flag"])
    assert once.agg(F.sum("flag"), F.min("x"), F.max("x")).first() == (1, pytest.approx(9.99), pytest.approx(989.01))
    assert cleaning.winsorize(df, ["x", "flag"], keep_binary=False).agg(F.sum("flag")).first()[0] == 0


def test_patching(spark):
    registry = units.registry_of(units.Variable("c", measure=units.Measure(convert="creatinine_mgdl_to_umol", plausible=(30.0, 200.0))))
    df = spark.createDataFrame([(1.0,)] * 8 + [(90.0,), (None,)], "c double")
    inferred = {r["feature"]: r["inferred_unit"] for r in cleaning.infer_units(df, registry).collect()}
    assert inferred == {"c": "unit_si"}
    fixed, audit = cleaning.patch_units(df, registry, {"c": "ambiguous"})
    assert audit.first()["inverse_patched"] == 8 and fixed.where("c between 30 and 200").count() == 9


def test_replay_reproduces_the_cohort(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), None if i % 5 == 0 else float(b)) for i, (a, b) in enumerate(rng.gamma(2, 2, (200, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    out = cleaning.replay(df, cleaning.fit_assets(df, ["a", "b"], ["a"]), ["id"]).toPandas()
    assert np.allclose(out[["a", "b"]].mean(), 0, atol=1e-9) and np.allclose(out[["a", "b"]].std(ddof=0), 1)


def test_chained_equations_recover_a_plane(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 2))
    z = 2 * x[:, 0] - x[:, 1] + 1
    rows = [(i, float(a), float(b), None if i % 4 == 0 else float(c)) for i, ((a, b), c) in enumerate(zip(x, z, strict=True))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    m = cleaning.fit_mice(df, ["a", "b", "c"], sweeps=8)
    got = cleaning.apply_mice(df, m).orderBy("id").toPandas()["c"].to_numpy()
    assert np.abs(got - z).max() < 0.05


def scored(spark, n=300, seed=2):
    rng = np.random.default_rng(seed)
    p = np.round(rng.random(n), 2)
    y = (rng.random(n) < p).astype(int)
    return spark.createDataFrame([(i, int(a), float(b), "m") for i, (a, b) in enumerate(zip(y, p, strict=True))], "id long, y int, p double, g string"), y, p


def test_auc_counts_pairs(spark):
    df, y, p = scored(spark)
    d = p[y == 1][:, None] - p[y == 0][None, :]
    want = ((d > 0) + 0.5 * (d == 0)).mean()
    assert evaluate.auc(df, "y", "p", ["g"]).first()["auc"] == pytest.approx(want)
    in_parts = evaluate.roc_points(df, "y", "p", ["g"], ranges=7).orderBy("threshold").collect()
    assert in_parts == evaluate.roc_points(df, "y", "p", ["g"]).orderBy("threshold").collect()
    assert evaluate.auc(df.where("y = 1"), "y", "p", ["g"]).first()["auc"] is None
    assert evaluate.youden(df.where("y = 1"), "y", "p", ["g"]).first()["cutoff"] == 0.5


def test_decision_curve_counts_rows(spark):
    df, y, p = scored(spark)
    for r in evaluate.decision_curve(df, "y", "p", ["g"]).collect():
        t, hit = r["k"] / 100, p >= r["k"] / 100 - 1e-9
        assert r["model"] == pytest.approx((hit & (y == 1)).mean() - (hit & (y == 0)).mean() * t / (1 - t))


def test_bootstrap_is_the_same_in_any_partitions(spark):
    df = spark.range(900).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), ((F.col("id") * 37 % 101) / 101 + (F.col("id") % 3 == 0).cast("int") / 5).alias("p"))
    first, *others = [sorted(map(tuple, evaluate.bootstrap_ci(df.repartition(n), "y", "p", "id", 40, vectorised=True).collect())) for n in (1, 4, 16)]
    for other in others:
        for a, b in zip(first, other, strict=True):
            assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-12)


def test_units_back_and_forth(spark):
    df = spark.createDataFrame([(float(x),) for x in (2, 30, 300)], "x double")
    for name in units.CONVERSIONS:
        there = units.convert(F.col("x"), name)
        assert [round(r[0], 9) for r in df.select(units.convert(there, name, inverse=True)).collect()] == [2.0, 30.0, 300.0]
    registry = units.registry_of(units.Variable("x", measure=units.Measure("g/dL", "g/L", "gdl_to_gl_multiply_10", (2.0, 40.0))))
    si = spark.createDataFrame([(float(x),) for x in (100, 150, 300, 350)], "x double")
    found = cleaning.infer_units(si, registry, direction="inverse").first()
    assert (found["inferred_unit"], found["confidence"], found["p_inv"]) == ("unit_si", "high", 1.0)
    fixed, audit = cleaning.patch_units(si, registry, {"x": "unit_si"}, direction="inverse")
    assert [r[0] for r in fixed.collect()] == [10.0, 15.0, 30.0, 35.0] and audit.first()["global_converted"] == 1
    with pytest.raises(ValueError):
        cleaning.infer_units(si, registry, direction="back")


@pytest.mark.parametrize("mice", [False, True])
def test_stored_assets_replay_alike(spark, tmp_path, mice):
    rows = [(k, float(k % 13) if k % 5 else None, float(k % 7) * 2 if k % 4 else None, float(k)) for k in range(200)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    assets = cleaning.fit_assets(df, ["a", "b", "c"], ["c"], mice=mice)
    assets.save(spark, f"{tmp_path}/assets")
    again = cleaning.load_assets(spark, f"{tmp_path}/assets")
    assert again == assets
    other = df.withColumn("c", F.col("c") + 3)
    assert cleaning.replay(other, again, ["id"]).orderBy("id").collect() == cleaning.replay(other, assets, ["id"]).orderBy("id").collect()


def test_branches_by_role(spark):
    V, to_gl = units.Variable, units.Measure(convert="gdl_to_gl_multiply_10")
    registry = units.registry_of(
        V("a", measure=to_gl), V("b", units.Use(in_model=False)), V("c", units.Use("confounder"), to_gl),
        V("o", units.Use("outcome")), V("g", units.Use("group")), V("i", units.Use("id")), V("absent"),
    )
    df = spark.createDataFrame([(k, 1.0, 2.0, 3.0, k % 2 if k else None, "g", "extra") for k in range(11)], "i int, a double, b double, c double, o int, g string, extra string")
    report, model = cleaning.bifurcate(df, registry, "o", "i")
    assert report.columns == ["a", "b", "c", "o", "g"] and report.first()[:3] == (10.0, 2.0, 3.0) and report.count() == 11
    assert model.columns == ["i", "a", "c", "o", "is_train"] and model.count() == 10 and model.where("is_train = 1").count() == 8


def test_bootstrap_forms_agree(spark):
    df, _, _ = scored(spark, 600)
    a, b = ({r["metric"]: (r["lo"], r["hi"]) for r in evaluate.bootstrap_ci(df, "y", "p", "id", 60, vectorised=v).collect()} for v in (False, True))
    assert a.keys() == b.keys() and all(abs(x - y) < 0.04 for k in a for x, y in zip(a[k], b[k], strict=True))


def test_drift_by_brute_force(spark):
    rng = np.random.default_rng(3)
    x, z = np.round(rng.normal(size=200), 1), np.round(rng.normal(0.4, 1, 150), 1)
    a, b = (spark.createDataFrame([(float(v), None) for v in s], "f double, empty double") for s in (x, z))
    got = {r["feature"]: r for r in stats.ks_drift(a, b, ["f", "empty"]).collect()}
    grid = np.unique(np.concatenate([x, z]))
    want = max(abs((x <= g).mean() - (z <= g).mean()) for g in grid)
    assert got["f"]["statistic"] == pytest.approx(want) and got["f"]["significant"] == 1


def test_running_totals_in_parts(spark):
    df = spark.createDataFrame([(g, float(v), v) for g in "ab" for v in range(50)], "g string, v double, n long")
    whole = cumulative.running(df, ["g"], "v", ["n"]).orderBy("g", "v").collect()
    assert cumulative.running(df, ["g"], "v", ["n"], ranges=6).orderBy("g", "v").collect() == whole


def test_chi_square_tail(spark):
    def density(t, k):
        return math.exp((k / 2 - 1) * math.log(t) - t / 2 - k / 2 * math.log(2) - math.lgamma(k / 2))

    cases = [(x, k) for k in (1, 2, 3, 4, 7, 10, 51) for x in (0.3, 1.0, 3.9, 7.9, 8.1, 30.0, 90.0)]
    df = spark.createDataFrame([*cases, (0.0, 3), (None, 2), (5.0, 0), (3.841458820694124, 1), (18.307038053275146, 10)], "x double, k int")
    got = {(r["x"], r["k"]): r["p"] for r in df.withColumn("p", chi2_tail(F.col("x"), F.col("k"))).collect()}
    assert got[3.841458820694124, 1] == pytest.approx(0.05) and got[18.307038053275146, 10] == pytest.approx(0.05)
    assert got[0.0, 3] == 1 and got[None, 2] is None and got[5.0, 0] == 1
    for x, k in cases:  # Simpson's rule over a tail long enough
        n, width = 20_000, 400.0
        f = [density(x + width * i / n, k) for i in range(n + 1)]
        want = width / n / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))
        assert got[x, k] == pytest.approx(want, rel=1e-5), (x, k)


def test_places_are_those_of_one_sort(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 != 0, F.col("id") % 3).alias("y"))
    h = cleaning.hash_number(F.col("id"), salt="s")
    w = Window.partitionBy("y")
    want = df.withColumns({"_place": F.row_number().over(w.orderBy(h, "id")), "_size": F.count(F.lit(1)).over(w)})
    for buckets in (1, 7, 4096):
        assert cumulative.placed(df, "y", h, "id", buckets).orderBy("id").collect() == want.orderBy("id").collect()
    assert cleaning.stratified_split(df.limit(0), "y", "id").count() == 0


def test_curves_measure_their_ranges(spark, monkeypatch):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(int(i % 2), int(y), float(p)) for i, (y, p) in enumerate(zip(rng.integers(0, 2, 400), np.round(rng.random(400), 2), strict=True))], "g int, y int, p double")
    both = df.withColumns({"q": F.col("p") * 3, "h": F.col("g").cast("string")})
    whole = [f(df, "y", "p", ["g"]).orderBy("g").collect() for f in (evaluate.auc, evaluate.youden)], stats.kruskal(both, ["p", "q"], "h").orderBy("feature").collect(), stats.ks_drift(df.where("g = 0"), df.where("g = 1"), ["p"]).collect()
    monkeypatch.setattr(cumulative.ranges_for, "__defaults__", (10,))
    assert cumulative.ranges_for(df, "p") > 5
    parts = [f(df, "y", "p", ["g"]).orderBy("g").collect() for f in (evaluate.auc, evaluate.youden)], stats.kruskal(both, ["p", "q"], "h").orderBy("feature").collect(), stats.ks_drift(df.where("g = 0"), df.where("g = 1"), ["p"]).collect()
    flat = lambda found: [v for part in ([x for f in found[0] for x in f], found[1], found[2]) for r in part for v in r]
    assert flat(parts) == [v if isinstance(v, (str, int)) else pytest.approx(v) for v in flat(whole)]


def test_approximate_quantiles_stand_near(spark):
    df = spark.range(1000).select(F.col("id"), F.col("id").cast("double").alias("x"), F.lit(None).cast("double").alias("none"))
    exact, near = (cleaning.fit_imputer(df, {"x": "median", "none": "median"}, approximate=a) for a in (None, 1000))
    assert near == pytest.approx(exact, abs=2) and near["none"] == 0
    assert profile.numeric_profile(df, ["x"], 1000).first()["median"] == pytest.approx(499.5, abs=2)
    assert [tuple(r) for r in profile.standardisation_audit(df.withColumn("flag", F.col("id") % 2), ["x", "flag", "none"]).select("feature", "is_binary").collect()] == [("x", 0), ("flag", 1), ("none", 1)]


def test_odds_ratios_by_newton(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 2))
    y = (rng.random(800) < 1 / (1 + np.exp(-(0.7 * x[:, 0] - 0.4 * x[:, 1])))).astype(int)
    df = spark.createDataFrame([(i, int(t), float(a), float(b)) for i, (t, (a, b)) in enumerate(zip(y, x, strict=True))], "id long, y int, a double, b double")
    design, beta = np.column_stack([np.ones(800), x]), np.zeros(3)
    for _ in range(20):
        mu = 1 / (1 + np.exp(-design @ beta))
        beta += np.linalg.solve((design * (mu * (1 - mu))[:, None]).T @ design, design.T @ (y - mu))
    got = {r["feature"]: r for r in models.odds_ratios(df, "y", ["a", "b"], "id", replicates=40).collect()}
    for i, c in enumerate("ab"):
        assert got[c]["coef"] == pytest.approx(beta[i + 1], abs=1e-3) and got[c]["lo"] < got[c]["odds_ratio"] < got[c]["hi"]


def test_plans_have_no_products(spark):
    a = spark.range(10).select(F.col("id").alias("k"), F.lit(T0).cast("timestamp_ntz").alias("ts"))
    b = spark.range(10).select(F.col("id").alias("k"), F.lit(T0).cast("timestamp_ntz").alias("t0"))
    plan = select.in_window(a, b, "k", "ts", "t0", "0 days", "1 days")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
