"""Another cohort's preparation on literal rows: units, limits, clipping, what is kept, and the frozen space."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import cleaning, flows


def prepared(spark, rows, **more):
    df = spark.createDataFrame(rows, "id long, lac double, crea double, spare double, dead_28d int")
    chosen = [("death", 1, "lac"), ("death", 2, "gone"), ("failure", 1, "crea"), ("failure", 2, "unknown")]
    limits = {"lac": flows.Limits(0.5, 30.0), "crea": flows.Limits(0.1, 20.0, 100.0), "spare": flows.Limits(0.0, 1.0), "gone": flows.Limits(0.0, 5.0)}
    assets = cleaning.Assets(["lac", "crea", "gone"], ["lac"], {"lac": 1.0, "crea": 2.0, "gone": 3.0}, {"lac": (0.0, 2.0), "crea": (1.0, 1.0), "gone": (1.0, 4.0)})
    selection = spark.createDataFrame(chosen, "outcome string, place int, feature string")
    return flows.prepare_external(df, limits, selection, assets, "id", ["dead"], {"dead_28d": "dead"}, {"low": F.col("crea") < 1.5}, **more)


def test_tables_hold_what_each_outcome_selected(spark):
    rows = [(i, 1.0 + i / 10, 1.0 + i, 0.5, i % 2) for i in range(100)] + [(100, 99.0, 1.0, 9.0, None), (101, None, None, None, 1)]
    got = prepared(spark, rows)
    assert set(got.audited.columns) == {"id", "lac", "crea", "dead", "low"} and set(got.tables) == {"death", "failure"}
    assert got.tables["death"].columns == ["id", "lac", "gone", "dead", "low"] and got.tables["failure"].columns == ["id", "crea", "dead", "low"]
    assert {r["feature"]: r["removed"] for r in got.removed.collect()} == {"lac": 1, "crea": 80}
    death = {r["id"]: r for r in got.tables["death"].collect()}
    lac = np.array([1.0 + i / 10 for i in range(100)])
    lo, hi = np.quantile(lac, [0.01, 0.99])
    for i in range(100):
        assert death[i]["lac"] == pytest.approx(math.log1p(min(max(lac[i], lo), hi)) / 2)
        assert (death[i]["dead"], death[i]["low"]) == (i % 2, int(1.0 + i < 1.5))
    assert death[100]["lac"] == pytest.approx(0.5) and (death[100]["dead"], death[100]["low"]) == (0, 1)  # beyond the limit: filled
    assert (death[101]["lac"], death[101]["gone"], death[101]["dead"], death[101]["low"]) == (0.5, 0.5, 1, 0)  # a feature that isn't there is filled
    spread = {r["feature"]: r for r in got.spread.collect()}
    assert spread["gone"]["mean"] == pytest.approx(0.5) and spread["gone"]["std"] == 0.0


def test_units_are_mended_by_the_median(spark):
    low = prepared(spark, [(i, 1.0, 0.01 + i / 5000, 0.0, 0) for i in range(49)])  # the median is far below the least logical value
    crea = sorted(r["crea"] for r in low.audited.collect())
    assert crea[24] == pytest.approx(1.48) and crea[0] == pytest.approx(1 + 0.02 * 0.48) and crea[-1] == pytest.approx(1.96 - 0.02 * 0.48)
    assert {r["low"] for r in low.audited.collect()} == {1}  # flags were made before
    plain = prepared(spark, [(i, 1.0, 0.5 + i, 0.0, 0) for i in range(10)])
    assert sorted(r["crea"] for r in plain.audited.collect())[5] == 5.5


def test_exact_quantiles_by_ranges_are_the_same(spark):
    rows = [(i, 1.0 + (i * 37 % 101) / 7, 1.0 + i % 13, 0.5, 0) for i in range(300)]
    a, b = (sorted(map(tuple, prepared(spark, rows, approximate=x).audited.collect())) for x in (None, cleaning.RANGES))
    assert a == b


def test_no_rows(spark):
    got = prepared(spark, [])
    assert got.tables["death"].count() == 0 and {r["mean"] for r in got.spread.collect()} == {None}
