"""Blocks meet their cohort in one join, whatever their number."""

from __future__ import annotations

import re

import pytest

from cohortspark.operators.joins import assemble


def test_blocks_are_gathered_before_one_join(spark):
    cohort = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "id long, name string")
    x = spark.createDataFrame([(1, 5.0), (None, 9.0), (7, 1.0)], "id long, x double")
    y = spark.createDataFrame([(1, None, "p"), (2, 3, None)], "id long, y int, w string")
    z = spark.createDataFrame([(2, 1)], "id long, z int")
    with_sizes_off = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = assemble(cohort, [x, y, z], "id", ["z"])
        plan = out._jdf.queryExecution().sparkPlan().toString()
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_sizes_off)
    assert len(re.findall(r"\w*Join ", plan)) == 1  # a join for each block held all their sorts in one task
    assert out.columns == ["id", "name", "x", "y", "w", "z"]
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == [(1, "a", 5.0, None, "p", 0), (1, "b", 5.0, None, "p", 0), (2, "c", None, 3, None, 1), (None, "d", None, None, None, 0)]


def test_clashing_blocks_raise(spark):
    a = spark.createDataFrame([(1, 2)], "id long, x int")
    with pytest.raises(ValueError, match="x"):
        assemble(a.select("id"), [a, a], "id", [])


def test_the_small_cohort_joins_its_blocks_once(spark):
    from cohortspark.plans.queries import flagship

    plan = flagship(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the window is stored, and the blocks are gathered
