"""Every query of the cohort library that has SQL, beside DuckDB on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from cohortspark.plans.clinical import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x
    return x


def near(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return type(a) is type(b) and a == b


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = sql.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert len(got) == len(want)
    assert all(near(a, b) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["clinical_cohort", "external_cohort", "external_cleaning_flow"])
def test_jobs_have_no_products_and_no_python(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # small tables would hide what large ones get
    try:
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not any(x in plan for x in ("CartesianProduct", "NestedLoop", "Python", "InPandas", "SinglePartition"))


def test_curves_round_halves_as_the_statement_does(spark, tmp_path):
    """Prices half way between two scores, and rates half way between two published ones."""
    rows = ", ".join(f"({i}, {i}, '{'FOP'[i % 3]}', {400 * i + 200}::double, timestamp '1998-01-01', 'one')" for i in range(1000))
    halves = ", ".join(f"({1000 + i}, {i}, '{'F' if i < 333 else 'O'}', {400.0 * (i % 640)}::double, timestamp '1998-01-01', 'two')" for i in range(973))
    con = duckdb.connect()
    con.execute(f"copy (select * from (values {rows}, {halves}) t(o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)) to '{tmp_path}/orders.parquet'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path if t == 'orders' else DATA}/{t}.parquet')")
    df = QUERIES["roc_points"](spark, str(tmp_path))
    found = con.execute(ORACLES["roc_points"])
    names = [d[0] for d in found.description]
    assert sorted(map(tuple, df.select(names).collect())) == sorted(found.fetchall())


@pytest.mark.parametrize("name", ["plausibility_audit"])
def test_quantiles_without_a_buffer_of_a_column(spark, name):
    """No task merges a map of all distinct values of a column."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan
