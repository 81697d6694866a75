"""Jobs of several passes read their input once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from cohortspark.operators import cleaning, evaluate, flows, models, validation
from cohortspark.plans.queries import FEAT
from cohortspark.plans.views import Views


def counted(spark, df):
    """(df, a counter of the rows that were worked out)."""
    seen = spark.sparkContext.accumulator(0)

    def through(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    return df.mapInPandas(through, df.schema), seen


def test_assets_are_fitted_from_one_read(spark):
    df, seen = counted(spark, spark.createDataFrame(pd.DataFrame({"a": [1.0, 2.0, 5.0, None], "b": [3.0, 1.0, 0.0, 8.0]})))
    got = cleaning.fit_assets(df, ["a", "b"], ["b"], approximate=cleaning.RANGES)
    assert seen.value == 4 and got.fill["a"] == 2.0


def test_the_cleaning_flow_reads_its_table_once(spark):
    table = Views(spark, "/root/testdata/sf0.001").feat
    n = table.count()
    df, seen = counted(spark, table)
    got = flows.clean_cohort(df, FEAT, "any_f", "id")
    got.model.collect()
    got.report.collect()
    assert seen.value == n


def test_another_cohort_is_read_once(spark):
    rows = spark.range(50).select("id", (F.col("id") * 1.0).alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    assets = cleaning.fit_assets(rows, ["a"], [])
    df, seen = counted(spark, rows)
    chosen = spark.createDataFrame([("y", 1, "a")], "outcome string, place int, feature string")
    got = flows.prepare_external(df, {"a": flows.Limits(0.0, 40.0, 1.0)}, chosen, assets, "id", ["y"])
    assert got.tables["y"].count() == 50 and got.removed.first()["removed"] == 9 and seen.value == 50


def test_draws_by_digits_equal_draws_by_numbers(spark):
    rows = spark.range(20_000).withColumn("r", F.col("id") % 7)
    drawn = rows.select(evaluate.poisson1_of_hash(F.col("id"), F.col("r"), salt="42").alias("a"), evaluate.poisson1(cleaning.hash_number(F.col("id"), F.col("r"), salt="42")).alias("b"))
    assert drawn.where("a <=> b").count() == 20_000 and drawn.select("a").distinct().count() > 5


def test_scores_are_validated_from_one_read(spark):
    rows = spark.range(60).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), ((F.col("id") * 7) % 20 / 20).alias("p"), F.lit("m").alias("model"))
    cuts = spark.createDataFrame([("m", 0.4)], "model string, threshold double")
    df, seen = counted(spark, rows)
    assert validation.validate(df, "y", "p", "id", ["model"], cuts, 5, vectorised=False).first()["n"] == 60
    assert seen.value == 60


def test_learners_are_tuned_from_one_read(spark):
    # the rarer leaf has the likelier rows: ranked by the weight of a leaf, as raw predictions of trees are, the area is below a half
    rows = spark.range(440).select("id", (F.col("id") >= 400).cast("double").alias("x"), F.when(F.col("id") >= 400, F.col("id") % 4 > 0).otherwise(F.col("id") % 5 == 0).cast("int").alias("y"))
    df, seen = counted(spark, rows)
    got, fitted = models.tune(df, "y", ["x"], "id", ("logistic", "tree"), k=2)
    area = {r["model"]: r["mean_auc"] for r in got.collect()}
    assert seen.value == 440 and list(area) == list(fitted) == ["logistic", "tree"]
    assert area["tree"] > 0.5 and abs(area["tree"] - area["logistic"]) < 1e-12  # both know two scores
