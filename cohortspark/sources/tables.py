"""Reading and writing cohort tables and their metadata."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_CSV = {"header": "true", "nullValue": "\\N", "emptyValue": '""', "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all executors share (spark.checkpoint.dir), or a local one where it is unset and all runs on one
    machine; elsewhere it raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep_table(df: DataFrame, name: str) -> DataFrame:
    """df written once to scratch() and read back: it is computed once, and lost executors cost a reread."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_cohort_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_CSV).csv(path)


def read_cohort_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Typed read: the schema is declared, never inferred; a row that doesn't fit it raises."""
    return spark.read.schema(schema).options(**_CSV, mode="FAILFAST").csv(path)


def _files(spark: SparkSession, path: str):
    """(Hadoop's path class, the file system of path)."""
    kind = spark._jvm.org.apache.hadoop.fs.Path
    return kind, kind(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the versions that were published at path, oldest first."""
    kind, fs = _files(spark, path)
    if not fs.exists(kind(path)):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(kind(path))]
    found = [re.fullmatch(r"_current\.(\d+)\.([\w-]+)", n) for n in names]
    return sorted((int(m[1]), m[2]) for m in found if m)


def publish_table(df: DataFrame, path: str, partition_by: list[str] | None = None, keep: int = 2) -> DataFrame:
    """Replaces the table at path and returns it as it was written.

    The rows go to a folder of their own first; only when all of it is written does an empty file of the next number name that
    folder, in one step. A job that fails leaves the table as it was, a table may be read and replaced by one job, and readers keep
    the folder they began with: the last `keep` versions stay. Of two jobs at once, the last one by number and name counts."""
    spark = df.sparkSession
    kind, fs = _files(spark, path)
    folder = f"data-{uuid.uuid4().hex}"
    df.write.partitionBy(*(partition_by or [])).parquet(f"{path}/{folder}")
    before = _pointers(spark, path)
    fs.createNewFile(kind(f"{path}/_current.{before[-1][0] + 1 if before else 1}.{folder}"))
    after = _pointers(spark, path)
    for number, old in after[: -max(keep, 1)]:
        fs.delete(kind(f"{path}/_current.{number}.{old}"), False)
        fs.delete(kind(f"{path}/{old}"), True)
    return spark.read.schema(df.schema).parquet(f"{path}/{folder}").select(df.columns)


def read_published(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """The table that was last published at path."""
    found = _pointers(spark, path)
    if not found:
        raise FileNotFoundError(f"no table was published at {path}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/{found[-1][1]}")


def write_assets_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_assets_json(spark: SparkSession, path: str, schema: StructType | str, multi_line: bool = False) -> DataFrame:
    """Nested metadata: {name: ..., features: [...], weights: {...}}; multi_line for one pretty-printed document a file."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def explode_weights(df: DataFrame, key: str, weights: str) -> DataFrame:
    """(key, feature, weight) from a map column."""
    return df.select(key, F.explode(weights).alias("feature", "weight"))


#: Fixed format: one JSON document, outcome -> its selected features.
SELECTION = "map<string, struct<n_features: int, features: array<string>, weights: map<string, double>, best_C: double, best_lambda: double>>"


def write_selection(selection: DataFrame, path: str) -> None:
    """One JSON document of selected features from (outcome, feature, weight, best_c, best_lambda): features stand in the order of their
    absolute weight, then name; rows of one outcome agree on the last two. What is written is bounded by outcomes and features."""
    listed = F.sort_array(F.collect_list(F.struct((-F.abs("weight")).alias("k"), "feature", "weight")))
    each = selection.groupBy("outcome").agg(listed.alias("l"), F.max("best_c").alias("c"), F.max("best_lambda").alias("m"))
    weights = F.map_from_entries(F.transform("l", lambda x: F.struct(x["feature"], x["weight"])))
    entry = F.struct("outcome", F.struct(F.size("l").alias("n_features"), F.col("l.feature").alias("features"), weights.alias("weights"), F.col("c").alias("best_C"), F.col("m").alias("best_lambda")))
    document = each.agg(F.map_from_entries(F.collect_list(entry)).alias("d"))
    document.select(F.to_json("d", {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """(outcome, place, feature, weight, n_features, best_c, best_lambda), place from 1 in the order of the document's list; a listed
    feature without a weight has NULL. A document that doesn't parse raises."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", SELECTION, {"mode": "FAILFAST"}).alias("d"))
    each = parsed.select(F.explode("d").alias("outcome", "s"))
    rows = each.select("outcome", "s", F.posexplode("s.features").alias("at", "feature"))
    return rows.select("outcome", (F.col("at") + 1).alias("place"), "feature", F.try_element_at("s.weights", "feature").alias("weight"), F.col("s.n_features").alias("n_features"), F.col("s.best_C").alias("best_c"), F.col("s.best_lambda").alias("best_lambda"))
