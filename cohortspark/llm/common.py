"""Pieces that the operators share: tables, stored intermediate results, folds, components."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as Parquet to the shared folder and reads it back; cuts lineage and survives lost executors.

    The shuffles of the write go with it. Else they stay until the driver collects its garbage, those of many steps at a time."""
    path, conf = fresh_dir(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEAN, "false")
    conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEAN, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what stash() wrote for df, once everything that was made from it is written itself."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stashed)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fold(column: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(column.cast("string").cast("binary")) % 4


def held_out(column: Column) -> Column:
    return F.coalesce(fold(column) == 2, F.lit(False))


def uniform(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) from the md5 of the columns as text; the same in any SQL engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def fresh_name(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with no column of df."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of the links a-b, component being the least node that it reaches.

    Each round hooks every component to the neighbour of the least hash, if that is less than its own, and contracts the links.
    The hashes are new in each round, so that the number of rounds grows with the logarithm of the nodes whatever the ids are.
    Both tables stay on the executors, and a hot node costs one row for each of its links, summed before the shuffle."""
    links = stash(
        edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct(), "links"
    )
    labels = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().select("node", F.col("node").alias("component"))
    labels, k = stash(labels, "labels"), 0
    while not links.isEmpty():
        order = lambda c, k=k: F.struct(F.xxhash64(F.lit(k), c).alias("hash"), F.col(c).alias("node"))
        both = links.union(links.select("b", "a"))
        parents = both.groupBy("a").agg(F.min(order("b")).alias("to")).where(F.col("to") < order("a"))
        parents = stash(parents.select(F.col("a").alias("child"), F.col("to.node").alias("parent")), "parents")
        # two jumps: a parent may have hooked itself in the same round
        up = parents.select(F.col("child").alias("c2"), F.col("parent").alias("p2"))
        jumped = stash(parents.join(up, F.col("parent") == F.col("c2"), "left").select("child", F.coalesce("p2", "parent").alias("parent")), "jumped")
        old_labels, old_links = labels, links
        labels = stash(
            labels.join(jumped, F.col("component") == F.col("child"), "left").select("node", F.coalesce("parent", "component").alias("component")),
            "labels",
        )
        pa, pb = (jumped.select(F.col("child").alias(f"c{s}"), F.col("parent").alias(f"p{s}")) for s in "ab")
        links = stash(
            links.join(pa, F.col("a") == F.col("ca"), "left").join(pb, F.col("b") == F.col("cb"), "left")
            .select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b")).where("a <> b").distinct(),
            "links",
        )
        for done in (parents, jumped, old_labels, old_links):
            discard(done)
        k += 1
    least = labels.groupBy("component").agg(F.min("node").alias("least"))
    out = stash(labels.join(least, "component").select("node", F.col("least").alias("component")), "labels")
    discard(labels)
    discard(links)
    return out


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions)
