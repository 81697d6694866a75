"""Replicates that draw each class's rows with replacement, as many as the class has.

Rows are dealt into small leaves by a hash of all that they hold. A replicate's total of a class is split down a binary tree over
the leaves: a node's total goes to its two halves by a binomial draw of their sizes, seeded by the node, so that a task finds what
falls to its leaf from the sizes on the way there and no task or driver holds the totals of all leaves. Inside a leaf the rows are
in the order of the hash. So the counts depend on the rows and the seed only, not on partitions, and add up to the class exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import keep_table

#: Rows of a leaf, and the levels whose sizes are broadcast: 2^TOP - 1 nodes of a class at most.
LEAF, TOP = 1_000, 12


def _paths(sizes: DataFrame, depth: int) -> DataFrame:
    """(_y, _leaf, lefts, nodes): the size of the left half and of the whole at each node from the root to the leaf."""
    rows = sizes.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(depth)))).withColumn("node", F.expr(f"shiftright(_leaf, {depth} - level)"))
    halves = rows.groupBy("_y", "level", "node").agg(F.sum("n").alias("n"))
    parents = halves.groupBy("_y", "level", F.shiftright("node", 1).alias("parent")).agg(F.sum(F.when(F.col("node") % 2 == 0, F.col("n")).otherwise(0)).alias("left"), F.sum("n").alias("size"))
    ways = rows.select("_y", "_leaf", "level", F.shiftright("node", 1).alias("parent"))
    keys = ["_y", "level", "parent"]
    near = ways.where(F.col("level") <= TOP).join(F.broadcast(parents.where(F.col("level") <= TOP)), keys)
    far = ways.where(F.col("level") > TOP).join(parents.where(F.col("level") > TOP), keys)  # at most 2^(depth - TOP) leaves a node
    listed = near.unionByName(far).groupBy("_y", "_leaf").agg(F.sort_array(F.collect_list(F.struct("level", "left", "size"))).alias("w"))
    return listed.select("_y", "_leaf", F.col("w.left").alias("lefts"), F.col("w.size").alias("nodes"))


def stratified_leaves(df: DataFrame, y: str, columns: list[str], key: str, rows: int = LEAF) -> tuple[DataFrame, dict[float, int], int]:
    """(leaves, rows of each class, depth of the tree); a leaf is one row: its class, number, way, an array of each column and one
    of how often each row stands in the table. Rows with a NULL are left out; rows that repeat whole are counted, not kept apart."""
    held = df.select(F.xxhash64(key, y, *columns).alias("_own"), F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)]).dropna()
    names = [f"_x{i}" for i in range(len(columns))]
    held = keep_table(held.groupBy("_own", "_y", *names).agg(F.count(F.lit(1)).alias("_n")), "replicate_rows")
    classes = held.groupBy("_y").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()  # one row for each class
    depth = max(1, (sum(r["kinds"] for r in classes) // rows).bit_length())
    dealt = held.withColumn("_leaf", F.shiftrightunsigned("_own", 64 - depth))
    listed = dealt.groupBy("_y", "_leaf").agg(F.sort_array(F.collect_list(F.struct("_own", "_n", *names))).alias("r"))
    ways = _paths(dealt.groupBy("_y", "_leaf").agg(F.sum("_n").alias("n")), depth)
    leaves = listed.join(ways, ["_y", "_leaf"]).select("_y", "_leaf", "lefts", "nodes", *[F.col(f"r.{c}").alias(c) for c in ("_n", *names)])
    files = max(df.sparkSession.sparkContext.defaultParallelism, 2**depth // 64)  # a pass costs replicates x rows, so small tables are dealt too
    return keep_table(leaves.repartition(files), "replicate_leaves"), {r["_y"]: r["n"] for r in classes}, depth


def leaf_weights(place: int, total: int, leaf: int, depth: int, lefts: np.ndarray, nodes: np.ndarray, n: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """(replicate, row) counts of a leaf. place: the class's place among the classes; total: its rows; n: how often each row stands there."""
    share = np.full(replicates, total, np.int64)
    for level in range(depth):
        parent, right = leaf >> (depth - level), (leaf >> (depth - level - 1)) & 1
        drawn = np.random.default_rng([seed, place, level, parent]).binomial(share, lefts[level] / nodes[level])
        share = share - drawn if right else drawn
    rng = np.random.default_rng([seed, place, depth, leaf])
    if n.max() > 1:
        return rng.multinomial(share, n / n.sum())
    cells = np.repeat(np.arange(replicates, dtype=np.int64) * len(n), share) + rng.integers(0, len(n), int(share.sum()))
    return np.bincount(cells, minlength=replicates * len(n)).reshape(replicates, len(n))


def logistic_replicates(leaves: DataFrame, classes: dict[float, int], depth: int, p: int, replicates: int, start: np.ndarray, steps: int, ridge: float, seed: int) -> np.ndarray:
    """(replicate, 1 + p) logistic weights by Newton steps; replicate 0 counts each row once. One pass over the leaves for each step
    adds up the gradients and Hessians of all replicates; the driver solves small systems."""
    q, r, order = p + 1, replicates + 1, sorted(classes)
    beta = np.tile(start, (r, 1)) if start.ndim == 1 else start

    for _ in range(steps):
        now = beta

        def pass_over(batches: Iterator[pd.DataFrame], now: np.ndarray = now) -> Iterator[pd.DataFrame]:
            g, h = np.zeros((r, q)), np.zeros((r, q * q))
            for pdf in batches:
                for leaf in pdf.to_dict("records"):
                    n, label = np.asarray(leaf["_n"], np.int64), leaf["_y"]
                    x = np.column_stack([np.ones(len(n)), *[np.asarray(leaf[f"_x{i}"], float) for i in range(p)]])
                    w = np.empty((r, len(n)))
                    w[0] = n
                    if replicates:
                        w[1:] = leaf_weights(order.index(label), classes[label], leaf["_leaf"], depth, leaf["lefts"], leaf["nodes"], n, replicates, seed)
                    mu = 1 / (1 + np.exp(-np.clip(now @ x.T, -30, 30)))
                    g += (w * (label - mu)) @ x
                    h += (w * mu * (1 - mu)) @ (x[:, :, None] * x[:, None, :]).reshape(len(n), q * q)
            flat = np.concatenate([g.ravel(), h.ravel()])
            yield pd.DataFrame({"place": np.arange(len(flat)), "value": flat})

        sums = np.zeros(r * q + r * q * q)
        for row in leaves.mapInPandas(pass_over, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
            sums[row["place"]] = row["value"]
        g, h = sums[: r * q].reshape(r, q), sums[r * q :].reshape(r, q, q)
        move = np.linalg.solve(h + ridge * np.eye(q), (g - ridge * beta)[:, :, None])[:, :, 0]
        beta = beta + move
        if np.abs(move).max() < 1e-8:
            break
    return beta
