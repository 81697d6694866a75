"""What the n-gram join keeps on disk: postings are shuffled once, stored steps leave no shuffle files, common tokens stay out of prefixes."""

from __future__ import annotations

import glob
import time
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from cohortspark.llm.common import discard, stash
from cohortspark.llm.ngram_join import SKETCH_BITS, met_postings, packed_postings, prefixes, sketch_bits


def shuffle_files(spark):
    return set(glob.glob(f"{spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]}/*/shuffle_*"))


def test_stored_steps_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    out = stash(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "counts")
    for _ in range(50):  # files go a moment after the write
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    discard(out)


def test_postings_that_two_sets_share_take_one_shuffle(spark):
    rng = np.random.default_rng(5)
    token, node = rng.choice(rng.integers(0, 1 << 64, 150, np.uint64), 400), rng.integers(-20, 20, 400)
    n = (node + 100) * 8 + 3
    batches = [packed_postings(token[k::3], node[k::3], n[k::3], 7) for k in range(3)]
    rows = [(int(r["range"]), bytes(r["token"]), bytes(r["node"]), bytes(r["packed"])) for b in batches for r in b.to_pylist()]
    got = met_postings(spark.createDataFrame(rows, "range long, token binary, node binary, packed binary"))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    of_token = defaultdict(set)
    for t, x in zip(token.view(np.int64).tolist(), node.tolist(), strict=True):
        of_token[t].add(x)
    want = sorted((t, x, x + 100, 3) for t, nodes in of_token.items() if len(nodes) > 1 for x in nodes)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_prefixes_take_the_least_counts(spark):
    count = np.full(1 << 20, 1, np.uint16)
    hashes = np.sort(np.random.default_rng(6).integers(0, 1 << 64, 20, np.uint64))
    count[(hashes >> np.uint64(44)).astype(np.int64)] = np.arange(120, 80, -2)  # all of one power of two
    token, _, layers = prefixes(hashes, np.array([0, 20]), count, 80, 10**6)
    assert layers.tolist() == [1] * 5 and sorted(token.tolist()) == hashes[-5:].tolist()
    assert sketch_bits(0) == SKETCH_BITS[0] and sketch_bits(200_000_000) == 22 and sketch_bits(1 << 40) == SKETCH_BITS[1]
