"""Near-duplicate vectors by NN-descent over a neighbour graph, with exact link counts inside the groups found.

1. Equal vectors are one node with a weight.
2. Sorting the nodes by the signs of random projections, several times, gives first neighbours.
3. NN-descent: the neighbours of each node (both ways) are compared with each other; each node keeps its nearest ones inside
   its group and as many outside it, so that a dense group doesn't hide its surroundings. Places bound the search only: each
   link found between two groups makes them one, whatever its rank.
4. After each round the links of a bounded sample of nodes are compared with those by brute force, node by node, so that large
   groups don't outweigh small ones. Rounds go on until the audit is passed and a round makes no groups one; where `rounds`
   of them don't suffice, with twice the places and new projections, and after `attempts` of that all pairs are compared, so
   that no graph is taken which the audit didn't pass.
5. Within a group all vectors are compared in blocks, so that the numbers of links are exact there however large the group is,
   and no list of pairs is made."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, stash

JOIN_SIZE = 48


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Unit rows in double precision; each is brought to a greatest component of 1 first, so that no square overflows."""
    x = np.array([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))
    x = x / np.abs(x).max(axis=1, initial=np.finfo(np.float64).tiny)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of sorted rows, some at a time."""
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        last = (pdf[keys] == pdf[keys].iloc[-1]).all(axis=1).to_numpy()
        start = len(pdf) - int(np.argmin(last[::-1])) if not last.all() else 0
        if start:
            yield pdf.iloc[:start].reset_index(drop=True)
        held = pdf.iloc[start:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def _bounds(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    k = pdf[keys].to_numpy()
    return np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, [len(k)]])


EDGE = "a long, b long, sim double"


def _first_edges(nodes: DataFrame, tables: int, reach: int, seed: int) -> DataFrame:
    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, part in pdf.groupby(pdf["vector"].map(len)):
                x = _matrix(part["vector"])
                for t in range(tables):
                    planes = np.random.default_rng([seed, t, int(size)]).standard_normal((int(size), 32))
                    code = ((x @ planes > 0) * (1 << np.arange(32, dtype=np.int64))).sum(axis=1)
                    yield pd.DataFrame({"t": t, "size": int(size), "code": code, "node": part["node"].to_numpy(), "vector": part["vector"].to_numpy()})

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            key = pdf["t"].to_numpy() * 100_000 + pdf["size"].to_numpy()
            node = pdf["node"].to_numpy()
            for k in np.unique(key):
                rows = np.flatnonzero(key == k)
                x, own = _matrix(pdf["vector"].iloc[rows]), node[rows]
                for d in range(1, min(reach, len(rows) - 1) + 1):
                    yield pd.DataFrame({"a": own[:-d], "b": own[d:], "sim": (x[:-d] * x[d:]).sum(axis=1)})
            held = pdf.iloc[-reach:]

    codes = nodes.mapInPandas(project, f"t int, size int, code long, node long, vector {nodes.schema['vector'].dataType.simpleString()}")
    return codes.repartitionByRange("t", "size", "code", "node").sortWithinPartitions("t", "size", "code", "node").mapInPandas(near, EDGE)


FOUND = EDGE + ", link boolean"


def _nearest(edges: DataFrame, labels: DataFrame, places: int) -> DataFrame:
    """(a, b, sim, same) both ways: each node's nearest `places` inside its own group and as many outside it."""
    both = edges.union(edges.select("b", "a", "sim")).groupBy("a", "b").agg(F.max("sim").alias("sim"))
    both = both.join(labels.toDF("a", "ga"), "a").join(labels.toDF("b", "gb"), "b").withColumn("same", F.col("ga") == F.col("gb"))
    rank = F.row_number().over(Window.partitionBy("a", "same").orderBy(F.desc("sim"), "b"))
    return both.withColumn("rank", rank).where(F.col("rank") <= places).select("a", "b", "sim", "same")


def _between(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): the different groups at the ends of links."""
    ends = links.join(labels.toDF("a", "ga"), "a").join(labels.toDF("b", "gb"), "b")
    return ends.where("ga <> gb").select(F.col("ga").alias("a"), F.col("gb").alias("b"))


def _merge(labels: DataFrame, pairs: DataFrame) -> tuple[DataFrame, int]:
    """labels with the groups of each pair (a, b) made one, and how many groups went."""
    up = components(pairs)
    gone = up.where("node <> component").count()
    if not gone:
        return labels, 0
    joined = labels.join(up.toDF("old", "new"), F.col("group") == F.col("old"), "left")
    return stash(joined.select("node", F.coalesce("new", "group").alias("group")), "groups"), gone


def _join_round(graph: DataFrame, nodes: DataFrame, labels: DataFrame, places: int, threshold: float, seed: int) -> DataFrame:
    """New edges from comparing each node's neighbours; a node with many neighbours compares them in random parts.

    A link between two groups is always reported, once for each pair of groups, as (group, group, sim, true): it has no place
    to compete for. Other rows are edges that are nearer than one that an end has, among those inside or outside its group."""
    around = graph.select(F.col("a").alias("center"), F.col("b").alias("node")).union(graph.select("b", "a")).distinct()
    # a list that isn't full takes any edge
    bars = [F.when(F.count(F.when(w, 1)) >= places, F.min(F.when(w, F.col("sim")))).otherwise(-2.0).alias(c) for c, w in (("inside", F.col("same")), ("outside", ~F.col("same")))]
    bars = graph.groupBy(F.col("a").alias("node")).agg(*bars)
    size = F.count(F.lit(1)).over(Window.partitionBy("center"))
    parted = around.withColumn("part", F.pmod(F.xxhash64("node", F.lit(seed)), F.ceil(size / JOIN_SIZE)))
    known = nodes.join(labels, "node").join(bars, "node").select("node", "vector", "group", "inside", "outside", F.size("vector").alias("size"))
    keys = ["center", "part", "size"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _grouped(batches, keys):
            node, group, inside, outside = (pdf[c].to_numpy() for c in ("node", "group", "inside", "outside"))
            at, edges, links = _bounds(pdf, keys), [], []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                if hi - lo > 1:
                    x = _matrix(pdf["vector"].iloc[lo:hi])
                    sim, g = x @ x.T, group[lo:hi]
                    same = g[:, None] == g
                    nearer = sim > np.where(same, inside[lo:hi, None], outside[lo:hi, None])
                    i, j = np.nonzero(np.triu(nearer | nearer.T, 1))
                    edges.append((node[lo + i], node[lo + j], sim[i, j]))
                    i, j = np.nonzero(np.triu((sim >= threshold) & ~same, 1))
                    links.append((np.minimum(g[i], g[j]), np.maximum(g[i], g[j]), sim[i, j]))
            for found, link in ((edges, False), (links, True)):
                if found:
                    a, b, s = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield pd.DataFrame({"a": a, "b": b, "sim": s, "link": link}).drop_duplicates(["a", "b"])

    rows = parted.join(known, "node").select(*keys, "node", "group", "inside", "outside", "vector")
    return rows.repartition("center", "part").sortWithinPartitions(*keys).mapInPandas(compare, FOUND)


def _audit(nodes: DataFrame, rows: int, threshold: float) -> DataFrame:
    """(a, b): the links, by brute force, of the `rows` nodes with the least hashes."""
    picked = nodes.orderBy(F.xxhash64("node"), "node").limit(rows).collect()
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(r["vector"]) for r in picked}:
        own = [r for r in picked if len(r["vector"]) == size]
        by_size[size] = np.array([r["node"] for r in own]), _matrix(pd.Series([r["vector"] for r in own]))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, part in pdf.groupby(pdf["vector"].map(len)):
                if size in by_size:
                    ids, q = by_size[size]
                    other = part["node"].to_numpy()
                    i, j = np.nonzero(q @ _matrix(part["vector"]).T >= threshold)
                    keep = ids[i] != other[j]
                    yield pd.DataFrame({"a": ids[i][keep], "b": other[j][keep]})

    return nodes.mapInPandas(compare, "a long, b long")


def _audited(truth: DataFrame, labels: DataFrame) -> float:
    """The share of the audited nodes with links that have all of them inside their group; 1 if there are none.

    A link counts as found if its ends are in one group, where all pairs are compared in the end."""
    ends = truth.join(labels.toDF("a", "ga"), "a").join(labels.toDF("b", "gb"), "b")
    whole = ends.groupBy("a").agg(F.min((F.col("ga") == F.col("gb")).cast("int")).alias("whole"))
    share = whole.agg(F.avg("whole").alias("share")).first()["share"]
    return 1.0 if share is None else share


def _all_pairs(nodes: DataFrame, labels: DataFrame, threshold: float, rows: int = 4096, step: int = 512) -> DataFrame:
    """(a, b, sim): a link for each two different groups that have one, from comparing all pairs of vectors of one length.

    Blocks of about `rows` nodes are compared with each other in tasks of their own, `step` rows at a time."""
    known = nodes.join(labels, "node").withColumn("size", F.size("vector"))
    counts = {r["size"]: -(-r["count"] // rows) for r in known.groupBy("size").count().collect()}
    sizes = nodes.sparkSession.createDataFrame(list(counts.items()) or [(0, 1)], "size int, blocks int")
    own = known.join(F.broadcast(sizes), "size").withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    keys = ["size", "i", "j"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _grouped(batches, keys):
            at = _bounds(pdf, keys)
            group, own_, i_ = (pdf[c].to_numpy() for c in ("group", "own", "i"))
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                x, g = _matrix(pdf["vector"].iloc[lo:hi]), group[lo:hi]
                left = own_[lo:hi] == i_[lo]
                right = left if left.all() else ~left
                (x, y), (g, h) = (x[left], x[right]), (g[left], g[right])
                for k in range(0, len(x), step):
                    sim = x[k : k + step] @ y.T
                    r, c = np.nonzero((sim >= threshold) & (g[k : k + step, None] != h))
                    a, b = g[k + r], h[c]
                    yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "sim": sim[r, c]}).drop_duplicates(["a", "b"])

    dealt = dealt.select(*keys, "own", "group", "vector").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(compare, EDGE)


def _count_links(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, links): weights of the other members of a node's component that are linked with it, compared block by block.

    members: node, component, size of the component, weight, vector."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a pair of blocks (i, j), i <= j, is compared in one place
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    keys = ["component", "i", "j"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _grouped(batches, keys):
            at = _bounds(pdf, keys)
            node, weight, own, i_, j_ = (pdf[c].to_numpy() for c in ("node", "weight", "own", "i", "j"))
            out = []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                x, w = _matrix(pdf["vector"].iloc[lo:hi]), weight[lo:hi]
                if i_[lo] == j_[lo]:
                    near = x @ x.T >= threshold
                    np.fill_diagonal(near, False)
                    out.append((node[lo:hi], near @ w))
                else:
                    left = own[lo:hi] == i_[lo]
                    near = x[left] @ x[~left].T >= threshold
                    out += [(node[lo:hi][left], near @ w[~left]), (node[lo:hi][~left], w[left] @ near)]
            a, n = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pd.DataFrame({"node": a, "links": n.astype(np.int64)})

    dealt = dealt.select(*keys, "own", "node", "weight", "vector").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", embedding: str = "embedding", places: int = 10, tables: int = 5, reach: int = 4, rounds: int = 6, attempts: int = 3, audit_rows: int = 256, recall: float = 0.99, block: int = 512, seed: int = 11) -> DataFrame:
    """(id, n_links long, component_id long, kept boolean) for each row of vectors.

    n_links: other rows with a cosine of threshold or more (in double precision); component_id: the least id that the row
    reaches by links, itself included; kept: the row's id is that. A vector that is null, empty or zero, or holds null or
    non-finite components, links with nothing and keeps its own id, and so do vectors of different lengths among each other. A
    row with a null id has a null component_id, isn't kept and lends no links. Repeated rows of one id count as rows. Other
    columns are ignored."""
    # floats stay as small as they are
    kind = "float" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(embedding).cast(f"array<{kind}>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    ok = F.coalesce(finite & F.exists("vector", lambda v: v != 0), F.lit(False)) & F.col("id").isNotNull()
    # -0.0 and 0.0 are equal numbers
    good = rows.where(ok).withColumn("vector", F.transform("vector", lambda v: v + F.lit(0.0).cast(kind)))
    nodes = stash(good.groupBy("vector").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("weight")), "nodes")
    # an id with several vectors: each is a node of its own
    nodes = nodes.withColumn("least", F.col("node")).withColumn("node", F.xxhash64("node", "vector"))
    nodes = stash(nodes, "nodes")
    bare = nodes.select("node", "vector")

    first = stash(_first_edges(bare, tables, reach, seed), "edges")
    labels, _ = _merge(bare.select("node", F.col("node").alias("group")), first.where(F.col("sim") >= threshold))
    graph = stash(_nearest(first, labels, places), "graph")
    truth = stash(_audit(bare, audit_rows, threshold), "audit")
    for k in range(rounds * attempts):
        if k and k % rounds == 0:
            places *= 2
            first = stash(_first_edges(bare, tables, reach, seed + k), "edges")
            labels, _ = _merge(labels, _between(first.where(F.col("sim") >= threshold), labels))
            graph = stash(_nearest(graph.drop("same").union(first), labels, places), "graph")
        found = stash(_join_round(graph, bare, labels, places, threshold, seed + k), "found")
        labels, merged = _merge(labels, found.where("link"))
        if not merged and _audited(truth, labels) >= recall:
            break
        graph = stash(_nearest(graph.drop("same").union(found.where("not link").drop("link")), labels, places), "graph")
    else:
        labels, _ = _merge(labels, stash(_all_pairs(bare, labels, threshold), "links"))
    labels, _ = _merge(labels, _between(truth, labels))
    sizes = labels.groupBy("group").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stash(labels.join(sizes, "group").withColumnRenamed("group", "component").join(nodes, "node"), "members")
    counted = _count_links(members, threshold, block)
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = members.join(least, "component").select("node", "component_id").join(counted, "node", "left")
    of_node = nodes.join(of_node, "node", "left").select("vector", F.coalesce("component_id", "least").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    of_node = of_node.withColumnRenamed("vector", "own")
    keyed = rows.withColumn("key", F.when(ok, F.transform("vector", lambda v: v + F.lit(0.0).cast(kind))))
    out = keyed.join(of_node, F.col("key") == F.col("own"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
