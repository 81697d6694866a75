"""N-gram Jaccard join with adaptive multi-match prefixes, and the groups that its links make.

1. Each text becomes its set of shingle hashes. Rows with equal sets are one set from then on.
2. A sketch of counters, one for SPREAD shingles within bounds, estimates how many texts hold each shingle. All sets are read in
   the order of these counts, so that what chance repeats in a large corpus stays out of most prefixes.
3. A set's prefix are its first n - ceil(t n) + l tokens; l is 1, and more for a set whose prefix meets many others by that
   estimate. Sets of a and b tokens that are similar share k = ceil(t / (1 + t) (a + b)) tokens at least. After the first m of
   these come k - m more, so that these m stand among the first a - k + m tokens of one and b - k + m of the other: two sets
   are compared only if their prefixes share min(pa - a, pb - b) + k tokens, pa and pb being the lengths of the prefixes. A
   longer prefix asks for as many more shared tokens. Prefixes are shuffled once, packed by ranges of the token, and what only one
   set holds is left out where they arrive.
4. Candidates are verified on whole sets. Since the result is groups, sets that share a token are first tried against a few
   leaders of the token, and only pairs that are still in different groups are left.
5. Of a token that at most `few` sets of several groups hold, each pair is tried. The sets of a token that more hold are dealt in
   blocks, and a task compares two whole blocks and returns only what joins groups: as many rows as sets at most, while the
   pairs of a large family that is just under the threshold are never listed."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, stash
from .sentencepiece_sample import ragged
from .shingles import shingle_sets
from .textbytes import byte_column, chunks, releasing

#: Least and greatest size of the sketch as a power of two, and the shingles that a counter is meant to hold.
SKETCH_BITS, SPREAD = (20, 23), 64
LAYERS = 4
#: Postings of a range of tokens, and those that a task gathers before it passes them on.
RANGE, GATHERED = 200_000, 1 << 18


def _sets(batch: pa.RecordBatch, column: int, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = byte_column(batch.column(column))
    for lo, hi in chunks(offsets):
        hashes, owner = shingle_sets(data, offsets[lo : hi + 1], words)
        n = np.bincount(owner, minlength=hi - lo)
        yield lo, hi, hashes, np.concatenate([[0], np.cumsum(n)])


def _digest(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each set."""
    out = []
    for k in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        mixed = (hashes ^ np.uint64(k)) * np.uint64(k)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
        out.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
    return out[0], out[1]


def digests(docs: DataFrame, words: int) -> DataFrame:
    """(id, n_shingles, s1, s2) for each row: the size and the digest of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, hashes, ends in _sets(batch, 1, words):
                a, b = _digest(hashes, ends)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(ends)), pa.array(a), pa.array(b)], ["id", "n_shingles", "s1", "s2"])

    return docs.mapInArrow(releasing(run), f"id {docs.schema['id'].dataType.simpleString()}, n_shingles long, s1 long, s2 long")


def sketch_bits(shingles: int) -> int:
    return min(max(SKETCH_BITS[0], (shingles // SPREAD).bit_length()), SKETCH_BITS[1])


def sketch(docs: DataFrame, words: int, bits: int = SKETCH_BITS[0]) -> np.ndarray:
    """How many rows hold a shingle, by the first bits of its hash; 2**bits numbers of two bytes, the greatest for all beyond.

    Tasks count all their rows and pass on compressed slices of their counters, which are summed by slice."""
    slices = 64
    width = (1 << bits) // slices

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int32)
        for batch in batches:
            for _, _, hashes, _ in _sets(batch, 1, words):
                np.add.at(total, (hashes >> np.uint64(64 - bits)).astype(np.int64), 1)
        if total.any():
            parts = [zlib.compress(total[k * width : (k + 1) * width].tobytes(), 1) for k in range(slices)]
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, data in zip(pdf["slice"], pdf["counts"], strict=True):
                part = np.frombuffer(zlib.decompress(data), np.int32).astype(np.int64)
                totals[k] = totals[k] + part if k in totals else part
        yield pd.DataFrame({"slice": list(totals), "counts": [zlib.compress(np.minimum(v, 0xFFFF).astype(np.uint16).tobytes(), 1) for v in totals.values()]})

    parts = stash(docs.mapInArrow(releasing(count), "slice int, counts binary").repartition("slice").mapInPandas(add, "slice int, counts binary"), "sketch")
    total = np.zeros(1 << bits, np.uint16)
    for r in parts.collect():
        total[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.uint16)
    discard(parts)
    return total


def prefixes(hashes: np.ndarray, ends: np.ndarray, count: np.ndarray, percent: int, costly: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, row, layers of the row): the tokens of each set's prefix in the common order.

    count: the sketch, whose counts are the order's first key. The number of layers (l) grows with the estimated number of rows
    that the one-layer prefix meets, and stops at LAYERS or at the set's size."""
    bits = int(np.log2(len(count)))
    n = np.diff(ends)
    row = np.repeat(np.arange(len(n)), n)
    slot = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    order = np.lexsort((hashes, count[slot], row))
    hashes, slot = hashes[order], slot[order]
    rank = np.arange(len(hashes)) - np.repeat(ends[:-1], n)
    first = n - (n * percent + 99) // 100 + 1
    cost = np.bincount(row, weights=np.where(rank < first[row], count[slot], 0), minlength=len(n))
    spare = np.maximum(n - first + 1, 1)
    layers = np.minimum(np.minimum(1 + np.floor(np.log2(np.maximum(cost / np.maximum(first * costly, 1), 1))).astype(np.int64), LAYERS), spare)
    keep = rank < (first + layers - 1)[row]
    return hashes[keep], row[keep], layers[row[keep]]


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers, first bytes first, so that what neighbours share compresses."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(planes: list[bytes]) -> np.ndarray:
    return np.concatenate([np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.int64)[:, 0] for x in planes])


def packed_postings(token: np.ndarray, node: np.ndarray, packed: np.ndarray, ranges: int) -> pa.RecordBatch:
    """A row for each range of tokens, with the postings in it."""
    order = np.argsort(token)
    token = token[order]
    range_of = ((token >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    at = np.flatnonzero(np.diff(range_of, prepend=-1))
    columns = [[_planes(x[lo:hi]) for lo, hi in zip(at, [*at[1:], len(token)], strict=True)] for x in (token, node[order], packed[order])]
    return pa.RecordBatch.from_arrays([pa.array(range_of[at], pa.int64()), *[pa.array(c, pa.binary()) for c in columns]], ["range", "token", "node", "packed"])


def met_postings(postings: DataFrame) -> DataFrame:
    """(token, node, n, layers) of packed postings: each node of a token once, of the tokens that several nodes hold.

    One shuffle; a task holds the postings of one range."""

    def met(held: list[tuple]) -> pa.RecordBatch:
        token, node, packed = (_numbers(x) for x in zip(*held, strict=True))
        order = np.lexsort((node, token))
        t, n = token[order], node[order]
        fresh = np.ones(len(t), bool)
        fresh[1:] = (t[1:] != t[:-1]) | (n[1:] != n[:-1])
        order, t = order[fresh], t[fresh]
        count = np.diff(np.append(np.flatnonzero(np.append(True, t[1:] != t[:-1])), len(t)))
        order = order[np.repeat(count > 1, count)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (token[order], node[order], packed[order] >> 3, packed[order] & 7)], ["token", "node", "n", "layers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for k, number in enumerate(batch.column(0).to_pylist()):
                if number != last and held:
                    yield met(held)
                    held = []
                last = number
                held.append(tuple(batch.column(c)[k].as_py() for c in (1, 2, 3)))
        if held:
            yield met(held)

    return postings.repartition("range").sortWithinPartitions("range").mapInArrow(releasing(run), "token long, node long, n long, layers long")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar; sets: (node, tokens as packed 64-bit numbers in order)."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(p) + len(q) - len(np.union1d(p, q)) if min(len(p), len(q)) * 100 >= percent * max(len(p), len(q)) else 0
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(releasing(check), "a long, b long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, leader_rounds: int = 3, costly: int = 20, few: int = 32, block_sets: int = 512) -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs, linked where 100 * intersection >= percent * union of the sets.

    component_id: the least id that the row reaches by links, itself included. A row without words links with nothing, and
    keeps its own id. Rows with a null id have a null component_id where no other row has their set, and lend no links
    beyond those that their set has. Repeated rows stay; other columns are ignored.

    costly: the average estimate for a prefix token from which a set takes a longer prefix. leader_rounds: how often sets are
    tried against one leader for each token before the remaining pairs are tried. few: how many sets of a token are tried pair by
    pair; those of other tokens are compared in blocks of about block_sets. None of these changes the result."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    digest = stash(digests(rows, words), "digests")
    # a set's node is the first half of its digest; it goes by the least id of its rows
    nodes = digest.where("n_shingles > 0 and id is not null").groupBy(F.col("s1").alias("node"), "s2", "n_shingles").agg(F.min("id").alias("node_id"))
    shingles = digest.agg(F.sum("n_shingles")).first()[0] or 0
    sent = docs.sparkSession.sparkContext.broadcast(sketch(rows, words, sketch_bits(shingles)))
    ranges = max(4 * docs.sparkSession.sparkContext.defaultParallelism, shingles * (100 - percent) // 100 // RANGE)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = sent.value
        seen: set[int] = set()
        held, n = [], 0
        for batch in batches:
            for _, _, hashes, ends in _sets(batch, 1, words):
                node, _ = _digest(hashes, ends)
                token, row, layers = prefixes(hashes, ends, count, percent, costly)
                # equal sets have equal postings: a task passes them on once, as far as it remembers
                fresh = np.array([x not in seen and not seen.add(x) for x in node.tolist()], bool)
                if len(seen) > 200_000:
                    seen.clear()
                slot = (token >> np.uint64(64 - int(np.log2(len(count))))).astype(np.int64)
                # what only one row holds meets no other
                k = np.flatnonzero(fresh[row] & (count[slot] > 1))
                row = row[k]
                held.append((token[k], node[row], np.diff(ends)[row] * 8 + layers[k]))
                n += len(k)
                if n >= GATHERED:
                    yield packed_postings(*(np.concatenate(x) for x in zip(*held, strict=True)), ranges)
                    held, n = [], 0
        if n:
            yield packed_postings(*(np.concatenate(x) for x in zip(*held, strict=True)), ranges)

    packed = rows.where("id is not null").mapInArrow(releasing(emit), "range long, token binary, node binary, packed binary")
    postings = stash(met_postings(packed), "postings")

    tried = None
    for k in range(leader_rounds):
        leaders = postings.groupBy("token").agg(F.min_by(F.struct("node", "n", "layers"), F.xxhash64(F.lit(k), "node")).alias("leader"))
        x = postings.select("token", *[F.col(c).alias(f"{c}x") for c in ("node", "n", "layers")])
        y = leaders.select("token", *[F.col(f"leader.{c}").alias(f"{c}y") for c in ("node", "n", "layers")])
        # a leader is seen in a part of the tokens only, and what is missed here is found in the end
        found = _candidates(x.join(y, "token").where("nodex <> nodey"), percent, share=0.5)
        tried = found if tried is None else tried.union(found)
    tried = stash(tried.distinct(), "tried")
    near = _verified(tried, rows, nodes, words, percent)
    discard(tried)
    held = stash(_across(postings, components(near)), "held")
    discard(postings)
    x, y = (held.where(F.col("sets") <= few).select("token", *[F.col(c).alias(c + s) for c in ("node", "n", "layers", "group")]) for s in "xy")
    pairs = stash(_candidates(x.join(y, "token").where("nodex < nodey and groupx <> groupy"), percent), "pairs")
    links = near.union(_verified(pairs, rows, nodes, words, percent))
    discard(pairs)
    hot = held.where(F.col("sets") > few)
    if not hot.isEmpty():
        links = links.union(_block_links(hot, rows, nodes, words, percent, block_sets))
    labels = components(links)

    of_set = nodes.join(labels, "node", "left").select(F.col("node").alias("s1"), "s2", "n_shingles", "node_id", F.coalesce("component", "node").alias("group"))
    of_set = stash(of_set, "groups")
    least = of_set.groupBy("group").agg(F.min("node_id").alias("component_id"))
    of_set = of_set.join(least, "group").select("s1", "s2", "n_shingles", "component_id")
    out = digest.join(of_set, ["s1", "s2", "n_shingles"], "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _candidates(met: DataFrame, percent: int, share: float = 1.0) -> DataFrame:
    """(a, b) of rows of shared prefix tokens (nodex, nx, layersx, nodey, ny, layersy): pairs whose sizes agree and which share as
    many tokens as similar sets do, or `share` of them and two at least."""
    close = F.expr(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)")
    both = met.where(close).groupBy(F.least("nodex", "nodey").alias("a"), F.greatest("nodex", "nodey").alias("b"))
    counted = both.agg(F.count(F.lit(1)).alias("met"), F.first("nx").alias("nx"), F.first("ny").alias("ny"), F.first("layersx").alias("lx"), F.first("layersy").alias("ly"))
    outside = lambda s: f"floor((n{s} * {percent} + 99) / 100) - l{s}"  # noqa: E731  tokens that aren't in the prefix
    least = F.expr(f"ceil({percent} * (nx + ny) / {100 + percent}) - greatest({outside('x')}, {outside('y')})")
    return counted.where(F.col("met") >= (least if share == 1.0 else F.greatest(least * share, F.lit(2)))).select("a", "b")


def _verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that are similar, from the whole sets of their nodes."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = _token_sets(rows, nodes, ends, words)
    out = stash(_verify(pairs, sets, percent), "links")
    discard(sets)
    return out


def _across(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings with their group and the number of sets that hold the token (sets), of the tokens that several groups hold."""
    grouped = postings.join(labels, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
    tokens = grouped.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count(F.lit(1)).alias("sets"))
    return grouped.join(tokens.where("lo <> hi").select("token", "sets"), "token")


BLOCK_KEYS = ["token", "class1", "block1", "class2", "block2"]


def _dealt_blocks(hot: DataFrame, percent: int, block_sets: int, block_tokens: int) -> DataFrame:
    """(token, class1, block1, class2, block2, side, node, group): each set of a token in each pair of blocks that is to be compared.

    The sets of a token are parted into classes and these into blocks of about block_sets sets and block_tokens shingles. Only
    classes whose sizes agree meet: a class spans a factor of 100 / percent in size. Two kinds of classes aren't compared with
    themselves: sets of one group, and sets whose largest token is one and the same other token, since they meet there."""
    first = hot.groupBy("node").agg(F.max(F.struct("sets", "token"))["token"].alias("first"))
    held = hot.join(first, "node")
    many = block_sets // 4
    of_group = held.groupBy("token", "group").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= many).select("token", "group", F.lit(True).alias("one_group"))
    of_first = held.where("first <> token").groupBy("token", "first").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= many).select("token", "first", F.lit(True).alias("one_first"))
    held = held.join(of_group, ["token", "group"], "left").join(of_first, ["token", "first"], "left")
    step = -np.log(percent / 100) * 1.0001 if percent < 100 else 1e-9
    held = held.select(
        "token", "node", "group", "n", F.floor(F.log("n") / step).alias("span"), F.coalesce("one_group", "one_first", F.lit(False)).alias("done"),
        F.when(F.col("one_group"), F.xxhash64(F.lit("group"), "group")).when(F.col("one_first"), F.xxhash64(F.lit("first"), "first")).otherwise(0).alias("kind"),
    )
    classes = held.groupBy("token", "span", "kind").agg(
        F.first("done").alias("done"), F.count(F.lit(1)).alias("sets"),
        F.greatest(F.ceil(F.count(F.lit(1)) / block_sets), F.ceil(F.sum("n") / block_tokens)).cast("int").alias("blocks"),
    )
    x, y = (classes.select("token", *[F.col(c).alias(c + s) for c in ("span", "kind", "done", "sets", "blocks")]) for s in "xy")
    same = "(spanx = spany and kindx = kindy)"
    meet = x.join(y, "token").where(f"abs(spanx - spany) <= 1 and if(kindx = kindy, not donex and (not {same} or setsx > 1), true)")
    meet = meet.select("token", F.col("spanx").alias("span"), F.col("kindx").alias("kind"), "blocksx", F.col("spany").alias("span2"), F.col("kindy").alias("kind2"), "blocksy")
    own = held.drop("done").join(meet, ["token", "span", "kind"])
    own = own.withColumns({
        "block": F.pmod(F.xxhash64("node"), F.col("blocksx")).cast("int"),
        "class": F.xxhash64("span", "kind"), "other": F.xxhash64("span2", "kind2"),
    })
    own = own.withColumn("block2", F.explode(F.sequence(F.lit(0), F.col("blocksy") - 1)))
    here, there = F.struct("class", "block"), F.struct(F.col("other").alias("class"), F.col("block2").alias("block"))
    lo, hi = F.least(here, there), F.greatest(here, there)
    return own.select("token", lo["class"].alias("class1"), lo["block"].alias("block1"), hi["class"].alias("class2"), hi["block"].alias("block2"), (here == lo).alias("side"), "node", "group")


def shared_counts(x: np.ndarray, x_ends: np.ndarray, y: np.ndarray, y_ends: np.ndarray, columns: int = 2048, cells: int = 1 << 22) -> np.ndarray:
    """Intersection sizes of each set of one block with each of another; x, y: their tokens one after the other.

    Tokens that many of both hold are counted by a product of 0/1 matrices, `columns` at a time, others by their pairs of sets."""
    nx, ny = len(x_ends) - 1, len(y_ends) - 1
    out = np.zeros((nx, ny), np.float32)
    xt, xi, xc = np.unique(x, return_inverse=True, return_counts=True)
    yt, yi, yc = np.unique(y, return_inverse=True, return_counts=True)
    _, xs, ys = np.intersect1d(xt, yt, assume_unique=True, return_indices=True)
    if not len(xs):
        return out
    often = xc[xs] * yc[ys] * 64 >= nx * ny
    rows = []
    for inverse, counts, shared, ends in ((xi, xc, xs, x_ends), (yi, yc, ys, y_ends)):
        place = np.full(len(counts), -1)
        place[shared] = np.arange(len(shared))
        column, row = place[inverse], np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        keep = np.flatnonzero(column >= 0)
        keep = keep[np.argsort(column[keep], kind="stable")]
        rows.append((column[keep], row[keep]))
    (cx, rx), (cy, ry) = rows
    dense = np.flatnonzero(often)
    for k in range(0, len(dense), columns):
        part = dense[k : k + columns]
        a, b = np.zeros((nx, len(part)), np.float32), np.zeros((ny, len(part)), np.float32)
        for m, c, r in ((a, cx, rx), (b, cy, ry)):
            at = np.searchsorted(part, c)
            inside = (at < len(part)) & (part[np.minimum(at, len(part) - 1)] == c)
            m[r[inside], at[inside]] = 1
        out += a @ b.T
    sparse = np.flatnonzero(~often)
    wx, wy = np.bincount(cx, minlength=len(xs)), np.bincount(cy, minlength=len(xs))
    sx, sy = np.cumsum(wx) - wx, np.cumsum(wy) - wy
    todo = np.cumsum(wx[sparse] * wy[sparse])
    for lo in range(0, int(todo[-1]) if len(todo) else 0, cells):
        part = sparse[np.searchsorted(todo, lo, "right") if lo else 0 : np.searchsorted(todo, lo + cells, "right")]
        each = ragged(wx[part], sx[part])
        width = np.repeat(wy[part], wx[part])
        i, j = np.repeat(rx[each], width), ry[ragged(width, np.repeat(sy[part], wx[part]))]
        out += np.bincount(i * ny + j, minlength=nx * ny).reshape(nx, ny)
    return out


def _joined(near: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """near: whether set i of one block is similar to set j of another; x, y: their groups. (k, 2): groups that become one."""
    names, g = np.unique(np.concatenate([x, y]), return_inverse=True)
    gx, gy = g[: len(x)], g[len(x) :]
    i, j = np.nonzero(near & (gx[:, None] != gy))
    if not len(i):
        return np.zeros((0, 2), np.int64)
    links = np.unique(np.minimum(gx[i], gy[j]) * len(names) + np.maximum(gx[i], gy[j]))
    a, b = links // len(names), links % len(names)
    label = np.arange(len(names))
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if (least == label).all():
            break
        label = least
    moved = np.flatnonzero(label != np.arange(len(names)))
    return np.stack([names[label[moved]], names[moved]], axis=1)


def _block_links(hot: DataFrame, rows: DataFrame, nodes: DataFrame, words: int, percent: int, block_sets: int, block_tokens: int = 1 << 19) -> DataFrame:
    """(a, b) of groups to be made one: for each token, all its sets that aren't in one group are compared, block by block."""
    dealt = stash(_dealt_blocks(hot, percent, block_sets, block_tokens), "dealt")
    sets = _token_sets(rows, nodes, dealt.select("node").distinct(), words)
    whole = dealt.join(sets, "node").select(*BLOCK_KEYS, "side", "group", "tokens")

    def compare(keys: list, held: list[tuple[bool, int, bytes]]) -> np.ndarray:
        sides = []
        for side in (True, False):
            mine = [(g, np.frombuffer(t, np.uint64)) for s, g, t in held if s == side]
            size = np.array([len(t) for _, t in mine], np.int64)
            sides.append((np.array([g for g, _ in mine], np.int64), np.concatenate([t for _, t in mine]) if mine else None, np.concatenate([[0], np.cumsum(size)]), size))
        if sides[1][1] is None and keys[1:3] == keys[3:5]:
            sides[1] = sides[0]
        (gx, x, x_ends, nx), (gy, y, y_ends, ny) = sides
        if x is None or y is None:
            return np.zeros((0, 2), np.int64)
        both = shared_counts(x, x_ends, y, y_ends).astype(np.int64)
        return _joined(100 * both >= percent * (nx[:, None] + ny - both), gx, gy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
            out = []
            for k, (key, side, group) in enumerate(zip(keys, batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True)):
                if key != last and held:
                    out.append(compare(list(last), held))
                    held = []
                last = key
                held.append((side, group, batch.column(7)[k].as_py()))
            if out:
                out = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])
        if held:
            out = compare(list(last), held)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    found = stash(whole.repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS).mapInArrow(releasing(run), "a long, b long"), "joined")
    discard(dealt)
    discard(sets)
    return found


def _token_sets(rows: DataFrame, nodes: DataFrame, ends: DataFrame, words: int, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(node, tokens) of the nodes in ends: the set of one row of each, packed. Their ids are broadcast up to broadcast_rows, and
    joined by a shuffle beyond."""
    ends = stash(ends, "ends")
    of_node = nodes.join(ends, "node").groupBy("node").agg(F.min("node_id").alias("pick"))
    if ends.limit(broadcast_rows + 1).count() <= broadcast_rows:
        of_node = F.broadcast(of_node)
    picked = rows.join(of_node, F.col("id") == F.col("pick")).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, hashes, ends in _sets(batch, 1, words):
                a, _ = _digest(hashes, ends)
                offsets = pa.array((ends * 8).astype(np.int64))
                tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, offsets.buffers()[1], pa.py_buffer(hashes.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), tokens, pa.array(a)], ["node", "tokens", "s1"])

    made = picked.mapInArrow(releasing(run), "node long, tokens binary, s1 long")
    # an id may have rows with other texts, and rows with the same one
    out = stash(made.where("s1 = node").dropDuplicates(["node"]).select("node", "tokens"), "sets")
    discard(ends)
    return out
