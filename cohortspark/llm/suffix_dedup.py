"""Suffix-array dedup: removal of bytes that long repeated strings cover, over all texts.

1. Anchors: of the 40-byte strings in a window of `length` bytes, those of the least hash. Equal windows have equal anchors
   at equal places, so that a repeated window is found among the contexts of one anchor's occurrences.
2. Occurrences with equal contexts (all windows that hold the anchor) are counted as one class. A class of two or more
   occurrences is repeated as a whole.
3. The classes of an anchor are sorted by what follows it and by what precedes it (backwards) with a deep-shallow sort:
   multikey quicksort to a shallow depth, blind tries for the groups that are still equal there. The common prefixes of
   neighbours give for each pair of classes the longest match around the anchor.
4. An anchor with more than `most_classes` classes is split: its windows are halved by how far they begin before the anchor,
   and the classes part by what all windows of a half share. Members that agree in all that a half's windows reach are
   repeated there, and one of them stands for them. This goes on until groups are small."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh_name, stash
from .runs import gather
from .textbytes import byte_column, chunks, mix, prefix_hashes, releasing, span_hash

ANCHOR = 40
SHALLOW = 32
#: Bytes of text that a task looks at together: the arrays of its anchors take some 55 times that.
TEXT = 1 << 18
#: Contexts that a task cuts together; the arrays that place their bytes take some 30 bytes for each.
PART = 4096


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least (or greatest) of x[i : i + width] for each i with a whole window."""
    f, step = (np.minimum if least else np.maximum), 1
    while step * 2 <= width:
        x = f(x[:-step], x[step:])
        step *= 2
    return f(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in its text, hash, context hash, bytes before, bytes after) of the anchors of some texts.

    The context is what the windows that hold the anchor can reach, cut at the ends of the text."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    text, at, reach = data[lo:hi], offsets - lo, length - ANCHOR
    n = len(text)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none, none
    prefix = prefix_hashes(text)
    i = np.arange(n - ANCHOR + 1)
    h = mix(span_hash(prefix, i, i + ANCHOR))
    least = _sliding(h, reach + 1, True)
    # windows across two texts choose nothing
    ends = np.repeat(at[1:], np.diff(at))
    least = np.where(np.arange(len(least)) + length <= ends[: len(least)], least, np.uint64(0))
    edge = np.zeros(reach, np.uint64)
    chosen = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), reach + 1, False)[: len(h)] == h)
    chosen = chosen[h[chosen] != 0]
    row = np.searchsorted(at, chosen, "right") - 1
    before = np.minimum(chosen - at[row], reach)
    after = np.minimum(at[row + 1] - chosen, length)
    keep = (after >= ANCHOR) & (before + after >= length)
    chosen, row, before, after = chosen[keep], row[keep], before[keep], after[keep]
    context = mix(span_hash(prefix, chosen - before, chosen + after) + (before * 1024 + after).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return row, chosen - at[row], h[chosen], context, before, after


class Branch:
    """An inner node of a blind trie: the length that its strings share, and its children by the next byte (-1: the end).
    A leaf is the list of the indices of equal strings."""

    __slots__ = ("length", "kids")

    def __init__(self, length: int, kids: dict):
        self.length, self.kids = length, kids


def _byte(s: bytes, at: int) -> int:
    return s[at] if at < len(s) else -1


def _common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of a and b, which share `start` bytes."""
    lo, hi = start, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _blind_trie(strings: list[bytes], group: list[int], depth: int) -> Branch | list[int]:
    """A trie of a group that shares `depth` bytes. A string goes down blindly to some leaf, is compared with that one string,
    and is put in where they part."""
    root: Branch | list[int] = [group[0]]
    for i in group[1:]:
        s, node, path = strings[i], root, []
        while isinstance(node, Branch):
            path.append(node)
            node = node.kids.get(_byte(s, node.length)) or next(iter(node.kids.values()))
        other = strings[node[0]]
        n = _common(s, other, depth)
        if n == len(s) == len(other):
            node.append(i)
            continue
        above = next((b for b in reversed(path) if b.length < n), None)
        below = root if above is None else above.kids[_byte(s, above.length)]
        if isinstance(below, Branch) and below.length == n:
            below.kids[_byte(s, n)] = [i]
            continue
        made = Branch(n, {_byte(other, n): below, _byte(s, n): [i]})
        if above is None:
            root = made
        else:
            above.kids[_byte(s, above.length)] = made
    return root


def deep_shallow_sort(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """(order, common): the sorted order of strings that share `depth` bytes, and for each place in it the length of the
    prefix that is common to the string there and the one before (0 at the first). Equal strings keep their order.

    Multikey quicksort to `shallow` more bytes; groups that are still together are ordered by blind tries. What a group shares is
    the common prefix of its least and greatest string, and isn't partitioned byte by byte."""
    order: list[int] = []
    common: list[int] = []
    deep, todo = depth + shallow, [(list(range(len(strings))), depth, 0)]
    while todo:
        group, depth, left = todo.pop()
        if len(group) == 1:
            order.append(group[0])
            common.append(left)
            continue
        own = [strings[i] for i in group]
        depth = _common(min(own), max(own), depth)
        if depth >= deep:
            stack = [(_blind_trie(strings, group, depth), left)]
            while stack:
                node, lead = stack.pop()
                if isinstance(node, Branch):
                    kids = sorted(node.kids.items(), key=lambda x: x[0])
                    stack += [(kid, lead if k == 0 else node.length) for k, (_, kid) in reversed(list(enumerate(kids)))]
                else:
                    order += node
                    common += [lead] + [len(strings[node[0]])] * (len(node) - 1)
        else:
            pivot = _byte(own[len(own) // 2], depth)
            less, same, more = [], [], []
            for i, s in zip(group, own, strict=True):
                c = s[depth] if depth < len(s) else -1
                (same if c == pivot else less if c < pivot else more).append(i)
            if pivot < 0:  # they end here, so that they are equal and come first
                order += same
                common += [left] + [depth] * (len(same) - 1)
                left, parts = depth, [(more, depth)] if more else []
            else:
                parts = [x for x in ((less, depth), (same, depth + 1), (more, depth)) if x[0]]
            todo += [(g, d, left if k == 0 else depth) for k, (g, d) in reversed(list(enumerate(parts)))]
    return order, common


def _pairwise(order: list[int], common: list[int]) -> np.ndarray:
    """Common prefix of each pair of strings, from their sorted order: the least one between their places."""
    n = len(order)
    m = np.zeros((n, n), np.int64)
    c, places = np.array(common), np.array(order)
    for k in range(n - 1):
        m[places[k], places[k + 1 :]] = m[places[k + 1 :], places[k]] = np.minimum.accumulate(c[k + 1 :])
    return m


def longest_matches(left: list[bytes], right: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes before, bytes after the anchor) of the union of each occurrence's matches of `length` bytes or more with another
    one; 0, 0 without any. left: what stands before the anchor, backwards; right: the anchor and what follows."""
    after = _pairwise(*deep_shallow_sort(right, ANCHOR))
    before = _pairwise(*deep_shallow_sort(left))
    long = before + after >= length
    np.fill_diagonal(long, False)
    return np.where(long, before, 0).max(axis=1), np.where(long, after, 0).max(axis=1)


PLACE = "did long, rid long, pos int"


def _anchor_table(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["did", "rid", "pos", "h", "context", "before", "after"]
        for batch in batches:
            data, offsets = byte_column(batch.column(2))
            for lo, hi in chunks(offsets, TEXT):
                row, pos, h, context, before, after = anchors(data, offsets[lo : hi + 1], length)
                at = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x.astype(t) if t else x.view(np.int64)) for x, t in ((pos, np.int32), (h, None), (context, None), (before, np.int16), (after, np.int16)))], names)

    return rows.mapInArrow(releasing(run), f"{PLACE}, h long, context long, before short, after short")


def _cut(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: (did, rid, pos, h, before, after, size); (did, rid, pos, key, size, left, right) with the bytes before (backwards)
    and after each place, once for rows that docs hold several times."""
    lists = wanted.groupBy("did", "rid").agg(F.collect_list(F.struct("pos", "h", "before", "after", "size")).alias("places"))
    lists = lists.withColumnsRenamed({"did": "d2", "rid": "r2"})
    both = rows.join(lists, (F.col("rid") == F.col("r2")) & (F.col("did") == F.col("d2"))).select("did", "rid", "text", "places")
    both = both.groupBy("did", "rid").agg(F.first("text").alias("text"), F.first("places").alias("places"))
    schema = f"{PLACE}, key long, size long, left binary, right binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            data, offsets = byte_column(batch.column(2))
            backwards = data[::-1]
            row, places = _members(batch.column(3))
            for lo in range(0, len(row), PART):
                own, part = row[lo : lo + PART], places.slice(lo, PART)
                pos, h, before, after, size = part.flatten()
                at, before, after = offsets[own] + pos.to_numpy(), before.to_numpy(), after.to_numpy()
                left = gather(backwards, len(data) - at, len(data) - at + before, pa.binary())
                docs = pa.array(own)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(docs), batch.column(1).take(docs), pos, h, size, left, gather(data, at, at + after, pa.binary())], names)

    return both.mapInArrow(releasing(run), schema)


def _members(lists: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """(row, member) of all members of a column of lists."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def _solve(groups: DataFrame, length: int) -> DataFrame:
    """(did, rid, pos, back, forward) of the occurrences in small groups of one key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def solved() -> list[tuple]:
            back, forward = longest_matches([x[4] for x in held], [x[5] for x in held], length)
            return [(x[1], x[2], x[3], int(b), int(f)) for x, b, f in zip(held, back, forward, strict=True) if f]

        for pdf in batches:
            out: list[tuple] = []
            for x in zip(pdf["key"], pdf["did"], pdf["rid"], pdf["pos"], pdf["left"], pdf["right"], strict=True):
                if held and held[-1][0] != x[0]:
                    out += solved()
                    held = []
                held.append(x)
            yield pd.DataFrame(out, columns=["did", "rid", "pos", "back", "forward"])
        if held:
            yield pd.DataFrame(solved(), columns=["did", "rid", "pos", "back", "forward"])

    dealt = groups.select("key", "did", "rid", "pos", "left", "right").repartition("key").sortWithinPartitions("key")
    return dealt.mapInPandas(releasing(run), f"{PLACE}, back int, forward int")


def _split(groups: DataFrame, length: int) -> DataFrame:
    """The two halves of each member's range lo..hi of bytes before the anchor: keyed by what all windows of the half share, with
    the bytes that any of them can reach and a hash of these (cls)."""

    def number(head: bytes, a: bytes, b: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(head + a + b, digest_size=8).digest(), "little", signed=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, did, rid, pos, left, right, lo, hi in zip(*(pdf[c] for c in ("key", "did", "rid", "pos", "left", "right", "lo", "hi")), strict=True):
                middle = (lo + hi) // 2
                for x, y in ((lo, middle), (middle + 1, hi)):
                    a, b = left[:y], right[: length - x]
                    if len(a) >= x and len(b) >= length - y and len(a) + len(b) >= length:
                        own = number(b"%d %d %d " % (key, x, y), a[:x], b[: length - y])
                        out.append((own, number(b"%d %d " % (own, len(a)), a, b), did, rid, pos, a, b, x, y))
            yield pd.DataFrame(out, columns=["key", "cls", "did", "rid", "pos", "left", "right", "lo", "hi"])

    fields = groups.select("key", "did", "rid", "pos", "left", "right", "lo", "hi")
    return fields.mapInPandas(releasing(run), f"key long, cls long, {PLACE}, left binary, right binary, lo int, hi int")


def repeated_spans(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text: str = "text", most_classes: int = 128) -> DataFrame:
    """(did, rid, spans array<struct<start int, end int>>) for the texts of which something is repeated: bytes that a string of
    `length` bytes covers that also starts elsewhere, in the same text or another one. rid: xxhash64(id, text).

    length is over 40 (ANCHOR). Spans may overlap. A null text is empty; a text shorter than length has no spans; rows that are
    repeated as a whole repeat each other."""
    if length <= ANCHOR:
        raise ValueError(f"length must be over {ANCHOR}")
    rows = _rows(docs, id_col, text)
    every = stash(_anchor_table(rows, length), "anchors")
    keys = every.groupBy("h").agg(F.count(F.lit(1)).alias("k"), (F.min("context") != F.max("context")).alias("mixed")).where("k > 1").select("h", "mixed")
    found = stash(every.join(keys, "h"), "repeated")
    discard(every)
    first = F.min(F.struct("did", "rid", "pos")).alias("rep")
    classes = found.groupBy("h", "context").agg(F.count(F.lit(1)).alias("n"), first, F.first("before").alias("before"), F.first("after").alias("after"), F.first("mixed").alias("mixed"))
    classes = stash(classes, "classes")
    several = classes.where("n > 1").select("h", "context")
    whole = found.join(several, ["h", "context"]).select("did", "rid", F.expr("pos - before").alias("start"), F.expr("pos + after").alias("end"))
    sizes = classes.where("mixed").groupBy("h").agg(F.count(F.lit(1)).alias("size"))
    wanted = classes.where("mixed").join(sizes, "h").select("rep.did", "rep.rid", "rep.pos", "h", "before", "after", "size")
    level = _cut(rows, wanted).withColumns({"lo": F.lit(0), "hi": F.lit(length - ANCHOR)})
    parts = [whole]
    while True:
        level = stash(level, "level")
        solved = _solve(level.where(F.col("size") <= most_classes), length)
        parts.append(solved.select("did", "rid", F.expr("pos - back").alias("start"), F.expr("pos + forward").alias("end")))
        large = level.where(F.col("size") > most_classes)
        if large.isEmpty():
            break
        pieces = stash(_split(large, length), "pieces")
        counts = pieces.groupBy("key", "cls").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("did", "rid", "pos")).alias("rep"))
        counts = stash(counts, "counts")
        # members that agree in all that the half's windows reach are repeated there; one of them goes on for the others
        equal = pieces.drop("key").join(counts.where("m > 1").select("cls"), "cls")
        parts.append(equal.select("did", "rid", F.expr("pos - octet_length(left)").alias("start"), F.expr("pos + octet_length(right)").alias("end")))
        sizes = counts.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        going = counts.join(sizes, "key").select("cls", "rep", "size")
        same = F.struct("did", "rid", "pos").eqNullSafe(F.col("rep"))
        level = pieces.join(going, "cls").where(same).select("did", "rid", "pos", "key", "size", "left", "right", "lo", "hi")
    spans = parts[0]
    for part in parts[1:]:
        spans = spans.union(part)
    return spans.groupBy("did", "rid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(_did(id_col), F.xxhash64(F.col(id_col).cast("long"), body).alias("rid"), body.alias("text"))


def _did(id_col: str) -> Column:
    """The id without nulls, which pandas would turn into floats; rid tells a null from the number that stands for it."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("did")


def _runs(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the maximal runs of the union of spans; places count on from row to row, and runs end with their row."""
    order = np.lexsort((start, row))
    row, start, reach = row[order], start[order], np.maximum.accumulate(end[order])
    first = np.ones(len(row), bool)
    first[1:] = (start[1:] > reach[:-1]) | (row[1:] != row[:-1])
    return row[first], start[first], reach[np.append(first[1:], True)] if len(row) else reach


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text: str = "text", most_classes: int = 128) -> DataFrame:
    """docs with n_bytes long, n_removed long, n_spans long, kept binary: the size of each whole text in UTF-8, the bytes that
    repeated strings cover, the number of maximal removed runs and the bytes that are left.

    kept may cut characters; kept_text string is kept without the parts of characters that are cut. Both judge all texts as they
    are given. The id column is an integer. Columns of docs with these names are replaced; all others stay, whatever their names."""
    added = ["n_bytes", "n_removed", "n_spans", "kept", "kept_text"]
    docs = docs.drop(*added)
    spans = repeated_spans(docs, length, id_col, text, most_classes)
    did, rid, held = fresh_name(docs, "span_did", "span_rid", "span_list")
    spans = spans.withColumnsRenamed({"did": did, "rid": rid, "spans": held})
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    on = (F.xxhash64(F.col(id_col).cast("long"), body) == F.col(rid)) & (_did(id_col) == F.col(did))
    both = docs.join(spans, on, "left").select(*docs.columns, held)
    place, n = docs.columns.index(text), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column(place))
            held, spans = _members(batch.column(n))
            starts, ends = (x.to_numpy() + offsets[held] for x in spans.flatten())
            for lo, hi in chunks(offsets, TEXT):
                base, at = int(offsets[lo]), offsets[lo : hi + 1] - offsets[lo]
                own = slice(*np.searchsorted(held, [lo, hi]))
                row, start, end = _runs(held[own] - lo, starts[own] - base, ends[own] - base)
                edge = np.zeros(int(at[-1]) + 1, np.int8)
                edge[start] += 1
                edge[end] -= 1
                body = data[base : base + int(at[-1])][np.cumsum(edge[:-1], dtype=np.int8) == 0]
                removed = np.bincount(row, end - start, minlength=hi - lo).astype(np.int64)
                places = np.zeros(hi - lo + 1, np.int64)
                np.cumsum(np.diff(at) - removed, out=places[1:])
                kept = gather(body, places[:-1], places[1:], pa.binary())
                columns = [pa.array(np.diff(at)), pa.array(removed), pa.array(np.bincount(row, minlength=hi - lo)), kept, pa.array([x.decode(errors="ignore") for x in kept.to_pylist()], pa.string())]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:n]), *columns], [*batch.schema.names[:n], *added])

    schema = docs.schema.__class__([*docs.schema.fields])
    for name, kind in zip(added, ("long", "long", "long", "binary", "string"), strict=True):
        schema = schema.add(name, kind)
    return both.mapInArrow(releasing(run), schema)
