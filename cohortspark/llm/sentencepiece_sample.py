"""Sampled SentencePiece segmentations: forward filtering and backward sampling over the piece lattice."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import byte_column, chunks, mix, releasing
from .vocabulary import MODEL, SEGMENTS, Vocabulary, load_vocabulary

#: Characters that are segmented at a time, so that temporary arrays stay small.
PART = 1 << 17
#: Segments of more characters are drawn alone, one position at a time: there is nothing to do side by side in one long lattice.
LONG = 1 << 10
_STEP = 0x9E3779B97F4A7C15


class Lattices:
    """Backward distributions of the segments seen so far, in flat arrays of a fixed number of edges.

    Segment w of n characters has nodes base[w] + 1 .. base[w] + n, one for each end. The edges of node v stand together from
    first[v] on, each with the probability of the edges up to and with it. When the arrays are full they are emptied; only
    segments that need more at once make them larger."""

    def __init__(self, vocabulary: Vocabulary, alpha: float, most_edges: int = 3_000_000):
        self.vocabulary, self.alpha, self.most_edges = vocabulary, alpha, most_edges
        pieces = {i: (len(t), s) for t, i, s in vocabulary.pieces}
        self.widths = np.array([pieces.get(i, (0, 0))[0] for i in range(vocabulary.size)], np.int32)
        self.scores = np.array([pieces.get(i, (0, 0))[1] for i in range(vocabulary.size)]) * alpha
        # what stands for a character without pieces: token size + k is its UTF-8 bytes
        self.spelled: dict[str, int] = {}
        self.token_ids: list[tuple[int, ...]] = [(i,) for i in range(vocabulary.size)]
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.nodes, self.edges, n = 0, 0, self.most_edges
        # pages of these are taken when they are written
        self.base, self.length = np.zeros(n // 8, np.int32), np.zeros(n // 8, np.int32)
        self.first = np.zeros(n, np.int32)
        self.reached, self.tokens, self.back = np.zeros(n), np.zeros(n, np.int32), np.zeros(n, np.int16)

    def add(self, segments: list[str]) -> bool:
        """Forward filtering of new segments, all at once: the weight of a node is the sum over its edges. False, and nothing
        added, if there is no room beside other segments."""
        size = np.array([len(x) for x in segments], np.int64)
        text = "\0".join(segments)
        start = np.cumsum(size + 1) - size - 1
        end, token = self.vocabulary.matches(text)
        if self.index and (self.edges + len(end) + size.sum() > len(self.reached) or len(self.index) + len(segments) > len(self.base)):
            return False
        word_at = np.repeat(np.arange(len(segments), dtype=np.int32), size + 1)
        base = np.cumsum(size) - size
        word, width, score = word_at[end], self.widths[token], self.scores[token]
        node = base[word] + end - start[word]
        single = np.zeros(int(size.sum()), bool)
        single[node[width == 1]] = True
        if not single.all():
            bare = np.flatnonzero(~single)
            w = np.searchsorted(base, bare, "right") - 1
            chars = [text[k] for k in (start[w] + bare - base[w]).tolist()]
            node = np.concatenate([node, bare])
            token = np.concatenate([token, np.array([self.spell(c) for c in chars], np.int32)])
            width = np.concatenate([width, np.ones(len(bare), np.int32)])
            score = np.concatenate([score, np.full(len(bare), self.alpha * self.vocabulary.unknown_score)])
            word = np.concatenate([word, w])
        place = node - base[word] + 1
        order = np.lexsort((node, place))
        ends = np.cumsum(np.bincount(place, minlength=1))
        forward, reached = np.zeros(len(single)), np.zeros(len(node))
        for e in range(1, len(ends)):
            k = order[ends[e - 1] : ends[e]]
            n, w = node[k], width[k]
            weight = score[k] + np.where(w == e, 0.0, forward[n - w])
            new = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))
            edges = np.diff(np.append(new, len(n)))
            top = np.maximum.reduceat(weight, new)
            weight = np.exp(weight - np.repeat(top, edges))
            total = np.add.reduceat(weight, new)
            forward[n[new]] = top + np.log(total)
            run = np.cumsum(weight)
            reached[k] = (run - np.repeat(run[new] - weight[new], edges)) / np.repeat(total, edges)
        by_node = np.argsort(node, kind="stable")
        node, reached = node[by_node], reached[by_node]
        new = np.concatenate([[True], node[1:] != node[:-1]])
        reached[np.append(np.flatnonzero(new)[1:] - 1, len(node) - 1)] = 2.0  # the last edge takes what rounding leaves
        known, n_nodes, n_edges = len(self.index), self.nodes, self.edges
        self.base = _put(self.base, known, base + n_nodes)
        self.length = _put(self.length, known, size)
        self.first = _put(self.first, n_nodes + 1, np.flatnonzero(new) + n_edges)
        self.reached = _put(self.reached, n_edges, reached)
        self.tokens = _put(self.tokens, n_edges, token[by_node])
        self.back = _put(self.back, n_edges, width[by_node])
        self.nodes, self.edges = n_nodes + len(single), n_edges + len(node)
        self.index.update(zip(segments, range(known, known + len(segments))))
        return True

    def spell(self, char: str) -> int:
        if (token := self.spelled.get(char)) is None:
            token = self.spelled[char] = len(self.token_ids)
            self.token_ids.append(tuple(self.vocabulary.byte_ids[b] for b in char.encode()))
        return token

    def sample(self, segments: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, number of tokens for each segment); seeds: a 64-bit number for each segment."""
        fresh = [x for x in dict.fromkeys(segments) if x not in self.index]
        if fresh and not self.add(fresh):
            self.clear()
            self.add(list(dict.fromkeys(segments)))
        which = np.fromiter(map(self.index.__getitem__, segments), np.int64, len(segments))
        base = self.base[which]
        at = base + self.length[which]
        alive, steps, step = np.arange(len(which)), [], 0
        while len(alive):
            here = at[alive]
            edge = self.first[here]
            u = (mix(seeds[alive] + np.uint64(step * _STEP & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            more = np.flatnonzero(u >= self.reached[edge])
            while len(more):
                edge[more] += 1
                more = more[u[more] >= self.reached[edge[more]]]
            steps.append((alive, self.tokens[edge]))
            here = here - self.back[edge]
            at[alive] = here
            alive = alive[here > base[alive]]
            step += 1
        count = np.zeros(len(which), np.int64)
        for a, _ in steps:
            count[a] += 1
        last = np.cumsum(count) - 1
        out = np.empty(int(count.sum()), np.int32)
        for k, (a, tokens) in enumerate(steps):
            out[last[a] - k] = tokens
        return out, count

    def edges_of(self, segment: str, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The edges that end at nodes lo + 1 .. hi of a segment, node by node: (place of each node's first edge and the end,
        tokens, widths, scores), in the order in which add() holds them."""
        begin = max(0, lo - int(self.widths.max()) + 1)
        end, token = self.vocabulary.matches(segment[begin:hi])
        own = end >= lo - begin
        node, token = end[own] + (begin - lo), token[own]
        width, score = self.widths[token], self.scores[token]
        single = np.zeros(hi - lo, bool)
        single[node[width == 1]] = True
        if not single.all():
            bare = np.flatnonzero(~single)
            token = np.concatenate([token, np.array([self.spell(segment[lo + k]) for k in bare.tolist()], np.int32)])
            node = np.concatenate([node, bare])
            width = np.concatenate([width, np.ones(len(bare), np.int32)])
            score = np.concatenate([score, np.full(len(bare), self.alpha * self.vocabulary.unknown_score)])
        order = np.argsort(node, kind="stable")
        node, token, width, score = node[order], token[order], width[order], score[order]
        return np.searchsorted(node, np.arange(hi - lo + 1)), token, width, score

    def sample_long(self, segment: str, seed: np.uint64, window: int = 1 << 16) -> np.ndarray:
        """The tokens that sample() draws for one segment, for segments of any length.

        Forward filtering keeps one weight for each character; edges are held for a window only, and are found again, window by
        window from the end, when tokens are drawn backwards. So memory is eight bytes a character beside the window, and time
        is linear in the characters."""
        n, exp, log = len(segment), math.exp, math.log
        forward = array("d", bytes(8 * (n + 1)))
        for lo in range(0, n, window):
            hi = min(n, lo + window)
            first, _, width, score = (x.tolist() for x in self.edges_of(segment, lo, hi))
            for node in range(lo + 1, hi + 1):
                a, b = first[node - lo - 1], first[node - lo]
                if b - a == 1:
                    forward[node] = forward[node - width[a]] + score[a]
                else:
                    weights = [forward[node - w] + s for w, s in zip(width[a:b], score[a:b])]
                    top = max(weights)
                    forward[node] = top + log(sum([exp(x - top) for x in weights]))
        reach, node, step, parts = np.frombuffer(forward, np.float64), n, 0, []
        while node:
            hi, lo = node, max(0, node - window)
            first, token, width, score = self.edges_of(segment, lo, hi)
            count = np.diff(first)
            end = np.repeat(np.arange(lo + 1, hi + 1), count)
            weight = np.exp(score + reach[end - width] - reach[end])
            run, total = np.cumsum(weight), np.add.reduceat(weight, first[:-1])
            below = (run - np.repeat(run[first[:-1]] - weight[first[:-1]], count)) / np.repeat(total, count)
            below[first[1:] - 1] = 2.0  # the last edge takes what rounding leaves
            steps = np.arange(step, step + hi - lo, dtype=np.uint64) * np.uint64(_STEP)
            draws = ((mix(steps + seed) >> np.uint64(11)).astype(np.float64) * 2.0**-53).tolist()
            first, width, below, drawn = first.tolist(), width.tolist(), below.tolist(), []
            while node > lo:
                edge, u = first[node - lo - 1], draws[len(drawn)]
                while u >= below[edge]:
                    edge += 1
                drawn.append(edge)
                node -= width[edge]
            parts.append(token[np.array(drawn)])
            step += len(drawn)
        return np.concatenate(parts)[::-1]


def _put(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """array with values from `at` on, in a larger copy if they don't fit."""
    need = at + len(values)
    if need > len(array):
        array = np.concatenate([array, np.zeros(need - len(array), array.dtype)])
    array[at:need] = values
    return array


def ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0] + 1, ... (lengths[0] of them), starts[1], ..."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Decoder:
    """Bytes of many ids at once: piece texts and bytes in order, the space prefix included."""

    def __init__(self, vocabulary: Vocabulary):
        self.lengths = np.array([len(x) for x in vocabulary.piece_bytes], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.flat = np.frombuffer(b"".join(vocabulary.piece_bytes), np.uint8)

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.lengths[ids]
        return self.flat[ragged(lengths, self.starts[ids])], lengths


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """The text that sample_encode() was given: ids in order, without the space prefix."""
    return b"".join(vocabulary.piece_bytes[i] for i in ids)[1:].decode()


class Sampler:
    """Ids of the rows of a task, some at a time."""

    def __init__(self, vocabulary: Vocabulary, alpha: float):
        self.vocabulary, self.lattices, self.decoder = vocabulary, Lattices(vocabulary, alpha), Decoder(vocabulary)

    def ids(self, segments: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids for each segment), PART characters at a time; a long segment stands alone."""
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        done, long = np.cumsum(size), np.flatnonzero(size > LONG)
        parts = np.searchsorted(done, np.arange(PART, done[-1], PART), "left") + 1
        cuts = np.unique(np.concatenate([[0, len(segments)], parts, long, long + 1])).tolist()
        found = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if size[a] > LONG:
                drawn = self.lattices.sample_long(segments[a], seeds[a])
                found.append((drawn, np.array([len(drawn)])))
            else:
                found.append(self.lattices.sample(segments[a:b], seeds[a:b]))
        tokens, count = (np.concatenate(x) for x in zip(*found, strict=True))
        at = np.flatnonzero(tokens >= self.vocabulary.size)
        if len(at):
            # only characters without a piece are longer than one id
            spelled = self.lattices.token_ids[self.vocabulary.size :]
            widths = np.array([len(x) for x in spelled], np.int64)
            flat, which = np.array([i for x in spelled for i in x], np.int32), tokens[at] - self.vocabulary.size
            size = np.ones(len(tokens), np.int64)
            size[at] = widths[which]
            starts = np.cumsum(size) - size
            out = np.repeat(tokens, size)
            out[ragged(size[at], starts[at])] = flat[ragged(size[at], (np.cumsum(widths) - widths)[which])]
            owner = np.searchsorted(np.cumsum(count), at, "right")
            np.add.at(count, owner, size[at] - 1)
            tokens = out
        return tokens, count

    def encode(self, texts: list[str | None], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bool | None]]:
        """(ids of all texts, number for each text, whether they decode to it)."""
        found = [SEGMENTS.findall(" " + x) if x else [] for x in texts]
        per_row = np.array([len(x) for x in found], np.int64)
        if not per_row.sum():
            return np.zeros(0, np.int32), per_row, [None if x is None else True for x in texts]
        place = ragged(per_row, np.zeros(len(per_row), np.int64)).astype(np.uint64)
        tokens, count = self.ids([s for x in found for s in x], mix(np.repeat(rows, per_row) ^ mix(place + np.uint64(1))))
        n = np.add.reduceat(np.append(count, 0), np.minimum(np.cumsum(per_row) - per_row, len(count))) * (per_row > 0)
        ends, same = np.cumsum(n), []
        for x, lo, hi in zip(texts, ends - n, ends, strict=True):
            same.append(None if x is None else self.decoder(tokens[lo:hi])[0].tobytes() == ((b" " + x.encode()) if x else b""))
        return tokens, n, same


def sample_encode(docs: DataFrame, model: str = MODEL, alpha: float = 0.001, seed: int = 1, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, ids array<int>, n_pieces int and lossless boolean for each row.

    P(segmentation) is proportional to exp(alpha * sum of the pieces' scores). Draws are seeded by seed and the row's keys
    (all of them), so that a rerun gives the same ids and repeated rows get equal ones. lossless: decoding the ids gave back
    the text. A character without a piece stands as its UTF-8 bytes, U+2581 too. A null text has null ids, 0 pieces and
    null lossless; an empty text has no ids. Other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model))
    n_keys = len(keys)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(sent.value, alpha)
        for whole in batches:
            _, offsets = byte_column(whole.column(n_keys))
            for lo, hi in chunks(offsets, PART):
                batch = whole.slice(lo, hi - lo)
                texts = batch.column(n_keys).to_pylist()
                tokens, n, same = sampler.encode(texts, batch.column(n_keys + 1).to_numpy().astype(np.uint64))
                starts = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                null = np.array([x is None for x in texts], bool)
                ids = pa.ListArray.from_arrays(pa.array(starts), pa.array(tokens), mask=pa.array(null) if null.any() else None)
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], ids, pa.array(n.astype(np.int32)), pa.array(same, pa.bool_())], [*(f"k{i}" for i in range(n_keys)), "ids", "n_pieces", "lossless"])

    fields = ", ".join(f"k{i} {docs.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    rows = docs.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).cast("string").alias("text"), F.xxhash64(F.lit(seed), *keys).alias("row"))
    out = rows.mapInArrow(releasing(encode), f"{fields}, ids array<int>, n_pieces int, lossless boolean")
    return out.withColumnsRenamed({f"k{i}": k for i, k in enumerate(keys)})
