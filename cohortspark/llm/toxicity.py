"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs.

The network reads windows of words; a document's score is that of its worst window, through a logistic calibration. It is
trained in numpy on a bounded sample of labelled rows and scores all overlapping windows of whole texts on the executors."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sentencepiece_sample import ragged
from .textbytes import mix, prefix_hashes, release, releasing, span_hash

WORDS = re.compile(r"\w+")
#: Bytes of text that are learned from at most.
SAMPLE_BYTES = 64 << 20
WIDTH, STRIDE = 64, 48
HIDDEN, NGRAMS = 8, (3, 4, 5, 6)
WORD_BITS, GRAM_BITS = 18, 18
#: Evidence of the word, greatest and mean evidence of its character n-grams, and its length.
INPUTS = 4


def spell(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, hashes of all character n-grams with word ends marked, number of n-grams of each word).

    Words are read as UTF-8 bytes; each has one n-gram at least."""
    marked = [b"<" + w.encode() + b">" for w in words]
    sizes = np.array([len(m) for m in marked], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    p = prefix_hashes(np.frombuffer(b"".join(marked), np.uint8))
    whole = mix(span_hash(p, starts, ends))
    grams, owner = [], []
    for n in NGRAMS:
        count = np.maximum(sizes - n + 1, 1 if n == NGRAMS[0] else 0)
        at = ragged(count, starts)
        who = np.repeat(np.arange(len(words)), count)
        grams.append(mix(span_hash(p, at, np.minimum(at + n, ends[who])) + np.uint64(n)))
        owner.append(who)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return whole, np.concatenate(grams)[order], np.bincount(owner, minlength=len(words))


@dataclass
class Net:
    """What the executors get: evidence tables, weights and the calibration; about 2.3 MB whatever the input is."""

    word_evidence: np.ndarray
    gram_evidence: np.ndarray
    w: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def evidence(held: Iterable[np.ndarray], labels: list[int], bits: int) -> list[np.ndarray]:
    """Log odds of label 1 by slot, from the documents that hold it, shrunk to 0 where few do: as a document of label 0 has
    them without itself, as one of label 1 has them without itself, and as a new document has them.

    held: the slots of each document, one at a time."""
    counts = np.zeros((2, 1 << bits))
    for slots, label in zip(held, labels, strict=True):
        counts[label, np.unique(slots)] += 1
    prior, k = (sum(labels) + 1) / (len(labels) + 2), 2.0

    def odds(n: np.ndarray) -> np.ndarray:
        n = np.maximum(n, 0)
        return (np.log((n[1] + k * prior) / (n[0] + k * (1 - prior))) - np.log(prior / (1 - prior))).astype(np.float32)

    return [odds(counts - [[1], [0]]), odds(counts - [[0], [1]]), odds(counts)]


def word_slots(words: list[str], step: int = 1 << 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot of each word, slots of all n-grams, number of n-grams of each word); a part of the words at a time."""
    parts = [(_slots(w, WORD_BITS).astype(np.int32), _slots(g, GRAM_BITS).astype(np.int32), n) for w, g, n in (spell(words[k : k + step]) for k in range(0, len(words), step))]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def features(words: list[str], slots: tuple[np.ndarray, np.ndarray, np.ndarray], word_evidence: np.ndarray, gram_evidence: np.ndarray) -> np.ndarray:
    """The network's inputs for distinct words."""
    ws, gs, n = slots
    at, known = np.cumsum(n) - n, gram_evidence[gs]
    sizes = np.log1p([len(w) for w in words]) - 2
    return np.stack([word_evidence[ws], np.maximum.reduceat(known, at), np.add.reduceat(known, at) / n, sizes], axis=1).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _scan(gates: np.ndarray, mask: np.ndarray | None, u: np.ndarray, c: np.ndarray, backwards: bool, keep: list | None = None) -> np.ndarray:
    """Hidden states (n, t, h) of one direction; gates: inputs' share of update, reset and candidate, (t, n, 3h)."""
    t, n, h3 = gates.shape
    h = h3 // 3
    state, out = np.zeros((n, h), np.float32), np.empty((t, n, h), np.float32)
    for k in range(t - 1, -1, -1) if backwards else range(t):
        a = state @ u + c
        zr = sigmoid(gates[k, :, : 2 * h] + a[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        cand = np.tanh(gates[k, :, 2 * h :] + r * a[:, 2 * h :])
        new = cand + z * (state - cand)
        if mask is not None:
            new = np.where(mask[k], new, state)
        if keep is not None:
            keep.append((k, state, a, z, r, cand))
        state = out[k] = new
    return out


def pooled_logits(gates: np.ndarray, mask: np.ndarray | None, w: dict[str, np.ndarray], keep: dict | None = None) -> np.ndarray:
    """Logits of windows: both directions, attention over the words, one output."""
    h3 = 3 * HIDDEN
    kept = ([], []) if keep is not None else (None, None)
    both = np.concatenate([_scan(gates[:, :, :h3], mask, w["uf"], w["cf"], False, kept[0]), _scan(gates[:, :, h3:], mask, w["ub"], w["cb"], True, kept[1])], axis=2)
    s = both @ w["attend"]
    if mask is not None:
        s = np.where(mask[:, :, 0], s, -1e9)
    e = np.exp(s - s.max(axis=0))
    share = e / e.sum(axis=0)
    pooled = (share[:, :, None] * both).sum(axis=0)
    if keep is not None:
        keep.update(kept=kept, both=both, share=share, pooled=pooled)
    return pooled @ w["out"] + w["bias"][0]


def _unscan(kept: list, mask: np.ndarray, d_out: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of one direction: of its gates, u and c."""
    d_gates, du, dc = np.zeros((*d_out.shape[:2], 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros(3 * HIDDEN, np.float32)
    d_state = np.zeros_like(d_out[0])
    for k, state, a, z, r, cand in reversed(kept):
        d_new = d_state + d_out[k]
        d_live = d_new * mask[k]
        d_cand = d_live * (1 - z) * (1 - cand * cand)
        d_z = d_live * (state - cand) * z * (1 - z)
        d_r = d_cand * a[:, 2 * HIDDEN :] * r * (1 - r)
        d_a = np.concatenate([d_z, d_r, d_cand * r], axis=1)
        d_gates[k] = np.concatenate([d_z, d_r, d_cand], axis=1)
        du += state.T @ d_a
        dc += d_a.sum(axis=0)
        d_state = d_live * z + d_a @ u.T + d_new * (1 - mask[k])
    return d_gates, du, dc


def gradients(shown: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Gradients, for each weight, of the mean over windows of weight times cross-entropy; shown: (word, window, input)."""
    h, keep = HIDDEN, {}
    logits = pooled_logits(shown @ w["in"] + w["in_bias"], mask > 0, w, keep)
    d = ((sigmoid(logits) - target) * weight / len(target)).astype(np.float32)
    d_pooled = d[:, None] * w["out"]
    d_both = keep["share"][:, :, None] * d_pooled
    d_share = (keep["both"] * d_pooled).sum(axis=2)
    d_s = keep["share"] * (d_share - (keep["share"] * d_share).sum(axis=0))
    d_both += d_s[:, :, None] * w["attend"]
    gf, duf, dcf = _unscan(keep["kept"][0], mask, d_both[:, :, :h], w["uf"])
    gb, dub, dcb = _unscan(keep["kept"][1], mask, d_both[:, :, h:], w["ub"])
    gates = np.concatenate([gf, gb], axis=2)
    return {
        "in": np.tensordot(shown, gates, ((0, 1), (0, 1))), "in_bias": gates.sum(axis=(0, 1)), "uf": duf, "ub": dub, "cf": dcf, "cb": dcb,
        "attend": np.einsum("tn,tnh->h", d_s, keep["both"]), "out": keep["pooled"].T @ d, "bias": np.array([d.sum()], np.float32),
    }


def windows_of(n: np.ndarray, width: int = WIDTH, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, number of words) of overlapping windows that cover documents of n words; the last one of a
    long document ends with it. A document without words has none."""
    count = np.where(n > width, -(-(np.maximum(n, width) - width) // stride) + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), count)
    start = np.minimum(ragged(count, np.zeros(len(n), np.int64)) * stride, np.maximum(n - width, 0)[doc])
    return doc, start, np.minimum(n[doc], width)


def train(texts: list[str], labels: list[int], shares: tuple[float, float] = (1.0, 1.0), epochs: int = 8, least_steps: int = 200, seed: int = 3) -> Net | None:
    """A network from labelled texts; None where either label is missing.

    A text's own words don't count in the evidence that the network is shown for it in training. Of a text with label 1 the
    window of the greatest evidence is a positive example; of one with label 0 the window of the greatest evidence and a
    random one are negative examples. shares: what part of the rows of each label the texts are, for the calibration."""
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    ids = [np.array([index.setdefault(w, len(index)) for w in WORDS.findall(x.lower())], np.int32) for x in texts]
    if not index:
        return None
    words = list(index)
    ws, gs, n = slots = word_slots(words)
    at = np.cumsum(n) - n
    by_word = evidence((ws[x] for x in ids), labels, WORD_BITS)
    by_gram = evidence((gs[ragged(n[u], at[u])] for u in map(np.unique, ids)), labels, GRAM_BITS)
    inputs = np.concatenate([features(words, slots, by_word[y], by_gram[y]) for y in (0, 1)])
    strong, rows, target = np.maximum(inputs[:, 0], inputs[:, 1]), [], []
    for own, y in zip(ids, labels, strict=True):
        if len(own):
            own = own + y * len(index)
            _, start, size = windows_of(np.array([len(own)]))
            worst = [strong[own[s : s + k]].max() for s, k in zip(start, size, strict=True)]
            for k in {int(np.argmax(worst))} | ({int(rng.integers(len(start)))} if not y else set()):
                rows.append(np.pad(own[start[k] : start[k] + size[k]], (0, WIDTH - size[k]), constant_values=-1))
                target.append(y)
    if len(set(target)) < 2:
        return None
    x, y = np.array(rows), np.array(target, np.float32)
    h = HIDDEN
    init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    zero = lambda n: np.zeros(n, np.float32)
    w = {"in": init(INPUTS, 6 * h), "in_bias": zero(6 * h), "uf": init(h, 3 * h), "ub": init(h, 3 * h), "cf": zero(3 * h), "cb": zero(3 * h), "attend": init(2 * h), "out": init(2 * h), "bias": zero(1)}
    m, v, step = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(max(epochs, -(-least_steps * 256 // len(y)))):
        mixed = rng.permutation(len(y))
        for lo in range(0, len(y), 256):
            b = mixed[lo : lo + 256]
            mask = (x[b].T >= 0).astype(np.float32)[:, :, None]
            g = gradients(inputs[np.maximum(x[b].T, 0)], mask, y[b], weight[b], w)
            step += 1
            for k, a in w.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] * g[k] - v[k])
                a -= (0.01 * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    z, t = zip(*[(z, y) for y in (0, 1) for z in Scorer(Net(by_word[y], by_gram[y], w), 256).logits([[words[i] for i in x] for x, own in zip(ids, labels, strict=True) if own == y and len(x)])], strict=True)
    t = np.array(t)
    return Net(by_word[2], by_gram[2], w, *_logistic(np.array(z), t.astype(float), 1 / np.array(shares)[t]))


def _logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Slope and shift of P(y | z), by Newton's method with a ridge; a row counts weight times."""
    x, b = np.stack([z, np.ones_like(z)], axis=1), np.array([0.1, 0.0])
    for _ in range(50):
        p = sigmoid(np.clip(x @ b, -30, 30))
        b = b - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), x.T @ (weight * (p - y)) + ridge * b)
    return float(b[0]), float(b[1])


class Scorer:
    """Scores lists of words, so many windows at once; keeps the gates of the words it has seen."""

    most = 400_000

    def __init__(self, net: Net, windows: int = 2048):
        self.net, self.windows = net, windows
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.gates = np.zeros((1 << 12, 6 * HIDDEN), np.float32)

    def logits(self, docs: list[list[str]]) -> np.ndarray:
        """The greatest logit of each document's windows; -inf without words."""
        if len(self.index) > self.most:
            self.clear()
        index, base = self.index, len(self.index)
        flat = np.fromiter((index.setdefault(x, len(index)) for d in docs for x in d), np.int64)
        if len(index) > base:
            fresh = list(index)[base:] if base == 0 else [x for x, _ in zip(reversed(index), range(len(index) - base), strict=False)][::-1]
            got = features(fresh, word_slots(fresh), self.net.word_evidence, self.net.gram_evidence) @ self.net.w["in"] + self.net.w["in_bias"]
            if len(index) > len(self.gates):
                self.gates = np.concatenate([self.gates, np.zeros((max(len(index), len(self.gates)), 6 * HIDDEN), np.float32)])
            self.gates[base : len(index)] = got
        n = np.array([len(d) for d in docs], np.int64)
        doc, start, size = windows_of(n)
        out = np.full(len(docs), -np.inf)
        first = (np.cumsum(n) - n)[doc] + start
        for full in (True, False):
            pick = np.flatnonzero((size == WIDTH) == full)
            for lo in range(0, len(pick), self.windows):
                p = pick[lo : lo + self.windows]
                t = np.arange(WIDTH)[:, None]
                at = first[p] + np.minimum(t, size[p] - 1)
                z = pooled_logits(self.gates[flat[at]], None if full else (t < size[p])[:, :, None], self.net.w)
                np.maximum.at(out, doc[p], z)
        return out

    def scores(self, docs: list[list[str]]) -> np.ndarray:
        return np.where(np.isfinite(z := self.logits(docs)), sigmoid(np.clip(z * self.net.slope + self.net.shift, -50, 50)), 0.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, keep, most: int, id_col: str = "doc_id", text: str = "text", label: str = "toxic", most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[int], tuple[float, float]]:
    """Texts, labels, and the share of its rows that each label's texts are: at most `most` labelled documents of each label, those with the least hashes of their ids.
    A label has half of most_bytes: a text of more than an eighth of that isn't a sample, and texts count until it is used up.

    keep: a condition on the id column. An id with several labels counts as the greatest; null texts and labels are left out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and id is not null").where(keep(F.col("id")))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = [known.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(most) for y in (0, 1)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where(F.octet_length("text") <= most_bytes // 16).join(F.broadcast(picked[0].union(picked[1])), "id")
    # an id may have many rows
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id", F.xxhash64("text"), "text")
    rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    used = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("label").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("used", used).where(F.col("used") <= most_bytes // 2)
    got = rows.select("id", "text", "label").orderBy("id", "place").collect()
    shares = tuple(min(1.0, most / max(n.get(y, 1), 1)) for y in (0, 1))
    return [r["text"] for r in got], [r["label"] for r in got], shares


def score_toxicity(docs: DataFrame, labels: DataFrame, keep, threshold: float = 0.3, most: int = 1500, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with `score` double (0 to 1) and `predicted` int (1 if score >= threshold).

    keep: a condition on the id column: the documents whose labels may be learned from; most: the greatest number of them for
    each label. A null or empty text, or one without a word, scores 0, and so do all where a label is missing from the
    sample. Repeated rows stay; columns of docs that are named score or predicted are replaced."""
    net = train(*labelled_sample(docs, labels, keep, most, id_col, text))
    release()
    sent = docs.sparkSession.sparkContext.broadcast(net)
    docs = docs.drop("score", "predicted")
    place = docs.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value) if sent.value is not None else None
        for batch in batches:
            texts, found, lo, size = batch.column(place).to_pylist(), [], 0, 0
            parts = []
            for hi, x in enumerate([*texts, None]):
                size += len(x) if x else 0
                if size > 1 << 20 or hi == len(texts):
                    parts.append(scorer.scores([WORDS.findall(x.lower()) if x else [] for x in texts[lo : hi + 1]]) if scorer else np.zeros(len(texts[lo : hi + 1])))
                    lo, size = hi + 1, 0
            found = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    schema = docs.schema
    return docs.mapInArrow(releasing(score), schema.__class__([*schema.fields]).add("score", "double").add("predicted", "integer"))
