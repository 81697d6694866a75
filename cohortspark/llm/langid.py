"""Language identification by interpolated Kneser-Ney character models, one for each language, in shared sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textbytes import mix

ORDER = 4
UNDETERMINED = "und"
#: Bytes of text that are learned from at most.
SAMPLE_BYTES = 64 << 20
_OTHER = 0


def codes(text: str) -> np.ndarray:
    """Characters of a text in lower case as numbers; all that isn't a letter counts as a boundary (0), one for each run."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _is_letter(points)
    out = np.where(letters, points, _OTHER)
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    if len(keep):
        keep[0] = True
    return out[keep]


_table: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _table:
        _table.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _table[0][points]


def grams(points: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 .. order, the hash of the n characters that end at each position, ORDER - 1 boundaries standing before."""
    padded = np.concatenate([np.zeros(order - 1, np.uint32), points]).astype(np.uint64)
    out, h = [], np.zeros(len(points), np.uint64)
    for n in range(1, order + 1):
        # the hash of n characters from that of the last n - 1: the added one is the farthest back
        h = mix(h + (padded[order - n : len(padded) - n + 1] + np.uint64(1)) * np.uint64((0x9E3779B97F4A7C15 * (2 * n + 1)) & 0xFFFFFFFFFFFFFFFF))
        out.append(h)
    return out


@dataclass
class Models:
    """languages; for each order the sorted hashes of its n-grams and their log2 probabilities (n-gram, language); for each
    order the sorted hashes of contexts and the log2 weights (context, language) that they leave to shorter ones."""

    languages: list[str]
    hashes: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    floor: np.ndarray
    #: entropy above which a text is none of the languages, and what a bit of difference counts
    reject: float = np.inf
    sharp: float = 1.0


def fit(samples: dict[str, list[str]], order: int = ORDER, checks: int = 4) -> Models | None:
    """Models of samples of text by language; None without any. A language whose samples have no letter is left out.

    Interpolated Kneser-Ney with one discount for each order, n1 / (n1 + 2 n2): the highest order counts occurrences, the
    lower ones the distinct characters before. Every checks-th text of a language calibrates the rejection and the score and
    isn't counted, where a language has that many."""
    samples = {k: v for k, v in samples.items() if any(codes(x).any() for x in v)}
    languages = sorted(samples)
    counted = {k: [x for i, x in enumerate(v) if (i + 1) % checks or len(v) < checks] for k, v in samples.items()}
    counted = {k: v if any(codes(x).any() for x in v) else samples[k] for k, v in counted.items()}
    if not languages:
        return None
    tables: list[dict[str, tuple]] = []
    for k in languages:
        parts = [grams_of(x, order) for x in counted[k]]
        joined = {f: np.concatenate([p[f] for p in parts]) if parts else np.zeros((0, order), np.uint64) for f in ("gram", "context")}
        tables.append(_kneser_ney(joined["gram"], joined["context"], order))
    alphabet = len(np.unique(np.concatenate([t[0][0] for t in tables]))) + 1
    floor = np.full(len(languages), -np.log2(alphabet), np.float32)
    hashes, logs, contexts, weights = [], [], [], []
    lower = None
    for n in range(order):
        keys = np.unique(np.concatenate([t[n][0] for t in tables]))
        left = np.unique(np.concatenate([t[n][3] for t in tables]))
        prob = np.zeros((len(keys), len(languages)))
        weight = np.ones((len(left), len(languages)))
        for j, t in enumerate(tables):
            own, share, context, cs, gamma, suffix = t[n]
            weight[np.searchsorted(left, cs), j] = gamma
            prob[np.searchsorted(keys, own), j] = share
        # every n-gram of any language gets its whole probability in all of them
        suffix_of, context_of = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
        for t in tables:
            at = np.searchsorted(keys, t[n][0])
            suffix_of[at], context_of[at] = t[n][5], t[n][2]
        g = weight[np.searchsorted(left, context_of)]
        below = np.full(prob.shape, 1 / alphabet) if lower is None else lower[1][np.searchsorted(lower[0], suffix_of)]
        prob = prob + g * below
        lower = (keys, prob)
        hashes.append(keys)
        logs.append(np.log2(prob).astype(np.float32))
        contexts.append(left)
        weights.append(np.log2(weight).astype(np.float32))
    models = Models(languages, hashes, logs, contexts, weights, floor)
    rest = [(k, x) for k, v in samples.items() for i, x in enumerate(v) if not (i + 1) % checks and len(v) >= checks and codes(x).any()]
    if rest:
        bits = entropies([codes(x) for _, x in rest], models)
        models.reject = float(np.quantile(bits.min(axis=1), 0.999) + 0.5)
        truth = np.array([languages.index(k) for k, _ in rest])
        options = 2.0 ** np.arange(-2, 8)
        loss = [-np.log(np.maximum(_softmax(-bits * s)[np.arange(len(truth)), truth], 1e-9)).mean() for s in options]
        models.sharp = float(options[int(np.argmin(loss))])
    return models


def grams_of(text: str, order: int) -> dict[str, np.ndarray]:
    """gram: hashes of the n-grams that end at each position (position, n - 1); context: those of their first n - 1 characters."""
    points = codes(text)
    padded = np.concatenate([np.zeros(order, np.uint32), points])
    g = np.stack(grams(points, order), axis=1) if len(points) else np.zeros((0, order), np.uint64)
    before = grams(padded[:-1], order)
    c = np.stack([np.zeros(len(points), np.uint64)] + [b[order - 1 :][: len(points)] for b in before[: order - 1]], axis=1) if len(points) else g
    return {"gram": g, "context": c}


def _kneser_ney(gram: np.ndarray, context: np.ndarray, order: int) -> list[tuple]:
    """For each order: n-gram hashes (sorted), their discounted shares, their context hashes, and the contexts (sorted) with
    the weight that they leave to the shorter n-grams; last the hashes of the n-grams without their first character."""
    out = []
    for n in range(order):
        if n == order - 1:
            rows = gram[:, n]
        else:  # distinct continuations: one for each distinct n-gram that is longer by one
            _, first = np.unique(gram[:, n + 1], return_index=True)
            gram_n = gram[first]
            rows = gram_n[:, n]
        keys, at, count = np.unique(rows, return_index=True, return_counts=True)
        source = (gram, context) if n == order - 1 else (gram_n, context[first])
        own_context, suffix = source[1][at, n], source[0][at, n - 1] if n else np.zeros(len(at), np.uint64)
        n1, n2 = (count == 1).sum(), (count == 2).sum()
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        cs, where = np.unique(own_context, return_inverse=True)
        total = np.bincount(where, weights=count, minlength=len(cs))
        kinds = np.bincount(where, minlength=len(cs))
        share = (count - d) / total[where] if len(keys) else np.zeros(0)
        out.append((keys, share, own_context, cs, d * kinds / total if len(cs) else np.zeros(0), suffix))
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


def entropies(texts: list[np.ndarray], models: Models) -> np.ndarray:
    """Bits a character of each text under each language (text, language); texts as codes(), each with one at least."""
    order = len(models.hashes)
    sizes = np.array([len(t) for t in texts], np.int64)
    # order boundaries stand before each text, and their own n-grams are left out
    joined = np.concatenate([x for t in texts for x in (np.zeros(order, np.uint32), t)])
    g = grams(joined, order)
    live = np.ones(len(joined), bool)
    starts = np.cumsum(sizes + order) - sizes
    live[(starts[:, None] - 1 - np.arange(order)).ravel()] = False
    here = np.flatnonzero(live)
    at, hit = _find(models.hashes[-1], g[-1][here])
    got = models.logs[-1][at]
    missed = np.flatnonzero(~hit)
    if len(missed):
        got[missed] = 0
        rest = missed
        for n in range(order - 2, -1, -1):
            p = here[rest]
            ca, ch = _find(models.contexts[n + 1], g[n][p - 1])
            got[rest] += np.where(ch[:, None], models.weights[n + 1][ca], 0)
            a, h = _find(models.hashes[n], g[n][p])
            got[rest[h]] += models.logs[n][a[h]]
            rest = rest[~h]
        got[rest] += models.floor + models.weights[0][0]
    ends = np.cumsum(sizes)
    return -np.add.reduceat(got.astype(np.float64), ends - sizes, axis=0) / sizes[:, None]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def labelled_texts(docs: DataFrame, keep, most: int, id_col: str = "doc_id", text: str = "text", lang: str = "lang", most_bytes: int = SAMPLE_BYTES) -> dict[str, list[str]]:
    """Texts by language of the rows that keep (a condition on the id) holds for: of each language the `most` rows with the
    least hashes of their ids, and at most `most` rows altogether where ids repeat. Null languages and texts, and ids that are
    null, are left out. A language has an equal share of most_bytes: a text of more than an eighth of that isn't a sample, and
    texts count until the share is used up."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    ids = rows.where("lang is not null and text is not null and id is not null").where(keep(F.col("id"))).select("lang", "id")
    languages = sorted(r[0] for r in ids.select("lang").distinct().limit(1001).collect())
    if len(languages) > 1000:
        raise ValueError("more than 1000 languages; the labels aren't languages")
    if not languages:
        return {}
    share = most_bytes // len(languages)
    least = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    picked = ids.withColumn("place", least).where(F.col("place") <= most).select("lang", "id").distinct()
    found: dict[str, list[str]] = {k: [] for k in languages}
    # an id may have many rows
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", F.xxhash64("text"), "text")
    rows = rows.where(F.octet_length("text") <= share // 8).join(F.broadcast(picked), ["id", "lang"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    used = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("lang").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    for r in rows.withColumn("used", used).where(F.col("used") <= share).orderBy("id", "place").collect():
        found[r["lang"]].append(r["text"])
    return found


def identify_language(docs: DataFrame, keep, most: int = 600, reject: bool = False, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with `lang_pred` string and `score` double.

    keep: a condition on the id column: rows whose lang may be learned from; most: the greatest number of them for each
    language, the rows with the least hashes of their ids (most_bytes of labelled_texts() bounds their size). The prediction is the language of the lowest cross-entropy a
    character of the whole text. score: its calibrated probability. A text that is null or has no letter (str.isalpha) is `und` with score
    0; so is every text where no language can be learned; with reject, also a text whose entropy is beyond what nearly all
    texts of the languages have. Ties go to the first language in order. Columns of docs of these two names are replaced."""
    models = fit(labelled_texts(docs, keep, most, id_col, text, lang))
    sent = docs.sparkSession.sparkContext.broadcast(models)
    docs = docs.drop("lang_pred", "score")
    place = docs.columns.index(text)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        for batch in batches:
            texts = batch.column(place).to_pylist()
            names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            group, held, size = [], [], 0
            for k, x in enumerate(texts):
                if models is not None and x and (own := codes(x)).any():
                    group.append(k)
                    held.append(own)
                    size += len(own)
                if group and (size > 1 << 19 or k == len(texts) - 1):
                    bits = entropies(held, models)
                    best = bits.argmin(axis=1)
                    sure = _softmax(-bits * models.sharp)
                    for i, b, row, s in zip(group, best, bits, sure, strict=True):
                        if not reject or row[b] <= models.reject:
                            names[i], scores[i] = models.languages[b], s[b]
                    group, held, size = [], [], 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(predict, docs.schema.__class__([*docs.schema.fields]).add("lang_pred", "string").add("score", "double"))
