"""Spelling variants over a reduced alphabet.

1. Words are counted where they are read, a part of a batch at a time.
2. Letters are hashed to a few symbols. Words one edit apart have reduced words that are equal or one edit apart, so that the whole
   neighbourhood of one edit of each distinct reduced word is generated and joined with the reduced words that there are. A
   neighbourhood is a list of 64-bit hashes, each worked out from those of the word's beginnings, so that a long word costs as
   much as its length. Words that meet are held against each other letter by letter: the alphabet changes the work only.
3. Forms make a forest, since a form occurs five times as often as its word; roots are found by doubling the jumps."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import bit_table, has
from .common import discard, stash
from .runs import gather, parts, spans
from .textbytes import BASE, mix, powers, prefix_hashes, releasing, span_hash

#: Every how many hashes a letter is left out, and the least length and number of occurrences of a word.
EVERY, LENGTH, TIMES = 199, 6, 5
#: How many times as often a form occurs as its word.
OVER = 5

#: The byte that begins each of U+00C0 to U+00FF, and no other character.
_LEAD = 0xC3
_ASCII_LETTER = np.array([i < 0x80 and chr(i).isalpha() for i in range(256)])
_CRC = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)
#: Code points up to which words are compared by the built-in distance.
SHORT = 64
#: Bytes up to which hashes of words are worked out in columns; longer words take one call each.
_WIDE = 48


def _inside(text: np.ndarray) -> np.ndarray:
    """The bytes of letters: those of ASCII, and the two of each of U+00C0 to U+00FF."""
    lead = text == _LEAD
    out = _ASCII_LETTER[text] | lead
    out[1:] |= lead[:-1]
    return out


def crc32_of(text: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each word's bytes after those whose crc32 is `before`."""
    size = end - start
    order = np.argsort(-np.minimum(size, _WIDE + 1), kind="stable")
    at, size = start[order], size[order]
    out = before[order].astype(np.uint32)
    long = int(np.searchsorted(-size, -_WIDE))  # the words of more than _WIDE bytes come first
    for k in range(long):
        out[k] = zlib.crc32(text[at[k] : at[k] + size[k]].tobytes(), int(out[k]))
    at, size, register = at[long:], size[long:], ~out[long:]
    for k in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -k))
        r = register[:live]
        register[:live] = _CRC[(r ^ text[at[:live] + k]) & np.uint32(255)] ^ (r >> np.uint32(8))
    out[long:] = ~register
    back = np.empty_like(out)
    back[order] = out
    return back


def count_words(docs: DataFrame, every: int = EVERY, length: int = LENGTH) -> DataFrame:
    """(word string, n long) for parts of the texts of docs (id string, text): runs of letters up to U+00FF, A-Z in lower case, of at
    least `length` code points. Where `every` divides the crc32 h of `<id>:<run>`, its code point h % (its length) is left out first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = np.array([zlib.crc32(f"{x}:".encode()) for x in batch.column(0).to_pylist()], np.uint32)
            for lo, _, text, offsets in parts(batch.column(1)):
                start, end, row = spans(_inside(text), offsets)
                leads = np.zeros(len(text) + 1, np.int64)
                np.cumsum(text == _LEAD, out=leads[1:])
                points = end - start - (leads[end] - leads[start])
                enough = np.flatnonzero(points >= length)
                start, end, points = start[enough], end[enough], points[enough]
                h = crc32_of(text, start, end, states[lo + row[enough]])
                cut = h % np.uint32(every) == 0
                changed: Counter[str] = Counter()
                for k in np.flatnonzero(cut & (points > length)):
                    word = text[start[k] : end[k]].tobytes().decode()
                    at = int(h[k]) % len(word)
                    changed[word[:at] + word[at + 1 :]] += 1
                start, end = start[~cut], end[~cut]
                _, first, n = np.unique(mix(span_hash(prefix_hashes(text), start, end)), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([gather(text, start[first], end[first], pa.string()), pa.array(n)], ["word", "n"])
                if changed:
                    yield pa.RecordBatch.from_arrays([pa.array(list(changed), pa.string()), pa.array(list(changed.values()), pa.int64())], ["word", "n"])

    return docs.mapInArrow(releasing(run), "word string, n long")


def symbols_of(text: np.ndarray, offsets: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols 1, 2, ... of the letters of words, offsets of the words in them)."""
    after = np.zeros(len(text), bool)
    after[1:] = text[:-1] == _LEAD
    letter = np.where(after, text.astype(np.uint64) + np.uint64(0x40), text.astype(np.uint64))
    seen = text != _LEAD
    count = np.zeros(len(text) + 1, np.int64)
    np.cumsum(seen, out=count[1:])
    return mix(letter[seen] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(symbols) + np.uint64(1), count[offsets]


def neighbourhoods(s: np.ndarray, offsets: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each reduced word, word, hash) with the hashes of the word itself and of all that are one edit away, once each."""
    size, word = np.diff(offsets), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(s)) - offsets[:-1][word]
    up = powers(int(size.max(initial=0)) + 2)
    terms = s * up[at]
    sums = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    own = sums[offsets[1:]] - sums[offsets[:-1]]
    before = sums[:-1] - sums[offsets[:-1]][word]  # of the letters before each place
    down = np.uint64(pow(int(BASE), -1, 1 << 64))
    same = np.zeros(len(s), bool)
    same[1:] = (s[1:] == s[:-1]) & (at[1:] > 0)
    out_word, out = [np.arange(len(size))], [own]
    keep = ~same
    out_word.append(word[keep])
    out.append((before + (own[word] - before - terms) * down)[keep])
    for c in range(1, symbols + 1):
        other = s != np.uint64(c)
        out_word.append(word[other])
        out.append((own[word] + (np.uint64(c) - s) * up[at])[other])
        # c stands before a letter; the same again after a c is left to the first place
        free = np.ones(len(s), bool)
        free[1:] = (s[:-1] != np.uint64(c)) | (at[1:] == 0)
        out_word.append(word[free])
        out.append((before + np.uint64(c) * up[at] + (own[word] - before) * BASE)[free])
        last = np.flatnonzero(size > 0)
        last = last[s[offsets[1:][last] - 1] != np.uint64(c)]
        out_word.append(last)
        out.append(own[last] + np.uint64(c) * up[size[last]])
    return mix(own), np.concatenate(out_word), mix(np.concatenate(out))


def _reduced(words: DataFrame, symbols: int) -> DataFrame:
    """words (word, n) with `key`, the hash of the reduced word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for _, _, text, offsets in parts(batch.column(0)):
                s, at = symbols_of(text, offsets, symbols)
                up = powers(int(np.diff(at).max(initial=0)) + 1)
                sums = np.zeros(len(s) + 1, np.uint64)
                np.cumsum(s * up[np.arange(len(s)) - np.repeat(at[:-1], np.diff(at))], out=sums[1:])
                keys.append(mix(sums[at[1:]] - sums[at[:-1]]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64))], ["word", "n", "key"])

    return words.select("word", "n").mapInArrow(releasing(run), "word string, n long, key long")


def _near_keys(words: DataFrame, symbols: int) -> DataFrame:
    """(key, near) for the reduced words of `words` (word, n, key), one for each key: every key of a word there that is the same or one
    edit away."""
    table = bit_table(words.select("key"))
    sent = words.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            for _, _, text, offsets in parts(batch.column(0), 1 << 16):
                own, word, near = neighbourhoods(*symbols_of(text, offsets, symbols), symbols)
                known = has(table, near)
                yield pa.RecordBatch.from_arrays([pa.array(own[word[known]].view(np.int64)), pa.array(near[known].view(np.int64))], ["key", "near"])

    each = words.groupBy("key").agg(F.min("word").alias("word")).select("word")
    met = each.mapInArrow(releasing(run), "key long, near long")
    return met.join(words.select(F.col("key").alias("near")).distinct(), "near", "left_semi")


def near_words(words: DataFrame, symbols: int | None = None) -> DataFrame:
    """(word, n, other, other_n) for each ordered pair of words (word, n) that are one inserted, deleted or replaced code point
    apart.

    symbols: the size of the alphabet; by default it grows with the sixth root of the number of words, so that the shortest words don't
    all meet. It changes the work only."""
    if symbols is None:
        symbols = min(max(int(np.ceil((words.count() / 4) ** (1 / LENGTH))), 4), 64)
    keyed = stash(_reduced(words, symbols), "reduced")
    keys = stash(_near_keys(keyed, symbols), "keys")

    def met(held: DataFrame) -> DataFrame:
        other = held.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("key").alias("near"))
        return held.join(keys, "key").join(other, "near").where(F.col("word") != F.col("other")).select("word", "n", "other", "other_n")

    # the built-in distance takes the square of a word's length; beyond SHORT its linear form is one pass of Python
    size, other_size = F.length("word"), F.length("other")
    short = met(keyed).where((size <= SHORT) & (other_size <= SHORT) & (F.levenshtein("word", "other", 1) == 1))
    long = met(keyed.where(F.length("word") >= SHORT)).where((size > SHORT) | (other_size > SHORT))
    return short.union(long.mapInArrow(_checked, long.schema))


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes one of the other; linear in their lengths."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # the length of the common beginning
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return a[lo + (len(a) >= len(b)) :] == b[lo + (len(b) >= len(a)) :]


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([one_edit(a.as_py(), b.as_py()) for a, b in zip(batch.column(0), batch.column(2), strict=True)], pa.bool_()))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form) of a forest; each round doubles how far the jumps reach."""
    up = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = up.select(F.col("word").alias("at"), F.col("root").alias("to"))
        far = stash(up.join(on, F.col("root") == F.col("at"), "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "roots")
        discard(up)
        up = far
        if up.where("moved").isEmpty():
            return up.select("word", "root")


def spelling_variants(docs: DataFrame, least: int = TIMES, over: int = OVER, every: int = EVERY, length: int = LENGTH, symbols: int | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n long, n_near long, form_n long) for each word of the texts.

    Words are maximal runs of letters of ASCII and U+00C0 to U+00FF, A-Z in lower case, of `length` code points and `least` occurrences
    at least; where `every` divides the crc32 h of `<id>:<run>`, the run's code point h % (its length) is left out before. Two words are near
    if they differ by one inserted, deleted or replaced code point. form: the near word of the most occurrences (the least in the order of
    code points of equal ones), if it occurs `over` (more than 1) times as often as the word at least, else null; root: where following
    forms ends.

    Null texts have no words, and a null id counts as an empty text before the colon. Repeated rows count as often as they stand. Other columns
    are ignored; an empty table has no words. Runs of a part of a batch are told apart by 64-bit hashes."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text).cast("string").alias("text"))
    words = count_words(rows, every, length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    words = stash(words, "words")
    best = F.min(F.struct((-F.col("other_n")).alias("order"), F.col("other").alias("word")))
    found = near_words(words, symbols).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    form_n = -F.col("best.order")
    found = found.withColumn("is_form", form_n >= over * F.col("n"))
    found = stash(found.select("word", "n_near", F.when(F.col("is_form"), F.col("best.word")).alias("form"), F.when(F.col("is_form"), form_n).alias("form_n")), "near")
    out = words.join(found, "word", "left").join(_roots(found.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
