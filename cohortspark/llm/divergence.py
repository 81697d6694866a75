"""Source divergence audit over the terms that enough documents of a language hold, found by iceberg prefix refinement.

1. Levels of 8, 16, 32, ... bytes. A level counts, for each language, the documents that hold a prefix of that many bytes, or a
   whole term that is no longer than that. What fewer documents than the threshold hold goes: no longer term with that prefix
   can be in more. Only terms whose prefix is left are looked at on the next level; the last level is the one that leaves no prefix.
   Documents are counted where they are read, each in one task, so that counts of distinct documents are sums.
2. What is left of a level reaches the next one's tasks as a bit table of a fixed size. A prefix that passes it by chance is counted
   and goes by its own count, so that the table changes the work only.
3. Whole terms carry their occurrences by source from the same pass. Sources are then compared in blocks of sources and
   hash buckets of terms, each a matrix of a bounded size, whose sums are added up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bits import bit_table, has
from .common import discard, stash
from .runs import gather, parts, spans
from .textbytes import mix, prefix_hashes, releasing, span_hash

#: Fixed values of the smoothing: what is added to each count, and the unit of shares.
ADDED, UNIT = 2, 1_000_000_000

#: Bytes of terms: letters of ASCII and all bytes of other characters.
_TERM = np.array([i >= 0x80 or chr(i).isalpha() for i in range(256)])
#: Bytes of text that a task counts together: what it holds beside its batch is some 60 times that.
PART = 1 << 19

_LEVEL = "lang string, source string, term binary, whole boolean, n_docs long, n long"


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _hash(hashes: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """The hash of a prefix of a language."""
    return mix(hashes ^ salts)


def _level(docs: DataFrame, length: int, left: np.ndarray | None) -> DataFrame:
    """docs: (lang, source, text). Rows of _LEVEL for each part of each batch: whole terms of more than length / 2 and at most
    `length` bytes (all of at most `length` on the first level), and prefixes of `length` bytes of longer ones, without a source.

    left: the bit table of the level before, which has prefixes of length / 2 bytes."""
    before = 0 if left is None else length // 2
    sent = docs.sparkSession.sparkContext.broadcast(left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = sent.value
        for batch in batches:
            lang, source = (batch.column(i).dictionary_encode() for i in (0, 1))
            langs, sources = lang.indices.to_numpy().astype(np.int64), source.indices.to_numpy().astype(np.int64)
            salts = np.array([_salt(x) for x in lang.dictionary.to_pylist()], np.uint64)
            width = len(source.dictionary) + 1  # the last place is that of no source
            for lo, _, text, offsets in parts(batch.column(2), PART):
                start, end, row = spans(_TERM[text], offsets)
                row += lo
                prefix = prefix_hashes(text)
                if before:
                    longer = np.flatnonzero(end - start > before)
                    longer = longer[has(left, _hash(span_hash(prefix, start[longer], start[longer] + before), salts[langs[row[longer]]]))]
                    start, end, row = start[longer], end[longer], row[longer]
                whole = end - start <= length
                end = np.minimum(end, start + length)
                found, first, term = np.unique(mix(span_hash(prefix, start, end)) + whole, return_index=True, return_inverse=True)
                if not len(found):
                    continue
                # (document, term), then (language, source, term)
                pair, n = np.unique(row * len(found) + term, return_counts=True)
                row, term = np.divmod(pair, len(found))
                group = langs[row] * width + np.where(whole[first[term]], sources[row], width - 1)
                key, where, docs_n = np.unique(group * len(found) + term, return_inverse=True, return_counts=True)
                group, term = np.divmod(key, len(found))
                of_lang, of_source = np.divmod(group, width)
                rep = first[term]
                names = source.dictionary.take(pa.array(np.where(of_source < width - 1, of_source, 0), mask=of_source == width - 1))
                columns = [lang.dictionary.take(pa.array(of_lang)), names, gather(text, start[rep], end[rep], pa.binary()), pa.array(whole[rep]), pa.array(docs_n), pa.array(np.bincount(where, n, len(key)).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "whole", "n_docs", "n"])

    return docs.mapInArrow(releasing(run), _LEVEL)


def _prefix_hashes(prefixes: DataFrame) -> DataFrame:
    """(h): what _hash() makes of (lang, term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).dictionary_encode()
            salts = np.array([_salt(x) for x in lang.dictionary.to_pylist()], np.uint64)[lang.indices.to_numpy()]
            for lo, hi, text, offsets in parts(batch.column(1)):
                h = _hash(span_hash(prefix_hashes(text), offsets[:-1], offsets[1:]), salts[lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return prefixes.select("lang", "term").mapInArrow(releasing(run), "h long")


def kept_terms(docs: DataFrame, least: int, first: int = 8) -> tuple[DataFrame, list[DataFrame]]:
    """((lang, source, term string, n), the stored tables that it reads): the occurrences of the terms that at least `least`
    documents of the language hold. docs: (lang, source, text) without nulls; each row is a document."""
    length, left, stored, found = first, None, [], []
    while True:
        level = _level(docs, length, left).groupBy("lang", "source", "term", "whole").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))
        level = stash(level, "level")
        stored.append(level)
        enough = level.groupBy("lang", "term", "whole").agg(F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= least)
        cells = level.where("whole").join(enough.where("whole").select("lang", "term"), ["lang", "term"])
        found.append(cells.select("lang", "source", F.col("term").cast("string").alias("term"), "n"))
        prefixes = stash(enough.where("not whole").select("lang", "term"), "prefixes")
        done = prefixes.isEmpty()
        left = None if done else bit_table(_prefix_hashes(prefixes))
        discard(prefixes)
        if done:
            return reduce(DataFrame.union, found), stored
        length *= 2


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + ADDED) / (total + ADDED * terms)); decimals, since the product leaves 64 bits."""
    wide = lambda c, n: c.cast(f"decimal({n},0)")
    return 1 + F.call_function("div", wide(F.lit(UNIT), 10) * wide(count + ADDED, 19), wide(total + ADDED * terms, 19))


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_sums(rows: pd.DataFrame, block: int) -> pd.DataFrame:
    """One language, pair of blocks and bucket: (lang, a, b, value) for each pair of its sources, summed over its terms.

    Rows without a term give each source its share of a term that it doesn't hold."""
    zero = rows[rows["term"].isna()].sort_values("at")
    held = rows[rows["term"].notna()]
    at, p0 = zero["at"].to_numpy(), zero["p"].to_numpy()
    number, names = pd.factorize(held["term"])
    place = np.searchsorted(at, held["at"].to_numpy())
    order = np.argsort(number, kind="stable")
    number, place, p = number[order], place[order], held["p"].to_numpy()[order]
    total = np.zeros((len(at), len(at)), np.int64)
    step = max(1, (1 << 19) // max(len(at), 1))
    for lo in range(0, len(names), step):
        hi = min(lo + step, len(names))
        own = slice(*np.searchsorted(number, [lo, hi]))
        shares = np.repeat(p0[:, None], hi - lo, axis=1)
        shares[place[own], number[own] - lo] = p[own]
        for i in range(len(at) - 1):
            d = shares[i + 1 :] - shares[i]
            total[i, i + 1 :] += (d * d // (shares[i + 1 :] + shares[i])).sum(axis=1)
    i, j = np.triu_indices(len(at), 1)
    blocks = at // block
    if len(at) and blocks[0] != blocks[-1]:  # pairs inside a block are counted where it meets itself
        across = blocks[i] != blocks[j]
        i, j = i[across], j[across]
    return pd.DataFrame({"lang": rows["lang"].iloc[0], "a": at[i], "b": at[j], "value": total[i, j]})


def _pairs(cells: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """(lang, source, item, value) for each ordered pair of sources of a language, taken in blocks of `block` sources."""
    blocks = lambda df: df.withColumn("x", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_sources") - 1) / block).cast("int"))))
    own = F.floor(F.col("at") / block).cast("int")
    keys = lambda df: df.withColumns({"lo": F.least(own, "x"), "hi": F.greatest(own, "x")}).select("lang", "bucket", "lo", "hi", "at", "term", "p")
    held = cells.withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int"))
    none = groups.where("v > 0").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets").cast("int") - 1)))
    none = none.withColumns({"term": F.lit(None).cast("string"), "p": F.col("p0")})
    rows = keys(blocks(held)).union(keys(blocks(none)))
    sums = rows.groupBy("lang", "bucket", "lo", "hi").applyInPandas(lambda rows: _pair_sums(rows, block), "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one = groups.select("lang", F.col("at").alias("a"), F.col("source").alias("first"))
    two = groups.select(F.col("lang").alias("lang2"), F.col("at").alias("b"), F.col("source").alias("second"))
    pairs = one.join(two, (F.col("lang") == F.col("lang2")) & (F.col("a") < F.col("b"))).drop("lang2")
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0)).cast("long"))
    both = F.explode(F.array(F.struct(F.col("first").alias("source"), F.col("second").alias("item")), F.struct(F.col("second").alias("source"), F.col("first").alias("item"))))
    return pairs.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")


def audit_sources(docs: DataFrame, least: int = 10, top: int = 10, first: int = 8, block: int = 256, bucket: int = 1 << 18, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value long, rank int): how the sources of a language differ in the terms they use.

    Terms are runs of ASCII letters and of all other characters beyond ASCII, A-Z in lower case; of each language those that at
    least `least` of its documents (rows) hold. A share is 1 + floor(10^9 (count + 2) / (all counts + 2 terms)) of a source or of the
    whole language; two shares p and q differ by floor((p - q)^2 / (p + q)). Part `pair`: each other source of the language and the
    sum over all terms (0 where there are none). Part `term`: the `top` terms that the source holds with a greater share than the
    language. Ranks go from 1 in each source and part, greatest value first, then by the item's bytes.

    Null languages, sources and texts are read as empty ones. Repeated rows are documents of their own. A source without a term has
    its pairs and no terms; an empty table gives no rows. Other columns are ignored. first: bytes of the first level; block: sources
    that are compared at once, and bucket: counts of terms in one comparison; they change the work only. Equal
    prefixes of a part of a batch are told apart by 64-bit hashes; everything else compares bytes."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("text"))
    cells, stored = kept_terms(rows, least, first)
    cells = stash(cells, "cells")
    for level in stored:
        discard(level)
    terms = cells.groupBy("lang", "term").agg(F.sum("n").alias("m"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("m").alias("n_lang"))
    counts = cells.groupBy("lang", "source").agg(F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("held"))
    known = rows.select("lang", "source").distinct().join(counts, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n_all", "held", "v", "n_lang"])
    own = Window.partitionBy("lang")
    groups = known.withColumns({
        "at": F.row_number().over(own.orderBy("source")) - 1, "n_sources": F.count(F.lit(1)).over(own), "buckets": 1 + F.floor(F.sum("held").over(own) / bucket),
        "p0": F.when(F.col("v") > 0, _share(F.lit(0), F.col("n_all"), F.col("v"))),
    })
    groups = stash(groups, "groups")
    shares = cells.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("n_all"), F.col("v")))
    q = _share(F.col("m"), F.col("n_lang"), F.col("v"))
    over = shares.join(terms, ["lang", "term"]).withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    best = over.withColumn("rank", rank).where(F.col("rank") <= top)
    pairs = _pairs(shares, groups, block).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank)
    return pairs.union(best)
