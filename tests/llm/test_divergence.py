"""The source audit beside a plain version, and its edge rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cohortspark.llm.divergence import _level, audit_sources, kept_terms

SCHEMA = "doc_id long, text string, lang string, source string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    docs, used = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [x.translate(LOWER) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        docs[lang].update(set(terms))
        used[lang, source].update(terms)
    out = {}
    for lang in {k for k, _ in used}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        v, sources = len(kept), sorted(s for k, s in used if k == lang)
        share = lambda c, kept=kept, v=v: {t: 1 + (10**9 * (c[t] + 2)) // (sum(c[x] for x in kept) + 2 * v) for t in kept}
        p = {s: share(used[lang, s]) for s in sources}
        q = share(sum((used[lang, s] for s in sources), Counter()))
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-gap(p[s][t], q[t]), t.encode(), t) for t in kept if used[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, k + 1): (item, -f) for k, (f, _, item) in enumerate(found)}
    return out


def rows_of(seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("Wo", "wor", "überlänge", "日本語の長い言葉です", "prefixed-or-not") for b in ("", "a", "A", "ab", "é", "ß" * 40, "z" * 200)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["de", "de", "en", None]), rng.choice(["s", "s", "t", "u\U0001f600", "v", None, ""])) for i in range(240)]
    return rows + [(900, None, "fr", "only"), (901, "", "fr", "two"), (902, "...", "it", "alone"), (None, "one\x00two_three", "de", "s")] + rows[:20]


@pytest.mark.parametrize(("block", "bucket", "first"), [(256, 1 << 18, 8), (2, 7, 1)])
def test_as_the_plain_version(spark, block, bucket, first):
    rows = rows_of(block)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("term", "part", "rank", "bucket")}).repartition(5)
    got = audit_sources(docs, least=4, top=3, block=block, bucket=bucket, first=first).collect()
    assert {(r["lang"], r["source"], r["part"], r["rank"]): (r["item"], r["value"]) for r in got} == plain(rows, 4, 3)
    assert len(got) == len(plain(rows, 4, 3))


def test_no_rows_and_no_kept_terms(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s"), (2, "c", "en", "t"), (3, None, None, None)], SCHEMA)
    assert sorted(tuple(r) for r in audit_sources(docs).collect()) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
    assert audit_sources(docs.limit(0)).collect() == []


def test_prefixes_that_few_documents_hold_go(spark):
    """A long term in many documents survives all levels; one that shares its first bytes with it but is rare doesn't."""
    long, rare = "abcdefgh" * 9, "abcdefgh" * 8 + "zz"
    docs = spark.createDataFrame([("en", "s", f"{long} {rare if i < 3 else ''} {'q' * (9 + i)}") for i in range(12)], "lang string, source string, text string")
    cells, stored = kept_terms(docs, 10)
    assert [tuple(r) for r in cells.collect()] == [("en", "s", long, 12)]
    held = [{(r["term"].decode(), r["whole"]) for r in level.collect()} for level in stored]
    assert len(held) == 5 and ("q" * 16, False) in held[1]
    # five documents hold sixteen q's: nothing longer is looked at
    assert {t[:1] for t, _ in held[2] | held[3] | held[4]} == {"a"} and (rare, True) in held[4]


def test_a_level_holds_little_beside_its_batch():
    """What a task allocates for a batch of 16 MB, in numpy arrays and all; Arrow's buffers are not in it."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    tasks = []
    docs = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))), mapInArrow=lambda task, schema: tasks.append(task))
    _level(docs, 8, None)
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + j % 26)}" for j in range(400)) for i in range(10_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * len(texts)), pa.array(["b"] * len(texts)), pa.array(texts)], ["lang", "source", "text"])
    tracemalloc.start()
    try:
        assert sum(len(x) for x in tasks[0](iter([batch])))
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
    finally:
        tracemalloc.stop()
