"""Spelling variants beside a plain version, and their edge rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm.queries import op13_group_spelling_variants
from cohortspark.llm.variants import crc32_of, near_words, neighbourhoods, one_edit, spelling_variants, symbols_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows, every=199):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return n


def apart(a, b):
    """Whether one edit makes one of the other."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else (a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :])


def plain(rows, least=5, over=5, every=199, length=6):
    n = {w: c for w, c in counts(rows, every).items() if c >= least and len(w) >= length}
    near = {w: [o for o in n if apart(w, o)] for w in n}
    form = {}
    for w, others in near.items():
        if others and n[best := min(others, key=lambda o: (-n[o], o))] >= over * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def texts(seed, many=400):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abcéÿ×ß", k=rng.randint(5, 11))) for _ in range(30)] + ["é" * 60, "xyz" * 300]

    def word():
        w = list(rng.choice(stems[: rng.choice([2, 5, 32])]))
        for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [rng.choice("abéÀ")], [w[k], rng.choice("abc")]])
        return "".join(w)

    return [(i if i % 50 else None, " ".join(rng.choice([str.upper, str, str])(word()) for _ in range(40)) + rng.choice(["", " Āā1 ", "Āabcdefg"])) for i in range(many)]


@pytest.mark.parametrize(("symbols", "every"), [(None, 199), (2, 7)])
def test_as_the_plain_version(spark, symbols, every):
    rows = [*texts(symbols or 0), (900, None), (901, ""), (902, "short ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "key", "near", "id")}).repartition(5)
    got = spelling_variants(docs, symbols=symbols, every=every)
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    got = got.collect()
    want = plain(rows, every=every)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want and len(got) == len(want)
    assert sum(v[0] is not None for v in want.values()) > 20
    assert spelling_variants(docs.limit(0)).collect() == []


def test_chains_and_ties(spark):
    """Forms of forms, equal counts, and a word with more near words than a bucket would hold."""
    n = {"aaaaaa": 5, "aaaaaab": 25, "aaaaaabb": 125, "aaaaaabbb": 625, "aaaaac": 25, "zzzzzz": 9}
    words = spark.createDataFrame([(1, " ".join(w for w, c in n.items() for _ in range(c)))], "doc_id long, text string")
    got = {r["word"]: tuple(r) for r in spelling_variants(words, every=10**9).collect()}
    assert got["aaaaaa"][:3] == ("aaaaaa", "aaaaaab", "aaaaaabbb") and got["zzzzzz"] == ("zzzzzz", None, "zzzzzz", 9, 0, None)
    assert got["aaaaaabbb"][1:3] == (None, "aaaaaabbb") and got["aaaaac"][1] is None and got["aaaaac"][4] == 1


def test_crc_of_columns():
    rng = random.Random(1)
    words = ["".join(rng.choices("abéÿ", k=rng.choice([1, 3, 8, 47, 48, 49, 500]))).encode() for _ in range(500)]
    text, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in range(500)], np.uint32)
    assert crc32_of(text, ends - [len(w) for w in words], ends, before).tolist() == [zlib.crc32(f"{i}:".encode() + w) for i, w in enumerate(words)]


def test_one_edit():
    rng = random.Random(2)
    for _ in range(5000):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 6))) for _ in range(2))
        assert one_edit(a, b) == apart(a, b), (a, b)


@pytest.mark.parametrize("symbols", [1, 2, 3, 5])
def test_neighbourhoods_are_whole(symbols):
    rng = random.Random(symbols)
    words = ["".join(rng.choices("abcdeéÿ", k=rng.randint(1, 9))) for _ in range(60)]
    joined = "".join(words).encode()
    offsets = np.cumsum([0, *(len(w.encode()) for w in words)])
    s, at = symbols_of(np.frombuffer(joined, np.uint8), offsets, symbols)
    own, word, near = neighbourhoods(s, at, symbols)
    reduced = [tuple(s[a:b].tolist()) for a, b in zip(at, at[1:])]

    def edits(w):
        out = {w}
        for k in range(len(w) + 1):
            out |= {w[:k] + (c,) + w[k:] for c in range(1, symbols + 1)}
            if k < len(w):
                out |= {w[:k] + w[k + 1 :]} | {w[:k] + (c,) + w[k + 1 :] for c in range(1, symbols + 1)}
        return out

    key = {r: int(h) for r, h in zip(reduced, own)}
    for i, r in enumerate(reduced):
        mine = near[word == i].tolist()
        assert len(mine) == len(set(mine)) == len(edits(r))
        assert {key[x] for x in edits(r) if x in key} == set(mine) & set(key.values())


def test_very_long_words_meet(spark):
    long = "ab" * 150_000
    words = spark.createDataFrame([(long, 9), (long[1:], 5), ("b" + long, 7), (long[:-2], 6)], "word string, n long")
    got = {(len(r["word"]), len(r["other"])) for r in near_words(words).collect()}
    k = len(long)
    assert got == {(k, k - 1), (k - 1, k), (k, k + 1), (k + 1, k), (k - 1, k - 2), (k - 2, k - 1)}


def test_query_as_the_plain_version(spark, tmp_path):
    rows = texts(9, 150)
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")}).write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_group_spelling_variants(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.collect()} == plain(rows)
