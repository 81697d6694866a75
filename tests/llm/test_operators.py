"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

from __future__ import annotations

import base64
import hashlib
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from cohortspark.llm import warc
from cohortspark.llm.bm25 import bm25_top_k
from cohortspark.llm.common import components, fold, fresh_dir
from cohortspark.llm.embed_dedup import near_duplicates
from cohortspark.llm.langid import entropies, fit, codes, identify_language
from cohortspark.llm.mixing import mix_sources, poisson_table
from cohortspark.llm.ngram_join import shared_counts, similar_groups
from cohortspark.llm.sentencepiece_sample import Lattices, decode, sample_encode
from cohortspark.llm.suffix_dedup import deep_shallow_sort, remove_repeats
from cohortspark.llm.token_count import count_pieces, count_tokens
from cohortspark.llm.toxicity import score_toxicity, windows_of
from cohortspark.llm.vocabulary import MODEL, SEGMENTS, load_vocabulary

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [None, "", " \n\t ", "one", "One  two\nthree", "é ü 日本 ▁ \U0001f600", "a" * 5000, "word " * 3000, "Same text here.", "Same text here."]


def documents(spark, texts=TEXTS, **extra):
    rows = [(i if i != 4 else None, x, "en", "s", len(x or ""), "clash") for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


# 1


def test_sampling_is_reproducible_and_lossless(spark):
    vocabulary = load_vocabulary()
    docs = documents(spark)
    one, two = ({(r["doc_id"], r["n_pieces"]): r for r in sample_encode(docs).collect()} for _ in range(2))
    assert one == two
    texts = {i: x for i, x in enumerate([*TEXTS, "x" * 40_000 + " y" * 90_000, "\u2581 \u2581", "\0\x01"])}
    rows = spark.createDataFrame([(i, x, "clash") for i, x in texts.items()] * 2, "doc_id long, text string, ids string")
    decoded = sample_encode(rows).collect()
    assert len(decoded) == 2 * len(texts)
    for r in decoded:
        text = texts[r["doc_id"]]
        assert r["lossless"] is (None if text is None else True)
        assert r["ids"] is None if text is None else (decode(r["ids"], vocabulary) == text and len(r["ids"]) == r["n_pieces"])
    assert sample_encode(docs.limit(0)).count() == 0


def test_sampling_with_little_room():
    vocabulary = load_vocabulary()
    rng = random.Random(4)
    words = [" " + "".join(rng.choice("abcdefgh\U0001f600") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    seeds = np.random.default_rng(2).integers(0, 1 << 63, len(words)).astype(np.uint64)
    small, large = Lattices(vocabulary, 0.001, most_edges=2000), Lattices(vocabulary, 0.001)
    for k in range(0, len(words), 150):
        for a, b in zip(small.sample(words[k : k + 150], seeds[k : k + 150]), large.sample(words[k : k + 150], seeds[k : k + 150]), strict=True):
            assert (a == b).all()


def test_sampling_follows_the_lattice():
    vocabulary = load_vocabulary()
    word, alpha = " thing", 0.0005
    scores = {p: s for p, _, s in vocabulary.pieces}

    def ways(rest):
        if not rest:
            yield (), 0.0
        for n in range(1, len(rest) + 1):
            if rest[:n] in scores:
                for tail, s in ways(rest[n:]):
                    yield (rest[:n], *tail), s + scores[rest[:n]]

    every = {w: math.exp(alpha * s) for w, s in ways(word)}
    total = sum(every.values())
    lattices = Lattices(vocabulary, alpha)
    n = 40_000
    tokens, count = lattices.sample([word] * n, np.random.default_rng(1).integers(0, 1 << 63, n).astype(np.uint64))
    names = {i: p for p, i, _ in vocabulary.pieces}
    ends = np.cumsum(count)
    seen = Counter(tuple(names[t] for t in tokens[e - c : e]) for c, e in zip(count, ends, strict=True))
    assert set(seen) <= set(every)
    for way, weight in every.items():
        assert abs(seen[way] / n - weight / total) < 0.015


def test_long_segments_draw_the_same():
    rng, letters = random.Random(1), "abcdefghijklmnopqrstuvwxyzé日本▁\U0001f600語\0"
    for alpha in (0.001, 0.1, 1.0):
        lattices = Lattices(load_vocabulary(), alpha)
        for k in range(40):
            segment = "".join(rng.choice(letters[: rng.choice([3, 26, 33])]) for _ in range(rng.choice([1, 2, 7, 50, 400])))
            seed = np.array([rng.getrandbits(64)], np.uint64)
            tokens, _ = lattices.sample([segment], seed)
            assert lattices.sample_long(segment, seed[0], window=(5, 64, 1 << 16)[k % 3]).tolist() == tokens.tolist()


def test_texts_without_a_space(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("etaoinshrdlu日") for _ in range(n)) for n in (1023, 1024, 70_000, 300_000)]
    texts.append(texts[0] + " " + texts[2] + " x")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocabulary = load_vocabulary()
    for r in sample_encode(docs).collect():
        assert r["lossless"] and decode(r["ids"], vocabulary) == texts[r["doc_id"]] and r["n_pieces"] == len(r["ids"])
    counts = {r["doc_id"]: r["n_tokens"] for r in count_tokens(docs).collect()}
    assert counts == {i: sum(count_pieces(s, vocabulary)[1] for s in SEGMENTS.findall(" " + x)) for i, x in enumerate(texts)}


def test_streamed_counts_equal_a_plain_search():
    vocabulary, rng = load_vocabulary(), random.Random(4)
    known = {t: s for t, _, s in vocabulary.pieces}
    longest = max(map(len, known))
    for _ in range(200):
        text = " " + "".join(rng.choice(rng.choice(["ab", "etaoinsh", "é日\U0001f600x", "0011aa"])) for _ in range(rng.randint(0, 90)))
        score, count = [0.0], [0]
        for end in range(1, len(text) + 1):
            best = pieces = None
            for start in range(max(0, end - longest), end):
                if (s := known.get(text[start:end])) is not None and (best is None or score[start] + s > best):
                    best, pieces = score[start] + s, count[start] + 1
            if text[end - 1] not in known and (best is None or score[end - 1] + vocabulary.unknown_score > best):
                best, pieces = score[end - 1] + vocabulary.unknown_score, count[end - 1] + len(text[end - 1].encode())
            score.append(best)
            count.append(pieces)
        assert count_pieces(text, vocabulary) == (score[-1], count[-1])


# 2


def brute_groups(rows, words, percent):
    sets = {}
    for i, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
    group = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    return {i: (len(sets[i]), group[i]) for i in sets}


@pytest.mark.parametrize(("words", "percent", "costly", "few"), [(4, 85, 20, 32), (5, 80, 1, 2)])
def test_jaccard_groups(spark, words, percent, costly, few):
    rng = random.Random(words)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 80))]
        for j in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((i * 10 + j, " ".join(copy)))
    rows += [(9000, None), (9001, ""), (9002, "one"), (9003, "ONE"), (9004, "x " * 3000), (9005, "x " * 3000)]
    got = {r[0]: tuple(r[1:]) for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), words=words, percent=percent, costly=costly, few=few, block_sets=4).collect()}
    assert got == brute_groups(rows, words, percent)


def test_jaccard_large_families(spark):
    # near copies of one text, most of their pairs just under the threshold, and of a second one with other sizes
    rng = random.Random(8)
    rows, n = [], 0
    for size, copies, changes in ((70, 260, 3), (90, 90, 2)):
        base = [f"b{size}_{k}" for k in range(size)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, changes)):
                text[rng.randrange(size)] = f"u{n}_{rng.randint(0, 9999)}"
            rows.append((n, " ".join(text[: size - rng.randint(0, 3)])))
            n += 1
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, node int, token string")
    want = brute_groups(rows, 4, 85)
    assert len({g for _, g in want.values()}) > 20
    for few, block_sets in ((8, 32), (1, 512)):
        got = {r[0]: tuple(r[1:]) for r in similar_groups(docs, words=4, percent=85, few=few, block_sets=block_sets, leader_rounds=1).collect()}
        assert got == want


def test_shared_counts():
    rng = np.random.default_rng(3)
    for most in (30, 300, 100_000):
        sets = [np.unique(rng.integers(0, most, rng.integers(0, 60))).astype(np.uint64) for _ in range(50)]
        ends = lambda part: np.concatenate([[0], np.cumsum([len(s) for s in part])])
        x, y = sets[:30], sets[30:]
        got = shared_counts(np.concatenate(x), ends(x), np.concatenate(y), ends(y), columns=7, cells=50)
        assert got.tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 400), (500, 500), (None, 1)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(301)} | {500: 400, 400: 400}


def test_jaccard_edges(spark):
    got = similar_groups(documents(spark))
    assert got.count() == len(TEXTS)
    assert {r["component_id"] for r in got.collect() if r["doc_id"] in (8, 9)} == {8}
    assert similar_groups(documents(spark).limit(0)).count() == 0


# 3


def brute_repeats(texts, length):
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("most_classes", [4, 128])
def test_repeats(spark, most_classes):
    rng = random.Random(7)
    words = ["lorem", "ipsum", "é", "日本", "aaaaaaaa"]
    passage = " ".join(rng.choice(words) + str(rng.randint(0, 999)) for _ in range(60))
    rows = []
    for i in range(60):
        own = " ".join(rng.choice(words) + str(rng.randint(0, 9999)) for _ in range(rng.randint(0, 60)))
        k = rng.randint(0, len(passage) - 250) if i % 2 else 0
        rows.append((i, own + passage[k : k + rng.randint(150, 400)] + own[:50] + "x" * (rng.randint(0, 500) if i % 7 == 0 else 0)))
    rows += [(900, None), (901, ""), (902, "é" * 150), (903, "é" * 150), (904, "é" * 99)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeats(docs, 200, most_classes=most_classes).collect()}
    want = brute_repeats([(t or "").encode() for _, t in rows], 200)
    assert got == {i: w for (i, _), w in zip(rows, want, strict=True)}


def test_deep_shallow_sort():
    rng = random.Random(1)
    for _ in range(200):
        base = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 90))) for _ in range(4)]
        strings = [rng.choice(base)[: rng.randint(0, 90)] + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(1, 40))]
        order, common = deep_shallow_sort(strings, 0, rng.choice([0, 2, 8, 32]))
        assert [strings[i] for i in order] == sorted(strings)
        assert common[1:] == [len(os.path.commonprefix([strings[a], strings[b]])) for a, b in zip(order, order[1:])]


def test_repeats_of_one_row(spark):
    rng = random.Random(5)
    one = " ".join(str(rng.randint(0, 10**6)) for _ in range(80))
    other = "before " + one[:300] + " after " * 20
    rows = [(None, one)] * 20_000 + [((1 << 60) + 1, other), (7, "alone " + str(rng.random()))]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 200)
    n = len(one.encode())
    assert {tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans").distinct().collect()} == {(None, n, n, 1), ((1 << 60) + 1, len(other), 300, 1), (7, len(rows[-1][1]), 0, 0)}
    assert got.count() == len(rows)


def test_repeats_edges(spark):
    docs = documents(spark)
    assert remove_repeats(docs.union(docs)).count() == 2 * len(TEXTS)
    assert remove_repeats(docs.limit(0)).count() == 0


# 4


def test_poisson_table(spark):
    table = spark.range(1).select(poisson_table(F.lit(2.5), 50.0).alias("t")).first()["t"]
    want = np.cumsum([math.exp(-2.5) * 2.5**k / math.factorial(k) for k in range(20)])
    assert np.allclose(table[:20], want) and table[-1] == pytest.approx(1)


def test_mixing_reaches_weights(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"), F.lit(1).alias("copy"))
    mixed = mix_sources(docs, weights={"a": 6.0, "b": 3.0, None: 1.0}, total=9000)
    n = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    for source, share in (("a", 0.6), ("b", 0.3), (None, 0.1)):
        assert abs(n[source] - 9000 * share) < 5 * math.sqrt(9000 * share)
    assert mixed.columns == ["doc_id", "source", "copy", "mix_key"]
    assert mixed.orderBy("mix_key").collect() == mix_sources(docs, weights={"a": 6.0, "b": 3.0, None: 1.0}, total=9000, broadcast_rows=1).orderBy("mix_key").collect()
    assert mix_sources(documents(spark).limit(0)).count() == 0


def test_mixing_has_no_greatest_rate(spark):
    docs = spark.createDataFrame([(i, "rare" if i < 5 else "common") for i in range(2005)], "doc_id long, source string")
    rows = mix_sources(docs, weights={"rare": 1.0, "common": 1.0}, total=4000).collect()
    n = Counter(r["source"] for r in rows)
    assert all(abs(n[source] - 2000) < 5 * math.sqrt(2000) for source in ("rare", "common"))
    copies = Counter(r["doc_id"] for r in rows if r["source"] == "rare")
    assert len(copies) == 5 and len(set(copies.values())) > 1 and all(abs(c - 400) < 5 * math.sqrt(400) for c in copies.values())
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)


# 5


def test_warc_round_trip(spark):
    rows = [(1, "http://B.example.com/x?q=1", "same"), (2, "https://www.a.example.com/", "same"), (3, None, None), (4, "http://a.example.com/", ""), (5, "bad\r\nurl", "é" * 9000), (6, "http://a.example.com/", "same"), (None, "http://z.org", "null id")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, offset string")
    archives, index = fresh_dir(spark, "warc"), fresh_dir(spark, "index")
    directory = warc.build_index(warc.write_warc(pages, archives), index, block_rows=2)
    got = {r["page_id"]: r for r in warc.read_warc(directory, index, archives, payload=True).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i]["payload_bytes"] == len(data) and got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert [(got[i]["record_type"], got[i]["refers_to"]) for i in (1, 2, 3, 4, 6)] == [("response", None), ("revisit", 1), ("response", None), ("revisit", 3), ("revisit", 1)]
    keys = spark.createDataFrame([("http://a.example.com/",), ("http://nowhere.org/",), ("http://a.example.com/",)], "url string")
    assert sorted(x["page_id"] for x in warc.fetch(keys, directory, index, archives).collect()) == [2, 4, 6]
    fetched = warc.fetch(pages.select("url", "page_id"), directory, index, archives, payload=True)
    assert {r["page_id"]: r for r in fetched.collect()} == got and fetched.count() == len(rows)
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_warc_keeps_ids_beyond_doubles(spark):
    big = 1 << 60
    rows = [(big + 1, "same"), (big + 3, "same"), (big + 5, "other"), (big + 5, "same"), (big + 5, "same"), (None, "same"), (7, "x" * 3_000_000)]
    pages = spark.createDataFrame([(i, "http://a.example.com/", h) for i, h in rows], "page_id long, url string, html string").coalesce(1)
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.warc_round_trip(pages).collect())
    revisit = lambda i: (i, 4, "revisit", big + 1)
    assert got == {(big + 1, 4, "response", None): 1, revisit(big + 3): 1, (big + 5, 5, "response", None): 1, revisit(big + 5): 2, revisit(None): 1, (7, 3_000_000, "response", None): 1}


@pytest.mark.parametrize("share", [1, 5, 1000])
def test_hot_payloads_and_others_find_their_first_page(spark, share):
    rows = [(i, "hot", 3) for i in range(40, 90)] + [(i, f"d{i % 6}", 2) for i in range(20)] + [(None, "hot", 3), (7, "small", 1), (8, "small", 1), (41, "hot", 3)]
    got = Counter(tuple(r) for r in warc.first_of_copies(spark.createDataFrame(rows, "page_id long, digest string, n int"), 2, share).collect())
    want = {(i, "hot", 40) for i in [*range(41, 90), None]} | {(i, f"d{i % 6}", i % 6) for i in range(6, 20)}
    assert got == {x: 1 for x in want}


def test_records_are_read_in_runs_of_an_archive():
    places = [("a", 0, 10), ("a", 10, 20), ("a", 200_000, 5), ("a", 200_005, 90), ("b", 200_100, 1), ("b", 200_101, 500), ("b", 200_601, 2)]
    assert list(warc.runs_of(places, 100)) == [places[:2], places[2:4], places[4:5], places[5:6], places[6:]]
    assert list(warc.runs_of([])) == []


def test_fetch_deals_records_by_archive(spark):
    pages = spark.range(3000).selectExpr("id as page_id", "concat('http://h', id % 7, '.org/', id % 50) as url", "repeat(cast(id % 900 as string), 200) as html").repartition(6)
    archives, index = fresh_dir(spark, "warc"), fresh_dir(spark, "index")
    directory = warc.build_index(warc.write_warc(pages, archives), index, block_rows=40)
    found = warc.locate(pages.select("url", "page_id"), directory, index)
    records = warc.read_records(found, archives)
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(file" in plan and "url_key" not in plan
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in records.collect()}
    assert got == {i: (("response", None) if i < 900 else ("revisit", i % 900)) + (200 * len(str(i % 900)),) for i in range(3000)}


# 6


def best_by_bm25(rows, queries, k=10):
    """(query, rank) -> (id, score) of rows (id, text), each scored in full."""
    tf = {i: Counter(re.findall(r"\w+", t or "")) for i, t in rows if i is not None}
    n, mean = len(tf), sum(sum(c.values()) for c in tf.values()) / len(tf)
    df = Counter(t for c in tf.values() for t in c)
    want = {}
    for q in queries:
        scores = []
        for i, c in tf.items():
            size = sum(c.values())
            s = sum(m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * size / mean)) for t, m in tf[q].items() if t in c)
            if s > 0:
                scores.append((-round(s, 6), i))
        want |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])}
    return want


@pytest.mark.parametrize(("shard_docs", "most_queries"), [(70, 3), (25, 400_000)])
def test_bm25(spark, shard_docs, most_queries):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(80)] + ["é"]
    rows = [(i, " ".join(rng.choice(words[: rng.randint(2, 81)]) for _ in range(rng.randint(0, 60)))) for i in range(300)] + [(500, None), (501, ""), (502, "w1 w2"), (503, "w1 w2"), (None, "w1")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, term int")
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in bm25_top_k(docs, docs.where("doc_id % 50 = 0 or doc_id > 500"), shard_docs=shard_docs, most_queries=most_queries).collect()}
    want = best_by_bm25(rows, [i for i, _ in rows if i is not None and (i % 50 == 0 or i > 500)])
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=2e-6) for k in want)
    assert bm25_top_k(docs.limit(0), docs.limit(0)).count() == 0


@pytest.mark.parametrize("tasks", [1, 4])
@pytest.mark.parametrize("seed", [1, 2])
def test_bm25_of_short_queries_keeps_the_last_rank_and_its_ties(spark, tasks, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words[: rng.choice([20, 400])]) for _ in range(rng.randint(1, 12))) for _ in range(1000)]
    rows = list(enumerate([*texts, *texts]))  # each twice: ties, and over tasks
    asked = [(10_000 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(tasks, "doc_id")
    queries = spark.createDataFrame(asked, "doc_id long, text string")
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in bm25_top_k(docs, queries, shard_docs=2000 if tasks == 1 else 300).collect()}
    tf = [Counter(x.split()) for _, x in rows]
    n, mean = len(tf), sum(sum(c.values()) for c in tf) / len(tf)
    df = Counter(t for c in tf for t in c)
    for q, text in asked:
        scores = []
        for i, c in enumerate(tf):
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) * m for t, m in Counter(text.split()).items() if t in c)
            if s > 0:
                scores.append((-round(s, 6), i))
        want = sorted(scores)[:10]
        own = [got[q, k] for k in range(1, 11) if (q, k) in got]
        assert [i for i, _ in own] == [i for _, i in want] and [s for _, s in own] == pytest.approx([-s for s, _ in want], abs=2e-6)


def test_bm25_counts_all_of_a_word(spark):
    rows = [(0, "w"), (1, "w " * 100_000 + "x " * 400_000), (2, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in bm25_top_k(docs, docs.where("doc_id = 0"), k=10).collect()}
    mean, idf = 500_003 / 3, math.log(1 + 1.5 / 2.5)
    want = {i: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)) for i, tf, size in ((0, 1, 1), (1, 100_000, 500_000))}
    assert got == pytest.approx(want, abs=2e-6)


# 7


def test_near_duplicate_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base[:20] + 0.05 * rng.standard_normal((20, 16)), np.repeat(base[:1], 90, 0) + 0.04 * rng.standard_normal((90, 16)), base[:3]]).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] * 16), (1005, [1.0, 2.0]), (None, x[0].tolist())]
    vectors = spark.createDataFrame(rows + [(*o, 1) for o in odd], "vec_id long, embedding array<float>, kept int")
    got = {r[0]: tuple(r[1:]) for r in near_duplicates(vectors, block=32).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    links = spark.createDataFrame([(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)], "a long, b long")
    group = {r["node"]: r["component"] for r in components(links).collect()}
    for i in range(len(x)):
        assert got[i] == (near[i].sum(), group.get(i, i), group.get(i, i) == i)
    for o, _ in odd[:-1]:
        assert got[o] == (0, o, True)
    assert got[None] == (0, None, False)
    assert near_duplicates(vectors.limit(0)).count() == 0


def test_vectors_of_doubles(spark):
    rows = [(1, [1e300, 1e300]), (2, [1e-300, 1.0000001e-300]), (3, [1.0, 0.0]), (3, [0.0, 2.0]), (3, [0.0, 2.0]), (4, [1.0 + 1e-12, 0.0]), (5, [float("inf"), 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_duplicates(vectors).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (3, 1, 3), (3, 1, 3), (4, 1, 3), (5, 0, 5)]


def test_weak_links_between_dense_groups(spark):
    rng = np.random.default_rng(1)
    parts = []
    for _ in range(6):
        c, u = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
        for a, away in ((0.0, -0.12), (np.arccos(0.955), np.arccos(0.955) + 0.12)):
            parts += [(np.cos(a) * c + np.sin(a) * u)[None], np.cos(away) * c + np.sin(away) * u + 0.008 * rng.standard_normal((60, 64))]
    x = np.concatenate(parts).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    assert all(near[lo : lo + 61, lo + 61 : lo + 122].sum() == 1 for lo in range(0, len(x), 122))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicates(vectors).collect()}
    assert got == {i: (near[i].sum(), i - i % 122) for i in range(len(x))}


@pytest.mark.parametrize("attempts", [1, 2])
def test_no_graph_is_taken_unaudited(spark, attempts):
    # pairs in dense surroundings that aren't links: one projection and one round find few of the pairs
    rng = np.random.default_rng(2)
    base = rng.standard_normal((1, 32)) + 0.45 * rng.standard_normal((150, 32))
    x = np.concatenate([base, base + 0.05 * rng.standard_normal((150, 32))]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = near_duplicates(vectors, threshold=0.98, places=1, tables=1, reach=1, rounds=1, attempts=attempts, audit_rows=64)
    assert {r["vec_id"]: r["n_links"] for r in got.collect()} == {i: near[i].sum() for i in range(len(x))}


# 8


def test_languages(spark):
    rng = random.Random(2)
    made = {"aa": ["ka", "ko", "ta"], "bb": ["sch", "ung", "eit"], "cc": ["que", "eau", "ion"]}
    rows = [(i, " ".join("".join(rng.choice(s) for _ in range(3)) for _ in range(30)), k) for i, (k, s) in enumerate(list(made.items()) * 40)]
    rows += [(900, None, "aa"), (901, "", None), (902, "123 ! \u00bd \u00b2 \u2167", "bb"), (903, "KAKO " * 4000, None), (904, "\U00030000", None), (905, "KAKO", "aa"), (905, "KAKO", "aa")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in identify_language(docs, lambda i: fold(i) != 2).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows[:120]) and got[903]["lang_pred"] == "aa"
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[904]["lang_pred"] != "und" and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in identify_language(docs.withColumn("lang", F.lit(None).cast("string")), lambda i: fold(i) != 2).collect()} == {"und"}
    rejected = identify_language(docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(999, "zzz xxx yyy www " * 9, None)], "doc_id long, text string, lang string")), lambda i: fold(i) != 2, reject=True)
    assert rejected.where("doc_id = 999").first()["lang_pred"] == "und"


def test_character_model_sums_to_one():
    models = fit({"aa": ["kako tako kata"] * 8, "bb": ["ung eit sch"] * 8})
    letters = sorted({int(c) for t in ("kako tako kata", "ung eit sch") for c in codes(t)} - {0})
    for before in ("", "k", "ka", "ung "):
        head = codes(before) if before else np.zeros(0, np.uint32)
        total = np.zeros(2)
        for c in [*letters, 0]:
            with_c, n = np.append(head, np.uint32(c)), len(head)
            bits = entropies([with_c], models)[0] * (n + 1) - (entropies([head], models)[0] * n if n else 0)
            total += 2.0**-bits
        # one more symbol, never seen, holds what is left
        assert np.all(total <= 1.0001) and np.all(total > 0.8)


# 9


def test_counts_follow_the_library(spark, tmp_path):
    """The library's unigram search on all whole texts, with the scores that load_vocabulary() gives."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:
        piece.score = max(piece.score, -50_000)
    path = f"{tmp_path}/unigram.model"
    open(path, "wb").write(proto.SerializeToString())
    sp, vocabulary = sentencepiece.SentencePieceProcessor(model_file=path), load_vocabulary()
    rng = random.Random(4)
    words = "the thing ation heit sch eau queque ción internationalisation Thstinnt x zzzzzz représentation".split()
    for _ in range(500):
        word = "".join(rng.choice(words)[: rng.randint(1, 9)] for _ in range(rng.randint(1, 3)))
        assert count_pieces(" " + word, vocabulary)[1] == len(sp.encode(word)), word
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) < 50000")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(docs).collect()}
    assert len(got) == len(texts) > 900
    assert {i: len(sp.encode(x or "")) for i, x in texts.items()} == got


def test_counts_edges(spark):
    got = {r["doc_id"]: r for r in count_tokens(documents(spark)).collect()}
    assert (got[0]["n_tokens"], got[1]["n_tokens"]) == (0, 0) and got[8]["n_tokens"] == got[9]["n_tokens"]
    whole = load_vocabulary()
    assert got[6]["n_tokens"] == count_pieces(" " + TEXTS[6], whole)[1]
    assert count_tokens(documents(spark).limit(0)).count() == 0


# 10


def test_toxicity(spark):
    rng = random.Random(6)
    words = [f"{a}{b}{c}" for a in "bdk" for b in "aeiou" for c in ("n", "r", "st")]
    rows, labels = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(rng.randint(5, 300))]
        bad = i % 4 == 0
        if bad:
            text[rng.randrange(len(text))] = rng.choice(["horrid", "vile"]) if i % 8 else "grubble" + rng.choice(words)
        rows.append((i, " ".join(text), 1))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame([*rows, (900, None, 1), (901, "", 1), (902, "...", 1), (903, "ban " * 9000 + "horrid", 1)], "doc_id long, text string, score int")
    marks = spark.createDataFrame([*labels, (None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in score_toxicity(docs, marks, lambda i: fold(i) != 2).collect()}
    wrong = sum(got[i]["predicted"] != t for i, _, t in labels)
    assert wrong <= 12 and got[903]["predicted"] == 1
    assert [got[i]["score"] for i in (900, 901, 902)] == [0.0] * 3
    assert {r["score"] for r in score_toxicity(docs, marks.limit(0), lambda i: fold(i) != 2).collect()} == {0.0}


def test_windows_cover_all_words():
    n = np.array([0, 1, 63, 64, 65, 112, 113, 1000])
    doc, start, size = windows_of(n)
    for k, total in enumerate(n):
        covered = set()
        for s, w in zip(start[doc == k], size[doc == k], strict=True):
            covered |= set(range(s, s + w))
        assert covered == set(range(total))


def test_pieces_of_one_character_cost_no_match():
    """They are found by code point; all pieces are found, and the longest of one place stand first."""
    vocabulary = load_vocabulary()
    text = " a ab\0the\u00e9\U0001f600 \u2581z"
    end, token = vocabulary.matches(text)
    known = {t: i for t, i, _ in vocabulary.pieces}
    want = [(e, known[text[s : e + 1]]) for e in range(len(text)) for s in range(e + 1) if text[s : e + 1] in known]
    order = np.argsort(end, kind="stable")
    assert list(zip(end[order].tolist(), token[order].tolist(), strict=True)) == want
    single = sum(len(text[s : e + 1]) == 1 for e in range(len(text)) for s in range(e + 1) if text[s : e + 1] in known)
    assert single and len(list(vocabulary.id_automaton.iter(text))) == len(want) - single
