"""Nulls, very long texts, ties, repeated rows, empty tables and clashing names, where the other tests don't reach."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortspark.llm.bm25 import bm25_top_k
from cohortspark.llm.common import fold
from cohortspark.llm.embed_dedup import near_duplicates
from cohortspark.llm.langid import fit, identify_language, labelled_texts
from cohortspark.llm.mixing import mix_sources
from cohortspark.llm.ngram_join import similar_groups
from cohortspark.llm.suffix_dedup import remove_repeats
from cohortspark.llm.token_count import count_tokens
from cohortspark.llm.toxicity import labelled_sample, score_toxicity
from cohortspark.llm.warc import warc_round_trip

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
TRAIN = lambda i: fold(i) != 2


def test_jaccard_with_null_and_repeated_ids_and_taken_names(spark):
    one, other = "a b c d e f g h", "q r s t u v w x"
    rows = [(None, one), (None, one), (4, one), (4, other), (4, None), (9, other), (2, "p o n m l k"), (None, "all of its own words")]
    taken = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("token", "node", "component_id", "n_shingles", "id", "a", "b")})
    got = Counter(tuple(r) for r in similar_groups(taken).select("doc_id", "n_shingles", "component_id").collect())
    # a set goes by the least id of its rows, those of null ids too; an id with two texts is in both of their groups
    assert got == {(None, 4, 4): 2, (4, 4, 4): 2, (4, 0, 4): 1, (9, 4, 4): 1, (2, 2, 2): 1, (None, 1, None): 1}


def test_mixing_null_ids_and_sources(spark):
    rows = [(None, None)] * 3 + [(1, None)] * 2 + [(i, "s") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").withColumns({c: F.lit(1) for c in ("rate", "times", "mix_key", "rate_source")})
    mixed = mix_sources(docs, temperature=1.0, total=43 * 40)
    assert mixed.columns == ["doc_id", "source", "rate", "times", "rate_source", "copy", "mix_key"]
    n = Counter((r["doc_id"], r["copy"]) for r in mixed.where("source is null").collect())
    # equal rows are drawn alike, each with all its copies
    assert {(i, c): k for (i, c), k in n.items()} == {(i, c): {None: 3, 1: 2}[i] for (i, c) in n} and {i for i, _ in n} == {None, 1}


def test_warc_of_one_id_with_many_payloads(spark):
    pages = spark.createDataFrame([(5, "http://a.org", "x"), (5, "http://a.org", "y"), (5, "http://b.org", "x"), (3, None, "y")], "page_id long, url string, html string")
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc_round_trip(pages).collect())
    assert sum(got.values()) == 4 and got[3, 1, "response", None] == 1 and got[5, 1, "revisit", 3] == 1 and sum(k for (i, _, _, _), k in got.items() if i == 5) == 3


def test_top_k_of_very_long_texts_and_repeated_ids(spark):
    rows = [(1, "rare " + "common " * 200_000), (2, "rare common"), (2, "rare common"), (50, "rare"), (50, "common"), (3, None), (None, "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("query", "term", "score", "id")})
    got = bm25_top_k(docs, docs.where("doc_id = 50"), k=10).collect()
    # both rows of the query are one query; documents that have one id stand once for each row
    assert Counter(r["doc_id"] for r in got) == {1: 1, 2: 2, 50: 2} and {r["query_id"] for r in got} == {50}
    assert [r["score"] for r in sorted(got, key=lambda r: r["rank"])] == sorted((r["score"] for r in got), reverse=True)


def test_vectors_of_repeated_ids(spark):
    rows = [(7, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [0.0, 1.0]), (9, [0.0, 2.0]), (3, [-1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("node", "vector", "component_id", "sim")})
    got = Counter(tuple(r) for r in near_duplicates(vectors).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == {(7, 1, 7, True): 3, (9, 1, 7, False): 1, (3, 0, 3, True): 1}


def test_counts_with_taken_names(spark):
    docs = spark.createDataFrame([(1, "two words", "x"), (1, "two words", "x"), (None, "", "x")], "doc_id long, text string, n_tokens string").withColumn("id", F.lit(0))
    got = Counter(tuple(r) for r in count_tokens(docs).collect())
    assert sorted(got.values()) == [1, 2] and got[None, 0, 0] == 1


@pytest.mark.parametrize("doubled", [False, True])
def test_models_on_repeats_ties_and_no_rows(spark, doubled):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["ka", "ko"]) if i % 2 else rng.choice(["un", "ei"]) for _ in range(20)), "ab"[i % 2]) for i in range(60)]
    docs = spark.createDataFrame([*rows, (70, "ka", None), (70, "ka", None), (71, "x", "a"), (71, "x", "b"), (None, "un ei", None)], "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("taken"))
    docs = docs.union(docs) if doubled else docs
    got = identify_language(docs, TRAIN)
    assert got.count() == docs.count() and {r[0] for r in got.where("doc_id = 70").select("lang_pred").collect()} == {"b"}
    assert identify_language(docs.limit(0), TRAIN).count() == 0
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2 + [(0, 1), (None, 1), (1, None)], "doc_id long, toxic int")
    scored = score_toxicity(docs, marks, TRAIN)
    assert scored.count() == docs.count() and scored.select("doc_id", "text", "score").distinct().count() == docs.select("doc_id", "text").distinct().count()
    assert score_toxicity(docs.limit(0), marks, TRAIN).count() == 0


def test_pipeline_on_no_rows_and_null_rows(spark, tmp_path):
    rows = {"empty": [], "nulls": [(None, None, None, None, None)] * 3 + [(None, "the same words in both of the rows", "en", None, 9)] * 2 + [(5, "", "en", "s", 0)]}
    for name, held in rows.items():
        spark.createDataFrame(held, DOCUMENTS).withColumn("score", F.lit("x")).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:3]:
            kept = stage(spark, docs, f"{tmp_path}/{name}")
            assert kept.columns == docs.columns and kept.count() == len(held)
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").where("not lossless").count() == 0


def test_repeats_beside_taken_names(spark):
    names = ("span_list", "span_did", "span_rid", "did", "rid", "spans", "h", "kept")
    docs = spark.createDataFrame([(1, "x" * 300), (2, "clean")], "doc_id long, text string").withColumns({c: F.lit(f"own {c}") for c in names})
    rows = {r["doc_id"]: r for r in remove_repeats(docs).collect()}
    assert rows[1]["n_removed"] == 300 and rows[2]["n_removed"] == 0
    assert all(rows[1][c] == f"own {c}" for c in names if c != "kept")


def test_languages_without_letters(spark):
    rows = [(i, "", "a") for i in range(30)] + [(40, "abc", None), (41, "12", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in identify_language(docs, TRAIN).collect()} == {"und"}
    with_b = docs.union(spark.createDataFrame([(100 + i, "" if i % 2 else "wo wa", "b") for i in range(12)], docs.schema))
    assert {r["lang_pred"] for r in identify_language(with_b, TRAIN).where("text like '%w%' or doc_id = 40").collect()} == {"b"}
    assert fit({"a": ["", "", "", "only the fourth has letters"], "b": ["..."]}).languages == ["a"]


def test_samples_are_bounded_in_bytes(spark):
    rows = [(i, f"text {i} " * 20, "ab"[i % 2]) for i in range(40)] + [(99, "y" * 3_000_000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = docs.select("doc_id", (F.col("lang") == "a").cast("int").alias("toxic"))
    everyone = lambda i: i >= 0
    found = labelled_texts(docs, everyone, 600, most_bytes=4000)
    assert all(0 < sum(map(len, v)) <= 2000 for v in found.values()) and len(found) == 2
    texts, labels, _ = labelled_sample(docs, marks, everyone, 600, most_bytes=8000)
    assert 0 < sum(len(x) for x, y in zip(texts, labels) if y) <= 4000 and max(map(len, texts)) <= 500
