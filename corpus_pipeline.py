"""The corpus pipeline: each stage works on all documents that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import discard, fold, stash, table
from cohortspark.llm.mixing import mix_sources
from cohortspark.llm.ngram_join import similar_groups
from cohortspark.llm.sentencepiece_sample import sample_encode
from cohortspark.llm.suffix_dedup import remove_repeats
from cohortspark.llm.toxicity import score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network doesn't reject; it learns from the labels of the training folds."""
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), lambda i: fold(i) != 2)
    return scored.where("predicted = 0").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): the one with the smallest id.

    Documents without words and those with a null id stay; rows of one id count as one document."""
    groups = similar_groups(docs, words=5, percent=80)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that strings of 200 bytes cover which also start elsewhere. All documents stay."""
    cut = remove_repeats(docs, length=200)
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' rates say, in a shuffled order."""
    return mix_sources(docs).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of each document; copies of a document get equal ids."""
    return sample_encode(docs, keys=("doc_id", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", drop_repeats),
    ("mixing", mix),
    ("SentencePiece", encode),
]

#: SQL can express neither the network nor the sampled segmentation; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage returned is deleted when the next one's is stored."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, "stage")
            if before is not None:
                discard(before)
            before = docs
    return docs
