"""The pipeline keeps one stage's documents at a time."""

from __future__ import annotations

import glob

import corpus_pipeline
from cohortspark.llm.common import shared_dir


def test_stages_are_deleted_when_the_next_is_stored(spark, tmp_path, monkeypatch):
    spark.range(20).selectExpr("id as doc_id", "'a' as text").write.parquet(f"{tmp_path}/documents.parquet")
    kept = []

    def stage(_, docs, sf_dir):
        kept.append(len(held() - before))
        return docs.where(f"doc_id <> {len(kept)}")

    held = lambda: set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/stage-*"))
    before = held()
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(k), stage) for k in range(5)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 15
    assert kept == [0, 1, 1, 1, 1] and len(held() - before) == 1
