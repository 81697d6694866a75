"""The pipeline's stages on a small corpus: what each has to drop goes, and all else stays."""

from __future__ import annotations

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    words = [a + b + c for a in "bdgk" for b in "aeiou" for c in ("n", "r", "st", "lm")]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(240)]
    toxic = set(range(0, 240, 6))
    for i in toxic:
        texts[i] += " horrid vile"
    texts[11] = texts[7] + " once"
    passage = " ".join(rng.choice(words) for _ in range(70))
    for i in (13, 17, 19):
        texts[i] += " " + passage
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame([*rows, (900, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    (_, a), (_, b), (_, c), (_, d), (_, e) = corpus_pipeline.STAGES
    held = [r["doc_id"] for r in a(spark, docs, str(tmp_path)).collect()]
    assert len(toxic & set(held)) <= 4 and len(set(held) - toxic) >= 195 and 900 in held
    kept = {r["doc_id"] for r in b(spark, docs, str(tmp_path)).collect()}
    assert kept == set(range(240)) - {11} | {900}
    cut = {r["doc_id"]: r for r in c(spark, docs, str(tmp_path)).collect()}
    assert len(cut) == 241 and cut[900]["text"] is None and all(cut[i]["text"].strip() == texts[i][: -len(passage)].strip() for i in (13, 17, 19))
    mixed = d(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and 150 < mixed.count() < 330
    assert e(spark, docs, str(tmp_path)).where("lossless").count() == 240
    assert corpus_pipeline.run(spark, str(tmp_path)).where("not lossless").count() == 0
