"""The report of all models on another cohort beside plain numbers, and what is handed over to the scoring job."""

from __future__ import annotations

import numpy as np
import pytest

from cohortspark.operators import evaluate, validation
from cohortspark.sources import tables


def plain(rows, cut):
    """auc, average precision, brier, sensitivity, specificity of (y, p) rows, pair by pair."""
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    auc = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
    ap, before = 0.0, 0.0
    for t in sorted({p for _, p in rows}, reverse=True):
        tp, all_ = sum(p >= t for p in pos), sum(p >= t for _, p in rows)
        ap, before = ap + (tp / len(pos) - before) * tp / all_, tp / len(pos)
    return auc, ap, np.mean([(y - p) ** 2 for y, p in rows]), np.mean([p >= cut for p in pos]), np.mean([p < cut for p in neg])


def test_report_beside_plain_numbers(spark):
    rng = np.random.default_rng(2)
    rows = [(i, m, int(y), float(np.round(np.clip(0.3 * y + rng.random() * 0.7, 0, 1), 2))) for m in "ab" for i, y in enumerate(rng.random(300) < 0.3)]
    df = spark.createDataFrame([*rows, (900, "a", 1, None), (901, "a", None, 0.2)], "id long, model string, y int, p double")
    cut = spark.createDataFrame([("a", 0.4)], "model string, threshold double")
    own = spark.createDataFrame([("a", 0.9)], "model string, auc double")
    got = {r["model"]: r for r in validation.validate(df, "y", "p", "id", ["model"], cut, 200, own=own).collect()}
    for m, t in (("a", 0.4), ("b", 0.5)):
        want = plain([(y, p) for _, k, y, p in rows if k == m], t)
        assert [got[m][c] for c in ("auc", "average_precision", "brier", "sensitivity", "specificity")] == pytest.approx(want)
        assert got[m]["threshold"] == t and got[m]["n"] == 300
        assert all(got[m][f"{c}_lo"] < got[m][c] < got[m][f"{c}_hi"] for c in validation.METRICS)
    assert got["a"]["auc_change"] == pytest.approx(got["a"]["auc"] - 0.9) and got["b"]["auc_own"] is None


def test_single_class_and_no_rows(spark):
    kind = "id long, model string, y int, p double"
    cut = spark.createDataFrame([], "model string, threshold double")
    one = validation.validate(spark.createDataFrame([(1, "a", 0, 0.7), (2, "a", 0, 0.2)], kind), "y", "p", "id", ["model"], cut, 10, vectorised=False).first()
    assert one["auc"] is None and one["auc_lo"] is None and (one["n"], one["n_pos"], one["sensitivity"], one["specificity"]) == (2, 0, 0.0, 0.5)
    assert validation.validate(spark.createDataFrame([], kind), "y", "p", "id", ["model"], cut, 10, vectorised=False).count() == 0


def test_cutoffs_are_published_and_read(spark, tmp_path):
    rows = [(1, "m", 1, 0.9), (2, "m", 1, 0.6), (3, "m", 0, 0.6), (4, "m", 0, 0.1), (5, "lone", 1, 0.3)]
    df = spark.createDataFrame(rows, "id long, model string, y int, p double")
    tables.publish_table(validation.cutoffs(df, "y", "p", ["model"]), str(tmp_path / "cut"))
    assert {tuple(r) for r in tables.read_published(spark, str(tmp_path / "cut")).collect()} == {("m", 0.9), ("lone", 0.5)}


def test_selection_document(spark, tmp_path):
    rows = [("pof", "b", -0.5, 0.1, 0.02), ("pof", "a", 0.5, 0.1, 0.02), ("pof", "c", 0.9, 0.1, 0.02), ("death", "a", None, None, None)]
    path = str(tmp_path / "s.json")
    tables.write_selection(spark.createDataFrame(rows, "outcome string, feature string, weight double, best_c double, best_lambda double"), path)
    got = {(r["outcome"], r["place"]): r for r in tables.read_selection(spark, path).collect()}
    assert [got["pof", k]["feature"] for k in (1, 2, 3)] == ["c", "a", "b"] and got["pof", 3]["weight"] == -0.5 and got["pof", 1]["n_features"] == 3
    assert got["death", 1]["weight"] is None and got["death", 1]["best_c"] is None
    (tmp_path / "pretty.json").write_text('{\n  "pof": {"n_features": 2, "features": ["x", "y"],\n "weights": {"x": 1.5}, "best_C": 0.2, "best_lambda": 0.3}\n}')
    pretty = {r["feature"]: r for r in tables.read_selection(spark, str(tmp_path / "pretty.json")).collect()}
    assert pretty["x"]["weight"] == 1.5 and pretty["y"]["weight"] is None and pretty["y"]["best_lambda"] == 0.3
    (tmp_path / "bad.json").write_text("{pof")
    with pytest.raises(Exception):
        tables.read_selection(spark, str(tmp_path / "bad.json")).collect()


def test_top_by(spark):
    df = spark.createDataFrame([("g", "a", 1), ("g", "b", 1), ("g", "c", 3), ("h", "d", 0)], "g string, f string, n int")
    assert sorted(r["f"] for r in evaluate.top_by(df, "g", [df["n"].desc(), df["f"].asc()], 2).collect()) == ["a", "c", "d"]
