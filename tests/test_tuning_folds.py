"""The registered search over the learners leaves out no folds."""

from __future__ import annotations

import pytest

from cohortspark.operators import models
from cohortspark.plans.queries import QUERIES


def test_the_query_tunes_in_five_folds(spark, monkeypatch):
    class Dealt(Exception):
        pass

    def with_folds(df, y, key, k, salt="fold"):
        raise Dealt(k)

    monkeypatch.setattr(models, "with_folds", with_folds)
    with pytest.raises(Dealt, match="^5$"):
        QUERIES["tune_and_fit"](spark, "/root/testdata/sf0.001")
