"""Tasks of the suffix-array dedup: what they hold, and runs of spans beside plain ones."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from cohortspark.llm import suffix_dedup
from cohortspark.llm.suffix_dedup import _runs, anchors


class _Rows:
    """A table whose task can be called."""

    def __getattr__(self, name):
        return lambda *args, **kwargs: self

    def mapInArrow(self, task, schema):  # noqa: N802
        self.task = task
        return self


def _peak(task, batch) -> tuple[int, int]:
    tracemalloc.start()
    try:
        n = sum(len(x) for x in task(iter([batch])))
        return n, tracemalloc.get_traced_memory()[1] >> 20
    finally:
        tracemalloc.stop()


def test_contexts_are_cut_with_little_memory(spark, monkeypatch):
    """What a task allocates for 60,000 contexts of one batch; Arrow's buffers are not in it."""
    rows = _Rows()
    monkeypatch.setattr(suffix_dedup.F, "col", lambda c: c)
    suffix_dedup._cut(rows, _Rows())
    text, n = "the quick brown fox jumps over the lazy dog and runs on " * 20, 10_000
    places = [{"pos": 200 + 70 * k, "h": k, "before": 160, "after": 200, "size": 3} for k in range(6)]
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("h", pa.int64()), ("before", pa.int16()), ("after", pa.int16()), ("size", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array([text] * n), pa.array([places] * n, kind)], ["did", "rid", "text", "places"])
    made, peak = _peak(rows.task, batch)
    assert made == 6 * n and peak < 30
    last = list(rows.task(iter([batch])))[-1].to_pylist()[-1]
    assert last == {"did": n - 1, "rid": n - 1, "pos": 550, "key": 5, "size": 3, "left": text[390:550][::-1].encode(), "right": text[550:750].encode()}


def test_anchors_take_little_memory():
    rows = _Rows()
    suffix_dedup._anchor_table(rows, 200)
    made = random.Random(5)
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 2000), pa.array([2] * 2000), pa.array(["".join(made.choices("abcdef ", k=1000)) for _ in range(2000)])], ["did", "rid", "text"])
    n, peak = _peak(rows.task, batch)
    assert n and peak < 40
    text = np.frombuffer("".join(batch.column(2).to_pylist()).encode(), np.uint8)
    assert n == len(anchors(text, np.arange(2001) * 1000, 200)[0])


def test_runs_of_spans():
    made = random.Random(3)
    for _ in range(300):
        sizes = [made.randrange(30) for _ in range(made.randrange(1, 6))]
        at = np.concatenate([[0], np.cumsum(sizes)])
        spans = [(r, at[r] + (s := made.randrange(n)), at[r] + made.randrange(s, n) + 1) for r, n in enumerate(sizes) if n for _ in range(made.randrange(4))]
        inside = [{i for r, s, e in spans if r == k for i in range(s, e)} for k in range(len(sizes))]
        want = [(k, i, next(j for j in range(i, at[-1] + 1) if j not in own)) for k, own in enumerate(inside) for i in sorted(own) if i - 1 not in own]
        row, start, end = (np.array([x[j] for x in spans], np.int64) for j in range(3))
        assert list(zip(*(x.tolist() for x in _runs(row, start, end)), strict=True)) == want


def test_rows_that_touch_keep_their_own_spans(spark):
    """Rows removed as a whole stand beside each other; an empty one, a null and a cut character are between them."""
    body = "".join(random.Random(7).choices("abcdefghij", k=230))
    docs = [(1, body), (2, body), (3, ""), (4, None), (5, "é" + body + "é"), (None, body)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    seen = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]), r["kept_text"]) for r in got}
    assert seen == {1: (230, 230, 1, b"", ""), 2: (230, 230, 1, b"", ""), 3: (0, 0, 0, b"", ""), 4: (0, 0, 0, b"", ""), 5: (234, 230, 1, "éé".encode(), "éé"), None: (230, 230, 1, b"", "")}
