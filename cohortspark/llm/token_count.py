"""Token counts by a Viterbi search that keeps scores and counts but no path."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import byte_column, chunks, releasing
from .vocabulary import MODEL, SEGMENTS, Vocabulary, load_vocabulary

#: Bytes of text that stand as Python strings at a time.
PART = 1 << 20


def count_pieces(text: str, vocabulary: Vocabulary) -> tuple[float, int]:
    """(score, number of pieces) of the best segmentation of a text without its space prefix.

    Among equal scores the piece that begins first wins, as in the library's search: it takes starts in order and replaces
    a score only by a greater one. A character without a piece of its own may stand as its UTF-8 bytes."""
    unknown, mask = vocabulary.unknown_score, vocabulary.ring - 1
    # scores and counts of the last nodes only: no piece is longer than the ring
    score, count = [0.0] * (mask + 1), [0] * (mask + 1)
    node, best, pieces, longest, single = 1, None, 0, 0, False
    for end, (length, _, s) in chain(vocabulary.automaton.iter(text), [(len(text), (0, 0, 0.0))]):
        while node <= end:
            if not single:
                total = score[node - 1 & mask] + unknown
                if best is None or total > best:
                    best, pieces = total, count[node - 1 & mask] + len(text[node - 1].encode())
            score[node & mask], count[node & mask] = best, pieces
            node, best, longest, single = node + 1, None, 0, False
        total, single = score[node - length & mask] + s, single or length == 1
        if best is None or total > best or (total == best and length > longest):
            best, pieces, longest = total, count[node - length & mask] + 1, length
    return score[len(text) & mask], count[len(text) & mask]


class _Counts(dict):
    """Counts by segment of a task; filled as they are asked for, and emptied when it holds too many."""

    most, longest = 500_000, 64

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, segment: str) -> int:
        found = count_pieces(segment, self.vocabulary)[1]
        if len(segment) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[segment] = found
        return found


def count_tokens(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens long, n_chars long) for each row: pieces of its whole text, without begin and end tokens.

    Best segmentations are cut at spaces and line breaks, where no piece reaches across, so that each distinct segment is
    searched once in a task. A segment's search holds no more than the nodes a piece spans, whatever its length. Scores are summed in double precision for each segment. Null and empty texts have 0 tokens;
    repeated rows stay; other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model))

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunks(byte_column(batch.column(1))[1], PART):
                yield batch.slice(lo, hi - lo)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Counts(sent.value)
        for batch in pieces_of(batches):
            # as in the library, U+2581 in a text is a space
            texts = [x and x.replace("▁", " ") for x in batch.column(1).to_pylist()]
            n = [sum(map(cache.__getitem__, SEGMENTS.findall(" " + x))) if x else 0 for x in texts]
            chars = [len(x) if x else 0 for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(n, np.int64)), pa.array(np.array(chars, np.int64))], ["id", "n_tokens", "n_chars"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(releasing(count), f"id {kind}, n_tokens long, n_chars long").withColumnRenamed("id", id_col)
