"""Tables of bits of a fixed size, which tell tasks what isn't worth sending: they let everything through that is in a set and
little else, whatever the size of the set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26


def bit_table(hashes: DataFrame) -> np.ndarray:
    """The table of BITS bits (8 MB) that has those of a column of 64-bit hashes; at most one row a byte reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) % np.uint64(BITS)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(3)).astype(np.int32)), pa.array(1 << (at & np.uint64(7)).astype(np.int32))], ["byte", "bits"])

    table = np.zeros(BITS // 8, np.uint8)
    got = hashes.mapInArrow(run, "byte int, bits int").groupBy("byte").agg(F.bit_or("bits").cast("int").alias("bits")).toArrow()
    table[got["byte"].to_numpy()] = got["bits"].to_numpy()
    return table


def has(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % np.uint64(BITS)
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
