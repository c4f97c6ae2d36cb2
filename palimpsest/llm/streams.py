"""Sorted-group processing that holds one group at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .session import width

#: Text that a worker turns into arrays at once, in bytes; a longer text is a slice of its own.
SLICE = 2 << 20


def slices(batch: pa.RecordBatch, column: int | str, most: int = SLICE):
    """Consecutive parts of a batch with at most ``most`` bytes of a string or binary column each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def groups(batches, key: str):
    """Tables of equal ``key`` from Arrow batches sorted by it; a group may span batches."""
    held: list[pa.RecordBatch] = []
    current = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key)
        change = pc.not_equal(k.slice(1), k.slice(0, len(k) - 1)).to_pylist() if len(k) > 1 else []
        cuts = [0, *[i + 1 for i, x in enumerate(change) if x], b.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:]):
            value = k[i].as_py()
            if held and value != current:
                yield pa.Table.from_batches(held)
                held = []
            current = value
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def by_group(df: DataFrame, key: str, work, schema: str, order: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """``work(table) -> iterable of RecordBatch`` for each value of ``key`` (not null).

    Rows are dealt out by key and sorted (with spilling) in the JVM, so a task's memory holds its largest group.
    """

    def run(batches):
        for table in groups(batches, key):
            yield from work(table)

    return df.repartition(parts or width(df.sparkSession), key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
