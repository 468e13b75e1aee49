"""Rows through Python in a narrow Arrow stage, with few of them in memory at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa

#: Rows, and characters of their texts, of one outgoing Arrow batch.
BATCH_ROWS, BATCH_CHARS = 5_000, 2 << 20


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
    """The rows of batches, each made into Python values when its turn comes: a batch may hold thousands of pages."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
        del batch
        pa.default_memory_pool().release_unused()


def written(rows: Iterator[tuple[Sequence[Any], int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows, each of which comes with the length of its texts."""
    columns: list[list] = [[] for _ in schema]
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for row, length in rows:
        for column, value in zip(columns, row, strict=True):
            column.append(value)
        size += length
        if size >= BATCH_CHARS or len(columns[0]) >= BATCH_ROWS:
            yield batch()
            columns, size = [[] for _ in schema], 0
    if columns[0]:
        yield batch()
