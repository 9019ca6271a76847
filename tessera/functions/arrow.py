"""Small helpers for Arrow batch functions (``mapInArrow``)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 2000, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most ``rows`` rows and about ``size``
    bytes (one row at least), so that a worker's memory doesn't depend on the
    session's batch settings."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(rows, int(n * size / max(1, batch.nbytes))))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch of ``columns`` (lists or Arrow arrays) in the order of ``schema``."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)],
        schema=schema,
    )
