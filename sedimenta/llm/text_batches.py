"""Arrow batches of an id and a text column, cut so that a worker holds few texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a worker handles at once; only memory depends on it.
BATCH_BYTES = 3_000_000


def pieces(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches, cut by the bytes of ``column``; a single longer text stays whole."""
    for batch in batches:
        if batch.num_rows <= 1 or batch.column(column).nbytes <= BATCH_BYTES:
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > BATCH_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
