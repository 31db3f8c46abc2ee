"""Arrow batches cut so that no more of their texts than a bound are Python objects at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Bytes of a slice; a longer row is a slice of its own with its neighbours.
SLICE = 1 << 20


def slices(batches: Iterable[pa.RecordBatch], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in slices of about ``most`` bytes; a batch has up to 10,000 rows of any length. Slices
    share the batch's memory."""
    for batch in batches:
        rows = max(1, batch.num_rows * most // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
