"""Arrow batches in pieces of bounded bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


def chunks_by_bytes(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items of about `most` bytes; a larger item gets a range of its own."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def slices(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, list[str | None]]]:
    """A string column in ranges of about `most` bytes, so that only so much of a batch is in Python objects at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for i, j in chunks_by_bytes(sizes, most):
        yield i, j, column.slice(i, j - i).to_pylist()
