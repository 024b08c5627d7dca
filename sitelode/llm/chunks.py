"""Text columns as bytes, in chunks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes, without decoding them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def by_bytes(items: list[bytes | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges (start, end) of items of at most ``most`` bytes together; one larger item has a range of its own."""
    start = total = 0
    for i, x in enumerate(items):
        n = len(x) if x else 0
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(items):
        yield start, len(items)


def runs(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (lengths[0] of them), first[1], ... as one array."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(first, np.int64) - (ends - lengths), lengths)
