"""What the operators of this subpackage share: tables, checkpoints, and walks over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from sievewright.functions.frames import cut
from sievewright.functions.frames import read_table as table

__all__ = ["cut", "let", "ragged", "segments", "slices", "table", "texts"]

#: A Python worker holds about this much text at once; one longer text is handled alone.
SLICE_BYTES = 2 << 20


def let(value, body: Callable):
    """body(value) with value computed once a row, whatever the number of its uses in body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most so many bytes of text, or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(lengths), 0
    while start < len(lengths):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    return pc.fill_null(batch.column(text), "").to_pylist()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every (start, length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def segments(sizes: np.ndarray) -> np.ndarray:
    """0 and the running sums of the sizes."""
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out
