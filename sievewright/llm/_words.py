"""Words of many texts as numpy arrays over one buffer of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, each behind a blank, and where each text starts (its blank); null is empty."""
    parts = pc.fill_null(column.cast(pa.binary()), b"").to_pylist()
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    starts = np.cumsum(sizes) - sizes
    return np.frombuffer(b"".join(b" " + p for p in parts) + b" ", np.uint8), starts


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True; first and last are False."""
    edge = np.diff(inside.view(np.int8))
    return np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
