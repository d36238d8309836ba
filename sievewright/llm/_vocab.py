"""Vocabulary files: read from the folder of the public_tokenizers package, or from a path that is given."""

from __future__ import annotations

import base64
import os

#: Splits text before the merges, as the rank files are used with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def locate(name: str) -> str:
    """A path as it is; a bare file name in the installed package or in /opt/tokenizers."""
    if os.sep in name:
        return name
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join("/opt/tokenizers", name)
    return public_tokenizers.path(name)


def byte_ranks(name: str) -> dict[bytes, int]:
    with open(locate(name), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairTable:
    """(left id, right id) -> value, as an open-addressing hash table in two numpy arrays."""

    NONE = 2**31 - 1

    def __init__(self, left, right, value):
        import numpy as np

        keys = (np.asarray(left, np.uint64) << np.uint64(20)) | np.asarray(right, np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, self.NONE, np.int32)
        value, slot = np.asarray(value, np.int32), self._slot(keys)
        while len(keys):
            free = self.keys[slot] == np.uint64(2**64 - 1)
            _, first = np.unique(slot, return_index=True)
            put = np.zeros(len(keys), bool)
            put[first] = True
            put &= free
            self.keys[slot[put]], self.values[slot[put]] = keys[put], value[put]
            keys, value, slot = keys[~put], value[~put], (slot[~put] + 1) & self.mask

    def _slot(self, keys):
        import numpy as np

        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left, right):
        """Values of the pairs, NONE where a pair isn't in the table."""
        import numpy as np

        keys = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], np.int32(self.NONE))
        open_ = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64(2**64 - 1))]
        return out


class Memo(dict):
    """Piece -> number, given in order; pieces that are new wait in `fresh`."""

    def __init__(self):
        super().__init__()
        self.fresh, self.held = [], 0

    def __missing__(self, piece):
        self[piece] = number = len(self)
        self.fresh.append(piece)
        self.held += len(piece)
        return number

    def full(self, pieces: int, characters: int) -> bool:
        return len(self) > pieces or self.held > characters
