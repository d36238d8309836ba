"""Byte-level BPE encoding and decoding (operator 9).

Pieces of the pre-tokenizer's pattern are held once each, by length bucket, in padded numpy matrices of token ids. In
each round every row merges its leftmost pair of minimum rank; ranks come from a hashed pair table; rows that have no
pair left leave the matrix, and the others close the gap (compaction), so a matrix loses a column a round. A piece of
over LONG bytes is folded into a matrix of its own, WIDTH symbols a row: in each round every row whose least rank is the
piece's merges its leftmost such pair, and the matrix is laid out anew when half of its symbols are gone. Merges of one
rank in several rows may be one round because no merge gives rise to a pair of a lower rank; that holds where the merges
inside each token run in order of rank, which is checked when a vocabulary meets its first long piece; otherwise one row
merges a round.

Defined results: a null text is the empty text; an empty text has no ids (n_tokens 0, hashes of no bytes); repeated
rows are encoded each; special strings are ordinary text; extra input columns are ignored; an empty table gives an
empty result. Memory: SLICE_BYTES of text, or one text, and a memo of at most MEMO pieces and MEMO_CHARS characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sievewright.llm._batches import ragged, segments, slices, texts
from sievewright.llm._vocab import PATTERN, Memo, PairTable, byte_ranks

LONG, WIDTH = 128, 64
#: Pieces, and characters in them, of which a worker keeps the ids from one slice to the next.
MEMO, MEMO_CHARS = 300_000, 8 << 20
NONE = PairTable.NONE
#: Fills rows; in no pair.
PAD = (1 << 20) - 1


class ByteBPE:
    def __init__(self, name: str, pattern: str = PATTERN):
        ranks = byte_ranks(name)
        self.find, self.ranks = regex.compile(pattern).findall, ranks
        size = max(ranks.values()) + 1
        self.token = [b""] * size
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            self.token[rank] = token
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.pairs = PairTable(left, right, merged)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.lengths = np.array([len(t) for t in self.token], np.int64)
        self.starts = segments(self.lengths)[:-1]
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.memo, self.flat = Memo(), np.zeros(1 << 16, np.int32)
        self.used, self.at, self.n = 0, np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    # -- pieces -> ids -------------------------------------------------------------------------------------------

    @cached_property
    def in_order(self) -> bool:
        """Whether the merges inside every token run in order of rank, the token's own last."""
        for token, rank in self.ranks.items():
            parts, last = [token[k : k + 1] for k in range(len(token))], -1
            while len(parts) > 1:
                here, least = min(((k, self.ranks.get(parts[k] + parts[k + 1], NONE)) for k in range(len(parts) - 1)), key=lambda p: p[1])
                if least == NONE or least < last:
                    return False
                parts[here : here + 2], last = [parts[here] + parts[here + 1]], least
            if len(token) > 1 and last != rank:
                return False
        return True

    def _folded(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece."""
        ids, rank = self.single[np.frombuffer(piece, np.uint8)], -1
        while rank != NONE:
            n = left = len(ids)
            size = -(-n // WIDTH) * WIDTH
            # The last place belongs to no row; it is behind the first symbol and ahead of the last.
            ids = np.append(ids, np.full(size + 1 - n, PAD, np.int32))
            ahead, behind = np.minimum(np.arange(1, size + 2), size), np.arange(-1, size)
            ranks = np.full(size + 1, NONE, np.int32)
            ranks[: n - 1] = self.pairs(ids[: n - 1], ids[1:n])
            grid = ranks[:size].reshape(-1, WIDTH)
            least = grid.min(axis=1)
            while 2 * left > n and (rank := least.min()) != NONE:
                rows = np.flatnonzero(least == rank)[: None if self.in_order else 1]
                at = rows * WIDTH + grid[rows].argmin(axis=1)
                if (ranks[behind[at]] == rank).any():
                    at = self._leftmost(ranks, ahead, rank)[: None if self.in_order else 1]
                gone = ahead[at]
                after = ahead[gone]
                ids[at], ids[gone], ranks[gone] = rank, PAD, NONE
                ahead[at], behind[after] = after, at
                left -= len(at)
                places = np.concatenate([at, behind[at]])
                ranks[places] = self.pairs(ids[places], ids[ahead[places]])
                ranks[size] = NONE
                changed = np.unique(np.concatenate([places, gone]) // WIDTH)
                changed = changed[(changed >= 0) & (changed < len(least))]
                least[changed] = grid[changed].min(axis=1)
            ids = ids[:size][ids[:size] != PAD]
        return ids

    @staticmethod
    def _leftmost(ranks: np.ndarray, ahead: np.ndarray, rank: int) -> np.ndarray:
        """Each row's leftmost pair of the rank, where pairs that overlap count from the left, whatever row they begin in."""
        hits = np.flatnonzero(ranks == rank)
        fresh = np.r_[True, ahead[hits[:-1]] != hits[1:]]
        begin = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        hits = hits[(np.arange(len(hits)) - begin) % 2 == 0]
        return hits[np.unique(hits // WIDTH, return_index=True)[1]]

    def _matrix(self, rows: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> Iterator[tuple]:
        """(numbers, counts, ids) of the rows as they end."""
        width = int(lengths.max())
        ids = np.full((len(rows), width), PAD, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.single[flat]
        ranks = np.full(ids.shape, NONE, np.int32)
        ranks[:, :-1] = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        while len(rows):
            here = ranks.argmin(axis=1)
            each = np.arange(len(rows))
            least = ranks[each, here]
            ended = least == NONE
            if ended.any():
                done = ids[ended]
                yield rows[ended], (done != PAD).sum(axis=1), done[done != PAD]
                go = ~ended
                rows, ids, ranks, here, least = rows[go], ids[go], ranks[go], here[go], least[go]
                each = np.arange(len(rows))
                if not len(rows):
                    return
            n, width = ids.shape
            ids[each, here] = least
            keep = np.ones((n, width), bool)
            keep[each, here + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            keep[each, here + 1] = True
            keep[each, here] = False
            ranks = ranks[keep].reshape(n, width - 1)
            inner = here < width - 2
            e, h = each[inner], here[inner]
            ranks[e, h] = self.pairs(ids[e, h], ids[e, h + 1])
            ranks[each[~inner], here[~inner]] = NONE
            inner = here > 0
            e, h = each[inner], here[inner]
            ranks[e, h - 1] = self.pairs(ids[e, h - 1], ids[e, h])

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many each has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        numbers, counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        buffer, starts = np.frombuffer(b"".join(pieces), np.uint8), segments(lengths)[:-1]
        low = 0
        for high in (1, 2, 4, 6, 8, 12, 16, 24, 32, 64, LONG):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            low = high
            if len(rows):
                own = lengths[rows]
                for r, c, i in self._matrix(rows, buffer[ragged(starts[rows], own)], own):
                    numbers.append(r), counts.append(c), ids.append(i)
        for r in np.flatnonzero(lengths > LONG):
            i = self._folded(pieces[r])
            numbers.append(np.array([r])), counts.append(np.array([len(i)])), ids.append(i)
        numbers, counts, ids = np.concatenate(numbers), np.concatenate(counts), np.concatenate(ids)
        order = np.argsort(numbers, kind="stable")
        return ids[ragged(segments(counts)[:-1][order], counts[order])], counts[order]

    # -- texts <-> ids -------------------------------------------------------------------------------------------

    def _learn(self) -> None:
        """Ids of the pieces that are new to the memo."""
        fresh, self.memo.fresh = self.memo.fresh, []
        if not fresh:
            return
        ids, counts = self.merge([p.encode() for p in fresh])
        known = len(self.memo) - len(fresh)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.memo) > len(self.at):
            self.at, self.n = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.n))
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[known : len(self.memo)] = self.used + segments(counts)[:-1]
        self.n[known : len(self.memo)] = counts
        self.used += len(ids)

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other; bounds of each text's ids."""
        if self.memo.full(MEMO, MEMO_CHARS):
            self._forget()
        numbers = [np.fromiter(map(self.memo.__getitem__, pieces), np.int64, len(pieces)) for pieces in map(self.find, batch)]
        self._learn()
        flat = np.concatenate([np.zeros(0, np.int64), *numbers])
        counts = self.n[flat]
        ids = self.flat[ragged(self.at[flat], counts)]
        return ids, segments(counts)[segments(np.array([len(x) for x in numbers], np.int64))]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of all ids one after the other; bounds of each text's bytes."""
        lengths = self.lengths[ids]
        return self.bytes[ragged(self.starts[ids], lengths)].tobytes(), segments(lengths)[bounds]


_OPEN: dict[tuple[str, str], ByteBPE] = {}


def opened(name: str, pattern: str = PATTERN) -> ByteBPE:
    """One for each worker."""
    if (name, pattern) not in _OPEN:
        _OPEN[name, pattern] = ByteBPE(name, pattern)
    return _OPEN[name, pattern]


def encode_documents(docs: DataFrame, tokenizer: str, with_ids: bool = False, keep: list[str] = []) -> DataFrame:
    """doc_id, columns to keep, n_tokens, ids_sha256, decoded_sha256 of each row; with_ids adds ids array<int>."""
    kept = ["doc_id", *keep]
    types = {f.name: f.dataType.simpleString() for f in docs.select(*kept).schema.fields}
    schema = f"{', '.join(f'`{c}` {types[c]}' for c in kept)}, n_tokens bigint, {'ids array<int>, ' * with_ids}ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(tokenizer)
        for batch in batches:
            for part in slices(batch):
                ids, bounds = bpe.encode(texts(part))
                plain, at = bpe.decode(ids, bounds)
                raw = memoryview(ids.astype("<u4").tobytes())
                spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                out = {c: part.column(c) for c in kept} | {"n_tokens": pa.array(np.diff(bounds), pa.int64())}
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                out["ids_sha256"] = pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in spans], pa.string())
                decoded = memoryview(plain)
                out["decoded_sha256"] = pa.array([hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return docs.select(*kept, "text").mapInArrow(run, schema)
