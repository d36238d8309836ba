"""Minimum hashes by MD5, for many shingles at once in numpy.

The definition is that of dedup.signature: for each seed the least MD5, as hexadecimal digits, of "seed_" and the text
of a shingle. One engine call a hash and shingle costs about a microsecond there; here all shingles of a batch go
through the rounds of MD5 together, as arrays of 32-bit words, and only the first word differs from seed to seed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions import constants as K
from sievewright.functions import text as T

#: Shingles that go through the rounds together: their words stay in a core's cache.
TOGETHER = 1 << 14
#: A worker takes so many bytes of quoted words at once, or one text.
BYTES = 1 << 21

#: MD5 by RFC 1321: start values, turns of each round, sines.
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]


def md5(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The four words of the digests of padded messages of equal length; words: 16 rows a block, a column a message."""
    n = words.shape[1]
    state = [np.full(n, s, np.uint32) for s in _START]
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for block in range(0, len(words), 16):
        a, b, c, d = (s.copy() for s in state)
        for i in range(64):
            turn, k = divmod(i, 16)
            if turn == 0:  # d ^ (b & (c ^ d))
                np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
                at = k
            elif turn == 1:  # c ^ (d & (b ^ c))
                np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
                at = (5 * k + 1) % 16
            elif turn == 2:
                np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
                at = (3 * k + 5) % 16
            else:  # c ^ (b | ~d)
                np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
                at = 7 * k % 16
            f += a
            f += words[block + at]
            f += _SINES[i]
            by = _TURNS[turn][k % 4]
            np.left_shift(f, by, out=t), np.right_shift(f, 32 - by, out=f), np.bitwise_or(f, t, out=f)
            f += b
            a, b, c, d, f = d, f, b, c, a
        for s, x in zip(state, (a, b, c, d), strict=True):
            s += x
    return tuple(state)


def _messages(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ahead: int, blocks: int) -> np.ndarray:
    """Padded messages as 32-bit words: `ahead` free bytes, then "(", the bytes, ")"."""
    n, width = len(starts), 64 * blocks
    out = np.zeros((n, width), np.uint8)
    place = np.arange(width) - ahead - 1
    at = starts[:, None] + place
    inside = (place >= 0) & (place < lengths[:, None])
    out[inside] = data[at[inside]]
    each, end = np.arange(n), ahead + 1 + lengths
    out[:, ahead], out[each, end], out[each, end + 1] = ord("("), ord(")"), 0x80
    out[:, -8:] = ((end + 1) * 8).astype("<u8").view(np.uint8).reshape(n, 8)
    return np.ascontiguousarray(out.view("<u4").T)


def minima(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, heads: np.ndarray, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """High and low halves of the least digest of each run of shingles (from heads on), for each seed: (runs, hashes)."""
    owner = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(starts)]))
    high = np.full((len(heads), hashes), np.uint64(2**64 - 1))
    low = high.copy()
    for first, last, ahead in ((0, min(10, hashes), 2), (10, hashes, 3)):
        blocks = (lengths + ahead + 10) // 64 + 1
        for b in np.unique(blocks) if last > first else []:
            own = np.flatnonzero(blocks == b)
            for at in range(0, len(own), TOGETHER):
                some = own[at : at + TOGETHER]
                words = _messages(data, starts[some], lengths[some], ahead, int(b))
                rest, run = words[0].copy(), owner[some]
                edge = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
                sizes = np.diff(np.r_[edge, len(run)])
                for seed in range(first, last):
                    words[0] = rest | np.uint32(int.from_bytes(f"{seed}_".encode(), "little"))
                    x, y, z, w = (v.byteswap().astype(np.uint64) for v in md5(words))
                    h, l = (x << np.uint64(32)) | y, (z << np.uint64(32)) | w  # noqa: E741
                    top = np.minimum.reduceat(h, edge)
                    l[h != np.repeat(top, sizes)] = 2**64 - 1
                    bottom = np.minimum.reduceat(l, edge)
                    r, old_h, old_l = run[edge], high[run[edge], seed], low[run[edge], seed]
                    better = (top < old_h) | ((top == old_h) & (bottom < old_l))
                    high[r, seed], low[r, seed] = np.where(better, top, old_h), np.where(better, bottom, old_l)
    return high, low


def _hexed(high: np.ndarray, low: np.ndarray) -> pa.Array:
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)
    raw = np.stack([high.ravel(), low.ravel()], axis=1).astype(">u8").view(np.uint8)
    text = digits[np.stack([raw >> 4, raw & 15], axis=2)]
    edge = pa.py_buffer((np.arange(high.size + 1, dtype=np.int32) * 32).tobytes())
    return pa.StringArray.from_buffers(high.size, edge, pa.py_buffer(text.tobytes()))


def _shingles(texts: pa.StringArray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, lengths, heads): runs of n quoted words of each text, in which ", " follows every word."""
    edge = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edge[0] : edge[-1]]
    blank = np.flatnonzero(data == ord(" "))
    starts, sizes = np.r_[0, blank + 1][:-1], np.diff(np.r_[-1, blank]) - 2
    bounds = np.searchsorted(blank, edge - edge[0])
    count = np.diff(bounds)
    runs = np.maximum(count - n + 1, 1)
    heads = np.cumsum(runs) - runs
    row = np.repeat(np.arange(len(count)), runs)
    first = bounds[row] + np.arange(len(row)) - heads[row]
    last = np.minimum(first + n, bounds[row + 1]) - 1
    some = count[row] > 0
    begin, end = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    begin[some], end[some] = starts[first[some]], starts[last[some]] + sizes[last[some]]
    end[count[row] == 1] += 1  # the comma behind a lone word
    return data, begin, end - begin, heads


def quoted_words(word: Column) -> Column:
    """A word as a literal of a tuple's text form: in single quotes unless it has those and no double ones."""
    back = F.replace(word, F.lit("\\"), F.lit("\\\\"))
    single, double = F.contains(word, F.lit("'")), F.contains(word, F.lit('"'))
    return F.when(single & ~double, F.concat(F.lit('"'), back, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(back, F.lit("'"), F.lit("\\'")), F.lit("'")))


def quoted_text(normal: Column) -> Column:
    """The words of a normalised text as such literals, ", " after each; word by word only where one holds a quote or a backslash."""

    def quoted(t: Column) -> Column:
        plain = F.concat(F.lit("'"), F.replace(t, F.lit(" "), F.lit("', '")), F.lit("', "))
        each = F.concat(F.array_join(F.transform(F.split(t, " "), quoted_words), ", "), F.lit(", "))
        return F.when(t == "", "").when(T.has_any(t, ["'", "\\"]), each).otherwise(plain)

    return T.let(normal, quoted)


def with_signature(docs: DataFrame, text: str, n: int = K.SHINGLE_WORDS, hashes: int = K.HASHES) -> DataFrame:
    """The same columns but text, and signature array<string>: minimum MD5 digests as dedup.signature has them."""
    names = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column("__quoted")).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BYTES, side="right")))
                part = batch.slice(start, stop - start)
                high, low = minima(*_shingles(part.column("__quoted"), n), hashes)
                made = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * hashes), _hexed(high, low))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), made], names=[*names, "signature"])
                start = stop

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text), "signature array<string>"])
    return docs.select(*names, quoted_text(T.normalise(F.coalesce(F.col(text), F.lit("")))).alias("__quoted")).mapInArrow(run, schema)
