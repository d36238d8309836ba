"""SentencePiece in Python workers: encoding, pieces, decoding that drops broken byte runs, training."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions import constants as K

_BYTE = re.compile("<0x[0-9A-Fa-f]{2}>")
#: A worker holds so many characters or tokens as Python objects at once, or one row.
CHARS, TOKENS = 1 << 18, 1 << 16


@lru_cache(maxsize=4)
def _opened(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


@lru_cache(maxsize=4)
def _pieces_of(sp) -> tuple[pa.Array, dict[int, int]]:
    """Pieces of all ids, and the bytes that some ids stand for."""
    named = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
    return pa.array(named, pa.string()), {i: int(p[3:5], 16) for i, p in enumerate(named) if _BYTE.fullmatch(p)}


def _slices(batch: pa.RecordBatch, sizes: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of rows whose sizes sum to at most so much, or of one row."""
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _typed(docs: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)


def encode(docs: DataFrame, model: bytes, text: str = "text", eos: int | None = None) -> DataFrame:
    """The same columns and tokens array<int>; eos, if given, ends each document. Null texts have no tokens."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, ends = _opened(shared.value), [] if eos is None else [eos]
        for batch in batches:
            for part in _slices(batch, pc.binary_length(batch.column(text)), CHARS):
                ids = sp.encode([t or "" for t in part.column(text).to_pylist()], num_threads=1)  # the cores have tasks of their own
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([i + ends for i in ids], pa.list_(pa.int32()))], names=[*names, "tokens"])

    return docs.mapInArrow(run, f"{_typed(docs)}, tokens array<int>")


def _mapped(docs: DataFrame, model: bytes, column: str, name: str, kind: str, work) -> DataFrame:
    """Adds work(processor, arrays of ids), an Arrow array of a row each, for a column of arrays of ids, TOKENS at a time."""
    names, shared = docs.columns, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _opened(shared.value)
        for batch in batches:
            for part in _slices(batch, pc.list_value_length(batch.column(column)), TOKENS):
                yield pa.RecordBatch.from_arrays([*part.columns, work(sp, part.column(column))], names=[*names, name])

    return docs.mapInArrow(run, f"{_typed(docs)}, {name} {kind}")


def _as_pieces(sp, lists: pa.ListArray) -> pa.ListArray:
    """Pieces by place in the table of them; no id becomes a Python object."""
    edges = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), _pieces_of(sp)[0].take(lists.flatten()), mask=lists.is_null() if lists.null_count else None)


def pieces(docs: DataFrame, model: bytes, tokens: str = "tokens") -> DataFrame:
    """Adds pieces array<string>; a null array gives null."""
    return _mapped(docs, model, tokens, "pieces", "array<string>", _as_pieces)


def is_byte_piece(piece) -> Column:
    return F.regexp_like(F.col(piece) if isinstance(piece, str) else piece, F.lit("^<0x[0-9A-Fa-f]{2}>$"))


def decoded(sp, ids: list[int]) -> str:
    """Runs of byte pieces are decoded as a whole, or dropped if they aren't UTF-8 or hold U+FFFD; others as usual."""
    byte = _pieces_of(sp)[1]
    out = []
    for is_byte, run in groupby(ids, key=byte.__contains__):
        if is_byte:
            text = bytes(byte[i] for i in run).decode("utf-8", errors="replace")
            out.append("" if "\ufffd" in text else text)
        else:
            out.append(sp.decode(list(run)))
    return "".join(out)


def safe_decode(docs: DataFrame, model: bytes, tokens: str = "tokens") -> DataFrame:
    """Adds decoded, the text of the ids without broken byte runs; a null array gives null."""
    return _mapped(docs, model, tokens, "decoded", "string", lambda sp, lists: pa.array([None if ids is None else decoded(sp, ids) for ids in lists.to_pylist()], pa.string()))


def train(rows: DataFrame, text: str = "text", vocab: int = 64_000, sentences: int = 8_000_000, **options) -> bytes:
    """A BPE model with byte fallback and the chat tags, from a sample that the caller has bounded (capped_corpus).

    The library trains in one process; rows stream to it partition by partition.
    """
    import sentencepiece

    out = io.BytesIO()
    lines = (line for r in rows.select(text).toLocalIterator() for line in r[0].split("\n") if line)
    settings = {"model_type": "bpe", "character_coverage": 0.9990, "pad_id": 0, "unk_id": 1, "bos_id": 2, "eos_id": 3, "user_defined_symbols": K.CHAT_TAGS, "input_sentence_size": sentences, "shuffle_input_sentence": True, "max_sentence_length": 4192, "byte_fallback": True, "num_threads": 4}
    sentencepiece.SentencePieceTrainer.train(sentence_iterator=lines, model_writer=out, vocab_size=vocab, **settings | options)
    return out.getvalue()
