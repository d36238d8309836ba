"""Token counts (operator 10).

Pre-tokens of a batch are held as one ragged numpy array of symbols. In each round every pre-token's pair of lowest
rank is merged at all its places at once (in a run such as a a a from the left), and pre-tokens without a pair leave;
the symbols that survive are counted. Merging at once equals one merge at a time because every pair that contains a
merged symbol ranks after the merge that makes the symbol; this is checked when the vocabulary is read.

Defined results: a null text is the empty text and has no tokens; special strings inside a text count as one token
each, as the library does by default; repeated rows are counted each; extra columns are ignored; an empty table gives
an empty result. Memory: SLICE_BYTES of text, or one text, and a memo of at most MEMO pre-tokens and MEMO_CHARS characters.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from sievewright.llm._batches import slices, texts
from sievewright.llm._vocab import Memo, PairTable, locate

#: Pre-tokens, and characters in them, whose counts a worker keeps from one slice to the next.
MEMO, MEMO_CHARS = 300_000, 8 << 20
NONE = PairTable.NONE
#: Places are closed up when one in so many is idle.
CLOSE = 3
#: Behind each piece, and in place of a symbol that is gone; in no pair.
PAD, GONE = (1 << 20) - 1, (1 << 20) - 2


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordBPE:
    """Reads a byte-level BPE with word ends: NFC, white space to a blank, lower case, one pattern that splits."""

    def __init__(self, name: str):
        with open(locate(name), encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or not model["end_of_word_suffix"] or model["dropout"]:
            raise ValueError(f"{name}: not a lower-case BPE with word ends")
        self.find = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        special = [regex.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(sorted(special, key=len, reverse=True))) if special else None
        self.hints = [t["content"] for t in spec["added_tokens"]]
        letters, end = byte_alphabet(), model["end_of_word_suffix"]
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        rank = np.arange(len(pairs))
        self.made = made.astype(np.int32)
        self.pairs = PairTable(left, right, rank)
        latest = np.full(max(vocab.values()) + 1, -1)
        np.maximum.at(latest, made, rank)
        #: Whether all places of a pair may be merged at once.
        self.at_once = bool((np.maximum(latest[left], latest[right]) < rank).all())
        self._forget()

    def _forget(self) -> None:
        self.memo, self.counts = Memo(), np.zeros(1 << 14, np.int64)

    def survivors(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols each piece ends as.

        Ranks are looked up once and then only beside what merged; places of symbols that are gone, and of pieces that
        are done, are closed up when they make 1 / CLOSE of all.
        """
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = lengths.copy()
        own = np.flatnonzero(lengths)
        if not len(own):
            return counts
        # A pad behind each piece is in no pair.
        ends = np.cumsum(lengths[own] + 1) - 1
        ids = np.full(int(ends[-1]) + 1, PAD, np.int32)
        rows = np.repeat(own, lengths[own] + 1)
        inside = np.ones(len(ids), bool)
        inside[ends] = False
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        ids[inside] = self.inner[flat]
        ids[ends - 1] = self.last[flat[np.cumsum(lengths[own]) - 1]]
        ranks = np.full(len(ids), NONE, np.int32)
        ranks[:-1] = self.pairs(ids[:-1], ids[1:])
        while len(ids):
            ahead, behind = np.arange(1, len(ids) + 1), np.arange(-1, len(ids) - 1)
            heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            sizes = np.diff(np.r_[heads, len(ids)])
            gone = 0
            while True:
                least = np.minimum.reduceat(ranks, heads)
                going = least != NONE
                if not going.any() or CLOSE * (gone + sizes[~going].sum()) > len(ids):
                    break
                hits = np.flatnonzero((ranks == np.repeat(least, sizes)) & (ranks != NONE)) if len(heads) > 1 else np.flatnonzero(ranks == least[0])
                if self.at_once:  # only a pair of equal symbols overlaps itself: in a run of hits every second place
                    fresh = np.r_[True, ahead[hits[:-1]] != hits[1:]]
                    begin = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                    at = hits[(np.arange(len(hits)) - begin) % 2 == 0]
                else:
                    at = hits[np.r_[True, rows[hits[1:]] != rows[hits[:-1]]]]
                lost = ahead[at]
                after = ahead[lost]
                ids[at], ids[lost], ranks[lost] = self.made[ranks[at]], GONE, NONE
                ahead[at], behind[after] = after, at
                np.subtract.at(counts, rows[at], 1)
                gone += len(at)
                places = np.concatenate([at, behind[at]])
                places = places[places >= 0]
                ranks[places] = self.pairs(ids[places], ids[ahead[places]])
            keep = np.repeat(going, sizes) & (ids != GONE)
            ids, rows, ranks = ids[keep], rows[keep], ranks[keep]
        return counts

    def _pieces(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text) if not text.isascii() else text
        text = text.replace("Σ", "σ") if "Σ" in text else text  # no final sigma
        return self.find(text.lower())

    def count(self, batch: list[str]) -> np.ndarray:
        if self.memo.full(MEMO, MEMO_CHARS):
            self._forget()
        numbers, extra = [], np.zeros(len(batch), np.int64)
        for k, text in enumerate(batch):
            pieces: list[str] = []
            if self.special and any(h in text for h in self.hints):
                extra[k] = len(self.special.findall(text))
                for part in self.special.split(text):
                    pieces += self._pieces(part)
            else:
                pieces = self._pieces(text)
            numbers.append(np.fromiter(map(self.memo.__getitem__, pieces), np.int64, len(pieces)))
        fresh, self.memo.fresh = self.memo.fresh, []
        if fresh:
            while len(self.memo) > len(self.counts):
                self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            self.counts[len(self.memo) - len(fresh) : len(self.memo)] = self.survivors([p.encode() for p in fresh])
        return extra + np.array([self.counts[x].sum() for x in numbers], np.int64)


_OPEN: dict[str, WordBPE] = {}


def opened(name: str) -> WordBPE:
    if name not in _OPEN:
        _OPEN[name] = WordBPE(name)
    return _OPEN[name]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than limit tokens) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(tokenizer)
        for batch in batches:
            for part in slices(batch):
                n = bpe.count(texts(part))
                size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": size, "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array(n > limit)})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes bigint, n_tokens bigint, over_limit boolean")
