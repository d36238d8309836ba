"""The cascade and the near-duplicate choice in one plain process: an independent statement for tests and for timing."""

from __future__ import annotations

import hashlib
import re
import sys
import time
from collections import Counter

from sievewright.functions import constants as K
from sievewright.plans.sql import CSS, TAG, URL, W, WS


def _pattern(sql: str, flags: int = 0) -> re.Pattern:
    """A pattern of the SQL catalog for Python, whose classes know no \\x{..} and no \\p."""
    sql = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", sql)
    return re.compile(sql.replace(r"\p{L}\p{N}_", r"\w"), flags)


_TAGS, _RULES, _URLS = _pattern(TAG), _pattern(CSS), _pattern(URL)
_BLOCKS = [re.compile(f"<{t}[^>]*>.*?</{t}>", re.I | re.S) for t in K.BLOCK_TAGS]
_ATTRIBUTES = re.compile(r"""\b(?:style|class)\s*=\s*["'][^"']*["']""", re.I)
_PLATES = [re.compile(p, re.I | re.M) for p in K.BOILERPLATE]
_RUN = re.compile(r"([^\w\s]|_)\1{4}")
_FINE = frozenset(K.ALLOWED_SYMBOLS)


def tidied(text: str) -> str:
    for p in (*_BLOCKS, _TAGS):
        text = p.sub(" ", text)
    for name, char in K.ENTITIES:
        text = text.replace(name, char)
    for p in (_RULES, _ATTRIBUTES):
        text = p.sub(" ", text)
    return re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", text)).strip()


def verdict(text: str, least: int = 500) -> tuple[str | None, str]:
    markup = sum(len(m) for p in (_TAGS, _RULES) for m in p.findall(text))
    clean = tidied(text)
    low = clean.lower()
    words = low.split()
    n = len(words)
    rate = lambda hits: 1000 * hits / n if n else 0.0
    total = lambda keys: sum(map(low.count, keys))
    steps = (
        ("html_css_spam", lambda: markup / len(text) > 0.15),
        ("panjang_invalid", lambda: n < least or n > 10_000),
        ("symbol_spam", lambda: sum(not (c.isalpha() or c.isdigit() or c.isspace() or c in _FINE) for c in clean) > 0.3 * len(clean) or _RUN.search(clean)),
        ("boilerplate", lambda: rate(sum(len(p.findall(clean)) for p in _PLATES)) > 3),
        ("gambling_adult_content", lambda: any(k in low for k in K.GAMBLING_ADULT)),
        ("suspicious_domain", lambda: any(d in u for u in _URLS.findall(low) for d in K.SUSPICIOUS_DOMAINS)),
        ("excessive_links", lambda: len(_URLS.findall(clean)) > 10),
        ("dominant_repeated_word", lambda: n >= 10 and max(Counter(words).values()) / n > 0.4),
        ("no_punctuation", lambda: not set(".,?!") & set(clean)),
        ("profanity", lambda: rate(total(K.PROFANITY)) > 3),
        ("marketing_spam", lambda: rate(total(K.MARKETING)) > 15),
    )
    return next((name for name, rejects in steps if rejects()), None), clean


def duplicates(texts: list[str]) -> list[str | None]:
    """In order of arrival, over texts that passed."""
    seen, kept, out = set(), [], []
    for text in texts:
        words = text.lower().split()
        key = " ".join(words)
        if key in seen:
            out.append("exact_duplicate")
            continue
        seen.add(key)
        runs = {repr(tuple(words[i : i + 5])) for i in range(max(1, len(words) - 4))}
        signature = [min(hashlib.md5(f"{k}_{r}".encode()).digest() for r in runs) for k in range(32)]
        near = any(sum(map(bytes.__eq__, signature, other)) >= 28 for other in kept)
        out.append("near_duplicate" if near else None)
        if not near:
            kept.append(signature)
    return out


def main() -> None:
    import pyarrow.parquet as pq

    texts = [t.strip() for t in pq.read_table(f"{sys.argv[1]}/documents.parquet", columns=["text"]).column(0).to_pylist()]
    began = time.perf_counter()
    judged = [verdict(t, 50) for t in texts if t]
    print(f"cascade {time.perf_counter() - began:.1f} s, {sum(r is None for r, _ in judged)} pass", flush=True)
    began = time.perf_counter()
    marks = duplicates(texts)
    print(f"near_dedup_greedy {time.perf_counter() - began:.1f} s, {marks.count('near_duplicate')} near duplicates")


if __name__ == "__main__":
    main()
