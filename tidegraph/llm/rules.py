"""Quality rules: compression bands over whole documents and fixed chunks, beside base counts of each text.

A document is rejected if its zstandard ratio (compressed bytes / bytes) leaves the band of its length, or if more
than a share of its full chunks leave the chunk band: too low means repetitive, too high incompressible text.

Defined cases: a null or empty text has counts of zero, no ratio and fails the base rule; rows stay one to one,
equal rows give equal results, a null doc_id is carried; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import common

LEVEL = 3
#: (bytes below which the band holds, lowest ratio, highest ratio); the frame's own bytes weigh on short texts.
#: Texts of 20 words or more of documents at sf0.1 reach at most 0.91, 0.75, 0.70, 0.60, 0.53, 0.46 and 0.42 from the second band on,
#: chunks 0.49; base64 of random bytes in words of 60 characters has 0.85 up to 512 bytes, 0.79 up to 1 KB, 0.75 above.
BANDS = ((128, 0.15, 2.0), (256, 0.30, 1.0), (512, 0.30, 0.82), (1024, 0.28, 0.76), (2048, 0.28, 0.70), (8192, 0.24, 0.68), (32768, 0.20, 0.66), (1 << 62, 0.17, 0.66))
CHUNK_BYTES, CHUNK_LOW, CHUNK_HIGH, CHUNK_SHARE = 4096, 0.25, 0.70, 0.34
_PACK = zstandard.ZstdCompressor(level=LEVEL)
SYMBOLS = "#*$%&|<>"
_SYMBOLS = [x.encode() for x in SYMBOLS]
_ODD = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(1, 9)], np.uint64)


def repeat_words(words: list, window: int = 8) -> int:
    """Words inside a window that is found twice or more in the list, its first place included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict = {}
    number = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    if len(ids) == len(words):
        return 0
    number = common.mixed(number)
    name = number[:n] * _ODD[0]
    for i in range(1, window):
        name = common.mixed(name) + number[i : i + n] * _ODD[i] if i == 4 else name + number[i : i + n] * _ODD[i]
    order = np.argsort(name)
    again = name[order][1:] == name[order][:-1]
    if not again.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][again]] = True
    twice[order[:-1][again]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines that hold a word and equal an earlier line."""
    seen: set = set()
    found = 0
    for line in text.split("\n"):
        if line in seen:
            found += 1
        elif line and line.strip(" \t\x0b\x0c\r"):
            seen.add(line)
    return found


def ratios(raw: bytes) -> tuple[float | None, list[float]]:
    """Of the whole text, and of its full chunks."""
    if not raw:
        return None, []
    return len(_PACK.compress(raw)) / len(raw), [len(_PACK.compress(raw[i : i + CHUNK_BYTES])) / CHUNK_BYTES for i in range(0, len(raw) - CHUNK_BYTES + 1, CHUNK_BYTES)]


def verdict(n_bytes: int, whole: float | None, chunks: list[float]) -> bool:
    if whole is None:
        return False
    low, high = next((a, b) for most, a, b in BANDS if n_bytes < most)
    odd = sum(not CHUNK_LOW <= x <= CHUNK_HIGH for x in chunks)
    return low <= whole <= high and odd <= CHUNK_SHARE * len(chunks)


def quality_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio, n_chunks, n_odd_chunks, base_failed, kept)."""
    common.small_batches(docs.sparkSession)
    kind = pa.schema([("doc_id", pa.int64()), *((x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("ratio", pa.float64()), ("n_chunks", pa.int64()), ("n_odd_chunks", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())])

    def one(text: str | None) -> tuple:
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        n = len(words)
        repeated = repeat_words(words)
        base_failed = n < 20 or 100 * repeated > 30 * n
        whole, chunks = ratios(raw)
        odd = sum(not CHUNK_LOW <= x <= CHUNK_HIGH for x in chunks)
        return n, len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")), sum(raw.count(x) for x in _SYMBOLS), duplicate_lines(text), repeated, whole, len(chunks), odd, base_failed, not base_failed and verdict(len(raw), whole, chunks)

    def run(parts):
        for part in parts:
            rows = [one(x) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types[1:], strict=True))] if rows else [pa.array([], t) for t in kind.types], schema=kind)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, n_chunks long, n_odd_chunks long, base_failed boolean, kept boolean")
