"""Quality rules with compression bands: zstandard ratios of whole documents and of fixed chunks."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from folioflow.llm.common import doc_bytes, documents, per_document, tuned

WINDOW, MIN_WORDS, MAX_REPEATED_PERCENT = 5, 10, 20
LEVEL, CHUNK = 3, 4096
#: From so many bytes on, the least and the largest ratio of compressed to plain bytes of ordinary prose. Headers weigh on
#: short texts, so they have no upper limit; longer texts repeat more of their words, so the lower limit falls.
BANDS = ((0, 0.36, 9.0), (200, 0.34, 0.95), (500, 0.32, 0.85), (1_000, 0.30, 0.78), (4_000, 0.27, 0.74), (20_000, 0.24, 0.72), (100_000, 0.20, 0.72))
#: The same for a chunk, and the share of chunks outside that rejects a document. A text that doesn't end with a chunk has
#: its final CHUNK bytes as one more.
CHUNK_BAND, BAD_CHUNKS = (0.27, 0.74), 0.34
SYMBOLS = [bytes([c]) for c in b"#*$%&|<>"]

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("bad_chunks", pa.int64()), ("n_chunks", pa.int64())])
DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks long, n_chunks long"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words that the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict = {}
    at = [seen.setdefault(w, i) for i, w in enumerate(zip(*(islice(words, k, None) for k in range(window)), strict=False))]
    if len(seen) == n:
        return 0
    first = np.array(at)
    again = first != np.arange(n)
    hit = again.copy()
    hit[first[again]] = True
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, np.nonzero(hit)[0], 1)
    np.add.at(steps, np.nonzero(hit)[0] + window, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.split(None, 1)]
    return len(lines) - len(set(lines))


def measure(text: bytes, zip_: zstandard.ZstdCompressor) -> tuple:
    words = text.split()
    raw = np.frombuffer(text, np.uint8)
    chars = len(raw) - int(((raw & 0xC0) == 0x80).sum())
    chars -= int(((raw == 0x20) | ((raw >= 9) & (raw <= 13))).sum())
    symbols, repeated = sum(map(text.count, SYMBOLS)), repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * len(words)
    ratio = len(zip_.compress(text)) / len(text) if text else 1.0
    starts = [*range(0, len(text) - CHUNK + 1, CHUNK)]
    if starts and len(text) % CHUNK:  # the tail, as the last chunk's worth of bytes
        starts.append(len(text) - CHUNK)
    n_chunks = len(starts)
    bad = sum(not CHUNK_BAND[0] <= len(zip_.compress(text[k : k + CHUNK])) / CHUNK <= CHUNK_BAND[1] for k in starts)
    low, high = next((lo, hi) for n, lo, hi in reversed(BANDS) if len(text) >= n)
    kept = not failed and low <= ratio <= high and (not n_chunks or bad <= BAD_CHUNKS * n_chunks)
    return len(words), chars, symbols, duplicate_lines(text), repeated, failed, kept, ratio, bad, n_chunks


def assess(docs: DataFrame) -> DataFrame:
    """The base measures of each document, whether they fail it, and whether the compression bands keep it.

    A null or empty text has no words and fails. Every row is judged by itself, repeated ones alike; an empty table gives
    no rows; other columns are ignored. Texts are read whole.
    """
    tuned(docs.sparkSession)

    def each(ids, texts):
        zip_ = zstandard.ZstdCompressor(level=LEVEL)
        columns = list(zip(*(measure(t, zip_) for t in texts), strict=True))
        return dict(zip(SCHEMA.names, [ids, *columns], strict=True))

    return doc_bytes(docs).mapInArrow(per_document(each, SCHEMA), DDL)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(documents(spark, sf_dir))
