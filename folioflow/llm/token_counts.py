"""Token counts by a map-side two-tier lookup: no pre-token is shuffled.

Tier one is a broadcast table from frequent pre-tokens to their numbers of tokens; tier two is a cache in each Python
worker, filled by encoding the misses of a batch together.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import Bounded, documents, doc_bytes, held, lean, tokenizer_path, tuned

#: Documents that the frequent table is learned from, about, whatever the corpus; the commonest pre-tokens of each that count;
#: and the table's size. The table only saves time: counts are exact without it.
SAMPLE_DOCS, PER_DOC, TABLE = 2_000, 512, 16_384
#: Bytes of a worker's cache, and longest pre-token that it keeps.
CACHE_BYTES, CACHE_KEY_BYTES = 32 << 20, 64
_SPACE = "\N{LOWER ONE EIGHTH BLOCK}".encode()
#: A run of spaces with what follows it, or a line end with what follows it.
_SEGMENT = re.compile(rb" +[^ \n]*|\n[^ \n]*")


def _load(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    mark = _SPACE.decode()
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(mark in p.lstrip(mark) or "\n" in p for p in pieces):
        raise ValueError("tokens of this vocabulary cross white space; pre-tokens can't be counted one by one")
    return model


def _kept(path: str) -> tuple:
    """This worker's model and cache."""
    return held(f"token counts {path}", lambda: (_load(path), Bounded(CACHE_BYTES)))


def segments(text: bytes) -> list[bytes]:
    """The pre-tokens of a text, as keys: no token crosses the start of a run of spaces, or a line end.

    A key that starts with a line end stands for itself; any other has one space in front, which the library adds.
    """
    text = text.replace(_SPACE, b" ")
    keys = text.replace(b"\n", b" \n").split(b" ")
    if b"" in keys:  # runs of spaces, or spaces at an end
        keys = [s if s[:1] == b"\n" else s[1:] for s in _SEGMENT.findall(b" " + text)] if text else []
    return keys


def lengths(keys: list[bytes], path: str) -> list[int]:
    """Tokens of each key. The lone space before a line end that the library adds doesn't count."""
    encoded = _kept(path)[0].encode([k.decode("utf-8", "replace") for k in keys], num_threads=1)
    return [len(ids) - 1 if k[:1] == b"\n" else len(ids) or 1 for k, ids in zip(keys, encoded, strict=True)]


def count_tokens(docs: DataFrame, limit: int = 4096, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each document.

    A null or empty text has 0 tokens. Every row is counted, repeated ones too; an empty table gives no rows; other columns
    are ignored. Texts count whole, whatever their length.
    """
    spark = tuned(docs.sparkSession)
    path = path or tokenizer_path("piece_bpe_32k.model")
    texts = doc_bytes(docs)
    table = spark.sparkContext.broadcast(frequent(texts, path))

    def run(batches):
        first, cache = table.value, _kept(path)[1]
        for batch in batches:
            cache.tidy()
            texts = batch.column(1).to_pylist()
            keys = [segments(t) for t in texts]
            sums, waiting = [], []
            for k in keys:
                found = list(map(first.get, k))
                if None in found:
                    misses = [w for w, n in zip(k, found, strict=True) if n is None]
                    again = list(map(cache.get, misses))
                    unseen = [w for w, n in zip(misses, again, strict=True) if n is None]
                    waiting.append(unseen)
                    sums.append(sum(n for n in found if n is not None) + sum(n for n in again if n is not None))
                else:
                    waiting.append(())
                    sums.append(sum(found))
            new = list({w for ws in waiting for w in ws})
            if new:
                known = dict(zip(new, lengths(new, path), strict=True))
                sums = [n + sum(map(known.__getitem__, ws)) for n, ws in zip(sums, waiting, strict=True)]
                for w, n in known.items():
                    if len(w) <= CACHE_KEY_BYTES:
                        cache.learn(w, n, len(w))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(sums, pa.int64()), pa.array([n > limit for n in sums])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def frequent(texts: DataFrame, path: str) -> dict[bytes, int]:
    """The commonest pre-tokens of about SAMPLE_DOCS rows, with their numbers of tokens. Rows are drawn one by one, whatever
    their doc_id, so alike and null ids don't come together."""
    drawn = texts.where(F.rand(3) < SAMPLE_DOCS / max(texts.count(), 1))

    def count(batches):
        for batch in batches:
            for t in batch.column(1).to_pylist():
                top = [(k, c) for k, c in Counter(segments(t)).most_common(PER_DOC) if len(k) <= CACHE_KEY_BYTES]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.binary()), pa.array([c for _, c in top], pa.int64())], names=["key", "n"])

    counted = drawn.mapInArrow(lean(count), "key binary, n long").toArrow()  # at most about SAMPLE_DOCS * PER_DOC rows
    if not counted.num_rows:
        return {}
    total = counted.group_by("key").aggregate([("n", "sum")]).sort_by([("n_sum", "descending"), ("key", "ascending")])
    keys = total["key"][:TABLE].to_pylist()
    return dict(zip(keys, lengths(keys, path), strict=True))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
