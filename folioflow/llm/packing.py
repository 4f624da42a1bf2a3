"""Best-fit packing by exact-complement hashing: combinations of one, two or three pieces that fill a gap exactly are found in
an index by their sum, and consumed in bulk under counts of what is available; what is left is packed best fit.

Documents become token pieces of at most `capacity` ids. Which sequence a piece goes to depends on its length alone and on
its rank among the pieces of that length, so the plan is made from the histogram of lengths (at most `capacity` numbers,
whatever the corpus) and is applied to the pieces in parallel: no text is shuffled, no group of pieces is gathered.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import Bounded, documents, doc_bytes, held, input_mb, lean, materialise, tokenizer_path, tuned

CAPACITY = 2048
#: Bytes of a worker's caches from white-space-free chunks, and from words, to their ids; longest chunk that is kept.
CACHE_BYTES, WORD_BYTES, CACHE_KEY_BYTES = 64 << 20, 8 << 20, 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk int, rank long"


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _units() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary: itself where it prints, else the next free one from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(own)))}


_UNITS = _units()
#: Chunks of printing ASCII and Latin-1 letters: lower case and composition change each character by itself there.
_PLAIN = re.compile(r"[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_STOPS = frozenset([b",", b".", b"!", b"?", b";", b":"])
#: The vocabulary's own pattern (a fixed value), over such chunks.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^0-9a-z\xdf-\xf6\xf8-\xff]+")


def _chunk_ids(chunks: list[bytes], tok, words: Bounded) -> dict[bytes, bytes]:
    """Plain chunks word by word, through a cache of words; all others by the library as they are."""
    out, other = {}, []
    tokenize = tok.model.tokenize

    def ids_of(word: bytes) -> bytes:
        found = words.get(word)
        if found is None:
            ids = [t.id for t in tokenize(word.decode() if word.isascii() else "".join(map(_UNITS.__getitem__, word)))]
            found = pack_ids(f"<{len(ids)}I", *ids)
            if len(word) <= CACHE_KEY_BYTES:
                words.learn(word, found, len(word) + len(found))
        return found

    for chunk in chunks:
        low = chunk.lower()
        if low.isalpha():
            out[chunk] = ids_of(low)
        elif low[:-1].isalpha() and low[-1:] in _STOPS:
            out[chunk] = ids_of(low[:-1]) + ids_of(low[-1:])
        else:
            text = chunk.decode("utf-8", "replace")
            if _PLAIN.fullmatch(text) and "<|" not in text:
                out[chunk] = b"".join([ids_of(w.encode()) for w in _WORDS.findall(text.lower())])
            else:
                other.append((chunk, text))
    for k in range(0, len(other), 512):
        part = other[k : k + 512]
        for (chunk, _), e in zip(part, tok.encode_batch_fast([text for _, text in part], add_special_tokens=False), strict=True):
            out[chunk] = np.array(e.ids, "<u4").tobytes()
    return out


def encode(texts: list[bytes], path: str) -> list[bytes]:
    """Each text's ids as little-endian 32-bit numbers.

    The vocabulary drops white space, so no token, and no normalisation, crosses it: the ids of a text are those of its
    white-space-free chunks in order, and a worker keeps the ids of the chunks and of the words that it has seen.
    """
    tok, cache, words = held(f"packing {path}", lambda: (_tokenizer(path), Bounded(CACHE_BYTES), Bounded(WORD_BYTES)))
    cache.tidy()
    words.tidy()
    chunks = [t.split() for t in texts]
    new = _chunk_ids(list(set().union(*chunks).difference(cache)), tok, words)
    long = {}
    for w, ids in new.items():
        if len(w) <= CACHE_KEY_BYTES:
            cache.learn(w, ids, len(w) + len(ids))
        else:
            long[w] = ids
    if long:
        return [b"".join([long[w] if w in long else cache[w] for w in c]) for c in chunks]
    return [b"".join(map(cache.__getitem__, c)) for c in chunks]


def cut(docs: DataFrame, capacity: int, path: str, end_id: int = 0) -> DataFrame:
    """The pieces of all documents, each with its rank among the pieces of its length within its chunk (task)."""

    def run(batches):
        chunk, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist(), path), strict=True):
                ids += end
                total = len(ids) // 4
                for piece, start in enumerate(range(0, total, capacity)):
                    n = min(capacity, total - start)
                    rows.append((doc, piece, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), chunk, int(seen[n])))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = [x.split()[0] for x in PIECES.split(", ")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return doc_bytes(docs).mapInArrow(run, PIECES)


@dataclass
class Plan:
    """For pieces of `length` with ranks from `first` on: sequence `sequence` + (rank - first), at `offset`."""

    sequences: int = 0
    slots: list[tuple[int, int, int, int]] = field(default_factory=list)  # length, first, sequence, offset
    used: dict[int, int] = field(default_factory=dict)

    def place(self, length: int, times: int, sequence: int, offset: int) -> None:
        first = self.used.get(length, 0)
        self.slots.append((length, first, sequence, offset))
        self.used[length] = first + times


class Sums:
    """An index from a sum to the single lengths, pairs and triples of available lengths that make it.

    Pairs lie in a table sorted by their sum, with the first that may still be good for each; of triples, a sum has the
    first members whose rest may still be a pair. Availability only falls, so what has run out is passed over for good.
    """

    def __init__(self, free: np.ndarray):
        self.free, capacity = free, len(free) - 1
        have = np.flatnonzero(free)
        big, small = np.concatenate([np.stack([np.full(k + 1, x), have[: k + 1]]) for k, x in enumerate(have)] or [np.zeros((2, 0), np.int64)], axis=1)
        fits = big + small <= capacity
        big, small = big[fits], small[fits]
        order = np.lexsort([-big, big + small])  # the most unequal first
        self.big, self.small = big[order].tolist(), small[order].tolist()
        at = np.searchsorted((big + small)[order], np.arange(capacity + 2))
        self.at, self.end = at[:-1].tolist(), at[1:].tolist()
        self.firsts = have[::-1].tolist()
        self.third = [0] * (capacity + 1)

    def enough(self, *lengths: int) -> bool:
        return all(self.free[x] >= lengths.count(x) for x in lengths)

    def pair(self, total: int, *beside: int) -> tuple[int, int] | None:
        """Two lengths that sum to total and are there beside the others."""
        if total < 2:
            return None
        while self.at[total] < self.end[total] and not self.enough(self.big[self.at[total]], self.small[self.at[total]]):
            self.at[total] += 1
        for k in range(self.at[total], self.end[total]):
            two = self.big[k], self.small[k]
            if self.enough(*two, *beside):
                return two
        return None

    def complement(self, gap: int, length: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill gap exactly, beside one of `length`."""
        if self.enough(gap, length):
            return (gap,)
        if two := self.pair(gap, length):
            return two
        while self.third[gap] < len(self.firsts) and not (self.firsts[self.third[gap]] < gap and self.free[self.firsts[self.third[gap]]] and self.pair(gap - self.firsts[self.third[gap]])):
            self.third[gap] += 1
        for a in self.firsts[self.third[gap] :]:
            if 3 * a < gap:  # the largest of three is a third or more
                return None
            if a < gap and self.enough(a, length) and (rest := self.pair(gap - a, a, length)):
                return (a, *rest)
        return None


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Exact complements of one to three pieces first, then best fit for what is left; pieces of one length go in bulk."""
    left, out = np.zeros(capacity + 1, np.int64), Plan()
    for length, n in histogram.items():
        left[length] = n

    def open_bins(lengths: tuple[int, ...], times: int) -> int:
        at, offset = out.sequences, 0
        for x in lengths:
            out.place(x, times, at, offset)
            left[x] -= times
            offset += x
        out.sequences += times
        return at

    if left[capacity]:
        open_bins((capacity,), int(left[capacity]))
    index = Sums(left)
    for length in range(capacity - 1, 0, -1):
        while left[length] and (rest := index.complement(capacity - length, length)):
            whole = (length, *rest)
            open_bins(whole, int(min(left[x] // whole.count(x) for x in set(whole))))

    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: first sequence and number of alike bins
    for length in range(capacity, 0, -1):
        while left[length]:
            fit = min((g for g in gaps if g >= length), default=None)
            if fit is None:
                per = capacity // length
                times = int(left[length] // per)
                if not times:
                    per, times = int(left[length]), 1
                at = open_bins((length,) * per, times)
                if capacity - per * length:
                    gaps.setdefault(capacity - per * length, []).append((at, times))
                continue
            at, bins = gaps[fit].pop()
            times = int(min(bins, left[length]))
            if times < bins:
                gaps[fit].append((at + times, bins - times))
            if not gaps[fit]:
                del gaps[fit]
            out.place(length, times, at, capacity - fit)
            left[length] -= times
            if fit > length:
                gaps.setdefault(fit - length, []).append((at, times))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is its end token
    alone; longer documents are cut every `capacity` tokens; rows that repeat are packed once each; an empty table gives no
    rows; other columns are ignored. Ties between pieces of one length are broken by the task and place they were read at.
    """
    spark = tuned(docs.sparkSession)
    path = path or tokenizer_path("word_bpe_49k.json")
    pieces = materialise(cut(docs, capacity, path, end_id), "pieces")
    counts = pieces.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    mb = input_mb(docs)
    bases = materialise(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases", mb and 0.05 * mb)
    made = plan({r.length: r.n for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)  # one row a length
    slots = np.array(sorted(made.slots), np.int64).reshape(-1, 4)
    keys = slots[:, 0] << 48 | slots[:, 1]

    def assign(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            rank, length = t["rank"].to_numpy(), t["length"].to_numpy()
            at = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            t = t.drop_columns(["rank"]).append_column("sequence_id", pa.array(slots[at, 2] + rank - slots[at, 1])).append_column("offset", pa.array(slots[at, 3]))
            yield from t.to_batches()

    # a row of bases stands for a task's pieces of one length, so its table grows with the corpus: never broadcast
    ranked = pieces.join(bases.select("chunk", "length", "base").hint("merge"), ["chunk", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(lean(assign), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
