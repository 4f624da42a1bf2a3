"""Exact substring deduplication by a blockwise suffix array with a difference-cover sample.

Every byte covered by a string of 100 bytes that also starts earlier goes. Equal strings share their anchor (anchors.py), so
a text's windows are dealt by anchor, a block of neighbouring windows at a time. Blocks with an equal block are interned:
their windows are each other's copies. An anchor with different blocks needs order among their suffixes: the bytes of those
blocks form texts of about a megabyte, and of each one the suffix array is built one bucket at a time. A bucket is sorted by
COVER bytes; longer ties are resolved by the ranks of a difference-cover sample, which are computed beforehand and reach
past the window. So memory is bounded by the text, the sample's ranks and one bucket.

An anchor behind which very many different blocks meet is dealt again by the windows' own bytes, and sorted by Spark.
"""

from __future__ import annotations

import hashlib
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import anchors
from folioflow.llm.anchors import WINDOW
from folioflow.llm.common import cores, doc_bytes, documents, input_mb, lean, materialise, tuned
from folioflow.llm.shingles import mix

#: The period of the difference cover, and its root: {0..ROOT-1} and the multiples of ROOT have every difference.
COVER, ROOT = 32, 8
#: Bytes of a text whose suffixes are sorted together, suffixes of a bucket, and blocks of an anchor from which it is dealt again.
TEXT, BUCKET, HOT = 1 << 20, 1 << 16, 4_096
#: Times that a batch repeats a block from which its task knows it in later batches too, and blocks known at most.
OFTEN, KNOWN = 4, 50_000

_SAMPLE = np.array(sorted({*range(ROOT), *range(0, COVER, ROOT)}))
#: Bit d of _SHIFTS[r] says that r + d falls on the sample.
_SHIFTS = np.array([sum(1 << d for d in range(COVER) if (r + d) % COVER in set(_SAMPLE.tolist())) for r in range(COVER)], np.uint64)


def sample_ranks(words: np.ndarray, n: int) -> np.ndarray:
    """Ranks of the sample's suffixes among each other, by 4 * COVER bytes, at their places (elsewhere 0).

    words[p] holds the 8 bytes from p. Places p and p + COVER are both in the sample, so ranks by COVER bytes double.
    """
    at = (np.arange(0, n + COVER, COVER)[:, None] + _SAMPLE).ravel()
    at = at[at < n]
    rank = np.zeros(n + 4 * COVER, np.int64)
    order = np.lexsort([words[at + k] for k in range(COVER - 8, -1, -8)])
    keys = [words[at + k][order] for k in range(0, COVER, 8)]
    rank[at[order]] = 1 + np.cumsum(np.r_[0, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
    for reach in (COVER, 2 * COVER):
        first, second = rank[at], rank[at + reach]
        order = np.lexsort([second, first])
        first, second = first[order], second[order]
        rank[at[order]] = 1 + np.cumsum(np.r_[0, (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
    return rank


def sort_bucket(places: np.ndarray, words: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in order of their suffixes, and whether each ties with the one before by COVER bytes."""
    order = np.lexsort([words[places + k] for k in range(COVER - 8, -1, -8)])
    places = places[order]
    tied = np.zeros(len(places), bool)
    tied[1:] = np.logical_and.reduce([words[places[1:] + k] == words[places[:-1] + k] for k in range(0, COVER, 8)])
    run = np.cumsum(~tied) - 1
    in_tie = tied.copy()
    in_tie[:-1] |= tied[1:]
    at = np.flatnonzero(in_tie)
    if not len(at):
        return places, tied
    group = run[at]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    shifts = np.bitwise_and.reduceat(_SHIFTS[places[at] % COVER], starts)  # shifts that bring all of a tie to the sample
    size = np.diff(np.r_[starts, len(at)])
    shift = np.repeat(np.log2((shifts & (~shifts + np.uint64(1))).astype(np.float64).clip(1)).astype(np.int64), size)
    places[at] = places[at][np.lexsort([rank[places[at] + shift], group])]
    for k in np.flatnonzero(shifts == 0):  # no shift suits all: pairs have one each
        own = at[starts[k] : starts[k] + size[k]]

        def earlier(a, b):
            both = int(_SHIFTS[a % COVER] & _SHIFTS[b % COVER])
            d = (both & -both).bit_length() - 1
            return int(rank[a + d]) - int(rank[b + d])

        places[own] = sorted(places[own].tolist(), key=cmp_to_key(earlier))
    return places, tied


def repeated(blocks: list[bytes], doc: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans (doc, start, stop) of windows in blocks that also start earlier in one of them.

    blocks[k] is the text from start[k] of doc[k] on, up to the end of its last window.
    """
    ends = np.cumsum([len(b) for b in blocks])
    n = int(ends[-1])
    raw = np.frombuffer(b"".join(blocks) + bytes(4 * COVER + 8), np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(raw, 8).copy().view(">u8").ravel().astype(np.uint64)
    first = np.r_[0, ends[:-1]]
    sizes = ends - first - WINDOW + 1
    block = np.repeat(np.arange(len(blocks)), sizes)
    shift = np.arange(len(block)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    places = first[block] + shift
    window = np.full(n, -1, np.int64)
    window[places] = np.arange(len(places))
    of, at = doc[block], start[block] + shift
    rank = sample_ranks(words, n)
    heads = words[places]
    n_buckets = -(-len(places) // BUCKET)
    bounds = np.unique(np.sort(heads)[BUCKET::BUCKET]) if n_buckets > 1 else heads[:0]
    bucket = np.searchsorted(bounds, heads, side="right")
    removed = np.zeros(len(places), bool)
    for b in range(len(bounds) + 1):  # one suffix bucket at a time
        mine = places[bucket == b]
        if len(mine) < 2:
            continue
        sa, tied = sort_bucket(mine, words, rank)
        same = tied.copy()
        for k in (*range(COVER, WINDOW - 8, 8), WINDOW - 8):
            left = np.flatnonzero(same)
            same[left] = words[sa[left] + k] == words[sa[left - 1] + k]
        run = np.cumsum(~same)
        w = window[sa]
        order = np.lexsort([at[w], of[w], run])
        w, run = w[order], run[order]
        head = np.maximum.accumulate(np.where(np.r_[True, run[1:] != run[:-1]], np.arange(len(w)), 0))
        removed[w] = (of[w] != of[w[head]]) | (at[w] != at[w[head]])
    return _spans(of[removed], at[removed])


def _spans(doc: np.ndarray, at: np.ndarray, size: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Windows (doc, at), or blocks of size windows, joined to spans of bytes."""
    if not len(doc):
        return []
    stop = at + WINDOW - 1 + (1 if size is None else size)
    order = np.lexsort([at, doc])
    doc, at, stop = doc[order], at[order], stop[order]
    reach = np.maximum.accumulate(stop) if (doc == doc[0]).all() else None
    if reach is None:
        reach = stop.copy()
        cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            np.maximum.accumulate(reach[lo:hi], out=reach[lo:hi])
    new = np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] > reach[:-1])]
    firsts = np.flatnonzero(new)
    lasts = np.r_[firsts[1:], len(doc)] - 1
    return list(zip(doc[firsts].tolist(), at[firsts].tolist(), reach[lasts].tolist(), strict=True))


def _rows(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def find_blocks(docs: DataFrame) -> DataFrame:
    """key, block, doc, at of all blocks: the anchor's hash, the content's hash, the document, and first window * 256 + windows - 1.

    Of blocks alike within a batch, and of common ones within a task, only those go on that are earlier than any before; the
    others' bytes are spans already: rows with at = -1 - start and block = stop, under a key of their own.
    """

    def run(batches):
        known: dict[tuple[int, int], tuple[int, int]] = {}  # (key, block) that are common: the earliest (doc, at) so far
        for batch in batches:
            ids = batch.column(0).to_numpy()
            k, first, size, anchor, content = anchors.read(batch.column(1).to_pylist())
            if not len(k):
                continue
            doc, at = ids[k], first << 8 | size - 1
            order = np.lexsort([at, doc, content, anchor])
            doc, at, key, block = doc[order], at[order], anchor.view(np.int64)[order], content.view(np.int64)[order]
            alike = np.r_[False, (key[1:] == key[:-1]) & (block[1:] == block[:-1])]
            again = alike & np.r_[False, (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])]
            head = np.maximum.accumulate(np.where(alike, 0, np.arange(len(doc))))
            gone = alike & ((doc != doc[head]) | (at != at[head]))
            keep = ~alike & ~again
            if known:
                for i in np.flatnonzero(keep & np.isin(block, np.fromiter((b for _, b in known), np.int64, len(known)))).tolist():
                    own, mine = (int(key[i]), int(block[i])), (int(doc[i]), int(at[i]))
                    before = known.get(own)
                    if before is not None and mine < before:
                        known[own] = mine
                    elif before is not None:
                        keep[i], gone[i] = False, mine != before
            if len(known) < KNOWN:
                often = np.flatnonzero(np.bincount(head, minlength=len(doc)) >= OFTEN)
                for i in often[: KNOWN - len(known)].tolist():
                    known.setdefault((int(key[i]), int(block[i])), (int(doc[i]), int(at[i])))
            spans = _spans(doc[gone], at[gone] >> 8, (at[gone] & 255) + 1)
            names = ["key", "block", "doc", "at"]
            yield _rows(names, key[keep], block[keep], doc[keep], at[keep])
            if spans:
                d, a, z = (np.array(c, np.int64) for c in zip(*spans, strict=True))
                yield _rows(names, mix(d.view(np.uint64) + a.view(np.uint64)).view(np.int64), z, d, -1 - a)

    rows = doc_bytes(docs).where(F.col("doc_id").isNotNull())
    return rows.mapInArrow(lean(run), "key long, block long, doc long, at long")


def _resolve(batches):
    """From sorted blocks: spans of those that have an earlier equal (kind 0: start, stop), and the first of each kind of block
    where an anchor has several (kind 1: start, windows)."""
    names = ["kind", "doc", "start", "stop", "key"]
    last, waiting = None, None
    for batch in batches:
        rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
        spans = rows[rows[:, 3] < 0]
        if len(spans):
            yield _rows(names, np.zeros(len(spans)), spans[:, 2], -1 - spans[:, 3], spans[:, 1], np.zeros(len(spans)))
        rows = rows[rows[:, 3] >= 0]
        if not len(rows):
            continue
        before = np.concatenate([[last if last is not None else rows[0] ^ 1], rows[:-1]])
        last = rows[-1]
        new_key = rows[:, 0] != before[:, 0]
        first = new_key | (rows[:, 1] != before[:, 1])
        gone = rows[~first & ((rows[:, 2] != before[:, 2]) | (rows[:, 3] != before[:, 3]))]
        run = np.cumsum(new_key) - (1 if new_key[0] else 0)
        kinds = np.bincount(run[first], minlength=run[-1] + 1)
        ask = first & (kinds[run] > 1)
        goes_on = not new_key[0]
        asked = []
        if goes_on and kinds[0]:
            ask |= first & (run == 0)
            if waiting is not None:
                asked.append(waiting[None])
                waiting = None
        if not goes_on or run[-1] > 0:
            waiting = rows[np.flatnonzero(new_key)[-1]] if kinds[-1] == 1 else None
        asked.append(rows[ask])
        asked = np.concatenate(asked)
        if len(gone):
            start = gone[:, 3] >> 8
            yield _rows(names, np.zeros(len(gone)), gone[:, 2], start, start + (gone[:, 3] & 255) + WINDOW, np.zeros(len(gone)))
        if len(asked):
            yield _rows(names, np.ones(len(asked)), asked[:, 2], asked[:, 3] >> 8, (asked[:, 3] & 255) + 1, asked[:, 0])


def _sort_texts(batches):
    """From blocks in order of their keys, spans; keys are gathered to texts of about TEXT bytes."""
    names = ["doc", "start", "stop"]
    blocks, docs, starts, size, last = [], [], [], 0, None

    def out():
        spans = repeated(blocks, np.array(docs), np.array(starts))
        blocks.clear(), docs.clear(), starts.clear()
        return _rows(names, *zip(*spans, strict=True)) if spans else None

    for batch in batches:
        for key, doc, start, text in zip(*(batch.column(k).to_pylist() for k in ("key", "doc", "start", "text")), strict=True):
            if key != last and size >= TEXT:
                if (rows := out()) is not None:
                    yield rows
                size = 0
            last = key
            blocks.append(text)
            docs.append(doc)
            starts.append(start)
            size += len(text)
    if blocks and (rows := out()) is not None:
        yield rows


def _sorted_windows(batches):
    """From windows in order of their bytes, then doc and start: spans of all but the first of equals."""
    last, head = None, None
    for batch in batches:
        doc, start = [], []
        for d, s, text in zip(*(batch.column(k).to_pylist() for k in ("doc", "start", "text")), strict=True):
            if text != last:
                last, head = text, (d, s)
            elif (d, s) != head:
                doc.append(d)
                start.append(s)
        if doc:
            yield _rows(["doc", "start", "stop"], *zip(*_spans(np.array(doc), np.array(start)), strict=True))


def spans_of(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """doc, start and stop of removed bytes; spans may overlap. texts: docs with doc_id and text among their columns, dealt by
    doc_id; the caller joins all their columns once more, so that Spark deals them out only once."""
    blocks = find_blocks(docs).repartition("key").sortWithinPartitions("key", "block", "doc", "at")
    mb = input_mb(docs)
    found = materialise(blocks.mapInArrow(lean(_resolve), "kind long, doc long, start long, stop long, key long"), "blocks", mb and 1.2 * mb, 2 * cores(docs.sparkSession))
    asked = found.where("kind = 1")
    hot = materialise(asked.groupBy("key").count().where(F.col("count") > HOT).select("key", F.lit(True).alias("hot")), "hot", mb and 0.1 * mb)
    asked = asked.join(hot, "key", "left").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("key", "start", "stop", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("_asked")).withColumnRenamed("doc_id", "_doc")

    def cut(batches):
        for batch in batches:
            ordinary, windows = [], {}
            for doc, text, asked in zip(*(batch.column(k).to_pylist() for k in ("_doc", "text", "_asked")), strict=True):
                text = text.encode() if isinstance(text, str) else text
                for a in asked:
                    s, n = a["start"], a["stop"]
                    if a["hot"]:
                        for k in range(s, s + n):
                            own = windows.setdefault(text[k : k + WINDOW], [])
                            own.append((doc, k))
                    else:
                        ordinary.append((0, a["key"], doc, s, 0, text[s : s + n + WINDOW - 1]))
            out, gone = ordinary, []
            for text, own in windows.items():  # of equal windows of a batch only the earliest goes on
                own.sort()
                out.append((1, int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True), *own[0], 0, text))
                gone += [x for x in own[1:] if x != own[0]]
            if gone:
                out += [(2, (d * 31 + a) % (1 << 62), d, a, z, b"") for d, a, z in _spans(*np.array(gone, np.int64).T)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["kind", "key", "doc", "start", "stop", "text"])

    met = texts.join(asked, F.col("doc_id") == F.col("_doc")).mapInArrow(lean(cut), "kind int, key long, doc long, start long, stop long, text binary")
    dealt = met.repartition("kind", "key").sortWithinPartitions("kind", "key", "text", "doc", "start")
    more = dealt.mapInArrow(lean(_sort_kinds), "doc long, start long, stop long")
    return found.where("kind = 0").select("doc", "start", "stop").unionByName(more)


def _sort_kinds(batches):
    """Each kind of dealt rows in its way; they come in order of kind."""
    waiting: list[pa.RecordBatch] = []

    def pieces():
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo:
                    yield int(kinds[lo]), batch.slice(lo, hi - lo)

    stream = pieces()

    def of(kind):
        """Pieces of one kind; the first of another waits."""
        while True:
            if waiting:
                k, piece = waiting[0]
                if k != kind:
                    return
                waiting.pop()
                yield piece
                continue
            item = next(stream, None)
            if item is None:
                return
            waiting.append(item)

    yield from _sort_texts(of(0))
    yield from _sorted_windows(of(1))
    for piece in of(2):
        yield pa.RecordBatch.from_arrays([piece.column(k) for k in ("doc", "start", "stop")], names=["doc", "start", "stop"])


def _joined(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[list[int]] = []
    for a, z in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _with_spans(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """All columns of texts, and `_spans`. Rows without doc_id take no part and stay where they are."""
    tuned(docs.sparkSession)
    named, others = texts.where(F.col("doc_id").isNotNull()).repartition("doc_id"), texts.where(F.col("doc_id").isNull())
    spans = spans_of(docs, named).groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("start", "stop")).alias("_spans"))
    met = named.join(spans, F.col("doc_id") == F.col("_doc"), "left")
    return met.unionByName(others.withColumns({"_doc": F.lit(None).cast("long"), "_spans": F.lit(None).cast(met.schema["_spans"].dataType)}))


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document, and the removed spans.

    A null text is empty. Texts of fewer than 100 bytes keep all. Rows that repeat a doc_id with the same text are one
    document and get the same result; a document without doc_id keeps all and counts for no other. An empty table gives no
    rows; other columns are ignored. Texts are read whole, in pieces.
    """

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, spans in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "_spans")), strict=True):
                gone = _joined(spans)
                kept, at = hashlib.sha256(), 0
                for a, z in gone:
                    kept.update(text[at:a])
                    at = z
                kept.update(text[at:])
                out.append((doc, len(text), sum(z - a for a, z in gone), len(gone), kept.hexdigest(), [{"start": a, "stop": z} for a, z in gone]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return _with_spans(docs, doc_bytes(docs)).mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, stop: long>>")


def deduplicated_texts(docs: DataFrame) -> DataFrame:
    """The rows of docs with what is left of their texts. Spans shrink to whole characters; a text that loses all is empty,
    and a null text stays null."""

    def shorten(text: str, spans) -> str:
        raw, out, at = text.encode(), [], 0
        for a, z in _joined(spans):
            while a < z and raw[a] & 0xC0 == 0x80:
                a += 1
            while z > a and z < len(raw) and raw[z] & 0xC0 == 0x80:
                z -= 1
            out.append(raw[at:a])
            at = z
        return b"".join([*out, raw[at:]]).decode()

    def run(batches):
        for batch in batches:
            texts = [shorten(t, s) if s else t for t, s in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist(), strict=True)]
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, "text", pa.array(texts, pa.string())).drop_columns(["_doc", "_spans"])

    return _with_spans(docs, docs).mapInArrow(lean(run), docs.schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(documents(spark, sf_dir)).drop("spans")
