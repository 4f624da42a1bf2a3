import hashlib
import random

import numpy as np

from cases import ODD, frame, words
from folioflow.llm import suffix_dedup
from folioflow.llm.suffix_dedup import deduplicate, deduplicated_texts, repeated

WINDOW = 100


def brute(rows):
    """By a table of all windows."""
    first, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - WINDOW + 1):
            w = raw[i : i + WINDOW]
            if first.setdefault(w, (doc, i)) != (doc, i):
                gone[i : i + WINDOW] = b"\1" * WINDOW
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(g and not gone[i - 1] if i else g for i, g in enumerate(gone))
        out[doc] = (len(raw), sum(gone), int(runs), hashlib.sha256(kept).hexdigest())
    return out


def corpus(rng):
    out = list(ODD)
    shared = [words(rng, n) for n in (18, 25, 40, 90, 300)]
    for _ in range(25):
        parts = [words(rng, rng.randint(0, 50)) for _ in range(3)]
        out.append(rng.choice(shared).join(parts) if rng.random() < 0.7 else " ".join(parts))
    out += [out[-1], out[-1], out[-2][:250], "ab" * 200, "ab" * 150 + "c", "x" * 99, "x" * 100, "x" * 101, "é" * 80 + "x" * 50, "é" * 80 + "y" * 50]
    edited = list(shared[4])
    for _ in range(9):
        edited[rng.randrange(len(edited))] = "#"
        out.append("".join(edited))
    rng.shuffle(out)
    return list(enumerate(out, 10))


def test_equals_a_table_of_all_windows(spark, monkeypatch):
    for seed, hot, text in ((1, 4096, 1 << 20), (2, 1, 300)):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        monkeypatch.setattr(suffix_dedup, "TEXT", text)
        rows = corpus(random.Random(seed))
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in deduplicate(frame(spark, rows)).collect()}
        assert got == brute(rows)


def test_no_rows_and_repeated_rows(spark):
    assert deduplicate(frame(spark, [])).collect() == []
    text = words(random.Random(4), 60)
    got = deduplicate(frame(spark, [(1, text), (1, text), (2, text), (None, text)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 0), (1, 0), (2, len(text))]


def test_texts_keep_whole_characters(spark):
    base = words(random.Random(8), 40)
    rows = [(0, f"{base}é!"), (1, f"ab{base}êcd"), (2, None)]  # é and ê share their first byte
    docs = frame(spark, rows)
    got = {r.doc_id: r.text for r in deduplicated_texts(docs).collect()}
    assert got == {0: f"{base}é!", 1: "abêcd", 2: None} and deduplicated_texts(docs).columns == docs.columns


def test_the_suffix_array_alone(monkeypatch):
    """Few letters, so that ties run past the cover and need every kind of shift; small buckets."""
    rng = random.Random(5)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 50)
    for alphabet in ("a", "ab", "abcd"):
        blocks = ["".join(rng.choice(alphabet) for _ in range(rng.randint(100, 180))) for _ in range(30)]
        blocks += [b[k:] + b[:k] for b in blocks[:10] for k in (3, 31)] + [("ab" * 100)[k : k + 150] for k in range(9)] + [blocks[0]] * 3
        rows = [b.encode() for b in blocks]
        seen, want = {}, np.zeros((len(rows), 200), bool)
        for d, b in enumerate(rows):
            for i in range(len(b) - WINDOW + 1):
                if seen.setdefault(b[i : i + WINDOW], (d, i)) != (d, i):
                    want[d, i : i + WINDOW] = True
        got = np.zeros_like(want)
        for d, a, z in repeated(rows, np.arange(len(rows)), np.zeros(len(rows), np.int64)):
            got[d, a:z] = True
        assert (got == want).all()
