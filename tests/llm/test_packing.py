import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from cases import frame, texts
from folioflow.llm.common import tokenizer_path
from folioflow.llm.packing import pack, plan


def whole(rows, capacity):
    """Sequences are gapless from 0 and never too long."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


def test_pieces_are_the_librarys_ids(spark):
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    made = texts()
    rows = pack(frame(spark, enumerate(made)), capacity=64).collect()
    got = {(r.doc_id, r.piece): r for r in rows}
    assert len(got) == len(rows)
    n = 0
    for i, t in enumerate(made):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for p, k in enumerate(range(0, len(ids), 64)):
            part = ids[k : k + 64]
            r = got[i, p]
            assert (r.start, r.length, r.ids_crc32) == (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())), repr(t)
            n += 1
    assert n == len(rows)
    assert whole(rows, 64) <= -(-sum(r.length for r in rows) // 64) * 1.1 + 2


def test_no_rows_and_repeated_rows(spark):
    assert pack(frame(spark, [])).collect() == []
    rows = pack(frame(spark, [(5, "same text")] * 9), capacity=8).collect()
    assert len(rows) == 9 and whole(rows, 8) == 5


def test_plan_places_each_piece_once_and_near_the_least():
    rng = random.Random(3)
    for capacity in (10, 97, 2048):
        for pull in (lambda c: rng.randint(1, c), lambda c: rng.choice([c // 3 + 1, c // 2 + 1, 2]), lambda c: min(c, int(rng.lognormvariate(4, 1)) + 1), lambda c: c // 3):
            h = {}
            for _ in range(5000):
                x = max(1, pull(capacity))
                h[x] = h.get(x, 0) + 1
            made = plan(h, capacity)
            fill, taken = {}, {}
            ends = sorted(made.slots)
            for k, (length, first, sequence, offset) in enumerate(ends):
                last = ends[k + 1][1] if k + 1 < len(ends) and ends[k + 1][0] == length else h[length]
                taken[length] = taken.get(length, 0) + last - first
                for s in range(last - first):
                    fill.setdefault(sequence + s, []).append((offset, length))
            assert taken == h
            for parts in fill.values():
                parts.sort()
                assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
                assert sum(n for _, n in parts) <= capacity
            assert len(fill) == made.sequences
            least = max(-(-sum(x * n for x, n in h.items()) // capacity), sum(n for x, n in h.items() if 2 * x > capacity))
            assert made.sequences <= least * 1.35 + 1
