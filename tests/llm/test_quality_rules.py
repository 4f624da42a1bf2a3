import random
import re
from collections import Counter

import zstandard

from cases import frame, texts, words
from folioflow.llm.quality_rules import assess

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_measures_against_plain_loops(spark):
    made = texts() + ["one two three four five six " * 20, "line a\nline a\n\nline a\n \n b", "a b c d e f a b c d e", "## $5 <b> 100% & |"]
    got = {r.doc_id: r for r in assess(frame(spark, enumerate(made))).collect()}
    for i, t in enumerate(made):
        want = base(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(t)
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_bands_reject_noise_and_loops_and_keep_prose(spark):
    rng = random.Random(1)
    noise = " ".join("".join(chr(rng.randint(33, 126)) for _ in range(rng.randint(3, 9))) for _ in range(2000))
    loop = " ".join(f"w{i % 7}x{i % 11}q{i % 13}" for i in range(3000))
    got = {r.doc_id: r.kept for r in assess(frame(spark, [(0, noise), (1, loop), (2, texts()[-1])])).collect()}
    assert got == {0: False, 1: False, 2: True}


def test_tail_after_the_last_full_chunk_is_judged(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    prose = " ".join(rng.choice(vocabulary) for _ in range(3000))
    tail = "".join(f"buy now cheap {k}\n" for k in range(400))[:4090]
    made = [prose[:4096] + tail, prose[:8186], prose[:4096], prose[:4095], prose[:4096] + tail[:1]]
    got = {r.doc_id: r for r in assess(frame(spark, enumerate(made))).collect()}
    assert not got[0].base_failed and 0.27 <= got[0].ratio <= 0.74
    assert [(got[k].n_chunks, got[k].bad_chunks, got[k].kept) for k in range(5)] == [(2, 1, False), (2, 0, True), (1, 0, True), (0, 0, True), (2, 0, True)]


def verdict(text):
    """By the rules' own words: the band of the text's length, then a third of its 4 KB chunks, the last one ending with it."""
    raw, limits = (text or "").encode(), {0: (0.36, 9.0), 200: (0.34, 0.95), 500: (0.32, 0.85), 1000: (0.30, 0.78), 4000: (0.27, 0.74), 20000: (0.24, 0.72), 100000: (0.20, 0.72)}
    ratio = lambda b: len(zstandard.ZstdCompressor(level=3).compress(b)) / len(b)
    n_words, _, _, _, n_repeat = base(text)
    if n_words < 10 or 100 * n_repeat > 20 * n_words:
        return False
    low, high = limits[max(n for n in limits if n <= len(raw))]
    chunks, at = [], 0
    while at + 4096 <= len(raw):
        chunks.append(raw[at : at + 4096])
        at += 4096
    if chunks and at < len(raw):
        chunks.append(raw[-4096:])
    bad = [c for c in chunks if ratio(c) < 0.27 or ratio(c) > 0.74]
    return low <= ratio(raw) <= high and len(bad) <= 0.34 * len(chunks)


def test_verdicts_against_plain_loops(spark):
    rng = random.Random(11)
    noise = lambda n: " ".join("".join(chr(rng.randint(33, 126)) for _ in range(7)) for _ in range(n))
    loop = lambda n: " ".join(f"w{i % 7}x{i % 11}q{i % 13}" for i in range(n))
    prose = lambda n: words(rng, n)
    made = texts()
    for n in (12, 40, 150, 700, 3000, 20000):
        parts = [noise(n), loop(n), prose(n)]
        made += [*parts, f"{parts[2]} {parts[0]}", f"{parts[2]} {parts[1]}", f"{parts[2]} {parts[2]}"]
    got = {r.doc_id: r.kept for r in assess(frame(spark, enumerate(made))).collect()}
    want = {i: verdict(t) for i, t in enumerate(made)}
    assert got == want and len(set(want.values())) == 2


def test_no_rows_and_repeated_rows(spark):
    assert assess(frame(spark, [])).collect() == []
    assert len(assess(frame(spark, [(1, "a b")] * 3)).collect()) == 3
