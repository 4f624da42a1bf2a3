import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import zstandard

from cases import ODD, frame, texts, words
from folioflow.llm import quality_qda, toxicity


def labels(spark, rows, name):
    return spark.createDataFrame([(d, int(y)) for d, y in rows], f"doc_id long, {name} int")


def test_quality_tells_noise_from_prose_on_held_out_rows(spark):
    rng = random.Random(6)
    good = [words(rng, rng.choice([8, 40, 200])).capitalize() + "." for _ in range(240)]
    bad = [" ".join(w + "***" for w in words(rng, 40).split()) for _ in range(80)] + [(words(rng, 1) + " ") * 60 for _ in range(80)]
    texts = [(t, y) for y, ts in ((1, good), (0, bad)) for t in ts]
    rng.shuffle(texts)
    rows = [(k, t) for k, (t, _) in enumerate(texts)]
    odd = [(1000 + k, t) for k, t in enumerate(ODD)]
    got = {r.doc_id: r for r in quality_qda.score(frame(spark, rows + odd), labels(spark, [(k, y) for k, (_, y) in enumerate(texts)], "quality")).collect()}
    assert len(got) == len(rows) + len(odd)
    held = [k for k in got if zlib.crc32(str(k).encode()) % 3 == 1]
    assert {k for k, r in got.items() if r.held_out} == set(held)
    right = [got[k].predicted == texts[k][1] for k in held if k < 1000]
    assert np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_discriminant_equals_the_density_formula():
    rng = np.random.default_rng(1)
    d = len(quality_qda.STATISTICS)
    x = {0: rng.normal(0, 1, (300, d)), 1: rng.normal(1, 2, (500, d))}
    model = quality_qda.discriminant({c: (len(v), v.sum(axis=0), v.T @ v) for c, v in x.items()})
    logs, total = [], 800
    own = {c: np.cov(v.T, bias=True) for c, v in x.items()}
    pooled = sum(len(x[c]) * own[c] for c in x) / total
    scale = np.sqrt(np.diag(pooled))
    for c, v in x.items():
        cov = (0.8 * own[c] + 0.1 * pooled + 0.1 * np.diag(np.diag(pooled))) / np.outer(scale, scale) + 0.01 * np.eye(d)
        diff = (x[1][:5] - v.mean(axis=0)) / scale
        logs.append(np.log(len(v) / total) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("nd,nd->n", diff @ np.linalg.inv(cov), diff))
    assert np.allclose(model.probabilities(x[1][:5]), 1 / (1 + np.exp(logs[0] - logs[1])))


def plain_statistics(text):
    """Each statistic by its name, character by character."""
    raw = text.encode()
    w, lines = re.findall(rb"[^\x20\x09-\x0D]+", raw), raw.split(b"\n")
    n, m = len(raw), len(w)
    logit = lambda count, of: math.log((count + 0.5) / (of - count + 0.5))
    share = lambda count, of: logit(count / of * of, of)
    of_bytes = lambda members: share(sum(b in members for b in raw) * (n + 1) / (n + 1), n + 1)
    return {
        "bytes": math.log(n + 1),
        "words": math.log(m + 1),
        "word_length": math.log(n / (m + 1) + 1),
        "line_length": math.log(n / len(lines) + 1),
        "upper": of_bytes(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "digits": of_bytes(b"0123456789"),
        "symbols": of_bytes(b"#*$%&|<>~^_{}[]@="),
        "exclamation": of_bytes(b"!"),
        "other_punctuation": of_bytes(b"\"'(),-./:;?"),
        "non_ascii": of_bytes(bytes(range(128, 256))),
        "spaces": of_bytes(b"\t\n\x0b\x0c\r "),
        "distinct_words": share(len(set(w)), m + 1),
        "distinct_pairs": share(len({(a, b) for a, b in zip(w, w[1:], strict=False)}), m + 1),
        "duplicate_lines": share(len(lines) - len(set(lines)), len(lines)),
        "top_word": share(max(Counter(w).values(), default=0), m + 1),
        "one_letter": share(sum(len(x) == 1 for x in w), m + 1),
        "compression": math.log((len(zstandard.ZstdCompressor(level=3).compress(raw)) + 1) / (n + 1)),
    }


def test_statistics_against_plain_loops(spark):
    made = texts() + ["A! B? c, d; (e) 12 34 #$% {x}=y", "same\nsame\nother\nsame", "AB12" * 50]
    got = {r.doc_id: r.x for r in quality_qda.describe(frame(spark, enumerate(made))).collect()}
    for k, t in enumerate(made):
        want = plain_statistics(t or "")
        assert list(want) == list(quality_qda.STATISTICS)
        assert np.allclose(got[k], list(want.values()), rtol=1e-5, atol=1e-5), repr(t)[:80]


def test_quality_of_repeated_rows(spark):
    rows = [(k, f"{words(random.Random(k), 20)}{'!!! ***' if k % 2 else '.'}") for k in range(60)]
    known = labels(spark, [(k, k % 2 == 0) for k in range(60)], "quality")
    got = quality_qda.score(frame(spark, rows + [rows[4]] * 3 + [(None, rows[4][1])]), known).collect()
    assert len(got) == 64 and len({r.score for r in got if r.doc_id in (4, None)}) == 1
    assert [r.held_out for r in got if r.doc_id is None] == [False]


def test_quality_without_labels_or_rows(spark):
    none = labels(spark, [], "quality")
    assert quality_qda.score(frame(spark, []), none).collect() == []
    assert {r.score for r in quality_qda.score(frame(spark, [(1, None), (2, "a b")]), none).collect()} == {0.5}


def test_toxicity_finds_planted_words_and_their_passages(spark):
    rng = random.Random(9)
    slurs = ["grubface", "mudling", "rotter"]
    rows, y = [], []
    for k in range(400):
        w = words(rng, rng.choice([10, 60, 200])).split()
        toxic = k % 6 == 0
        if toxic:
            for _ in range(1 + len(w) // 30):
                w.insert(rng.randrange(len(w)), rng.choice(slurs) + rng.choice(["", ".", "s", "!!"]))
        rows.append((k, " ".join(w)))
        y.append(toxic)
    lex = toxicity.fit(frame(spark, rows), labels(spark, enumerate(y), "toxic"))
    odd = [(1000 + k, t) for k, t in enumerate(ODD)]
    got = {r.doc_id: r for r in toxicity.score(frame(spark, rows + odd), lex).collect()}
    assert len(got) == len(rows) + len(odd)
    held = {k for k in got if zlib.crc32(str(k).encode()) % 4 == 2}
    assert {k for k, r in got.items() if r.held_out} == held
    assert np.mean([got[k].predicted == y[k] for k in held if k < 1000]) > 0.97
    assert not any(got[k].predicted for k, _ in odd)
    one = next(got[k] for k in range(400) if y[k] and got[k].passages)
    text = dict(rows)[one.doc_id].split()
    assert any(s in " ".join(text[p["first"] : p["last"] + 1]) for p in one.passages for s in slurs)
    docs = frame(spark, rows + odd)
    assert sorted(r.doc_id for r in toxicity.clean(docs, lex).collect()) == sorted(k for k, r in got.items() if not r.predicted)
    assert toxicity.clean(docs, lex).columns == docs.columns


def test_toxicity_without_labels_or_rows(spark):
    lex = toxicity.fit(frame(spark, [(1, "a")]), labels(spark, [], "toxic"))
    assert toxicity.score(frame(spark, []), lex).collect() == []
    assert [r.predicted for r in toxicity.score(frame(spark, [(1, "a b c")]), lex).collect()] == [0]


def test_segments_are_the_maximal_ones():
    """Against the definition: all of a segment's proper beginnings and ends score above nothing, and none can grow."""
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 14)
        hits = [(i, float(rng.randint(1, 5))) for i in range(n) if rng.random() < 0.4]
        s = [-1.0] * n
        for i, x in hits:
            s[i] = x
        total = lambda a, b: sum(s[a : b + 1])
        good = [(a, b) for a in range(n) for b in range(a, n) if all(total(a, k) > 0 for k in range(a, b + 1)) and all(total(k, b) > 0 for k in range(a, b + 1))]
        want = [(a, b, total(a, b)) for a, b in good if not any((c, d) != (a, b) and c <= a and b <= d for c, d in good)]
        assert toxicity.segments(hits, -1.0) == want


def test_probability_against_sampled_chances():
    """Evidence of k significant segments: how often the product of k chances is as small, by many draws."""
    lex = toxicity.Lexicon({}, {}, rate=0.6, prior=0.2, k=0.05, slope=0.9, start=-2.0)
    rng = np.random.default_rng(8)
    draws = rng.random((400_000, 3))
    for n, scores in ((50, [9.0]), (400, [14.0, 15.0]), (90, [10.0, 11.0, 10.5]), (90, [10.0, 0.5]), (5000, [3.0, 4.0])):
        chances = [1 - math.exp(-0.05 * n * math.exp(-0.6 * s)) for s in scores]
        told = [p for p in chances if p < toxicity.SIGNIFICANT] or [min(chances)]
        product = math.prod(told)
        sampled = (draws[:, : len(told)].prod(axis=1) <= product).mean()
        exact = product if len(told) == 1 else sampled
        found = [(i, i, s) for i, s in enumerate(scores)]
        want = 1 / (1 + math.exp(2.0 - 0.9 * -math.log(exact)))
        assert abs(toxicity.probability(found, n, lex) - want) < (1e-9 if len(told) == 1 else 0.02), (n, scores)
    assert abs(toxicity.probability([], 10, lex) - 1 / (1 + math.exp(2.0))) < 1e-12


def test_toxicity_of_repeated_rows(spark):
    rng = random.Random(2)
    rows = [(k, words(rng, 30) + (" grubface mudling grubface" if k % 3 == 0 else "")) for k in range(120)]
    lex = toxicity.fit(frame(spark, rows), labels(spark, [(k, k % 3 == 0) for k in range(120)], "toxic"))
    docs = frame(spark, rows + [rows[3]] * 2 + [rows[4]] * 2 + [(None, rows[3][1]), (None, rows[4][1])])
    got = toxicity.score(docs, lex).collect()
    assert len(got) == 126 and len({(r.doc_id, r.score) for r in got}) == 122
    assert [r.held_out for r in got if r.doc_id is None] == [False, False]
    kept = [r.doc_id for r in toxicity.clean(docs, lex).collect()]
    assert kept.count(4) == 3 and kept.count(3) == 0 and kept.count(None) == 1


def test_extreme_rate_solves_its_equation():
    hits = [(0.001, 4.0), (0.0004, 6.0)]
    rate = toxicity.extreme_rate(hits)
    assert abs(sum(p * np.exp(rate * s) for p, s in hits) + (1 - 0.0014) * np.exp(rate * toxicity.DRIFT) - 1) < 1e-9
