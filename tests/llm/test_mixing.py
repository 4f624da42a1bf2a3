import random
import re

from cases import ODD, frame, words
from folioflow.llm.mixing import mix, mixed_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def wanted(sizes):
    """Targets by sharing excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    goal, open_ = {}, set(names)
    left = 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not over:
            goal |= {s: level * weight[s] for s in open_}
            break
        goal |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(goal[s] for s in over)
        open_ -= over
    return goal


def corpus(rng, n=700):
    names = ["b", "a", "é", "Z", None, "zz", ""]
    rows = [(k, words(rng, rng.choice([1, 3, 20, 120])), rng.choices(names, [30, 8, 6, 4, 3, 2, 1])[0]) for k in range(n)]
    return rows + [(n + k, t, rng.choice(names)) for k, t in enumerate(ODD)]


def test_targets_and_taken_words(spark):
    rows = corpus(random.Random(2))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    goal = wanted(sizes)
    got = {r.doc_id: r for r in mix(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    taken = dict.fromkeys(goal, 0)
    for d, t, s in rows:
        r, n = got[d], len(WORD.findall(t or ""))
        assert r.size == n and r.source_size == sizes[s] and abs(r.target - goal[s]) < 1e-6 * max(1, goal[s])
        assert r.taken % n == 0 if n else r.taken == 0
        low = int(goal[s] / sizes[s]) * n
        assert low <= r.taken <= min(2 * n, low + n)
        taken[s] += r.taken
    for s, t in taken.items():
        assert abs(t - goal[s]) <= max(len(WORD.findall(x or "")) for _, x, o in rows if o == s)


def test_reruns_agree_whatever_the_partitions(spark):
    rows = corpus(random.Random(3), 300)
    runs = [sorted((r.doc_id, r.taken) for r in mix(frame(spark, rows, parts)).collect()) for parts in (1, 5)]
    assert runs[0] == runs[1]


def test_documents_repeat_as_often_as_taken(spark):
    rows = corpus(random.Random(4), 200)
    taken = {r.doc_id: r.taken // r.size for r in mix(frame(spark, rows)).collect() if r.size}
    docs = frame(spark, rows)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {d: k for d, k in taken.items() if k}


def test_no_rows_and_no_words(spark):
    assert mix(frame(spark, [])).collect() == []
    assert [(r.size, r.target, r.taken) for r in mix(frame(spark, [(1, None), (2, " ")])).collect()] == [(0, 0.0, 0)] * 2


def test_no_text_stands_for_another_and_alike_rows_share(spark):
    rows = [(1, "a b c", "s"), (1, "d e f", "s"), (None, "g h", "s"), (None, "g h", "s"), (None, "i j", "t"), (None, "i k", "t")]
    docs = frame(spark, rows)
    taken = {}
    for r in mix(docs).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    out = [(r.doc_id, r.text) for r in mixed_documents(docs).collect()]
    words_out = {}
    for d, t in out:
        words_out[d] = words_out.get(d, 0) + len(t.split())
    assert words_out == {d: n for d, n in taken.items() if n}
    assert {t for _, t in out} >= {"a b c", "d e f", "g h"} and max(out.count(x) for x in set(out)) <= 4
