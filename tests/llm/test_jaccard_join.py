import random
import re

from cases import ODD, frame, words
from folioflow.llm import jaccard_join
from folioflow.llm.jaccard_join import join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(d, least.get(top(i), d))
    return {d: (len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows)}


def corpus(rng):
    """Copies, chains of edits, a passage that many share, and awkward texts."""
    out = list(ODD)
    passage = words(rng, 30)
    for _ in range(12):
        base = words(rng, rng.choice([6, 30, 80, 200])).split()
        text = list(base)
        for _ in range(rng.randint(1, 8)):
            out.append(" ".join(text))
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = words(rng, 1)
            if rng.random() < 0.3:
                text += words(rng, rng.randint(1, 12)).split()
            if rng.random() < 0.3:
                out.append(" ".join(text).upper())
    out += [f"{words(rng, rng.randint(3, 60))} {passage} {words(rng, rng.randint(3, 60))}" for _ in range(40)]
    out += [words(rng, n) for n in (1, 2, 4, 5)] * 2
    rng.shuffle(out)
    return list(enumerate(out, 100))


def test_equals_all_pairs(spark, monkeypatch):
    for seed, block, loose in ((1, 1024, 3), (2, 3, 0), (3, 3, 1000)):
        monkeypatch.setattr(jaccard_join, "LOOSE", loose)
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        monkeypatch.setattr(jaccard_join, "BESIDE", block)
        monkeypatch.setattr(jaccard_join, "SMALL", 24 if seed == 1 else 2)
        monkeypatch.setattr(jaccard_join, "FREQUENT", 8 if seed == 1 else 1000)
        rows = corpus(random.Random(seed))
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in join(frame(spark, rows)).collect()}
        assert got == brute(rows)


def test_a_crowd_of_near_copies_needs_few_pairs(spark, monkeypatch):
    """Two words of each copy differ from the first text: any two are similar only where these lie close by chance."""
    rng = random.Random(5)
    first, rows = [f"w{k}" for k in range(150)], []
    for d in range(240):
        text = list(first)
        for k in rng.sample(range(5, 145), 2):
            text[k] = f"v{rng.random()}"
        rows.append((d, " ".join(text)))
    made, write = {}, jaccard_join.materialise

    def counted(df, name, *args):
        out = write(df, name, *args)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join, "materialise", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join(frame(spark, rows)).collect()}
    assert got == brute(rows)
    assert sum(made[k] for k in ("candidates", "ordered", "pairs")) < 20 * len(rows), made


def test_no_rows_and_repeated_rows(spark):
    assert join(frame(spark, [])).collect() == []
    got = join(frame(spark, [(3, "a b c d e f")] * 2 + [(2, "A b c d e F"), (1, None), (0, "")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(0, 0, 0), (1, 0, 1), (2, 2, 2), (3, 2, 2), (3, 2, 2)]


def test_representatives_are_whole_rows(spark):
    rows = corpus(random.Random(4)) + [(None, "no id"), (None, "no id")]
    docs = frame(spark, rows)
    got = jaccard_join.representatives(docs)
    assert got.columns == docs.columns
    want = {c for _, c in brute([r for r in rows if r[0] is not None]).values()}
    assert sorted((r.doc_id for r in got.collect()), key=lambda d: -1 if d is None else d) == [None, None, *sorted(want)]


def test_words_that_collide_as_polynomials_differ():
    """Thue-Morse words: any polynomial modulo 2**64 over their bytes is the same for a word and its complement."""
    from folioflow.llm.shingles import shingle_set

    bits = [bin(k).count("1") % 2 for k in range(4096)]
    one, other = (bytes(97 + (b ^ flip) for b in bits) for flip in (0, 1))
    assert shingle_set(one).tolist() != shingle_set(other).tolist()
