import numpy as np

from folioflow.llm import nearest
from folioflow.llm.nearest import search

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string, codes int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 1, "x", 1) for i, v in rows], SCHEMA).repartition(3) if rows else spark.createDataFrame([], SCHEMA)


def brute(rows, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % 100 == 0:
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            order = [j for j in np.lexsort([ids, d]) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_recall_scores_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 15))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3000 + i, x[7].tolist()) for i in range(400)]
    bad = [(9000, None), (9001, [0.0] * 15), (9002, [float("nan")] * 15), (9003, [float("inf")] * 15), (9004, [1.0, None] + [1.0] * 13), (9100, [1.0, 2.0]), (9005, [])]
    want = brute(rows)
    for block in (16_384, 9):
        monkeypatch.setattr(nearest, "QUERY_BLOCK", block)
        monkeypatch.setattr(nearest, "ROW_BLOCK", 700)
        got = {}
        for r in search(frame(spark, rows + bad)).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert set(got) == set(want)
        hits = 0
        for q, found in got.items():
            found.sort()
            assert [r for r, _, _ in found] == list(range(1, 11))
            dist = {i: d for i, d in want[q]}
            hits += sum(i in dist for _, i, _ in found)
            assert all(abs(dist[i] - d) < 1e-12 for _, i, d in found if i in dist)
            assert [(d, i) for _, i, d in found] == sorted((d, i) for _, i, d in found)
        assert hits / (10 * len(want)) >= 0.97


def test_equal_vectors_come_by_id_and_few_candidates_come_all(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in (0, 100, 3, 5, 7, 250, *range(400, 440))]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in search(frame(spark, rows)).collect())
    assert [v for q, _, v in got if q == 100] == [0, 3, 5, 7, 250, 400, 401, 402, 403, 404]
    assert [(r.query_id, r.vec_id) for r in search(frame(spark, [(0, [1.0]), (1, [2.0])])).collect()] == [(0, 1)]
    assert search(frame(spark, [])).collect() == [] and search(frame(spark, [(0, [1.0])])).collect() == []


def test_rows_that_repeat_a_vec_id_never_find_each_other(spark):
    rows = [(100, [1.0, 2.0]), (100, [1.0, 2.5]), (1, [1.0, 2.1]), (2, [5.0, 5.0]), (2, [6.0, 6.0])]
    got = search(frame(spark, rows)).collect()
    assert {r.query_id for r in got} == {100} and 100 not in {r.vec_id for r in got}
    assert {1, 2} == {r.vec_id for r in got}


def test_parallel_error_costs_more():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    made = nearest.fit(x)
    assert made.extra > 1
    plain = nearest.Quantiser(made.centre, made.codewords, 0.0)

    def along(q):
        codes = q.codes(x)
        back = q.codewords[np.arange(len(q.codewords)), codes].reshape(len(x), -1) + q.centre
        return np.abs(((x - back) * x).sum(axis=1)).mean()

    assert along(made) < 0.7 * along(plain)
