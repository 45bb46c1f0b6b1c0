"""Recall and exact scores against brute force; ties, copies and unusable vectors."""

import numpy as np
from findwell.llm.neighbours import TOP, search

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, q):
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    return sorted(((float(x[q] @ v), i) for i, v in x.items() if i != q), key=lambda s: (-round(s[0], 12), s[1]))[:TOP]


def test_recall(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((1500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for g in search(spark.createDataFrame([(*r_, 0) for r_ in rows], SCHEMA)).collect():
        got.setdefault(g["query_id"], []).append((g["rank"], g["vec_id"], g["score"]))
    assert sorted(got) == list(range(0, 1500, 20))
    found = 0
    for q, hits in got.items():
        want = brute(rows, q)
        assert [h[0] for h in sorted(hits)] == list(range(1, TOP + 1))
        by = {i: s for s, i in want}
        found += sum(h[1] in by for h in hits)
        assert all(abs(by[h[1]] - h[2]) < 1e-12 for h in hits if h[1] in by)
    assert found / (TOP * len(got)) >= 0.9


def test_copies_ties_and_unusable(spark):
    v, w = [1.0, 2.0], [2.0, 1.0]
    rows = [(i, v) for i in range(0, 70)] + [(100, w), (101, w), (120, None), (140, []), (160, [0.0, 0.0]), (180, [1.0, None]), (200, [float("nan"), 1.0]), (220, [1.0, float("inf")]), (240, [1.0, 2.0, 3.0])]
    got = {}
    for g in search(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)).orderBy("query_id", "rank").collect():
        got.setdefault(g["query_id"], []).append(g["vec_id"])
    assert sorted(got) == [0, 20, 40, 60, 100]
    assert got[0] == list(range(1, 21)) and got[20] == [*range(20)] and got[100] == [101, *range(19)]
    assert search(spark.createDataFrame([(20, v, 0)], SCHEMA)).count() == 0
    assert search(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_long_vector_does_not_blur_the_others(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= 1000
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for g in search(spark.createDataFrame([(*r_, 0) for r_ in rows], SCHEMA)).collect():
        got.setdefault(g["query_id"], set()).add(g["vec_id"])
    found = sum(len(hits & {i for _, i in brute(rows, q)}) for q, hits in got.items())
    assert len(got) == 30 and found / (TOP * len(got)) >= 0.9
