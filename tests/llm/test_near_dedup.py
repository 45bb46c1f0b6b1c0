"""Classes against connected components of all pairs."""

import random

import numpy as np
from findwell.llm.near_dedup import K, T, classified, family, may_link, near_dedup_stage, sketches


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + K]) for i in range(len(w) - K + 1)} if len(w) >= K else {tuple(w)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= T * max(len(sets[i]), len(sets[j])):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for g in groups.values():
        low = min((rows[i][0] for i in g if rows[i][0] is not None), default=None)
        out += [(rows[i][0], low, len(sets[i]), len(g)) for i in g]
    return sorted(map(str, out))


def corpus():
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(None, None), (None, "far far away from all of the others"), (None, "one two three four five six seven eight nine ten eleven"), (60, "one two three four five six seven eight nine ten eleven twelve"), (1, ""), (2, " \n "), (3, "One two"), (4, "one  TWO"), (5, "one two three four five"), (5, "one two three four five")]
    for base in range(12):
        words = [r.choice(vocab) for _ in range(r.choice([8, 40, 63, 64, 130, 700]))]
        for copy in range(r.choice([1, 2, 9])):
            w = list(words)
            for _ in range(r.randrange(0, 1 + len(w) // 40)):
                w[r.randrange(len(w))] = r.choice(vocab)
            if copy % 3 == 2:
                w = w[: int(len(w) * r.choice([0.7, 0.85, 0.95]))]
            rows.append((100 + 20 * base + copy, " ".join(w)))
    return rows


def test_against_all_pairs(spark):
    rows = corpus()
    got = classified(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, size int"))
    assert sorted(map(str, map(tuple, got.collect()))) == brute(rows)


def families():
    """Families of edited copies of copies, each linked with the text it was made from."""
    rows = []
    for family in (2, 12, 14, 18):
        r = random.Random(family)
        made = [[f"f{family}w{i}" for i in range(100)]]
        while len(made) < 84:
            w = list(r.choice(made))
            for at in r.sample(range(len(w)), r.choice([2, 3])):
                w[at] = f"x{r.randrange(10**9)}"
            made.append(w)
        rows += [(1000 * family + i, " ".join(w)) for i, w in enumerate(made)]
    return rows


def test_links_between_members_of_classes(spark):
    rows = families()
    got = classified(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"] // 1000, r["class_id"], r["class_size"]) for r in got} == {(f, 1000 * f, 84) for f in (2, 12, 14, 18)}


def test_many_rows_without_an_id_and_long_texts(spark):
    """1,000 rows without an id and 200 under one id, all different; a long text and its near copy."""
    r = random.Random(9)
    text = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    long_ = text(30_000).split()
    rows = [(None, text(12)) for _ in range(1000)] + [(7, text(12)) for _ in range(200)] + [(1, " ".join(long_)), (2, " ".join([*long_[:15_000], "new", *long_[15_000:]])), (None, " ".join(long_[:29_000]))]
    got = classified(spark.createDataFrame([(*x, 0, "k") for x in rows], "doc_id long, text string, n int, key string")).collect()
    assert len(got) == len(rows)
    assert sorted((g["class_id"], g["class_size"]) for g in got if g["n_shingles"] > 1000) == [(1, 3)] * 3
    assert all(g["class_size"] == 1 and g["class_id"] == g["doc_id"] for g in got if g["n_shingles"] < 1000)


def test_sketches_turn_no_linked_pair_away():
    r = np.random.default_rng(2)
    away = n = 0
    for size in (3, 20, 90, 400, 3000):
        for _ in range(300):
            a = r.integers(0, 1 << 63, size, dtype=np.uint64)
            keep = int(np.ceil(T * size))
            b = np.concatenate([a[:keep], r.integers(0, 1 << 63, size - keep, dtype=np.uint64)])
            x, y = sketches([np.unique(a)]), sketches([np.unique(b)])
            away += not may_link(np.array([size]), np.array([size]), x, y)[0][0]
            n += 1
    assert away <= n // 500
    far = [np.unique(r.integers(0, 1 << 63, 400, dtype=np.uint64)) for _ in range(20)]
    s = sketches(far)
    assert not may_link(np.full(19, 400), np.full(19, 400), s[:-1], s[1:])[0].any()


def test_stage_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "s"), (2, "A b c d e f", "t"), (3, "other", "t"), (3, "other", "t"), (3, "another text", "u"), (None, "a", "n"), (None, "a", "n"), (None, "b", "n"), (None, "other", "n")], "doc_id long, text string, source string")
    want = [(1, "a b c d e f", "s"), (3, "other", "t"), (3, "another text", "u"), (None, "a", "n"), (None, "b", "n")]
    assert sorted(map(str, map(tuple, near_dedup_stage(spark, docs, "").collect()))) == sorted(map(str, want))
    assert near_dedup_stage(spark, docs.limit(0), "").count() == 0


def test_banding_by_partition():
    assert family(0)[1:] != family(6)[1:]
    for p in range(12):
        low, rows, bands = family(p)
        assert low <= 1 << p and rows * bands <= 60
