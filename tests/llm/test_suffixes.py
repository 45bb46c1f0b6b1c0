"""Removed bytes against a dictionary of all 100-byte strings; merged transforms against sorting."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from findwell.llm import suffixes
from findwell.llm.suffixes import LENGTH, interleave, stripped, transform


def brute(rows):
    rows = [(i, (t or "").encode()) for i, t in rows]
    seen, out = set(), []
    for doc, raw in sorted(set((i, r) for i, r in rows if i is not None)):
        gone = np.zeros(len(raw) + 1, np.int64)
        for s in range(len(raw) - LENGTH + 1):
            x = raw[s : s + LENGTH]
            if x in seen:
                gone[s] += 1
                gone[s + LENGTH if s + LENGTH <= len(raw) else len(raw)] -= 1
            seen.add(x)
        mask = np.cumsum(gone)[:-1] > 0
        kept = bytes(b for b, m in zip(raw, mask, strict=True) if not m)
        spans = int(np.sum(np.diff(mask.astype(int), prepend=0) == 1))
        out.append((doc, len(raw), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    by = {r[0]: r for r in out}
    return sorted(by[i] if i is not None else (None, len(r), 0, 0, hashlib.sha256(r).hexdigest()) for i, r in rows) if all(i is not None for i, _ in rows) else [by[i] if i is not None else (None, len(r), 0, 0, hashlib.sha256(r).hexdigest()) for i, r in rows]


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("ab cdé") for _ in range(n))
    p, q = text(150), text(99)
    rows = [(1, text(300) + p + text(40)), (2, p), (3, text(20) + q), (4, q + text(200)), (5, "x" * 1000), (6, "ab" * 300 + p[:120]), (7, None), (8, ""), (9, text(99)), (10, text(50) + p[10:] + p + text(7)), (12, "y" * 350 + "x" * 150)]
    base = text(900)
    for i in range(20, 40):
        t = list(base)
        for _ in range(r.randrange(4)):
            t[r.randrange(len(t))] = r.choice("ABC")
        rows.append((i, "".join(t)[r.randrange(50) :]))
    return rows


@pytest.mark.parametrize("always", [False, True, "segments"])
def test_against_dictionary(spark, monkeypatch, always):
    if always == "segments":
        monkeypatch.setattr(suffixes, "BATCH", 128)
        always = False
    if always:  # every anchor settled string by string
        real = suffixes.Runs
        every = lambda plain, scratch: np.unique(np.concatenate([real([(t or "").encode()]).anchor for _, t in corpus(3)]))
        monkeypatch.setattr(suffixes, "frequent_anchors", every)
    rows = corpus(3) + [(3, corpus(3)[2][1])]
    got = stripped(spark.createDataFrame([(*x, "s", 1) for x in rows], "doc_id long, text string, doc string, begin long"))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_null_id_and_empty(spark):
    rows = [(None, "z" * 300), (None, None), (1, "z" * 300)]
    got = stripped(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))
    assert stripped(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_interleave_finds_shared_prefixes_in_order():
    r = np.random.default_rng(5)
    shards = [np.where(np.arange(n + 1) % 17 == 16, 0, r.integers(1, 4, n + 1)).astype(np.uint8) for n in (40, 1, 75, 33, 5000)]
    for t in shards:
        t[-1] = 0
    made = [transform(t) for t in shards]
    for t, (order, _) in zip(shards, made, strict=True):
        turned = [tuple(np.roll(t, -i).tolist()) for i in order] if len(t) < 100 else []
        assert turned == sorted(turned) and sorted(order) == list(range(len(t)))
    for k in (1, 3, 9):
        every = {}
        for s, t in enumerate(shards):
            for i in range(len(t)):
                key = tuple(int(t[(i + j) % len(t)]) for j in range(k))
                if 0 not in key:
                    every.setdefault(key, set()).add((s, i))
        want = [every[x] for x in sorted(every) if len(every[x]) > 1]
        shard, row, block = interleave([m[1] for m in made], k)
        got = {}
        for s, j, b in zip(shard.tolist(), row.tolist(), block.tolist(), strict=True):
            got.setdefault(b, set()).add((s, int(made[s][0][j])))
        assert [got[b] for b in sorted(got)] == want


def test_large_bucket_is_merged_in_groups_of_anchors(monkeypatch):
    r, rows = random.Random(8), []
    for anchor in range(300):
        core = bytes(r.choice(b"abcd ") for _ in range(130))
        rows += [(anchor, 10 * anchor + k, 7 * k, bytes(r.choice(b"xyz") for _ in range(k)) + core[: 130 - k]) for k in range(3)]
    r.shuffle(rows)
    names = ["anchor", "doc", "begin", "bytes"]
    seen, real = [], suffixes.interleave

    def counted(columns, rounds):
        seen.append(sum(len(c) for c in columns))
        return real(columns, rounds)

    def merge(some):
        return {tuple(x.values()) for x in suffixes._merge(pa.table(dict(zip(names, zip(*some, strict=True), strict=True)))).to_pylist()}

    want = set().union(*[merge([x for x in rows if x[0] == a]) for a in range(300)])
    monkeypatch.setattr(suffixes, "interleave", counted)
    monkeypatch.setattr(suffixes, "TOGETHER", 4000, raising=False)
    assert merge(rows) == want and len(want) == 600
    assert max(seen) < 4000 + 3 * 131 and sum(seen) == 900 * 131
