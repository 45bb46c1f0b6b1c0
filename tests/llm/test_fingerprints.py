"""Winnowing against a plain Python version that shares nothing but the definition."""

import hashlib
import re
import struct

import xxhash
from findwell.llm.fingerprints import K, PLACE_BITS, WINDOW, fingerprints

SEED = 42


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def kept(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    h = [signed(xxhash.xxh64_intdigest(w.encode(), SEED)) for w in words]
    grams = []
    for i in range(max(len(h) - K, 0) + 1):
        x = SEED
        for v in h[i : i + K]:
            x = xxhash.xxh64_intdigest(struct.pack("<q", v), x)
        grams.append(signed(x) >> PLACE_BITS)
    out = []
    for i in range(max(len(grams) - WINDOW + 1, 1)):
        at = min(range(i, min(i + WINDOW, len(grams))), key=lambda j: (grams[j], -j))
        if (at, grams[at]) not in out:
            out.append((at, grams[at]))
    return out


def shown(k):
    return " ".join(f"{((g << PLACE_BITS) | ((1 << PLACE_BITS) - 1 - at)) & ((1 << 64) - 1):X}" for at, g in k)


def like(a, b):
    a, b = {g for _, g in a}, {g for _, g in b}
    return len(a & b) / len(a | b)


def check(spark, rows):
    got = fingerprints(spark.createDataFrame(rows, "doc_id long, text string, bucket string, next int")).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest((r[1] or "").encode(), SEED))))
    want = []
    for i, r in enumerate(order):
        t, n = r[1] or "", order[(i + 1) % len(order)][1] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + n[:q]
        want.append((r[0], len(t), hashlib.sha256(e.encode()).hexdigest(), shown(kept(t)), shown(kept(e)), like(kept(t), kept(e)), like(kept(t), kept(n))))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_small_texts(spark):
    import random

    r = random.Random(3)
    rows = [(None, "nothing known of this", "x", 1), (5, None, "x", 1), (6, "", None, None), (7, "  lead and trail \n", "x", 1), (7, "same id", "x", 1), (7, "same id", "x", 1), (8, "été ça　va 😀😀😀😀 z", "x", 1)]
    rows += [(i, " ".join(r.choice("ab cd ef gh ij".split()) for _ in range(r.randrange(60))), "x", i) for i in range(20, 60)]
    rows += [(70, "word " * 5000, "x", 1)]
    check(spark, rows)


def test_frequent_and_missing_ids(spark):
    rows = [(None, f"no id {i} at all", "x", 1) for i in range(60)] + [(5, f"the same id {i}", "x", 1) for i in range(60)] + [(i, f"own {i}", "x", 1) for i in range(10)] + [(None, "twice", "x", 1)] * 20
    check(spark, rows)


def test_single_and_none(spark):
    check(spark, [(1, "one two three four five six", "", 0)])
    check(spark, [(None, None, "", 0), (None, "x", "", 0)])
    empty = fingerprints(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0
