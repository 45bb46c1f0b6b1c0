"""Plans and packed pieces against the contract: everything placed once, gapless, near the bound."""

import random
import zlib

import numpy as np
import pytest
from findwell.llm import tokens
from findwell.llm.packing import CAPACITY, best_fit, configurations, fractional, pack, plan, segments


def hist(lengths, capacity=CAPACITY):
    return np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    r = np.random.default_rng(seed)
    n = [[], [4096] * 3, r.integers(1, 4097, 300), np.minimum(4096, r.lognormal(6, 1.2, 5000).astype(int) + 1)][seed]
    h = hist(np.array(n, int))
    bins = plan(h)
    got = np.zeros_like(h)
    for items, m in bins:
        assert m > 0 and sum(a * k for a, k in items) <= CAPACITY
        for a, k in items:
            got[a] += k * m
    assert (got == h).all()
    used = sum(m for _, m in bins)
    assert used <= sum(m for _, m in best_fit(h, [], CAPACITY)) + len(n) // 200
    if seed == 3:
        assert used <= -(-int((h * np.arange(CAPACITY + 1)).sum()) // CAPACITY) + 1
    s = segments(bins)
    assert (np.diff(s["key"]) > 0).all()


def test_configurations_stay_within_demand():
    d = np.array([0, 5, 0, 7, 2, 0, 0, 1, 4])
    got = np.zeros_like(d)
    for conf, n in configurations(d, 8):
        assert sum(c * k for c, k in conf.items()) <= 8
        for c, k in conf.items():
            got[c] += k * n
    assert (got <= d).all()


def optimum(lengths, capacity):
    """The fewest sequences, by trying every way to place each piece, longest first."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= lengths[i]}:
            rest = list(rooms)
            rest.remove(room)
            go(i + 1, tuple(sorted([*rest, room - lengths[i]])))
        go(i + 1, tuple(sorted([*rooms, capacity - lengths[i]])))

    go(0, ())
    return best[0]


def test_small_plans_against_the_optimum():
    r = random.Random(3)
    over = 0
    for _ in range(40):
        capacity = r.choice([10, 13, 20])
        lengths = [r.randrange(1, capacity + 1) for _ in range(r.randrange(1, 12))]
        over += sum(m for _, m in plan(hist(lengths, capacity), capacity)) - optimum(lengths, capacity)
    assert over <= 1


def test_the_program_acts_on_small_tables_too():
    r = np.random.default_rng(3)
    for n in (200, 1000, 20_000):
        lengths = np.minimum(4096, r.lognormal(6, 1.2, n).astype(int) + 1)
        units = 256
        demand = np.bincount(np.minimum(np.maximum(1, (lengths + 8) // 16), units), minlength=units + 1)
        x = fractional(demand, units)
        assert len(x) > 20 and abs(sum(v * sum(c * k for c, k in conf) for conf, v in x.items()) - (demand * np.arange(units + 1)).sum()) < 1
        confs = configurations(demand, units)
        assert sum(m * sum(c * k for c, k in conf.items()) for conf, m in confs) > 0.7 * (demand * np.arange(units + 1)).sum()


def test_pieces(spark):
    r = random.Random(1)
    texts = ["", None, "word", "word", "Ünïcode été 😀 it's <|endoftext|>", "tok " * 9000] + [" ".join("".join(r.choice("abcdeé") for _ in range(5)) for _ in range(r.randrange(1, 900))) for _ in range(40)]
    rows = [(i, t, "s", 0) for i, t in enumerate(texts)] + [(2, "word", "s", 0), (None, "no id", "s", 0)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, salt string, length int")).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokens.vocabulary())
    want = []
    for d, t, *_ in rows:
        x = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(d, k, s, len(x[s : s + CAPACITY]), zlib.crc32(x[s : s + CAPACITY].tobytes())) for k, s in enumerate(range(0, len(x), CAPACITY))]
    assert sorted(map(str, (tuple(g)[:5] for g in got))) == sorted(map(str, want))
    by = {}
    for g in got:
        by.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= CAPACITY
    assert len(by) <= -(-sum(w[3] for w in want) // CAPACITY) + 1
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
