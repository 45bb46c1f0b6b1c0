"""Word hashes by array operations against splitting."""

import random

import numpy as np
from findwell.llm import common
from findwell.llm.common import Words


def test_words(monkeypatch):
    r = random.Random(1)
    texts = ["", "  ", "one", "a b\tc\n\nd ", "é 😀 é\x0b\x0cx", "w" * 300] + [" ".join(r.choice(["aa", "b", "été"]) for _ in range(r.randrange(80))) for _ in range(30)]
    whole = Words(texts)
    monkeypatch.setattr(common, "_BLOCK", 16)
    cut = Words(texts)
    split = [t.encode() for t in " ".join(texts).split()]
    for w in (whole, cut):
        assert [bytes(w.raw[a:z]) for a, z in zip(w.begin, w.end, strict=True)] == split
        assert np.diff(w.first).tolist() == [len(t.split()) for t in texts]
        ids = {}
        assert all(ids.setdefault(b, h) == h for b, h in zip(split, w.hash.tolist(), strict=True)) and len(set(ids.values())) == len(ids)
    assert (whole.hash == cut.hash).all() and Words([]).first.tolist() == [0]
    g, first = whole.grams(3)
    assert np.diff(first).tolist() == [max(len(t.split()) - 2, 0) for t in texts] and len(g) == first[-1]
