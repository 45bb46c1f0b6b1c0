"""Token ids of texts: the tokenizers library behind a bounded cache of pieces.

All ids are the library's. A text of ASCII and Latin-1 letters, digits and ASCII marks is cut by
the vocabulary's own pre-tokenizer rule, any other text at white space, which no token crosses; one
with the control characters on which Python's and the library's notions of white space differ is
not cut. The pieces not seen before are encoded together, as one text with marks between, whose id
tells them apart: a call for each would cost more than the work itself.
"""

from __future__ import annotations

import gc
import re

import numpy as np

#: Separators for Python but not for the tokenizers library.
_DIFFER = re.compile("[\x1c-\x1f]")
#: Texts whose normal form and pieces are found here: no combining marks, no special casing.
_PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")
#: The rule above holds for vocabularies with this split.
_RULE = "'s|'t|'re|'ve|'m|'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+"
END_ID = 1
#: Longer pieces are not remembered.
_LONGEST = 64
#: Stands between pieces that are encoded together; in this vocabulary it has an id of its own.
MARK = "~"
#: Characters of one call for new pieces.
GROUP = 1 << 16


def vocabulary(path: str | None = None) -> str:
    """The tokenizer's JSON. It travels to executors as text, as they may not share folders."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, without the end id."""

    def __init__(self, vocab: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocab)
        self.own = _RULE in vocab
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.known: dict[str, bytes] = {}
        self.most = most

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _cut(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.own and _PLAIN.fullmatch(text) and "<|" not in text:
            return _PIECES.findall(text.lower())
        if _DIFFER.search(text):
            return [text]
        return text.split()

    def _ids(self, new: list[str]) -> dict[str, bytes]:
        """Ids of pieces by calls of about GROUP characters each, a mark of one id between pieces."""
        out = {p: self.whole(p) for p in new if self.mark is None or MARK in p or _DIFFER.search(p)}
        rest, at = [p for p in new if p not in out], 0
        while at < len(rest):
            size, z = 0, at
            while z < len(rest) and (z == at or size + len(rest[z]) < GROUP):
                size += len(rest[z]) + 3
                z += 1
            group, at = rest[at:z], z
            ids = np.asarray(self.tokenizer.encode_batch_fast([f" {MARK} ".join(group)], add_special_tokens=False)[0].ids, "<u4")
            ends = [-1, *np.flatnonzero(ids == self.mark).tolist(), len(ids)]
            if len(ends) != len(group) + 1:  # the mark stands for something else as well
                out.update((p, self.whole(p)) for p in group)
                continue
            raw = ids.tobytes()
            out.update((p, raw[4 * a + 4 : 4 * z]) for p, a, z in zip(group, ends, ends[1:], strict=False))
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        collects = gc.isenabled()
        gc.disable()  # no cycles are made here, and walking the cache costs more than the work
        try:
            cut, known = [self._cut(t) for t in texts], self.known
            new = set().union(*cut).difference(known)
            keep = len(known) < self.most
            known.update(self._ids(list(new)))
            out = [b"".join(map(known.__getitem__, pieces)) for pieces in cut]
            for p in new:
                if not keep or len(p) > _LONGEST:
                    del known[p]
            return out
        finally:
            if collects:
                gc.enable()

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch([text])[0]


_ENCODERS: dict[int, Encoder] = {}


def encoder(vocab: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = hash(vocab)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocab)
    return _ENCODERS[key]
