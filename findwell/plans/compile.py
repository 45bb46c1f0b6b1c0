"""Syntax trees compiled to column expressions: one that filters and one that scores.

Nothing here runs: Catalyst sees plain predicates, pushes comparisons of columns with literals to the
scan and compiles the rest. A filter may be null where a value is missing, which selects nothing;
only what is negated is made false first, since a scan can't push a predicate wrapped in coalesce. Statistics for scoring (documents, mean lengths, document frequencies) are a dictionary that
``operators.search`` fills from one aggregation or from the persisted index.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from findwell.functions.text import array_tokens, literal_tokens, tokens, within_edits
from findwell.plans.query import Clause, Everything, Exists, Fuzzy, Nothing, OneOf, Phrase, Prefix, QueryError, Range, Regex, Term

K1 = 1.2
B = 0.75


@dataclass(frozen=True)
class Field:
    """A searchable leaf: its values, how they compare, and its tokens if they are stored."""

    value: Column
    kind: str  # text, number, timestamp, bool, array, raw
    stored_tokens: Column | None = None

    @property
    def tokens(self) -> Column:
        if self.stored_tokens is not None:
            return self.stored_tokens
        return array_tokens(self.value) if self.kind == "array" else tokens(self.value)

    @property
    def comparable(self) -> Column:
        return F.unix_millis(self.value) if self.kind == "timestamp" else self.value


@dataclass(frozen=True)
class Stats:
    n_docs: int
    mean_len: dict[str, float]
    df: dict[tuple[str, str], int]

    def idf(self, path: str, token: str) -> float:
        df = self.df.get((path, token), 0)
        return math.log(1 + (self.n_docs - df + 0.5) / (df + 0.5))


class Compiler:
    def __init__(self, fields: dict[str, Field], b: float = B):
        self.fields, self.b = fields, b

    def paths(self, path: str | None) -> list[str]:
        """The leaves that a path stands for; none given: all text leaves."""
        if path is None:
            return [p for p, f in self.fields.items() if f.kind in ("text", "array")]
        if path in ("id", "partition_key") and path in self.fields:
            return [path]
        name = path.removeprefix("document.")
        return [name] if name in self.fields else []

    # filters

    def filter(self, node) -> Column:
        if isinstance(node, Everything):
            return F.lit(True)
        if isinstance(node, Nothing):
            return F.lit(False)
        if isinstance(node, Clause):
            return self._clause(node)
        found = [self._leaf(node, p) for p in self.paths(node.path)]
        out = found[0] if found else F.lit(False)
        for c in found[1:]:
            out = out | c
        return out

    def _clause(self, node: Clause) -> Column:
        out = None
        for n in node.must:
            out = self.filter(n) if out is None else out & self.filter(n)
        if not node.must and node.should:
            for n in node.should:
                out = self.filter(n) if out is None else out | self.filter(n)
        if out is None:  # only exclusions select nothing
            return F.lit(False)
        for n in node.must_not:
            out = out & ~F.coalesce(self.filter(n), F.lit(False))
        return out

    def _leaf(self, node, path: str) -> Column:
        f = self.fields[path]
        if isinstance(node, Exists):
            return f.value.isNotNull()
        if isinstance(node, Range):
            return self._range(node, f)
        if isinstance(node, OneOf):
            return self.filter(Clause(should=tuple(Term(path, x) for x in node.items)))
        if f.kind == "raw":
            if isinstance(node, Prefix):
                return f.value.startswith(node.text)
            return f.value == node.text
        if f.kind in ("number", "timestamp", "bool"):
            return self._equal(node, f)
        if isinstance(node, Prefix):
            return F.exists(f.tokens, lambda t: t.startswith(node.text))
        if isinstance(node, Fuzzy):
            return F.exists(f.tokens, lambda t: within_edits(t, node.text, node.edits))
        if isinstance(node, Regex):
            return F.exists(f.tokens, lambda t: t.rlike(f"^(?:{node.pattern})$"))
        words = literal_tokens(node.text)
        if not words:
            return F.lit(False)
        if len(words) == 1 and not getattr(node, "prefix", False):
            return F.array_contains(f.tokens, words[0])
        return self._phrase(node, f, words)

    @staticmethod
    def _phrase(node, f: Field, words: list[str]) -> Column:
        slop, prefix = getattr(node, "slop", 0), getattr(node, "prefix", False)
        if slop:
            return F.size(_sloppy(f.tokens, words, slop)) > 0
        # tokens hold letters and digits only, so a space cannot occur within one
        line = F.concat(F.lit(" "), F.array_join(f.tokens, " "), F.lit(" "))
        return F.contains(line, F.lit(" " + " ".join(words) + ("" if prefix else " ")))

    @staticmethod
    def _equal(node, f: Field) -> Column:
        if isinstance(node, (Prefix, Fuzzy, Regex, Phrase)):
            return F.lit(False)
        if f.kind == "bool":
            return f.value == (node.text.lower() == "true") if node.text.lower() in ("true", "false") else F.lit(False)
        try:
            return f.comparable == _number(node.text)
        except ValueError:
            return F.lit(False)

    @staticmethod
    def _range(node: Range, f: Field) -> Column:
        convert = _number if f.kind in ("number", "timestamp") else str
        try:
            low, high = (None if x is None else convert(x) for x in (node.low, node.high))
        except ValueError:
            raise QueryError(f"not a number: {node.low} TO {node.high}") from None
        value, as_time = f.comparable, lambda x: x
        if f.kind == "timestamp":  # compare the column itself, so the scan can skip
            value, as_time = f.value, lambda ms: F.timestamp_millis(F.lit(int(ms)))
        out = value.isNotNull()
        if low is not None:
            out = out & ((value >= as_time(low)) if node.low_in else (value > as_time(low)))
        if high is not None:
            out = out & ((value <= as_time(high)) if node.high_in else (value < as_time(high)))
        return out

    # scores

    def terms(self, node) -> set[tuple[str, str]]:
        """All (path, token) whose document frequency scoring needs."""
        if isinstance(node, Clause):
            return set().union(*[self.terms(n) for n in node.must + node.should]) if node.must + node.should else set()
        if isinstance(node, (Term, Phrase)):
            return {(p, t) for p in self.paths(node.path) if self.fields[p].kind in ("text", "array") for t in literal_tokens(node.text)}
        return set()

    def score(self, node, stats: Stats) -> Column:
        """Score of a document that matches ``node``; 0 for what doesn't."""
        if isinstance(node, Clause):
            parts = [self.score(n, stats) for n in node.must + node.should]
            total = sum(parts[1:], parts[0]) if parts else F.lit(0.0)
            return total * F.lit(float(node.boost)) if node.boost != 1 else total
        if isinstance(node, (Everything, Nothing)):
            return F.lit(float(node.boost))
        parts = [self._leaf_score(node, p, stats) for p in self.paths(node.path)]
        return sum(parts[1:], parts[0]) if parts else F.lit(0.0)

    def _leaf_score(self, node, path: str, stats: Stats) -> Column:
        f = self.fields[path]
        boost = F.lit(float(node.boost))
        if f.kind not in ("text", "array") or not isinstance(node, (Term, Phrase)):
            return F.when(F.coalesce(self._leaf(node, path), F.lit(False)), boost).otherwise(0.0)
        words = literal_tokens(node.text)
        if not words:
            return F.lit(0.0)
        weight = sum(stats.idf(path, w) for w in words) * node.boost
        toks = f.tokens
        if len(words) == 1:
            tf = F.size(F.filter(toks, lambda t: t == words[0]))
        else:
            tf = F.size(_sloppy(toks, words, getattr(node, "slop", 0)))
        mean = stats.mean_len.get(path) or 1.0
        norm = K1 * (1 - self.b + self.b * F.size(toks).cast("double") / F.lit(mean))
        return F.when(tf > 0, F.lit(weight) * (tf * (K1 + 1)) / (tf + norm)).otherwise(0.0)


def _sloppy(toks: Column, words: list[str], slop: int) -> Column:
    """Start places at which the words follow in order, with at most ``slop`` others between. The
    tokens are bound once; within a lambda they would be made anew for each place."""
    return F.transform(F.array(toks), lambda t: _starts(t, words, slop))[0]


def _starts(toks: Column, words: list[str], slop: int) -> Column:
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(toks) - 1, F.lit(0))), lambda i: F.get(toks, i) == words[0])
    if not slop:
        def here(i):
            ok = F.lit(True)
            for k, w in enumerate(words[1:], 1):
                ok = ok & (F.get(toks, i + k) == w)
            return F.coalesce(ok, F.lit(False))

        return F.filter(starts, here)

    def reach(i):
        at = i
        for w in words[1:]:  # the nearest later place of each next word, no farther than the slop
            step = F.array_position(F.slice(toks, F.greatest(at, F.lit(0)) + 2, F.lit(slop + 1)), w)
            at = F.when((at >= 0) & (step > 0), at + step.cast("int")).otherwise(F.lit(-(1 << 20)))
        return (at >= 0) & (at - i - F.lit(len(words) - 1) <= slop)

    return F.filter(starts, reach)


def _number(text: str):
    return int(text) if text.lstrip("+-").isdigit() else float(text)
