"""The query language: syntax tree, parser and request rewriting. Driver-side text only."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


class QueryError(ValueError):
    """A query or request that cannot be run."""


@dataclass(frozen=True)
class Term:
    path: str | None
    text: str
    boost: float = 1.0


@dataclass(frozen=True)
class Phrase:
    path: str | None
    text: str
    slop: int = 0
    prefix: bool = False
    boost: float = 1.0


@dataclass(frozen=True)
class Prefix:
    path: str | None
    text: str
    boost: float = 1.0


@dataclass(frozen=True)
class Fuzzy:
    path: str | None
    text: str
    edits: int
    boost: float = 1.0


@dataclass(frozen=True)
class Range:
    path: str | None
    low: str | None
    high: str | None
    low_in: bool = True
    high_in: bool = True
    boost: float = 1.0


@dataclass(frozen=True)
class OneOf:
    path: str | None
    items: tuple[str, ...]
    boost: float = 1.0


@dataclass(frozen=True)
class Exists:
    path: str
    boost: float = 1.0


@dataclass(frozen=True)
class Regex:
    path: str | None
    pattern: str
    boost: float = 1.0


@dataclass(frozen=True)
class Everything:
    boost: float = 1.0


@dataclass(frozen=True)
class Nothing:
    boost: float = 1.0


@dataclass(frozen=True)
class Clause:
    """Boolean combination. Without ``must``, one of ``should`` has to match."""

    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()
    boost: float = 1.0


_BREAKS = set(" \t\r\n()\"")


@dataclass
class _Parser:
    text: str
    at: int = 0
    depth: int = 0
    marks: list = field(default_factory=list)

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def word(self, *words: str) -> str | None:
        """Consume one of the bare operators, if it stands here by itself."""
        for w in words:
            end = self.at + len(w)
            if self.text.startswith(w, self.at) and (end == len(self.text) or self.text[end] in _BREAKS):
                self.at = end
                return w
        return None

    def union(self, path: str | None):
        groups = [self.intersection(path)]
        while True:
            self.space()
            if self.at >= len(self.text) or self.peek() == ")":
                break
            self.word("OR")
            groups.append(self.intersection(path))
        flat = [c for g in groups for c in (g if len(g) == 1 else [("", self.both(g))])]
        if len(flat) == 1 and flat[0][0] in ("", "+"):
            return flat[0][1]
        return Clause(*[tuple(n for o, n in flat if o == k) for k in ("+", "", "-")])

    @staticmethod
    def both(group):
        return Clause(must=tuple(n for o, n in group if o != "-"), must_not=tuple(n for o, n in group if o == "-"))

    def intersection(self, path: str | None) -> list[tuple[str, object]]:
        out = [self.signed(path)]
        while True:
            self.space()
            if not self.word("AND"):
                return out
            out.append(self.signed(path))

    def signed(self, path: str | None) -> tuple[str, object]:
        self.space()
        if self.word("NOT"):
            return "-", self.signed(path)[1]
        if self.peek() in ("+", "-") and len(self.peek()):
            sign = self.peek()
            self.at += 1
            return sign, self.atom(path)
        return "", self.atom(path)

    def atom(self, path: str | None):
        self.space()
        if self.at >= len(self.text):
            raise QueryError(f"a clause is missing at the end of {self.text!r}")
        node = self.group(path) if self.peek() == "(" else self.leaf(path)
        if self.peek() == "^":
            self.at += 1
            node = replace(node, boost=node.boost * self.number())
        return node

    def group(self, path: str | None):
        self.at += 1
        node = self.union(path)
        self.space()
        if self.peek() != ")":
            raise QueryError(f"a closing parenthesis is missing in {self.text!r}")
        self.at += 1
        return node

    def number(self) -> float:
        start = self.at
        while self.at < len(self.text) and (self.text[self.at].isdigit() or self.text[self.at] == "."):
            self.at += 1
        try:
            return float(self.text[start : self.at])
        except ValueError:
            raise QueryError(f"a number is missing at {start} in {self.text!r}") from None

    def leaf(self, path: str | None):
        if self.peek() == '"':
            return self.phrase(path)
        if self.peek() in "[{":
            return self.range(path)
        if self.peek() == "/":
            return self.regex(path)
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in _BREAKS and self.text[self.at] not in ":^":
            self.at += 1
        text = self.text[start : self.at]
        if self.peek() == ":" and text:
            self.at += 1
            return self.value(text)
        if not text:
            raise QueryError(f"cannot read {self.text[start:]!r}")
        return self.literal(path, text)

    def value(self, path: str):
        if self.peek() == "(":
            return self.group(path)
        if self.word("IN"):
            self.space()
            if self.peek() != "[":
                raise QueryError("IN needs a list in brackets")
            end = self.text.find("]", self.at)
            if end < 0:
                raise QueryError("a closing bracket is missing")
            items = tuple(x.strip('"') for x in self.text[self.at + 1 : end].split())
            self.at = end + 1
            return OneOf(path, items)
        for sign in (">=", "<=", ">", "<"):
            if self.text.startswith(sign, self.at):
                self.at += len(sign)
                start = self.at
                while self.at < len(self.text) and self.text[self.at] not in _BREAKS:
                    self.at += 1
                v = self.text[start : self.at]
                return Range(path, v, None, low_in=sign == ">=") if sign[0] == ">" else Range(path, None, v, high_in=sign == "<=")
        if self.peek() == "*" and (self.at + 1 == len(self.text) or self.text[self.at + 1] in _BREAKS):
            self.at += 1
            return Exists(path)
        return self.leaf(path)

    def phrase(self, path: str | None):
        end = self.text.find('"', self.at + 1)
        if end < 0:
            raise QueryError(f"a closing quote is missing in {self.text!r}")
        text = self.text[self.at + 1 : end]
        self.at = end + 1
        if self.peek() == "~":
            self.at += 1
            return Phrase(path, text, slop=int(self.number()))
        if self.peek() == "*":
            self.at += 1
            return Phrase(path, text, prefix=True)
        return Phrase(path, text)

    def range(self, path: str | None):
        opens = self.peek()
        ends = [e for e in (self.text.find("]", self.at), self.text.find("}", self.at)) if e >= 0]
        if not ends:
            raise QueryError(f"a range is not closed in {self.text!r}")
        end = min(ends)
        parts = self.text[self.at + 1 : end].split(" TO ")
        if len(parts) != 2:
            raise QueryError(f"a range needs two ends: {self.text[self.at:end + 1]!r}")
        self.at = end + 1
        low, high = (None if p.strip() == "*" else p.strip().strip('"') for p in parts)
        return Range(path, low, high, opens == "[", self.text[end] == "]")

    def regex(self, path: str | None):
        end = self.text.find("/", self.at + 1)
        if end < 0:
            raise QueryError(f"a pattern is not closed in {self.text!r}")
        pattern = self.text[self.at + 1 : end]
        self.at = end + 1
        return Regex(path, pattern)

    @staticmethod
    def literal(path: str | None, text: str):
        if text == "*":
            return Everything()
        if text.endswith("*") and "*" not in text[:-1]:
            return Prefix(path, text[:-1].lower())
        head, mark, edits = text.rpartition("~")
        if mark and head and "~" not in head and (edits == "" or edits.isdigit()):
            if int(edits or 1) > 2:
                raise QueryError(f"at most two edits can be asked for: {text!r}")
            return Fuzzy(path, head.lower(), int(edits or 1))
        return Term(path, text)


def parse(text: str):
    """Syntax tree of a query. A blank query matches nothing."""
    if not text.strip():
        return Nothing()
    p = _Parser(text)
    node = p.union(None)
    p.space()
    if p.at < len(p.text):
        raise QueryError(f"cannot read {p.text[p.at:]!r}")
    return node


@dataclass(frozen=True)
class SearchRequest:
    query: str
    limit: int
    offset: int = 0
    consistency: int = 0
    default_fields: tuple[str, ...] = ()
    facet_fields: tuple[str, ...] = ()
    boost_fields: tuple[tuple[str, float], ...] = ()
    group_by_partition: bool = False

    def __post_init__(self):
        if self.limit < 0 or self.offset < 0 or self.limit + self.offset == 0:
            raise QueryError("limit and offset must not be negative, nor both be 0")


def expanded(request: SearchRequest) -> str:
    """A plain keyword query over several fields: every word must be in one of them. Boosted fields
    come before default fields; a query with a field or a quote, or a blank one, is left as it is."""
    q = request.query
    fields = request.boost_fields or tuple((f, None) for f in request.default_fields)
    if not fields or not q.strip() or ":" in q or '"' in q:
        return q
    name = lambda f: f if f.startswith("document.") else f"document.{f}"
    weight = lambda b: "" if b is None else f"^{b:g}"
    return " AND ".join("(" + " OR ".join(f"{name(f)}:{w}{weight(b)}" for f, b in fields) + ")" for w in q.split())
