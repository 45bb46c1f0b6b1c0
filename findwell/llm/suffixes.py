"""Operator 4. Exact substring dedup of bytes by merged Burrows-Wheeler transforms.

Every byte covered by a 100-byte string that also starts earlier is removed. A 100-byte string is
assigned to its anchor: the 32-byte gram of least hash in it, rightmost of equals. Consecutive
starts with one anchor occurrence form a run (69 starts at most, all different strings), so equal
strings always lie in runs of one anchor, and text without repeats drops out as anchors of one run.

1. Runs with the same anchor and the same bytes are settled by hash: all but the first are
   repeats. A batch of texts settles its own first, so one passage in a third of all documents
   costs a record a batch.
2. Anchors whose runs still differ bring their runs' bytes together, in buckets. There groups of
   anchors are merged one after another, so that a large bucket costs no more a byte. Each shard
   of a group's runs gets its Burrows-Wheeler transform by itself, and the shards are merged by
   iterative interleave refinement: a merged order by k symbols, read as one column of preceding
   symbols and sorted stably, is the order by k + 1 symbols (or more, where a column holds several
   symbols), and an entry leaves its predecessor's block in the round in which their common prefix
   ends. At 100 symbols the blocks are the intervals with a common prefix of 100, the repeated
   strings, without any suffix being sorted anew. A block of one entry is settled, and so is a
   prefix that reaches a run's end: what comes of them can't repeat, so they leave the interleave
   and the rounds get cheaper.
3. Anchors with a great many different runs (found beforehand from a share of the batches; which
   ones are found changes no result) are settled string by string, each string its own anchor.

Hashes have 64 bits; step 1 takes equal hashes of anchor and run for equal bytes.

Defined cases: null text is empty; documents without doc_id take no part and lose nothing; doc_id
is taken to identify a text, so rows repeated under one id are one document and treated alike; a
text under 100 bytes loses nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findwell.llm.common import Scratch, _powers, batches, documents, mix, texts, width

LENGTH = 100
GRAM = 32
STARTS = LENGTH - GRAM + 1
SHARDS = 4
#: Symbols that a round of the interleave puts before a prefix.
SYMBOLS = 4
#: Bytes of runs merged at a time, about: arrays of that size stay in a core's cache.
TOGETHER = 1 << 17
#: Bytes of a batch: places must fit PLACE_BITS.
BATCH = 4 << 20
PLACE_BITS = 26
#: One batch in SHARE is read to find frequent anchors; of these at most FREQUENT come out.
SHARE = 8
FREQUENT = 20_000


class Runs:
    """Runs of several texts: anchor hash, content hash, text index, first start, number of starts."""

    def __init__(self, coded: list[bytes]):
        self.raw = np.frombuffer(b"".join(coded), np.uint8)
        sizes = np.array([len(c) for c in coded], np.int64)
        self.base = np.cumsum([0, *sizes])
        n = len(self.raw)
        self.text = self.start = self.count = np.zeros(0, np.int64)
        self.anchor = self.content = np.zeros(0, np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        if n < LENGTH:
            return
        self.up, self.down = _powers(n + 1)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=self.sums[1:])
        g = mix((self.sums[GRAM:] - self.sums[:-GRAM]) * self.down[: n - GRAM + 1])
        low = np.uint64((1 << PLACE_BITS) - 1)
        m = (g & ~low) | (low - np.arange(len(g), dtype=np.uint64))
        size = 1
        while 2 * size <= STARTS:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        m = np.minimum(m[: n - LENGTH + 1], m[STARTS - size :][: n - LENGTH + 1])
        at = (low - (m & low)).astype(np.int64)  # the anchor's place, for every start
        ok = np.zeros(n - LENGTH + 1, bool)
        room = np.maximum(sizes - LENGTH + 1, 0)
        for b, r in zip(self.base[:-1][room > 0].tolist(), room[room > 0].tolist(), strict=True):
            ok[b : b + r] = True
        starts = np.flatnonzero(ok)
        if not len(starts):
            return
        at = at[starts]
        first = np.ones(len(starts), bool)
        first[1:] = (np.diff(at) != 0) | (np.diff(starts) != 1)
        heads = np.flatnonzero(first)
        self.count = np.diff(np.append(heads, len(starts)))
        begin = starts[heads]
        self.anchor = g[at[heads]]
        self.content = self.string(begin, begin + self.count + LENGTH - 1)
        self.text = np.searchsorted(self.base, begin, "right") - 1
        # empty texts share a base; the last text at a base is the one with bytes
        self.start = begin - self.base[self.text]

    def string(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Hashes of byte stretches of the batch."""
        return mix(((self.sums[z] - self.sums[a]) * self.down[a]) ^ ((z - a).astype(np.uint64) << np.uint64(44)))


def _coded(column) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _segments(docs: list, column) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(doc, offset, bytes) in groups of about BATCH bytes. A longer text is cut into segments that
    overlap by LENGTH - 1 bytes, so that every start lies in one of them."""
    ids, offs, held, size = [], [], [], 0
    for doc, raw in zip(docs, _coded(column), strict=True):
        for off in range(0, max(len(raw) - LENGTH + 1, 1), BATCH):
            piece = raw[off : off + BATCH + LENGTH - 1]
            ids.append(doc)
            offs.append(off)
            held.append(piece)
            size += len(piece)
            if size >= BATCH:
                yield np.array(ids, np.int64), np.array(offs, np.int64), held
                ids, offs, held, size = [], [], [], 0
    if held:
        yield np.array(ids, np.int64), np.array(offs, np.int64), held


def _frequent(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for i, t in enumerate(batches(it, BATCH)):
        if i % SHARE:
            continue
        for _, _, group in _segments([0] * t.num_rows, t.column("text")):
            r = Runs(group)
            order = np.lexsort((r.content, r.anchor))
            a, c = r.anchor[order], r.content[order]
            new = np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])) if len(a) else np.zeros(0, bool)
            a, n = np.unique(a[new], return_counts=True)
            keep = n >= 2
            yield pa.RecordBatch.from_arrays([pa.array(np.append(a[keep], np.uint64(0)).view(np.int64)), pa.array(np.append(n[keep], -len(r.anchor)))], names=["anchor", "n"])


def frequent_anchors(plain: DataFrame, scratch: Scratch) -> np.ndarray:
    """Anchors of so many different runs that their runs shouldn't meet. At most 2 * FREQUENT: each
    has at least a share of 1 / (2 * FREQUENT) of all runs looked at."""
    found = plain.mapInArrow(_frequent, "anchor long, n long").groupBy("anchor").agg(F.sum(F.when(F.col("n") > 0, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("n") < 0, -F.col("n")).otherwise(0)).alias("runs"))
    found = scratch.keep(found, "frequent")
    total = F.sum("runs")
    runs = found.agg(total.alias("t")).first()["t"] or 0
    rows = found.where((F.col("n") > 0) & (F.col("n") >= max(500, runs // (2 * FREQUENT)))).select("anchor").collect()
    return np.sort(np.array([r["anchor"] for r in rows], np.int64).view(np.uint64))


def _first(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows (anchor, content, doc, start): (indices of firsts, indices of the later)."""
    a, c, doc, start = keys
    order = np.lexsort((start, doc, c, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (c[order][1:] != c[order][:-1])
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
    later = ~new & ((doc[order] != doc[head]) | (start[order] != start[head]))
    return order[new], order[later]


_FOUND = pa.schema([("doc", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("anchor", pa.int64())])
_FOUND_SQL = "doc long, begin long, end long, anchor long"
_RUNS = "bucket int, anchor binary, content binary, doc binary, start binary, count binary"


def _joined(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of documents, joined where they overlap or touch."""
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    if not len(doc):
        return doc, begin, end
    span = 1 << 40
    rank = np.cumsum(np.append(0, doc[1:] != doc[:-1]))
    reach = np.maximum.accumulate(end + rank * span) - rank * span
    new = np.append(True, (doc[1:] != doc[:-1]) | (begin[1:] > reach[:-1]))
    heads = np.flatnonzero(new)
    last = np.append(heads[1:], len(doc)) - 1
    return doc[heads], begin[heads], reach[last]


def _runs(buckets: int, hot):
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.uint8)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = hot.value
        for ids, offs, group in (g for t in batches(it, BATCH) for g in _segments(t.column("doc_id").to_pylist(), t.column("text"))):
            r = Runs(group)
            if not len(r.anchor):
                continue
            r.start = r.start + offs[r.text]
            head, later = _first(r.anchor, r.content, ids[r.text], r.start)
            gone = _joined(ids[r.text[later]], r.start[later], r.start[later] + r.count[later] + LENGTH - 1)
            a, c, d, s, n = r.anchor[head], r.content[head], ids[r.text[head]], r.start[head], r.count[head]
            many = np.isin(a, often) if len(often) else np.zeros(len(a), bool)
            if many.any():  # one record a string, each string its own anchor
                k = n[many]
                step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                begin = np.repeat(r.base[r.text[head[many]]] + s[many] - offs[r.text[head[many]]], k) + step
                h = r.string(begin, begin + LENGTH)
                more = (h, h, np.repeat(d[many], k), np.repeat(s[many], k) + step, np.ones(len(h), np.int64))
                hh, ll = _first(*more[:4])
                gone = _joined(*[np.concatenate(x) for x in zip(gone, (more[2][ll], more[3][ll], more[3][ll] + LENGTH), strict=True)])
                a, c, d, s, n = (np.concatenate([x[~many], y[hh]]) for x, y in zip((a, c, d, s, n), more, strict=True))
            b = (mix(a) % np.uint64(buckets)).astype(np.int64)
            by = np.lexsort((s, d, b))
            cols = [x[by] for x in (a, c, d, s, n)]
            rows = []
            for x in np.split(np.arange(len(by)), np.flatnonzero(np.diff(b[by])) + 1):
                if len(x):
                    rows.append([int(b[by[x[0]]]), *[y[x].astype(kind).tobytes() for y, kind in zip(cols, kinds, strict=True)]])
            if len(gone[0]):
                rows.append([-1 - int(ids[0]) % buckets, b"", b"", *[x.astype(np.int64).tobytes() for x in gone[:2]], gone[2].astype(np.int64).tobytes()])
            schema = pa.schema([("bucket", pa.int32()), *[(k, pa.binary()) for k in ("anchor", "content", "doc", "start", "count")]])
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _settle(table: pa.Table) -> pa.Table:
    """Runs of one bucket: spans of later copies (anchor null), and the first copies of runs whose
    anchor has other runs as well. A batch's own spans pass."""

    def cat(name, kind):
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

    doc, start = cat("doc", np.int64), cat("start", np.int64)
    if table.column("bucket")[0].as_py() < 0:
        spans, rest = (doc, start, cat("count", np.int64)), (np.zeros(0, np.int64),) * 4
    else:
        a, n = cat("anchor", np.uint64), cat("count", np.uint8).astype(np.int64)
        head, later = _first(a, cat("content", np.uint64), doc, start)
        spans = _joined(doc[later], start[later], start[later] + n[later] + LENGTH - 1)
        same = a[head][1:] == a[head][:-1]
        shared = np.append(False, same) | np.append(same, False) if len(head) else np.zeros(0, bool)
        i = head[shared]
        rest = (doc[i], start[i], start[i] + n[i] + LENGTH - 1, a[i].view(np.int64))
    cols = [np.concatenate(x) for x in zip(spans, rest[:3], strict=True)]
    mask = np.append(np.ones(len(spans[0]), bool), np.zeros(len(rest[0]), bool))
    anchors = pa.array(np.append(np.zeros(len(spans[0]), np.int64), rest[3]), pa.int64(), mask=mask)
    return pa.Table.from_arrays([*[pa.array(c, pa.int64()) for c in cols], anchors], schema=_FOUND)


def _cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, wanted runs) -> the runs' bytes."""
    for t in batches(it, 8 << 20):
        rows = []
        for doc, raw, wanted in zip(t.column("doc").to_pylist(), _coded(t.column("text")), t.column("wanted").to_pylist(), strict=True):
            rows += [(w["anchor"], doc, w["begin"], raw[w["begin"] : w["end"]]) for w in wanted]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["anchor", "doc", "begin", "bytes"])


def transform(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rotation order, preceding symbols in it) of a cyclic text, by prefix doubling from the first
    four symbols."""
    n = len(text)
    wide = text.astype(np.uint32)
    first = (wide << np.uint32(24)) | (np.roll(wide, -1) << np.uint32(16)) | (np.roll(wide, -2) << np.uint32(8)) | np.roll(wide, -3)
    order = np.argsort(first, kind="stable")
    rank, k = np.empty(n, np.int64), 4
    rank[order] = np.maximum.accumulate(np.where(np.append(True, first[order][1:] != first[order][:-1]), np.arange(n), 0))
    # only places whose rank is still shared are sorted again
    while k < n:
        sorted_rank = rank[order]
        same = sorted_rank[1:] == sorted_rank[:-1]
        shared = np.append(False, same) | np.append(same, False)
        if not shared.any():
            break
        at = np.flatnonzero(shared)
        who = order[at]
        own, after = sorted_rank[at], rank[(who + k) % n]
        by = np.lexsort((after, own))
        who, own, after = who[by], own[by], after[by]
        order[at] = who
        new = np.append(True, (own[1:] != own[:-1]) | (after[1:] != after[:-1]))
        lead = np.append(True, own[1:] != own[:-1])
        # a rank is the number of smaller entries
        place = np.arange(len(who))
        head = np.maximum.accumulate(np.where(lead, place, 0))
        start = np.maximum.accumulate(np.where(new, place, 0))
        fresh = rank.copy()
        fresh[who] = own + (start - head)
        rank, k = fresh, 2 * k
    return order, text[order - 1]


def interleave(columns: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge transforms by refinement: the entries (shard, row) that share a prefix of ``rounds``
    symbols without a 0 with another one, in merged order, and the block of each. A round puts
    SYMBOLS symbols at once before a prefix, the last rounds one each."""
    shard = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    symbols = np.concatenate(columns)
    base = np.cumsum([0, *[len(c) for c in columns]])
    # where a row goes when its preceding symbol is put before it, shard by shard
    step = np.empty(len(symbols), np.int32)
    for s, c in enumerate(columns):
        step[base[s] + np.argsort(c, kind="stable")] = base[s] + np.arange(len(c))
    wide, far, ends = symbols.astype(np.uint32), step, symbols == 0
    for i in range(1, SYMBOLS):
        wide |= symbols[far].astype(np.uint32) << np.uint32(8 * i)
        ends = ends | (symbols[far] == 0)
        far = step[far]
    wide[ends] = 0
    values, place = np.unique(wide, return_inverse=True)
    wide = place.astype(np.uint16) if len(values) < 1 << 16 else place  # two bytes are sorted by counting
    if values[0]:
        wide += 1
    row, block = np.arange(len(symbols), dtype=np.int32), np.zeros(len(symbols), np.int32)
    for column, to in [(wide, far)] * (rounds // SYMBOLS) + [(symbols, step)] * (rounds % SYMBOLS):
        before = column[row]
        inside = np.flatnonzero(before)  # a 0 ends a run
        order = inside[np.argsort(before[inside], kind="stable")]
        symbol, old = before[order], block[order]
        new = np.append(True, (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1]))[: len(order)]
        more = np.flatnonzero(~(new & np.append(new[1:], True)[: len(order)]))
        block = np.cumsum(new, dtype=np.int32)[more]
        row = to[row[order[more]]]
    return shard[row], row - base[shard[row]], block


def _merge(table: pa.Table) -> pa.Table:
    """Runs of one bucket -> spans of strings that start earlier in another run. Equal strings lie in
    runs of one anchor, so anchors are merged in groups of about TOGETHER bytes, and the time of a
    bucket is in proportion to its bytes."""
    anchor = table.column("anchor").to_numpy()
    by = np.argsort(anchor, kind="stable")
    parts, doc, begin = table.column("bytes").to_pylist(), table.column("doc").to_numpy()[by], table.column("begin").to_numpy()[by]
    parts = [parts[i] for i in by]
    heads = np.flatnonzero(np.append(True, np.diff(anchor[by]) != 0))
    room = np.cumsum([len(x) + 1 for x in parts])[np.append(heads[1:], len(parts)) - 1] // TOGETHER
    cuts = [0, *heads[1:][np.diff(room) > 0].tolist(), len(parts)]
    found = [_strings(parts[a:z], doc[a:z], begin[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]
    spans = _joined(*[np.concatenate(x) for x in zip(*found, strict=True)])
    return pa.table({"doc": pa.array(spans[0], pa.int64()), "begin": pa.array(spans[1], pa.int64()), "end": pa.array(spans[2], pa.int64())})


def _strings(parts: list[bytes], doc: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of strings of runs that start earlier in another of the runs, by merged transforms."""
    group = np.arange(len(parts)) * SHARDS // len(parts)
    columns, places = [], []
    for s in range(SHARDS):
        who = np.flatnonzero(group == s)
        if not len(who):
            continue
        size = np.array([len(parts[i]) + 1 for i in who])
        text = np.frombuffer(b"\0".join([*[parts[i] for i in who], b""]), np.uint8) + np.uint8(1)  # UTF-8 has no byte above 0xF4
        text[np.cumsum(size) - 1] = 0  # ends of runs are a symbol of their own
        order, before = transform(text)
        run = np.repeat(who, size)
        off = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
        columns.append(before)
        places.append((run[order], off[order]))
    shard, row, block = interleave(columns, LENGTH)
    run, off = np.empty(len(shard), np.int64), np.empty(len(shard), np.int64)
    for s, (r, o) in enumerate(places):
        run[shard == s], off[shard == s] = r[row[shard == s]], o[row[shard == s]]
    d, at = doc[run], begin[run] + off
    order = np.lexsort((at, d, block))
    d, at, block = d[order], at[order], block[order]
    later = np.append(False, block[1:] == block[:-1])[: len(block)]
    # the first of its block stays, and so does the same place seen twice
    head = np.flatnonzero(~later)[np.cumsum(~later) - 1]
    later &= (d != d[head]) | (at != at[head])
    return _joined(d[later], at[later], at[later] + LENGTH)


def repeats(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc, begin, end): byte spans whose strings start earlier; they may overlap."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "suffixes")
    plain = texts(docs).where(F.col("doc_id").isNotNull())
    hot = spark.sparkContext.broadcast(frequent_anchors(plain, scratch))
    buckets = 4 * width(spark)
    runs = plain.mapInArrow(_runs(buckets, hot), _RUNS)
    found = scratch.keep(runs.groupBy("bucket").applyInArrow(_settle, _FOUND_SQL), "found", free=True)
    wanted = found.where("anchor is not null").groupBy("doc").agg(F.collect_list(F.struct("anchor", "begin", "end")).alias("wanted"))
    cut = scratch.keep(wanted.join(plain, F.col("doc") == F.col("doc_id")).select("doc", "text", "wanted").mapInArrow(_cut, "anchor long, doc long, begin long, bytes binary"), "cut", free=True)
    merged = cut.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(buckets))).applyInArrow(_merge, "doc long, begin long, end long")
    merged = scratch.keep(merged, "merged", free=True)
    scratch.drop("cut")
    return found.where("anchor is null").select("doc", "begin", "end").unionByName(merged)


def _strip(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches(it, 8 << 20):
        rows = []
        for doc, raw, spans in zip(t.column("doc_id").to_pylist(), _coded(t.column("text")), t.column("spans").to_pylist(), strict=True):
            gone, merged = 0, []
            for s in sorted((s["begin"], s["end"]) for s in spans or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append([s[0], min(s[1], len(raw))])
            kept, here = [], 0
            for a, z in merged:
                kept.append(raw[here:a])
                gone += z - a
                here = z
            rows.append((doc, len(raw), gone, len(merged), hashlib.sha256(b"".join([*kept, raw[here:]])).hexdigest()))
        kinds = (pa.int64(),) * 4 + (pa.string(),)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def stripped(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per document."""
    spans = repeats(docs, scratch).groupBy("doc").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    joined = texts(docs).join(spans, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stripped(documents(spark, sf_dir))
