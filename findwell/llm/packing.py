"""Operator 1. Best-fit packing by a configuration linear program over the length histogram.

Documents are tokenised and only those longer than a sequence are cut. The histogram of piece
lengths, at most ``CAPACITY`` numbers, is all that the driver sees. There the covering program over
configurations (which lengths share a sequence) is solved by multiplicative weights: each round
prices lengths by their weights, finds the best configuration by knapsack dynamic programming over
the pieces there are, adds a fraction of it to the solution, and lowers the weights of the lengths
that it covers. The fractional solution is scaled to the demand and rounded down; the program is
solved again for what that leaves, and the last solution's largest fractions are rounded up.

Configurations name classes of lengths. Exact lengths are then drawn, the last ones of a sequence so
that they fill it, and a sequence that stays more than ``WASTE`` tokens short is taken apart. What
is left, with the shortest pieces (a share of ``MORTAR`` of all tokens, held back for this), is
placed into gaps and new sequences by best fit decreasing.

The plan is a list of (length, ranks, sequences, offset) segments whose size depends on the number
of distinct lengths only; it is broadcast, and each piece finds its place from its rank among the
pieces of its length. Ranks come from salted windows, so a length shared by a third of all pieces
is dealt over many tasks.

Defined cases: null or empty text is the end id alone; a very long text is cut into pieces of
``CAPACITY``; ties of length are placed by doc_id and piece; repeated rows are separate documents; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findwell.llm import tokens
from findwell.llm.common import Scratch, batches, documents, texts, width

CAPACITY = 4096
#: Lengths are priced in so many classes at most; drawing and filling use exact lengths.
CLASSES = 256
ROUNDS = 300
#: How fast the weight of a covered length falls.
RATE = 0.5
#: The program is solved for what rounding leaves so many times at most.
PASSES = 3
MORTAR = 0.02
WASTE = 4

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cutter(vocab, capacity: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("salt", pa.int32())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, size = tokens.encoder(vocab.value), np.asarray([tokens.END_ID], "<u4").tobytes(), 4 * capacity
        for b in batches(it, 4 << 20):
            cols: list[list] = [[], [], [], [], [], []]
            for d, x in zip(b.column(0).to_pylist(), enc.encode_batch(b.column(1).to_pylist()), strict=True):
                x = memoryview(x + end)
                for k, at in enumerate(range(0, len(x), size)):
                    part = x[at : at + size]
                    crc = zlib.crc32(part)
                    salt = (crc + len(cols[0])) & 0xFFFF  # rows alike in everything differ in place
                    for col, v in zip(cols, (d, k, at // 4, len(part) // 4, crc, salt), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def _copies(demand: np.ndarray, units: int) -> list[tuple[int, int]]:
    """(class, copies) such that choosing some of them gives any number within the demand."""
    out = []
    for c in np.flatnonzero(demand).tolist():
        n, k = min(int(demand[c]), units // c), 1
        while n > 0:
            k = min(k, n)
            out.append((c, k))
            n, k = n - k, 2 * k
    return out


def _knapsack(items: list[tuple[int, int]], price: np.ndarray, units: int) -> dict[int, int]:
    """The choice of ``items`` whose prices sum highest in ``units``; class c takes c units."""
    best, taken = np.zeros(units + 1), np.zeros((len(items), units + 1), bool)
    for i, (c, k) in enumerate(items):
        with_it = best[: units + 1 - c * k] + price[c] * k
        taken[i, c * k :] = better = with_it > best[c * k :] + 1e-12
        best[c * k :] = np.where(better, with_it, best[c * k :])
    room, out = units, {}
    for i in range(len(items) - 1, -1, -1):
        if taken[i, room]:
            c, k = items[i]
            out[c] = out.get(c, 0) + k
            room -= c * k
    return out


Configuration = tuple[tuple[int, int], ...]


def fractional(demand: np.ndarray, units: int) -> dict[Configuration, float]:
    """The covering program's solution by multiplicative weights: how often each configuration is
    used, scaled so that all uses together hold as many units as the demand."""
    items, live = _copies(demand, units), demand > 0
    cover, used = np.zeros(units + 1), {}
    for _ in range(ROUNDS if live.any() else 0):
        price = np.arange(units + 1) / units * np.exp(-RATE * (cover - cover[live].min()))
        conf = _knapsack(items, price, units)
        times = min(demand[c] / k for c, k in conf.items())
        key = tuple(sorted(conf.items()))
        used[key] = used.get(key, 0.0) + times
        for c, k in conf.items():
            cover[c] += times * k / demand[c]
        if cover[live].min() >= 3:
            break
    held = sum(x * sum(c * k for c, k in conf) for conf, x in used.items())
    scale = float((demand * np.arange(units + 1)).sum()) / held if held else 0.0
    return {conf: x * scale for conf, x in used.items()}


def configurations(demand: np.ndarray, units: int) -> list[tuple[dict[int, int], int]]:
    """(configuration, how often): the rounded solution, never beyond the demand."""
    left, used = demand.astype(np.int64).copy(), {}

    def take(conf: Configuration, times: int) -> int:
        times = int(min(times, *(left[c] // k for c, k in conf)))
        if times > 0:
            for c, k in conf:
                left[c] -= times * k
            used[conf] = used.get(conf, 0) + times
        return times

    for n in range(1, PASSES + 1):
        x = fractional(left, units)
        got = sum(take(conf, int(x[conf])) for conf in sorted(x, key=lambda c: (-x[c], c)))
        if n == PASSES or 2 * got < len(x):  # rounding down leaves too much for another pass
            for conf in sorted(x, key=lambda c: (-(x[c] % 1), c)):
                take(conf, 1)
            break
    return [(dict(conf), n) for conf, n in used.items()]


def _class(n, wide: int):
    """The class of a length, to the nearest; classes are numbered by their units."""
    return np.maximum(1, (n + wide // 2) // wide)


def _drawn(confs, hist: np.ndarray, capacity: int, wide: int) -> tuple[list[tuple[list[tuple[int, int]], int]], np.ndarray]:
    """Sequences of exact lengths for the configurations, and what is left over."""
    left, lengths = hist.copy(), {}
    for n in np.flatnonzero(hist).tolist():
        lengths.setdefault(int(_class(n, wide)), []).append(n)
    bins = []
    for conf, times in confs:
        order = [c for c, k in sorted(conf.items(), reverse=True) for _ in range(k)]
        while times > 0:
            for c in conf:
                lengths[c] = [n for n in lengths[c] if left[n]]
            low = [lengths[c][0] if lengths[c] else 0 for c in order]
            rest, room, drawn = sum(low), capacity, {}
            for c, least in zip(order, low, strict=True):
                rest -= least
                fits = [n for n in lengths[c] if n <= room and left[n] > drawn.get(n, 0)]
                if fits:  # the longest that leaves room for the shortest of the others
                    n = max((n for n in fits if n <= room - rest), default=fits[0])
                    drawn[n] = drawn.get(n, 0) + 1
                    room -= n
            if not drawn:
                break
            m = min(times, *(int(left[n]) // k for n, k in drawn.items()))
            if room <= WASTE:
                bins.append((sorted(drawn.items(), reverse=True), m))
                for n, k in drawn.items():
                    left[n] -= m * k
            times -= m
    return bins, left


def best_fit(hist: np.ndarray, bins: list[tuple[list[tuple[int, int]], int]], capacity: int):
    """Best fit decreasing on a histogram: place ``hist`` into the gaps of ``bins`` and new bins."""
    by_gap: list[list] = [[] for _ in range(capacity + 1)]
    rooms = np.zeros(capacity + 1, bool)

    def put(items, m):
        gap = capacity - sum(n * k for n, k in items)
        by_gap[gap].append((items, m))
        rooms[gap] = True

    for items, m in bins:
        put(items, m)
    for n in range(len(hist) - 1, 0, -1):
        count = int(hist[n])
        while count:
            at = n + int(rooms[n:].argmax())
            if not rooms[at]:
                per = capacity // n
                if count // per:
                    put([(n, per)], count // per)
                if count % per:
                    put([(n, count % per)], 1)
                break
            items, m = by_gap[at].pop()
            rooms[at] = bool(by_gap[at])
            k = min(at // n, count) if m == 1 else 1
            use = 1 if m == 1 else min(m, count)
            if m > use:
                by_gap[at].append((items, m - use))
                rooms[at] = True
            put([*items, (n, k)], use)
            count -= use * k
    return [b for group in by_gap for b in group]


def plan(hist: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Sequences as ([(length, pieces of it)], how many such sequences); hist[n]: pieces of length n."""
    hist = hist.astype(np.int64)
    wide = max(1, capacity // CLASSES)
    units, tokens_ = capacity // wide, np.cumsum(hist * np.arange(len(hist)))
    large = np.where(np.arange(len(hist)) < np.searchsorted(tokens_, MORTAR * tokens_[-1]), 0, hist)
    demand = np.zeros(units + 1, np.int64)
    np.add.at(demand, np.minimum(_class(np.arange(1, capacity + 1), wide), units), large[1 : capacity + 1])
    bins, left = _drawn(configurations(demand, units), large, capacity, wide)
    return best_fit(left + hist - large, bins, capacity)


def segments(bins) -> dict[str, np.ndarray]:
    """The plan as sorted arrays: a piece of length n and rank r lies in the last segment whose
    key is at most (n << 40) + r."""
    rows, ranks, seq = [], {}, 0
    for items, m in bins:
        offset = 0
        for n, k in items:
            r = ranks.get(n, 0)
            rows.append(((n << 40) + r, k, seq, offset))
            ranks[n] = r + k * m
            offset += n * k
        seq += m
    a = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("key", "per", "seq", "offset"), a.T.copy(), strict=True))


def _placer(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in it:
            n, r = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(p["key"], (n << 40) + r, "right") - 1
            r = r - (p["key"][at] & ((1 << 40) - 1))
            seq = p["seq"][at] + r // p["per"][at]
            offset = p["offset"][at] + r % p["per"][at] * n
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq, pa.int64()), pa.array(offset, pa.int64())], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocab: str | None = None, capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    vocab_ = spark.sparkContext.broadcast(vocab or tokens.vocabulary())
    pieces = scratch.keep(texts(docs).mapInArrow(_cutter(vocab_, capacity), f"{_PIECES}, salt int"), "pieces")
    hist = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        hist[r["length"]] = r["count"]
    shared = spark.sparkContext.broadcast(segments(plan(hist, capacity)))
    salted = pieces.withColumn("salt", F.pmod("salt", F.lit(4 * width(spark))))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    bases = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("own", own).join(bases, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("own") - 1).cast("long").alias("rank"))
    return ranked.mapInArrow(_placer(shared), f"{_PIECES}, sequence_id long, offset long")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that the mix kept, packed."""
    return pack(docs)
