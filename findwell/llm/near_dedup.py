"""Operator 2. Near-duplicates by a containment ensemble of MinHash indexes.

A document is the set of its five-word shingles (lower case; a shorter text is one shingle, of all
its words). Two documents are linked when the larger set is contained in the smaller by at least
``T`` = 0.8 of itself; then so is the smaller in the larger. (A short text lying wholly inside a
much longer one is not a copy of it, so classes cannot chain different long texts through it.)

Documents are partitioned by set size into powers of two; a document near a partition's upper end
is also a guest of the next one, so that every pair that can be linked shares a partition. For each
partition the containment threshold becomes the least Jaccard index that a linked pair of its
sizes can have, and banding is tuned to that. Documents with the same words in order are one node
from the start, whatever their number.

In every band bucket one node, the centre, meets all others. Then, where a bucket still holds
several classes, every member outside its largest class meets every member, in blocks of at most
``BLOCK`` by ``BLOCK`` compared as arrays in one worker: no pair is written unless two sketches (the least shingle of each
of ``BINS`` bins, a byte each) leave room for a link, which turns away a linked pair with a
probability below 3e-4, less than banding does; and of these only as many a member as a round
takes, the likest first; the next round goes on from there. What is written is checked on whole
shingle sets, between blocks of about ``CHUNK`` texts, before it links anything. So copies of one text cost a check each, not one for each pair, no group is
gathered, and every pair that shares a bucket has been compared or is in one class.

Nodes are 64-bit content hashes. Defined cases: null text is empty and all empty texts are one
class; null doc_ids are documents whose class_id is null only if no member has an id; repeated
rows share a class; one doc_id with different texts is several documents; a very long text is one
set like any other, read in blocks; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findwell.llm.common import Scratch, Words, batches, components, documents, mix, texts, width

K = 5
T = 0.8
HASHES = 60
RECALL = 0.999
#: Members of a bucket, on either side, that one comparison takes.
BLOCK = 512
#: Rows that one worker takes at a time in comparing blocks, about.
GROUP = 50_000
#: Texts of a block of the exact check.
CHUNK = 64
#: Partners of a member that a round adds: up to these places of its list, then all.
ROUNDS = (16, 256, 1 << 30)
#: Bins of a sketch.
BINS = 128
#: Standard deviations by which a sketch may fall short of a linked pair's.
SLACK = 3.5


def least_jaccard(low: int, high: int, t: float = T) -> float:
    """The least Jaccard index of a linked pair of set sizes within low..high."""
    least = 1.0
    for b in range(low, min(high, low + 64) + 1):
        need = math.ceil(t * b - 1e-9)
        for a in range(max(low, need), b + 1):
            least = min(least, need / (a + b - need))
    return least


def tune(jaccard: float, hashes: int = HASHES) -> tuple[int, int]:
    """(rows, bands): the most selective banding that finds pairs of this index with RECALL."""
    for rows in range(min(hashes, 12), 0, -1):
        bands = hashes // rows
        if 1 - (1 - jaccard**rows) ** bands >= RECALL:
            return rows, bands
    return 1, hashes


def family(p: int, t: float = T) -> tuple[int, int, int]:
    """(least size, rows, bands) of the partition of sizes 2**p .. 2**(p+1)-1 with its guests."""
    low = max(1, math.ceil(t * (1 << p) - 1e-9))
    return low, *tune(least_jaccard(low, (2 << p) - 1, t))


_FAMILIES = [family(p) for p in range(31)]
_rng = np.random.default_rng(11)
_A = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


class Shingles:
    """Distinct shingle hashes of several texts, and a content hash of each text's words."""

    def __init__(self, texts_: list[str]):
        w = Words([t.lower() for t in texts_])
        g, first = w.grams(K)
        n = np.diff(w.first)
        self.sets: list[np.ndarray] = []
        self.node = np.zeros(len(texts_), np.int64)
        weights = np.uint64(0x9E3779B97F4A7C15)
        # order-dependent sum of word hashes, by text
        place = np.arange(len(w.hash), dtype=np.uint64) - np.repeat(w.first[:-1], n).astype(np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(w.hash + mix((place + np.uint64(1)) * weights)), dtype=np.uint64)])
        whole = mix((sums[w.first[1:]] - sums[w.first[:-1]]) ^ n.astype(np.uint64))
        self.node = whole.view(np.int64)
        for i in range(len(texts_)):
            self.sets.append(np.unique(g[first[i] : first[i + 1]]) if n[i] >= K else whole[i : i + 1])


_SIGNED = "doc_id long, h long, node long, size int, sketch binary, bands array<long>"


def _sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches(it, 4 << 20):
        s = Shingles(t.column("text").to_pylist())
        sizes = np.array([len(x) for x in s.sets])
        flat = (np.concatenate(s.sets) >> np.uint64(32)).astype(np.uint32)
        at = np.cumsum([0, *sizes[:-1]])
        sig = np.stack([np.minimum.reduceat(flat * a + b, at) for a, b in zip(_A, _B, strict=True)], axis=1).astype(np.uint64)
        keys: list[list[np.ndarray]] = [[] for _ in sizes]
        own = np.floor(np.log2(sizes)).astype(int)
        for p in np.unique(np.concatenate([own, own + 1])).tolist():
            low, rows, bands = _FAMILIES[p]
            who = np.flatnonzero((own == p) | ((own == p - 1) & (sizes >= low)))
            if not len(who):
                continue
            h = np.full((len(who), bands), p + 1, np.uint64) * np.uint64(1 << 32) + np.arange(bands, dtype=np.uint64)
            for r in range(rows):
                h = mix(h ^ sig[who, r : rows * bands : rows])
            for i, k in zip(who.tolist(), h, strict=True):
                keys[i].append(k)
        bands_ = [np.concatenate(k).view(np.int64) for k in keys]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(k) for k in bands_]]).astype(np.int32)), pa.array(np.concatenate(bands_)))
        cols = [t.column("doc_id").combine_chunks(), t.column("h").combine_chunks(), pa.array(s.node), pa.array(sizes.astype(np.int32)), pa.array([x.tobytes() for x in sketches(s.sets)], pa.binary()), lists]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "h", "node", "size", "sketch", "bands"])


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BINS bytes for each sorted set: of each bin its least shingle's mark, 0 for none."""
    flat, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    out = np.zeros(len(sets) * BINS, np.uint8)
    place = doc * BINS + (flat % np.uint64(BINS)).astype(np.int64)
    out[place[::-1]] = ((flat[::-1] >> np.uint64(20)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)  # the first, the least, comes last
    return out.reshape(len(sets), BINS)


def may_link(na: np.ndarray, nb: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether sets of these sizes and sketches may be linked, estimated Jaccard index)."""
    need = np.ceil(T * np.maximum(na, nb) - 1e-9)
    j = need / np.maximum(na + nb - need, 1)
    used = np.maximum(((x | y) > 0).sum(axis=1), 1)
    found = ((x == y) & (x > 0)).sum(axis=1) / used
    return (np.minimum(na, nb) >= T * np.maximum(na, nb) - 1e-9) & (found >= j - SLACK * np.sqrt(j * (1 - j) / used) - 1e-9), found


def _sketches(column, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, BINS)


_PAIR = "a long, b long, p long, q long"


def _alike(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, blocks p and q, sizes, sketches) -> pairs that may be linked."""
    for t in it:
        if t.num_rows:
            na, nb = (t.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            ok = pa.array(may_link(na, nb, _sketches(t.column("sa"), t.num_rows), _sketches(t.column("sb"), t.num_rows))[0])
            yield pa.RecordBatch.from_arrays([t.column(c).filter(ok) for c in "abpq"], names=[*"abpq"])


def _blocks(first: int, last: int):
    """Blocks of one group -> of each x its possible partners at places first..last of its list, and
    (x, null) where the list goes on."""

    def run(table: pa.Table) -> pa.Table:
        key, xb, yb, node, comp, home = (table.column(c).to_numpy() for c in ("key", "xb", "yb", "node", "comp", "block"))
        size, side, sketch = table.column("size").to_numpy().astype(float), table.column("side").to_numpy(), _sketches(table.column("sketch"), table.num_rows)
        order = np.lexsort((node, side, yb, xb, key))
        new = np.flatnonzero((np.diff(key[order]) != 0) | (np.diff(xb[order]) != 0) | (np.diff(yb[order]) != 0)) + 1
        pairs, more = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
        for own in np.split(order, new):
            x, y = own[side[own] == 0], own[side[own] == 1]
            for i in range(0, len(x), 32):
                w = x[i : i + 32]
                a, b = np.nonzero(comp[w][:, None] != comp[y][None, :])
                ok, found = may_link(size[w[a]], size[y[b]], sketch[w[a]], sketch[y[b]])
                a, b, found = a[ok], b[ok], found[ok]
                by = np.lexsort((node[y[b]], -found, a))
                a, b = a[by], b[by]
                place = np.arange(len(a)) - np.searchsorted(a, a)
                take = (place >= first) & (place < last)
                pairs.append(np.stack([w[a[take]], y[b[take]]], axis=1))
                more.append(w[np.unique(a[place >= last])])
        two, rest = np.concatenate(pairs), np.concatenate(more)
        turned = node[two[:, 0]] > node[two[:, 1]]
        two[turned] = two[turned][:, ::-1]
        low, high = np.concatenate([two[:, 0], rest]), np.concatenate([two[:, 1], rest])
        none = np.arange(len(low)) >= len(two)
        return pa.table({"a": pa.array(node[low]), "b": pa.array(node[high], mask=none), "p": pa.array(home[low]), "q": pa.array(home[high])})

    return run


def _check(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(nodes with texts, pairs of them) -> linked pairs."""
    for b in it:
        out = []
        for nodes, pairs in zip(b.column("nodes").to_pylist(), b.column("pairs").to_pylist(), strict=True):
            s = dict(zip([m["node"] for m in nodes], Shingles([m["text"] for m in nodes]).sets, strict=True))
            for p in pairs:
                x, y = s[p["a"]], s[p["b"]]
                if len(np.intersect1d(x, y, assume_unique=True)) >= T * max(len(x), len(y)) - 1e-9:
                    out.append((p["a"], p["b"]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])


def _checked(pairs: DataFrame, by_node: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Those of ``pairs`` (a, b, blocks p and q) that are linked. A text travels once for each two
    blocks that meet."""
    used = pairs.select("p", "q", F.explode(F.array("a", "b")).alias("node")).distinct()
    shown = used.join(by_node, "node").groupBy("p", "q").agg(F.collect_list(F.struct("node", "text")).alias("nodes"))
    ready = pairs.groupBy("p", "q").agg(F.collect_list(F.struct("a", "b")).alias("pairs")).join(shown, ["p", "q"]).select("nodes", "pairs")
    return scratch.keep(ready.mapInArrow(_check, "a long, b long"), f"{name}-found", free=True)


def _joined(labels: DataFrame | None, links: DataFrame, scratch: Scratch, name: str, rounds: int | None = None) -> DataFrame:
    """``labels`` (node, label) after classes that ``links`` (a, b) connect are one; with ``rounds``
    some may still be several."""
    if labels is None:
        return components(links, scratch, name, rounds)
    return components(links.unionByName(labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))), scratch, name, rounds)


def _mixed(members: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of the buckets that hold several classes, with their class and whether it is not the
    bucket's largest (``minor``); the numbers of members and of minor ones of the bucket."""
    comp = members.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
    counts = comp.groupBy("key", "comp").agg(F.count("*").alias("n"))
    tops = counts.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n")).where("n > top.n")
    tops = tops.select("key", F.col("top.comp").alias("major"), "n", (F.col("n") - F.col("top.n")).alias("n_minor"))
    return scratch.keep(comp.join(tops, "key").withColumn("minor", F.col("comp") != F.col("major")).drop("major"), "mixed", free=True)


def _met(mixed: DataFrame, rows: int, first: int, last: int) -> DataFrame:
    """(a, b) by blocks; see ``_blocks``."""
    spread = lambda k: F.explode(F.sequence(F.lit(0), (k - 1).cast("int")))
    across, down = F.ceil(F.col("n_minor") / BLOCK), F.ceil(F.col("n") / BLOCK)
    block = lambda k, salt: F.pmod(F.xxhash64("node", F.lit(salt)), k).cast("int")
    rest = ["node", "block", "comp", "size", "sketch"]
    x = mixed.where("minor").select("key", block(across, 1).alias("xb"), spread(down).alias("yb"), F.lit(0).alias("side"), *rest)
    y = mixed.select("key", spread(across).alias("xb"), block(down, 2).alias("yb"), F.lit(1).alias("side"), *rest)
    groups = max(4 * width(mixed.sparkSession), -(-rows // GROUP))
    met = x.unionByName(y).groupBy(F.pmod(F.xxhash64("key", "xb", "yb"), F.lit(groups))).applyInArrow(_blocks(first, last), _PAIR)
    return met.distinct()


def _plain(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text's hash; id and hash stand for a document."""
    return texts(docs).withColumn("h", F.xxhash64("text"))


def classes(docs: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(signed, labels): (doc_id, h, node, size) per document; (node, label) for linked nodes."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "near-dedup")
    plain = _plain(docs)
    signed = scratch.keep(plain.select("doc_id", "h", "text").mapInArrow(_sign, _SIGNED), "signed")
    banded = scratch.keep(signed.select(F.explode("bands").alias("key"), "node").distinct(), "banded", free=True)
    full = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = scratch.keep(banded.join(full, "key"), "buckets", free=True)
    scratch.drop("banded")
    # one document stands for a node, and nodes that meet mostly share a block of the exact check
    home = buckets.groupBy("node").agg(F.min(F.struct("key", "n")).alias("home"))
    block = F.xxhash64("home.key", F.pmod(F.xxhash64("node"), F.ceil(F.col("home.n") / CHUNK))).alias("block")
    one = signed.groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("d"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    nodes = scratch.keep(one.join(home, "node").select("node", block, F.col("d.doc_id").alias("id"), F.col("d.h").alias("hash"), "size", "sketch"), "nodes", free=True)
    # texts of the nodes: this one shuffle of all texts is the same plan at every size
    chosen = plain.hint("merge").join(nodes.select("node", "id", "hash"), F.col("h").eqNullSafe(F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id")))
    by_node = scratch.keep(chosen.groupBy("node").agg(F.first("text").alias("text")), "texts", free=True)
    members = scratch.keep(buckets.select("key", "node").join(nodes.select("node", "block", "size", "sketch"), "node"), "members", free=True)
    scratch.drop("buckets")
    side = lambda x, p: [F.col("node").alias(x), F.col("block").alias(p), F.col("size").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")]
    order = F.struct(F.xxhash64("node").alias("o"), "node", "block", "size", "sketch")
    centres = members.groupBy("key").agg(F.min(order).alias("c")).select("key", "c.*").select("key", *side("a", "p"))
    star = members.select("key", *side("b", "q")).join(centres, "key").where("a <> b")
    pairs = scratch.keep(star.drop("key").mapInArrow(_alike, _PAIR).distinct(), "pairs0", free=True)
    links = _checked(pairs, by_node, scratch, "check0")
    labels, first = _joined(None, links, scratch, "join0", rounds=2), 0
    for step, last in enumerate(ROUNDS, 1):
        mixed = _mixed(members, labels, scratch)
        rows = mixed.agg(F.sum(F.ceil(F.col("n_minor") / BLOCK) + F.when(F.col("minor"), F.ceil(F.col("n") / BLOCK)).otherwise(0))).first()[0]
        if not rows:
            break
        met = scratch.keep(_met(mixed, rows, first, last), f"pairs{step}", free=True)
        found = _checked(met.where("b is not null"), by_node, scratch, f"check{step}")
        links = links.unionByName(found)
        if not met.where("b is null").limit(1).count():
            break
        labels, first = _joined(labels, found, scratch, f"join{step}", rounds=2), last
    labels = _joined(None, links, scratch, "join")
    for name in ("members", "mixed", "texts", "nodes"):
        scratch.drop(name)
    return signed.select("doc_id", "h", "node", "size"), labels


def named(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(signed, groups): (doc_id, h, node, size) per document, and each node's class_id, the least
    doc_id of its class, the hash of that document's text (the least, if it has several), and
    class_size."""
    signed, labels = classes(docs, scratch)
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("low")
    by_node = signed.groupBy("node").agg(low, F.count("*").alias("n"))
    rooted = scratch.keep(by_node.join(labels, "node", "left").select("node", "low", "n", F.coalesce("label", "node").alias("root")), "rooted")
    groups = rooted.groupBy("root").agg(F.min("low").alias("low"), F.sum("n").alias("class_size"))
    return signed, rooted.join(groups.withColumnRenamed("low", "first"), "root").select("node", F.col("first.doc_id").alias("class_id"), F.col("first.h").alias("class_h"), "class_size")


def classified(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), n_shingles, class_size per document."""
    signed, groups = named(docs, scratch or Scratch(docs.sparkSession, "near-dedup"))
    return signed.join(groups, "node").select("doc_id", "class_id", F.col("size").cast("long").alias("n_shingles"), F.col("class_size").cast("long").alias("class_size"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(documents(spark, sf_dir))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the smallest doc_id (one without an id only
    where none has one), of several texts under that id the one of least hash; a row repeated as a
    whole stays once."""
    scratch = Scratch(spark, "near-dedup")
    signed, groups = named(docs, scratch)
    first = groups.select("class_id", "class_h").distinct()
    count = signed.groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    kept = scratch.keep(count.join(first, F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("h") == F.col("class_h"))).select(F.col("doc_id").alias("__fw_id"), F.col("h").alias("__fw_h"), "n"), "kept", free=True)
    repeated = kept.where("n > 1").limit(1).count()
    for name in ("signed", "rooted"):
        scratch.drop(name)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns({"__fw_key": F.col("doc_id").cast("long"), "__fw_text": F.xxhash64(text)})
    out = keyed.join(kept, F.col("__fw_text").eqNullSafe(F.col("__fw_h")) & F.col("__fw_key").eqNullSafe(F.col("__fw_id")), "left_semi")
    if repeated:
        out = out.dropDuplicates(["__fw_key", "__fw_text"])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
