"""Shared plumbing of the training-data operators: scratch tables, input shaping, word ids.

Scratch tables live in the folder that the session names in ``spark.checkpoint.dir`` (shared by
driver and executors); where that is unset a local folder is made and set for a local session, as
in tests, and a cluster's session is refused.
A table written there is read back as plain Parquet, so lineage is cut and lost executors only
cost the tasks that they held.
"""

from __future__ import annotations

import atexit
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findwell.sources.shared import shared_dir

#: Words of a text: runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch sent to Python; bounds a worker's memory when texts are long.
ARROW_ROWS = 512


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of one operator run in the shared folder; ``drop`` frees those no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/findwell/{name}-{uuid.uuid4().hex}"
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        atexit.register(self._close)

    def _close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                _remove(self.spark, self.root)
        except Exception:  # the session has ended: nothing left to ask
            pass

    def keep(self, df: DataFrame, name: str, free: bool = False) -> DataFrame:
        """Write ``df`` as a table and return the reread table. ``free``: large shuffles lie behind
        it, whose files can go now."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        if free:
            del df
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()  # Spark drops the files of shuffles that are garbage
        return out

    def drop(self, name: str) -> None:
        _remove(self.spark, f"{self.root}/{name}")


def width(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Only (doc_id long, text string), null texts empty: whatever else the table holds cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def batches(it, most: int = 16 << 20):
    """Arrow record batches of (doc_id, text, ...) gathered into tables of about ``most`` bytes."""
    held, size = [], 0
    for b in it:
        if b.num_rows == 0:
            continue
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


_M = np.uint64(0xFF51AFD7ED558CCD)
_N = np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> _S)
    x = x * _M
    x ^= x >> _S
    x = x * _N
    x ^= x >> _S
    return x


_ODD = np.uint64(0x9E3779B97F4A7C15)


def grams(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of word ids, in order; empty when there are fewer than k words."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = ids[:n].copy()
    for j in range(1, k):
        acc = acc * _ODD
        acc ^= ids[j : j + n] + (acc >> np.uint64(29))
    return mix(acc)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, remembered by rounded-up length."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        out = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[size] = (out[0], out[1])
    return _POWERS[size]


#: Bytes hashed at a time: bounds the arrays that a very long text needs.
_BLOCK = 1 << 20


class Words:
    """The words of several texts as hashes, found without a Python object for each.

    ``hash``: one 64-bit hash a word; ``begin``, ``end``: its bytes in ``raw``, the UTF-8 of all
    texts with a line end after each; ``first``: the index of each text's first word, and after
    them the number of words; ``base``: each text's first byte.
    """

    def __init__(self, texts: list[str]):
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        joined = b"\n".join([*coded, b""])
        self.raw = np.frombuffer(joined, np.uint8)
        self.base = np.cumsum([0, *[len(c) + 1 for c in coded]])
        cuts = [0]
        while cuts[-1] < len(self.raw):  # blocks end with white space, so that no word is cut
            at = min(cuts[-1] + _BLOCK, len(self.raw)) - 1
            cuts.append(at + 1 + int(_SPACE[self.raw[at:]].argmax()))
        found = [self._block(a, z) for a, z in zip(cuts, cuts[1:], strict=False)]
        self.begin, self.end, self.hash = (np.concatenate(x) if found else np.zeros(0, k) for x, k in zip(zip(*found, strict=True) if found else ((),) * 3, (np.int64, np.int64, np.uint64), strict=True))
        self.first = np.searchsorted(self.begin, self.base)

    def _block(self, a: int, z: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, hash) of the words in one block of ``raw``."""
        raw = self.raw[a:z]
        edge = np.flatnonzero(np.diff((~_SPACE[raw]).astype(np.int8), prepend=np.int8(0)))
        begin, end = edge[0::2], edge[1::2]
        up, down = _powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
        h = (sums[end] - sums[begin]) * down[begin]
        return begin + a, end + a, mix(h ^ ((end - begin).astype(np.uint64) << np.uint64(40)))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of k-grams, place of each text's first): those that cross texts are left out.
        A text of 1 to k - 1 words has none."""
        g = grams(self.hash, k)
        n = np.maximum(np.diff(self.first) - (k - 1), 0)
        keep = np.repeat(self.first[:-1], n) + _ramp(n)
        return g[keep], np.cumsum([0, *n])


def _ramp(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ..."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)


def _forest(it):
    """Edges (a, b) of a batch -> (node, the least node that it is connected with in the batch)."""
    for t in batches(it, 8 << 20):
        a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        label = np.arange(len(nodes))
        while True:
            new = label.copy()
            low = np.minimum(label[x], label[y])
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
        own = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own], pa.int64()), pa.array(nodes[label[own]], pa.int64())], names=["a", "b"])


def components(edges: DataFrame, scratch: Scratch, name: str, rounds: int | None = None) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a long, b long), but for those joined with themselves
    only: the smallest node that a node is connected with. Batches of edges are first reduced to
    stars; then each round takes the least label among neighbours, then that label's own. Ending
    after so many ``rounds`` leaves some components in several parts."""
    stars = edges.select("a", "b").mapInArrow(_forest, "a long, b long")
    both = scratch.keep(stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-both")
    labels = scratch.keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        own = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        new = scratch.keep(low.join(own, "label").select("node", F.least("label", "jump").alias("label"), "old"), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        labels = new.select("node", "label")
        if step == rounds or not new.where("label < old").limit(1).count():
            scratch.drop(f"{name}-both")
            return labels
