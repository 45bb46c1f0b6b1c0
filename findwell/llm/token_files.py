"""Operator 7. Token files in patched frame-of-reference blocks.

A file image holds whole documents in ascending doc_id order: a header, the documents' ids and
token counts, an index of block starts, then blocks of ``BLOCK`` ids. A block stores its minimum,
a bit width chosen at a percentile of the differences, the packed differences and a list of
exceptions (place, high part) for the values that the width cannot hold.

Images are rows of a Parquet table, at a path of the caller's or in the shared folder, so writing and
reading need nothing but Spark's own file systems; an image never exceeds ``IMAGE_IDS`` ids unless
one document does. ``read_block`` reads one block of one image through the index.

Defined cases: null or empty text is one end id; repeated rows are separate documents; ties of
doc_id are ordered by a hash of the text, so that no null or repeated id fills a task (rows alike
in both are dealt over neighbouring tasks); null doc_ids come first; a very long text is a document
of one image like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findwell.llm import tokens
from findwell.llm.common import Scratch, batches, documents, texts, width

BLOCK = 4096
PERCENTILE = 90
IMAGE_IDS = 1 << 20
MAGIC = b"PFR1"
_NULL = -(1 << 63)


def _pack(v: np.ndarray, w: int) -> bytes:
    """v (rows x BLOCK) at w bits each, row by row."""
    if w == 0:
        return b""
    bits = np.empty((*v.shape, w), np.uint8)
    for b in range(w):
        bits[..., b] = (v >> np.uint32(b)) & np.uint32(1)
    return np.packbits(bits.reshape(v.shape[0], -1), axis=1, bitorder="little").tobytes()


def _unpack(data: np.ndarray, w: int) -> np.ndarray:
    """The inverse, for rows of packed bytes."""
    out = np.zeros((data.shape[0], BLOCK), np.uint32)
    if w:
        bits = np.unpackbits(data, axis=1, bitorder="little").reshape(data.shape[0], BLOCK, w)
        for b in range(w):
            out |= bits[..., b].astype(np.uint32) << np.uint32(b)
    return out


def write_image(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One file image of whole documents."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, ids[-1] if n else 0, np.uint32)
    padded[:n] = ids
    v = padded.reshape(blocks, BLOCK)
    low = v.min(axis=1) if blocks else np.zeros(0, np.uint32)
    v = v - low[:, None]
    at = np.percentile(v, PERCENTILE, axis=1, method="higher").astype(np.uint32) if blocks else low
    widths = np.array([int(x).bit_length() for x in at], np.uint8)
    packed: list[bytes] = [b""] * blocks
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        data, size = _pack(v[rows], int(w)), BLOCK * int(w) // 8
        for i, r in enumerate(rows):
            packed[r] = data[i * size : (i + 1) * size]
    high = v >> widths[:, None].astype(np.uint32) if blocks else v
    body, starts, here = [], [], 0
    for r in range(blocks):
        where = np.flatnonzero(high[r]).astype("<u2")
        piece = struct.pack("<IBH", int(low[r]), int(widths[r]), len(where)) + packed[r] + where.tobytes() + high[r][where].astype("<u4").tobytes()
        starts.append(here)
        here += len(piece)
        body.append(piece)
    head = MAGIC + struct.pack("<QQQ", len(doc_ids), n, blocks)
    return b"".join([head, doc_ids.astype("<i8").tobytes(), counts.astype("<u8").tobytes(), np.asarray(starts, "<u8").tobytes(), *body])


class Image:
    """A file image opened for reading; ``block`` reads any one block through the index."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        self.data = data
        n_docs, self.n_ids, self.n_blocks = struct.unpack_from("<QQQ", data, 4)
        at = 28
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        self.counts = np.frombuffer(data, "<u8", n_docs, at + 8 * n_docs)
        self.starts = np.frombuffer(data, "<u8", self.n_blocks, at + 16 * n_docs)
        self.body = at + 16 * n_docs + 8 * self.n_blocks

    def _head(self, r: int) -> tuple[int, int, int, int]:
        at = self.body + int(self.starts[r])
        return *struct.unpack_from("<IBH", self.data, at), at + 7

    def block(self, r: int) -> np.ndarray:
        return self._blocks([r])[0]

    def _blocks(self, which) -> np.ndarray:
        heads = [self._head(r) for r in which]
        out = np.empty((len(heads), BLOCK), np.uint32)
        for w in {h[1] for h in heads}:
            rows, size = [i for i, h in enumerate(heads) if h[1] == w], BLOCK * w // 8
            raw = np.frombuffer(b"".join(self.data[heads[i][3] : heads[i][3] + size] for i in rows), np.uint8).reshape(len(rows), size)
            out[rows] = _unpack(raw, w)
        for i, (low, w, n, at) in enumerate(heads):
            at += BLOCK * w // 8
            where = np.frombuffer(self.data, "<u2", n, at)
            out[i, where] |= np.frombuffer(self.data, "<u4", n, at + 2 * n) << np.uint32(w)
            out[i] += np.uint32(low)
        return out

    def ids(self) -> np.ndarray:
        return self._blocks(range(self.n_blocks)).reshape(-1)[: self.n_ids]


_IMAGE = "part int, seq int, seg_start long, n_ids long, image binary"


def _writer(vocab):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = tokens.encoder(vocab.value), TaskContext.get().partitionId()
        end = np.asarray([tokens.END_ID], "<u4").tobytes()
        ids, docs, counts, held, seq, before = [], [], [], 0, 0, 0

        def image():
            data = np.frombuffer(b"".join(ids), "<u4")
            out = write_image(np.asarray(docs, np.int64), np.asarray(counts, np.int64), data)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "seg_start": pa.array([before], pa.int64()), "n_ids": pa.array([len(data)], pa.int64()), "image": pa.array([out], pa.binary())})

        for b in batches(it, 4 << 20):
            for d, x in zip(b.column(0).to_pylist(), enc.encode_batch(b.column(1).to_pylist()), strict=True):
                x += end
                if held and held + len(x) // 4 > IMAGE_IDS:
                    yield image()
                    seq, before = seq + 1, before + held
                    ids, docs, counts, held = [], [], [], 0
                ids.append(x)
                docs.append(_NULL if d is None else d)
                counts.append(len(x) // 4)
                held += len(x) // 4
        if held:
            yield image()

    return run


def _reader(bases: dict[int, int]):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part, seg, data in zip(b.column("part").to_pylist(), b.column("seg_start").to_pylist(), b.column("image"), strict=True):
                f = Image(data.as_py())
                raw = memoryview(f.ids().astype("<u4").tobytes())
                ends = np.cumsum(f.counts.astype(np.int64))
                begins = ends - f.counts.astype(np.int64)
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(begins.tolist(), ends.tolist(), strict=True)]
                ids = pa.array(f.doc_ids, pa.int64(), mask=f.doc_ids == _NULL)
                yield pa.RecordBatch.from_arrays([ids, pa.array(begins + (bases[part] + seg)), pa.array(f.counts.astype(np.int64)), pa.array(crc, pa.int64())], schema=schema)

    return run


def write_token_files(docs: DataFrame, vocab: str | None = None, scratch: Scratch | None = None, path: str | None = None) -> DataFrame:
    """Encode ``docs`` and write file images in ascending doc_id order, to ``path`` where they stay or
    else to a scratch table. One shuffle of the texts by range; each task then encodes and writes its
    range, holding one image at a time."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "token-files")
    shared = spark.sparkContext.broadcast(vocab or tokens.vocabulary())
    dealt = texts(docs).select("doc_id", F.xxhash64("text").alias("h"), (F.monotonically_increasing_id() % 1024).alias("k"), "text")
    ordered = dealt.repartitionByRange(width(spark), "doc_id", "h", "k").sortWithinPartitions("doc_id", "h", "text")
    images = ordered.select("doc_id", "text").mapInArrow(_writer(shared), _IMAGE)
    if path is None:
        return scratch.keep(images, "images")
    images.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_block(images: DataFrame, part: int, seq: int, block: int) -> np.ndarray:
    """The ids of one block of one image, found by the index of block starts."""
    f = Image(images.where((F.col("part") == part) & (F.col("seq") == seq)).first()["image"])
    return f.block(block)[: f.n_ids - block * BLOCK]


def read_token_files(images: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, decoded from the files. Only one total for
    each written part comes to the driver."""
    totals = {r["part"]: r["n"] for r in images.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    bases, here = {}, 0
    for part in sorted(totals):
        bases[part] = here
        here += totals[part]
    return images.select("part", "seg_start", "image").mapInArrow(_reader(bases), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(documents(spark, sf_dir)))
