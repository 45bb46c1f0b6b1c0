"""Operator 9. Nearest neighbours by an NN-descent graph and greedy search in it.

Equal vectors are one class, known by its smallest vec_id and its ``TOP + 1`` smallest members
(more can never be among one query's nearest ``TOP``). The graph joins classes. It starts from
random-hyperplane cells, and from cells that are random altogether, cut into chunks of bounded
size, so that every class begins with ``DEGREE`` neighbours if there are so many. Then iterative
joins improve it: the neighbours of each node, forward and reverse, meet in one row, and every pair
of them that is nearer than the farthest neighbour the first one has is proposed as an edge, until
few edges change or ``DESCENTS`` rounds have passed.

A query starts from its own class's neighbours, forward and reverse. Round after round the best
``BEAM`` classes found so far that have not been expanded yet are joined with their rows of the
packed graph (neighbours with their vectors), and what is nearer than the beam's last joins the
beam. The beam's best ``FINAL`` are scored on the original vectors in double precision.

Graph and search use 32-bit floats; the reported scores double precision. 8 bits of the largest
component's range are too coarse where one vector is long or many lie close together. Work grows with
vectors times degree squared, and with queries times beam: never with queries times vectors.

Defined cases: vectors that are null, zero, hold a null or non-finite component, or differ in
length from the commonest length take no part, as queries or candidates; rows repeated with the
same vec_id are candidates of each other's like any other rows; ties among what is found go to the
smaller vec_id; fewer candidates than ``TOP`` are all returned; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findwell.llm.common import Scratch

TOP = 20
DEGREE = 40
BEAM = 160
HOPS = 5
CELL = 600
#: Tables of hyperplane cells; one more table of random cells follows them.
TABLES = 3
DESCENTS = 9
#: Descent ends when a round changes less than this share of the edges.
SETTLED = 0.01
FINAL = 64


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    rows = rows.where((F.size("v") > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == common[0]["d"]) if common else rows


def _first(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key; partial limits run before the shuffle."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def _packer(scale: float):
    """Vectors as bytes of 32-bit floats; ``scale``, a power of two, keeps products finite."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                q = (v * scale).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x.tobytes() for x in q], pa.binary())], names=["id", "q"])

    return run


def _vectors(column, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(n, -1) if n else np.zeros((0, 1), np.float32)


def _cells(planes: np.ndarray):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            x = _vectors(b.column("q"), b.num_rows)
            for t in range(planes.shape[0]):
                bits = (x @ planes[t] > 0).astype(np.int64)
                cell = bits @ (1 << np.arange(bits.shape[1], dtype=np.int64)) if bits.shape[1] else np.zeros(b.num_rows, np.int64)
                if t == TABLES:
                    cell[:] = 0
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(cell, pa.int64()), b.column("id"), b.column("q")], names=["t", "cell", "id", "q"])

    return run


def _within(table: pa.Table) -> pa.Table:
    """All of a chunk against all of it: each one's nearest."""
    ids, n = table.column("id").to_numpy(), table.num_rows
    x = _vectors(table.column("q"), n)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    k = min(DEGREE, n - 1)
    if k <= 0:
        return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "sim": pa.array([], pa.float32())})
    at = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return pa.table({"src": np.repeat(ids, k), "dst": ids[at].ravel(), "sim": np.take_along_axis(s, at, 1).ravel().astype(np.float32)})


def _meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of one node meet: pairs nearer than the last that the first of them has."""
    for b in it:
        m = b.column("m")
        flat = m.flatten()
        ids, thr = flat.field("id").to_numpy(), flat.field("thr").to_numpy()
        x = _vectors(flat.field("q"), len(ids))
        offsets = np.cumsum([0, *[len(r) for r in m]])
        src, dst, sim = [], [], []
        for a, z in zip(offsets[:-1], offsets[1:], strict=True):
            s = x[a:z] @ x[a:z].T
            np.fill_diagonal(s, -np.inf)
            i, j = np.nonzero(s > thr[a:z, None])
            src.append(ids[a:z][i])
            dst.append(ids[a:z][j])
            sim.append(s[i, j])
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst)), pa.array(np.concatenate(sim).astype(np.float32))], names=["src", "dst", "sim"])


_EDGE = "src long, dst long, sim float"


def _nearest(edges: DataFrame) -> DataFrame:
    """At most DEGREE distinct edges of each source, nearest first kept."""
    return _first(edges.groupBy("src", "dst").agg(F.max("sim").alias("sim")), ["src"], [F.desc("sim"), F.col("dst")], DEGREE)


def both_ways(graph: DataFrame) -> DataFrame:
    """A node's forward neighbours and its nearest reverse ones, at most DEGREE each."""
    back = _first(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim"), ["src"], [F.desc("sim"), F.col("dst")], DEGREE)
    return graph.unionByName(back).groupBy("src", "dst").agg(F.max("sim").alias("sim"))


def descend(vectors: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """The neighbour graph (src, dst, sim) of (id, q)."""
    dim = len(vectors.first()["q"]) // 4
    bits = max(0, math.ceil(math.log2(max(1, n / (CELL / 2)))))
    planes = np.random.default_rng(7).standard_normal((TABLES + 1, dim, bits)).astype(np.float32)
    celled = scratch.keep(vectors.mapInArrow(_cells(planes), "t int, cell long, id long, q binary"), "cells")
    chunks = celled.groupBy("t", "cell").agg(F.ceil(F.count("*") / CELL).alias("chunks"))
    chunk = F.pmod(F.xxhash64("id", "t"), F.col("chunks"))
    edges = celled.join(chunks, ["t", "cell"]).withColumn("chunk", chunk).groupBy("t", "cell", "chunk").applyInArrow(_within, _EDGE)
    graph = scratch.keep(_nearest(edges), "graph0", free=True)
    for step in range(1, DESCENTS + 1):
        far = graph.groupBy("src").agg(F.when(F.count("*") >= DEGREE, F.min("sim")).otherwise(F.lit(-math.inf)).cast("float").alias("thr")).withColumnRenamed("src", "id")
        known = vectors.join(far, "id", "left").select("id", "q", F.coalesce("thr", F.lit(-math.inf).cast("float")).alias("thr"))
        members = both_ways(graph).select("src", F.col("dst").alias("id")).join(known, "id").groupBy("src").agg(F.collect_list(F.struct("id", "thr", "q")).alias("m")).select("m")
        new = scratch.keep(_nearest(graph.unionByName(members.mapInArrow(_meet, _EDGE))), f"graph{step}", free=True)
        changed = new.join(graph.select("src", "dst"), ["src", "dst"], "left_anti").count()
        scratch.drop(f"graph{step - 1}")
        graph = new
        if changed < SETTLED * n * DEGREE:
            break
    return graph


def _expand(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, q, thr, to) -> (src, dst, sim) for the neighbours in ``to`` nearer than thr."""
    for b in it:
        m = b.column("to")
        flat = m.flatten()
        sizes = np.array([len(r) for r in m])
        row = np.repeat(np.arange(b.num_rows), sizes)
        sim = np.einsum("ij,ij->i", _vectors(flat.field("q"), len(row)), _vectors(b.column("q"), b.num_rows)[row])
        src, dst = b.column("src").to_numpy()[row], flat.field("id").to_numpy()
        ok = (sim > b.column("thr").to_numpy()[row]) & (src != dst)
        yield pa.RecordBatch.from_arrays([pa.array(src[ok]), pa.array(dst[ok]), pa.array(sim[ok])], names=["src", "dst", "sim"])


def walk(starts: DataFrame, vectors: DataFrame, graph: DataFrame, scratch: Scratch) -> DataFrame:
    """Greedy search from the nodes ``starts`` (id): the best FINAL (src, dst, sim) found for each."""
    lists = both_ways(graph).join(vectors, F.col("dst") == F.col("id")).groupBy(F.col("src").alias("at")).agg(F.collect_list(F.struct("id", "q")).alias("to"))
    lists = scratch.keep(lists, "lists", free=True)
    order = [F.desc("sim"), F.col("dst")]
    back = graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim")
    near = graph.unionByName(back).join(starts.withColumnRenamed("id", "src"), "src", "left_semi").distinct()
    beam = scratch.keep(_first(near, ["src"], order, BEAM).withColumn("done", F.lit(False)), "beam0", free=True)
    own = vectors.join(starts, "id", "left_semi").withColumnRenamed("id", "src")
    for hop in range(1, HOPS + 1):
        thr = beam.groupBy("src").agg(F.when(F.count("*") >= BEAM, F.min("sim")).otherwise(F.lit(-math.inf)).cast("float").alias("thr"))
        front = beam.where("not done").select("src", F.col("dst").alias("at")).join(own.join(thr, "src"), "src")
        found = front.join(lists, "at").select("src", "q", "thr", "to").mapInArrow(_expand, _EDGE).withColumn("done", F.lit(False))
        both = beam.withColumn("done", F.lit(True)).unionByName(found).groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.max("done").alias("done"))
        beam = scratch.keep(_first(both, ["src"], order, BEAM), f"beam{hop}", free=True)
        scratch.drop(f"beam{hop - 1}")
        if not beam.where("not done").limit(1).count():
            break
    return _first(beam.select("src", "dst", "sim"), ["src"], order, FINAL)


def search(rows: DataFrame, every: int = 20, scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for the queries, rows whose vec_id is divisible by ``every``."""
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark, "neighbours")
    hashed = usable(rows).select("vec_id", "v", F.xxhash64("v").alias("h1"), F.hash(F.reverse("v")).alias("h2"))
    firsts = _first(hashed.select("vec_id", "h1", "h2", F.pmod(F.hash("vec_id"), F.lit(64)).alias("salt")), ["h1", "h2", "salt"], [F.col("vec_id")], TOP + 1)
    members = scratch.keep(_first(firsts.drop("salt"), ["h1", "h2"], [F.col("vec_id")], TOP + 1), "members")
    classes = members.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"))
    first_of = hashed.join(classes, ["h1", "h2"]).where("vec_id = id")
    nodes = scratch.keep(first_of.dropDuplicates(["id"]).select("id", "v", "h1", "h2"), "nodes")
    n = nodes.count()
    out = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], out)
    queries = hashed.where(F.col("vec_id") % every == 0).join(classes, ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), F.col("id"))
    starts = queries.select("id").distinct()
    largest = nodes.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0]
    vectors = scratch.keep(nodes.select("id", "v").mapInArrow(_packer(math.ldexp(1.0, min(1000, -math.frexp(largest)[1]))), "id long, q binary"), "vectors")
    beam = walk(starts, vectors, descend(vectors, n, scratch), scratch)
    beam = beam.select("src", "dst").where("src <> dst").unionByName(starts.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    a, b = nodes.select(F.col("id").alias("src"), F.col("v").alias("x")), nodes.select(F.col("id").alias("dst"), F.col("v").alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    scored = scratch.keep(beam.join(a, "src").join(b, "dst").select("src", "dst", dot.alias("score")), "scored")
    ids = members.join(classes, ["h1", "h2"]).select(F.col("id").alias("dst"), "vec_id")
    spread = _first(scored.join(ids, "dst"), ["src"], [F.desc("score"), F.col("vec_id")], TOP + 1)
    ranked = queries.join(spread, queries["id"] == spread["src"]).where("vec_id != query_id")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= TOP).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
