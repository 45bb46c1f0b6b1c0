"""Operator 5. Mixing sources to target weights by balanced (cube-method) sampling.

A source's target is a share of all words; every document of the source is taken
floor(target / source size) times, and once more with the fractional rest as inclusion
probability. The cube method's flight phase moves these probabilities to 0 or 1 along the null
space of two balancing constraints, words and documents, in bounded blocks of a source; what
each block leaves undecided, two documents at most, meets in the next level's blocks, until one
block of a source is left and its last two documents are landed with the least error in words.

Rows alike in doc_id, source and text are counted together first and then numbered, so each is a
document of its own in a block chosen by id, text and number: neither a null id nor a repeated row,
however frequent, fills a block, and the outcome depends on the rows alone.

Defined cases: null text has size 0 and is never taken; a source of size 0 has target 0; null
sources are one source, the last; null doc_ids and repeated rows are separate documents; a very
long text is one document of its size; an empty table gives no rows; other columns are ignored.
Draws are seeded from the block, so reruns agree.

The table of sources (name, size) comes to the driver: it is as long as there are sources, not
documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findwell.llm.common import WORD_PATTERN, Scratch, documents

#: Most times that a document may be taken.
MOST = 3
#: Documents that one block of the flight phase holds, about.
BLOCK = 4096
_NEAR = 1e-9


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Words wanted of each source: weights 1, 2, 3, repeating, in code-point order, null last."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    free, left = list(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > MOST * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = float(MOST * sizes[s])
            left -= MOST * sizes[s]
        free = [s for s in free if s not in out]
    return out


def fly(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> list[int]:
    """Flight phase: changes ``p`` in place, keeping sum(p) and sum(p * size) until at most two
    places are undecided; returns these. Longer documents go first, so short ones are left."""
    order = np.lexsort((np.arange(len(p)), -size)).tolist()
    s, q, draws, d = size.tolist(), p.tolist(), rng.random(len(p) + 1).tolist(), 0
    held: list[int] = []
    for nxt in order:
        if q[nxt] < _NEAR or q[nxt] > 1 - _NEAR:
            q[nxt] = float(round(q[nxt]))
            continue
        held.append(nxt)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        if u == (0, 0, 0):
            u = (1, -1, 0)
        up = min((1 - q[i]) / v if v > 0 else q[i] / -v for i, v in zip(held, u, strict=True) if v)
        down = min(q[i] / v if v > 0 else (1 - q[i]) / -v for i, v in zip(held, u, strict=True) if v)
        step = up if draws[d] * (up + down) < down else -down
        d += 1
        for i, v in zip(held, u, strict=True):
            x = q[i] + step * v
            q[i] = 0.0 if x < _NEAR else 1.0 if x > 1 - _NEAR else x
        held = [i for i in held if 0.0 < q[i] < 1.0]
    p[:] = q
    return held


def land(size: np.ndarray, p: np.ndarray, left: list[int]) -> None:
    """Decide the last places so that the words taken are nearest to those wanted."""
    want = sum(size[i] * p[i] for i in left)
    best = min(range(1 << len(left)), key=lambda m: (abs(sum(size[i] for k, i in enumerate(left) if m >> k & 1) - want), m))
    for k, i in enumerate(left):
        p[i] = float(best >> k & 1)


_KEY = ["doc_id", "none", "h", "k"]
_STATE = "doc_id long, none boolean, h long, k long, src int, blocks long, size long, whole int, p double"


def _level(seed: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        src, block = int(key[0]), int(key[1])
        pdf = pdf.sort_values(["size", *_KEY], kind="stable").reset_index(drop=True)
        size, p = pdf["size"].to_numpy(np.int64), pdf["p"].to_numpy(np.float64).copy()
        left = fly(size, p, np.random.default_rng([seed, src, block]))
        if pdf["blocks"].iloc[0] == 1:
            land(size, p, left)
        pdf["p"] = p
        return pdf[[*_KEY, "src", "blocks", "size", "whole", "p"]]

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """What decides about a document: doc_id (0 where there is ``none``), text hash h, source, size."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNull().alias("none"), F.xxhash64(text).alias("h"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("size"))


def mix(docs: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, list[tuple]]:
    """(decisions, sources): one row per document with doc_id, none, h, src, size, copies; the
    sources as (src, name, size, target) by place in code-point order."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mixing")
    alike = scratch.keep(_keyed(docs).groupBy("doc_id", "none", "h", "source", "size").agg(F.count("*").alias("n")), "alike")
    found = alike.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n")).collect()
    sizes = {r["source"]: int(r["size"]) for r in found}
    rows = {r["source"]: int(r["n"]) for r in found}
    wanted = targets(sizes)
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    share = [(s, i, wanted[s] / sizes[s] if sizes[s] else 0.0, -(-rows[s] // BLOCK)) for i, s in enumerate(names)]
    plan = spark.createDataFrame(share, "name string, src int, share double, blocks long")
    state = alike.join(plan, alike["source"].eqNullSafe(plan["name"])).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select(
        *_KEY, "src", "blocks", "size", F.floor("share").cast("int").alias("whole"), F.when(F.col("size") > 0, F.col("share") - F.floor("share")).otherwise(0.0).alias("p")
    )
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    parts, level = [state.where(~open_)], 0
    state = state.where(open_)
    while True:
        block = F.pmod(F.xxhash64(*_KEY, F.lit(level)), F.col("blocks"))
        done = scratch.keep(state.withColumn("block", block).groupBy("src", "block").applyInPandas(_level(level), _STATE), f"level{level}")
        parts.append(done.where(~open_))
        left = {r["src"]: r["n"] for r in done.where(open_).groupBy("src").agg(F.count("*").alias("n")).collect()}
        if not left:
            break
        level += 1
        blocks = F.lit(1)
        for src, n in left.items():
            blocks = F.when(F.col("src") == src, F.lit(-(-n // BLOCK))).otherwise(blocks)
        state = done.where(open_).withColumn("blocks", blocks.cast("long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    decided = out.select("doc_id", "none", "h", "src", "size", (F.col("whole") + F.col("p").cast("int")).alias("copies"))
    return decided, [(i, s, sizes[s], wanted[s]) for i, s in enumerate(names)]


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided, sources = mix(documents(spark, sf_dir))
    table = spark.createDataFrame([(i, size, target) for i, _, size, target in sources], "src int, source_size long, target double")
    doc_id = F.when(~F.col("none"), F.col("doc_id")).alias("doc_id")
    return decided.join(table, "src").select(doc_id, "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: each as often as decided, all columns kept. Rows alike in
    doc_id, source and text are taken equally often; where that leaves a rest, one of them more."""
    scratch = Scratch(spark, "mixing")
    decided, sources = mix(docs, scratch)
    names = spark.createDataFrame([(i, s) for i, s, _, _ in sources], "src int, name string")
    total = decided.groupBy("doc_id", "none", "h", "src").agg(F.sum("copies").alias("total"), F.count("*").alias("n")).where("total > 0").join(names, "src")
    whole = F.floor(F.col("total") / F.col("n")).cast("int")
    taken = total.select(F.col("doc_id").alias("__fw_id"), F.col("none").alias("__fw_none"), F.col("h").alias("__fw_h"), F.col("name").alias("__fw_source"), whole.alias("__fw_times"), (F.col("total") - whole * F.col("n")).alias("__fw_rest"))
    taken = scratch.keep(taken, "taken", free=True)
    text, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    keyed = docs.withColumns({"__fw_a": F.coalesce(doc_id, F.lit(0)), "__fw_b": doc_id.isNull(), "__fw_c": F.xxhash64(text), "__fw_d": F.col("source").cast("string")})
    same = (F.col("__fw_a") == F.col("__fw_id")) & (F.col("__fw_b") == F.col("__fw_none")) & (F.col("__fw_c") == F.col("__fw_h")) & F.col("__fw_d").eqNullSafe(F.col("__fw_source"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    out = keyed.join(taken.where("__fw_times > 0"), same).withColumn("__fw_time", F.explode(F.sequence(F.lit(1), F.col("__fw_times")))).select(*own)
    if not taken.where("__fw_rest > 0").limit(1).count():
        return out
    packed = F.struct(*[x.alias(f"c{i}") for i, x in enumerate(own)]).alias("__fw_row")
    more = keyed.join(taken.where("__fw_rest > 0"), same).groupBy("__fw_a", "__fw_b", "__fw_c", "__fw_d").agg(F.first(packed).alias("__fw_row"), F.first("__fw_rest").alias("__fw_rest"))
    more = more.withColumn("__fw_time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__fw_rest").cast("long"))))
    return out.unionByName(more.select(*[F.col(f"__fw_row.c{i}").alias(c) for i, c in enumerate(docs.columns)]))
