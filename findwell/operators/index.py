"""The persisted inverted index: postings and vocabulary tables, and searches that read only them.

``opened`` keeps the index of a table in the shared folder, made when it is first asked for and again
when the table's files have changed.

Postings are dealt by token, those of one token over several partitions, and sorted by token and path
within them, so a query's equality on token prunes pages by their statistics; prefix and fuzzy clauses are first resolved against the
vocabulary, which is small, and only the terms found are looked up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findwell.functions.text import literal_tokens, within_edits
from findwell.operators.search import Documents
from findwell.plans.compile import K1, B, Stats
from findwell.plans.query import Clause, Fuzzy, Phrase, Prefix, QueryError, SearchRequest, Term, expanded, parse
from findwell.sources.shared import shared_dir


#: Rows of one Arrow batch of texts, and partitions that the postings of one token are dealt over.
BATCH, SPREAD = 512, 16


def _postings(paths: list[str]):
    """(id, one line of tokens for each path) -> postings. A row holds all of a text, so its tokens
    are grouped where they are: no place of a token is shuffled by itself."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, path in enumerate(paths):
                lines = b.column(f"t{i}")
                kept = pc.and_kleene(lines.is_valid(), pc.not_equal(lines, ""))
                ids, lists = b.column("id").filter(kept), pc.split_pattern(lines.filter(kept), " ")
                if not len(lists):
                    continue
                sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
                rows, words = np.repeat(np.arange(len(sizes)), sizes), lists.flatten().dictionary_encode()
                keys = rows * len(words.dictionary) + words.indices.to_numpy()
                order = np.argsort(keys, kind="stable")  # places of a token stay in order
                starts = np.flatnonzero(np.diff(keys[order], prepend=-1))
                first, ends = order[starts], np.append(starts[1:], len(order))
                places = (np.arange(len(rows)) - (np.cumsum(sizes) - sizes)[rows])[order].astype(np.int32)
                row = rows[first]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path]).take(pa.array(np.zeros(len(row), np.int64))), words.dictionary.take(words.indices.take(pa.array(first))), ids.take(pa.array(row)),
                        pa.array(ends - starts), pa.array(sizes[row].astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)).astype(np.int32)), pa.array(places)),
                    ],
                    names=["path", "token", "id", "tf", "len", "positions"],
                )

    return run


def build(docs: Documents, paths: list[str], where: str, partitions: int | None = None) -> None:
    """Write postings, vocab and path_stats below ``where``. Texts are split once."""
    spark = docs.df.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * docs.df.rdd.getNumPartitions())
    lines = docs.df.select(docs.id.alias("id"), *[F.array_join(docs.fields[p].tokens, " ").alias(f"t{i}") for i, p in enumerate(paths)])
    kind = lines.schema["id"].dataType.simpleString()
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, str(BATCH))
    try:
        postings = lines.mapInArrow(_postings(paths), f"path string, token string, id {kind}, tf long, len int, positions array<int>")
        dealt = postings.repartition(n, "path", "token", F.pmod(F.xxhash64("id"), F.lit(SPREAD)))
        dealt.sortWithinPartitions("token", "path", "id").write.mode("overwrite").parquet(f"{where}/postings")
    finally:
        spark.conf.set(batch, before)
    written = spark.read.parquet(f"{where}/postings")
    written.groupBy("path", "token").agg(F.count("*").alias("df"), F.sum("tf").alias("n")).sortWithinPartitions("token", "path").write.mode("overwrite").parquet(f"{where}/vocab")
    held = [f.value if f.stored_tokens is None else f.stored_tokens for f in (docs.fields[p] for p in paths)]
    counts = docs.df.agg(F.count("*").alias("all"), *[F.count(h).alias(f"c{i}") for i, h in enumerate(held)]).first()
    sums = {r["path"]: r["n"] for r in spark.read.parquet(f"{where}/vocab").groupBy("path").agg(F.sum("n").alias("n")).collect()}
    stats = [(p, counts["all"], sums.get(p, 0) / counts[f"c{i}"]) for i, p in enumerate(paths) if counts[f"c{i}"]]
    spark.createDataFrame(stats, "path string, n_docs long, mean_len double").coalesce(1).write.mode("overwrite").parquet(f"{where}/path_stats")


class Index:
    def __init__(self, spark: SparkSession, where: str):
        self.postings, self.vocab, self.path_stats = (spark.read.parquet(f"{where}/{t}") for t in ("postings", "vocab", "path_stats"))

    def tokens_of(self, node) -> list[tuple[str, int]]:
        """(token, df) that a leaf stands for, from the vocabulary."""
        v = self.vocab.where(F.col("path") == node.path.removeprefix("document."))
        if isinstance(node, Term):
            v = v.where(F.col("token") == node.text.lower())
        elif isinstance(node, Prefix):
            v = v.where(F.col("token").startswith(node.text))
        elif isinstance(node, Fuzzy):
            v = v.where(within_edits(F.col("token"), node.text, node.edits))
        else:
            raise QueryError(f"the index answers terms, prefixes and fuzzy terms, not {type(node).__name__}")
        return [(r["token"], r["df"]) for r in v.select("token", "df").collect()]

    def stats(self, terms: list[tuple[str, str]]) -> Stats:
        """Statistics for the compiler without reading a document."""
        lens = {r["path"]: (r["n_docs"], r["mean_len"]) for r in self.path_stats.collect()}
        cond = F.lit(False)
        for p, t in terms:
            cond = cond | ((F.col("path") == p) & (F.col("token") == t))
        df = {(r["path"], r["token"]): r["df"] for r in self.vocab.where(cond).collect()}
        return Stats(max((n for n, _ in lens.values()), default=0), {p: m for p, (_, m) in lens.items()}, df)

    def any_of(self, path: str, terms: list[str] | dict[str, float], b: float = B) -> DataFrame:
        """(id, score) of documents with any of the terms, each with its boost, by BM25 from the
        postings alone."""
        boosts = terms if isinstance(terms, dict) else dict.fromkeys(terms, 1.0)
        terms = sorted(boosts)
        stats = self.stats([(path, t) for t in terms])
        idf = F.lit(0.0)
        for t in terms:
            idf = F.when(F.col("token") == t, F.lit(boosts[t] * stats.idf(path, t))).otherwise(idf)
        norm = K1 * (1 - b + b * F.col("len") / F.lit(stats.mean_len.get(path, 1.0)))
        hit = self.postings.where((F.col("path") == path) & F.col("token").isin(terms))
        return hit.groupBy("id").agg(F.sum(idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("score"))

    def phrase(self, path: str, words: list[str]) -> DataFrame:
        """(id, tf) of documents with the words next to each other: positions shifted to the first
        word's and counted, one aggregation by (id, place)."""
        place = {}
        for i, w in enumerate(words):
            place.setdefault(w, []).append(i)
        shifts = F.array().cast("array<int>")
        for w, at in place.items():
            shifts = F.when(F.col("token") == w, F.array(*[F.lit(i) for i in at])).otherwise(shifts)
        hit = self.postings.where((F.col("path") == path) & F.col("token").isin(sorted(place)))
        starts = hit.select("id", F.explode("positions").alias("pos"), shifts.alias("s")).select("id", "pos", F.explode("s").alias("i")).select("id", (F.col("pos") - F.col("i")).alias("at"))
        return starts.groupBy("id", "at").count().where(F.col("count") == len(words)).groupBy("id").agg(F.count("*").alias("tf"))

    def answer(self, node, b: float = B) -> DataFrame:
        """(id, score) of the documents that match a tree of terms, phrases, prefixes and fuzzy terms,
        scored as a scan scores them."""
        if isinstance(node, Clause):
            return self._clause(node, b)
        path = (node.path or "").removeprefix("document.")
        if isinstance(node, (Prefix, Fuzzy)):
            found = [t for t, _ in self.tokens_of(node)]
            hit = self.postings.where((F.col("path") == path) & F.col("token").isin(found))
            return hit.select("id").distinct().withColumn("score", F.lit(float(node.boost)))
        if not isinstance(node, (Term, Phrase)) or getattr(node, "slop", 0) or getattr(node, "prefix", False):
            raise QueryError(f"the index does not answer {node}")
        words = literal_tokens(node.text)
        if len(words) == 1:
            return self.any_of(path, {words[0]: node.boost}, b)
        stats = self.stats([(path, w) for w in words])
        sizes = self.postings.where((F.col("path") == path) & (F.col("token") == words[0])).select("id", "len") if words else None
        if sizes is None:
            return self.postings.select("id").limit(0).withColumn("score", F.lit(0.0))
        weight = node.boost * sum(stats.idf(path, w) for w in words)
        norm = K1 * (1 - b + b * F.col("len") / F.lit(stats.mean_len.get(path, 1.0)))
        return self.phrase(path, words).join(sizes, "id").select("id", (F.lit(weight) * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("score"))

    def _clause(self, node: Clause, b: float) -> DataFrame:
        """Terms of one leaf that may each stand alone are read together, in one pass."""
        alone: dict[str, dict[str, float]] = {}
        parts: list[tuple[DataFrame, bool]] = []
        for n in node.should:
            words = literal_tokens(n.text) if isinstance(n, Term) else []
            if len(words) == 1:
                own = alone.setdefault((n.path or "").removeprefix("document."), {})
                own[words[0]] = own.get(words[0], 0.0) + n.boost
            else:
                parts.append((self.answer(n, b), False))
        parts += [(self.any_of(p, t, b), False) for p, t in alone.items()] + [(self.answer(n, b), True) for n in node.must]
        if not parts:
            raise QueryError("the index answers no clause that only excludes")
        if len(parts) == 1:
            out = parts[0][0]
        else:
            both = None
            for df, must in parts:
                own = df.withColumn("must", F.lit(int(must)))
                both = own if both is None else both.unionByName(own)
            out = both.groupBy("id").agg(F.sum("score").alias("score"), F.sum("must").alias("must")).where(F.col("must") == len(node.must)).drop("must")
        for n in node.must_not:
            out = out.join(self.answer(n, b), "id", "left_anti")
        return out.withColumn("score", F.col("score") * F.lit(float(node.boost))) if node.boost != 1 else out

    def hits(self, request: SearchRequest, digits: int | None = None) -> DataFrame:
        """(id, score): the page asked for, best first, ties by id."""
        found = self.answer(parse(expanded(request)))
        found = found if digits is None else found.withColumn("score", F.round("score", digits))
        return found.orderBy(F.desc("score"), "id").offset(request.offset).limit(request.limit)


def opened(docs: Documents, paths: list[str], table: str) -> Index:
    """The index of ``docs``, which are read from ``table``."""
    spark = docs.df.sparkSession
    files = spark.read.parquet(table).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("n"), F.col("_metadata.file_modification_time").cast("string").alias("t")).distinct()
    state = files.agg(F.sum(F.xxhash64("f", "n", "t").cast("decimal(38,0)")).cast("string").alias("s")).first()["s"]
    name = hashlib.sha256("|".join([table, str(state), *paths]).encode()).hexdigest()[:24]
    where = f"{shared_dir(spark)}/findwell/index-{name}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/path_stats/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build(docs, paths, where)
    return Index(spark, where)
