"""Operator 8. Document fingerprints by winnowing, in DataFrame functions only.

A text's words (runs of anything but ASCII white space) are hashed, every ``K`` consecutive word
hashes become one gram hash, and in every window of ``WINDOW`` consecutive grams the smallest is
kept, the rightmost of equals. So any run of ``K + WINDOW - 1`` words that two texts share puts a
gram of that run into both fingerprints. A fingerprint is the kept grams in order of place, each
one 64-bit number in hexadecimal: the gram's leading 36 bits over 28 bits of inverted place, so
that the smallest number is the smallest gram and, among equals, the rightmost.

Likeness is the Jaccard index of the gram hashes of two fingerprints.

A text's successor in doc_id order comes from a window over range buckets whose bounds are
approximate quantiles, as many as four for each shuffle partition; the rows without an id, and those
of an id so frequent that it is several of the bounds, are dealt over ``PARTS`` buckets by the text's
hash. Each bucket is closed by a copy of the next bucket's first row, so the texts are shuffled once
and never gathered.

Defined cases: null text is empty; a text of fewer than ``K`` words has one gram, of all its words
(none: the hash of nothing); the last document's successor is the first, a single document's is
itself; repeated rows are separate documents, ties of doc_id ordered by a hash of the text; null
doc_ids come first; a very long text is one fingerprint (places beyond 2**28 words would clash); an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findwell.llm.common import documents, texts, width

K = 5
WINDOW = 8
PLACE_BITS = 28
#: Buckets that rows of one frequent id, or without any, are dealt over: a power of two.
PARTS = 16
_ALL = 1 << 30


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def winnow(text: Column) -> Column:
    """The kept grams of a text, in order of place, as packed 64-bit numbers."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def grams(h: Column) -> Column:
        last = F.greatest(F.size(h) - K, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.shiftleft(F.shiftright(F.xxhash64(*[F.get(h, i + j) for j in range(K)]), PLACE_BITS), PLACE_BITS).bitwiseOR(F.lit((1 << PLACE_BITS) - 1) - i.cast("long")))

    def least(a: Column, by: int) -> Column:
        return _let(a, lambda v: F.zip_with(v, F.slice(v, by + 1, F.greatest(F.size(v) - by, F.lit(0))), lambda x, y: F.least(x, y)))

    def windows(g: Column) -> Column:
        full = least(least(least(g, 1), 2), 4)  # minima of 8, shorter at the end
        return F.array_distinct(F.slice(full, 1, F.greatest(F.size(g) - (WINDOW - 1), F.lit(1))))

    return _let(hashes, lambda h: _let(grams(h), windows))


def gram_set(kept: Column) -> Column:
    return F.array_distinct(F.transform(kept, lambda x: F.shiftright(x, PLACE_BITS)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two gram sets."""
    return _let(F.size(F.array_intersect(a, b)).cast("double"), lambda both: both / (F.size(a) + F.size(b) - both))


def shown(kept: Column) -> Column:
    return F.array_join(F.transform(kept, lambda x: F.hex(x)), " ")


def _bucketed(t: DataFrame, buckets: int) -> DataFrame:
    """Adds ``bucket``, in the order of doc_id (null first) and h: by the number of quantile bounds
    not above doc_id, found by binary search, and within a frequent id's by leading bits of h."""
    q = F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10_000).alias("q")
    found = t.agg(q).first()["q"] or []
    bounds = sorted(set(found))
    often = [v for v in bounds if found.count(v) > 1]
    part = F.shiftright("h", 64 - PARTS.bit_length() + 1).cast("int") + PARTS // 2
    own = F.lit(0)
    if bounds:
        listed = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
        steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))])
        own = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(listed, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at))
    own = own * (PARTS + 1) + F.when(F.col("doc_id").isin(often), part).otherwise(PARTS)
    return t.withColumn("bucket", F.when(F.col("doc_id").isNull(), part - (PARTS + 1)).otherwise(own))


def with_next(t: DataFrame) -> tuple[DataFrame, Window]:
    """(doc_id, text, next, ...) in a window by bucket; ``tail`` rows only close their bucket."""
    spark = t.sparkSession
    t = _bucketed(t.withColumn("h", F.xxhash64("text")), max(2, 4 * width(spark))).withColumn("tail", F.lit(0))
    # the first row of each bucket: ids and hashes first, then the few texts that belong to them
    least = t.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "h")).alias("low"))
    first = {r["bucket"]: (r["low"]["doc_id"], r["low"]["h"]) for r in least.collect()}
    order = sorted(first)
    after = [(b, nxt, *first[nxt]) for b, nxt in zip(order, order[1:] + order[:1], strict=True)]
    wanted = spark.createDataFrame(after, "home int, source int, low long, low_h long")
    heads = t.join(F.broadcast(wanted), (F.col("bucket") == F.col("source")) & F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("h") == F.col("low_h")))
    tails = heads.groupBy("home").agg(F.min("text").alias("text")).select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("h"), F.col("home").alias("bucket"), F.lit(1).alias("tail"))
    spec = Window.partitionBy("bucket").orderBy(F.col("tail"), F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("text"))
    return t.unionByName(tails).withColumn("next", F.lead("text").over(spec)), spec


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: n_chars, edited_sha256, both fingerprints and the two likenesses."""
    t, spec = with_next(texts(docs))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.when(F.col("tail") == 0, F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.col("next").substr(F.lit(1), cut)))
    t = t.select("bucket", "tail", "doc_id", "h", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    t = t.select("bucket", "tail", "doc_id", "h", "text", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), winnow(F.col("text")).alias("kept"), winnow(F.col("edited")).alias("edited_kept"))
    t = t.withColumn("next_kept", F.lead("kept").over(spec)).where("tail = 0")
    t = t.select("doc_id", "n_chars", "edited_sha256", "kept", "edited_kept", gram_set(F.col("kept")).alias("a"), gram_set(F.col("edited_kept")).alias("b"), gram_set(F.col("next_kept")).alias("c"))
    return t.select("doc_id", "n_chars", "edited_sha256", shown(F.col("kept")).alias("fingerprint"), shown(F.col("edited_kept")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
