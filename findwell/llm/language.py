"""Operator 6. Language identification by compression.

For each language a zstandard dictionary of raw content is made from a bounded, hash-chosen
sample of labelled texts. A text is folded to lower-case letters and single spaces, cut into
blocks of ``BLOCK`` bytes so that the dictionaries, not the text's own past, decide, and every
block of it is compressed with each dictionary. The language with the fewest bytes wins; the
margin to the second is the score, and a margin below ``MARGIN`` is a rejection.

Documented bounds of the fit: about ``SAMPLE`` texts a language, none longer than ``LONGEST``
characters, and ``DICTIONARY`` bytes of folded text each. They come to the driver, so its memory bounds the number of
languages. Prediction reads whole texts, however long.

Defined cases: null text, or text without a letter, is ``und`` with score 0; only non-null labels
are learned; a tie goes to the first language in order, with score 0; with one learned language
the score is 1; with none every document is ``und``; a null doc_id is not held out; repeated rows
are separate documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findwell.llm.common import Scratch, batches, documents

SAMPLE = 300
LONGEST = 20_000
DICTIONARY = 64 << 10
LEVEL = 5
BLOCK = 1024
#: Relative margins below this are rejected.
MARGIN = 0.002
NONE = "und"

#: Anything but letters. (Digits, fractions, numbered signs and marks are none.)
_OTHER = regex.compile(r"\P{L}+")


def fold(text: str) -> bytes:
    """Lower-case letters, runs of anything else as one space, a space at either end."""
    return (" " + _OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-8", "surrogatepass")


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame) -> dict[str, bytes]:
    """language -> dictionary content, from labelled documents that are not held out."""
    text = F.col("text").cast("string")
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & text.isNotNull()).select(F.col("lang").cast("string").alias("lang"), text.alias("text"), F.xxhash64(text).alias("h"))
    rows = rows.where(F.length("text").between(1, LONGEST))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return {}
    grain = 1 << 30
    part = F.lit(0)
    for lang, n in counts.items():
        part = F.when(F.col("lang") == lang, F.lit(min(grain, int(grain * SAMPLE / max(n, 1)) + 1))).otherwise(part)
    chosen = rows.where(F.pmod("h", F.lit(grain)) < part).groupBy("lang", "h").agg(F.first("text").alias("text")).collect()
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in chosen:
        texts.setdefault(r["lang"], []).append((r["h"] % grain, r["text"]))
    return {lang: b"".join(fold(t) for _, t in sorted(found))[:DICTIONARY] for lang, found in sorted(texts.items())}


def _compressors(contents: dict[str, bytes]):
    import zstandard

    out = []
    for lang, content in contents.items():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress))
    return out


def classify(text: str | None, compressors) -> tuple[str, float]:
    """(language, margin) of a whole text."""
    if not text or not compressors:
        return NONE, 0.0
    folded = fold(text)
    if not folded.strip():
        return NONE, 0.0
    if len(folded) <= BLOCK:
        sizes = [(len(c(folded)), lang) for lang, c in compressors]
    else:
        blocks = [folded[i : i + BLOCK] for i in range(0, len(folded), BLOCK)]
        sizes = [(sum(len(c(b)) for b in blocks), lang) for lang, c in compressors]
    sizes.sort()
    return sizes[0][1], 1.0 if len(sizes) == 1 else 1.0 - sizes[0][0] / sizes[1][0]


def _predictor(contents: dict[str, bytes], kept: list[str]):
    """Arrow batches of (text, kept columns) -> (kept columns, lang_pred, score)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _compressors(contents)
        for b in batches(it, 8 << 20):
            found = [classify(t, made) for t in b.column("__fw_text").to_pylist()]
            cols = [b.column(c).combine_chunks() for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*kept, "__fw_lang", "__fw_score"])

    return run


def identify(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """All columns of ``docs`` with __fw_lang and __fw_score."""
    Scratch(docs.sparkSession, "language")  # for its Arrow batch size
    contents = train(docs if learn_from is None else learn_from)
    kept = [f"__fw_{i}" for i in range(len(docs.columns))]
    fed = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, kept, strict=True)], F.col("text").cast("string").alias("__fw_text"))
    schema = ", ".join(f"{k} {fed.schema[k].dataType.simpleString()}" for k in kept) + ", __fw_lang string, __fw_score double"
    out = fed.mapInArrow(_predictor(contents, kept), schema)
    return out.select(*[F.col(k).alias(c) for c, k in zip(docs.columns, kept, strict=True)], "__fw_lang", "__fw_score")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    fed = docs.select("doc_id", held_out().alias("held_out"), "text")
    found = identify(fed, learn_from=docs)
    return found.select("doc_id", "held_out", F.col("__fw_lang").alias("lang_pred"), F.col("__fw_score").alias("score"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is told with a sufficient margin."""
    found = identify(docs)
    return found.where((F.col("__fw_lang") != NONE) & (F.col("__fw_score") >= MARGIN)).select(*[F.col(f"`{c}`") for c in docs.columns])
