"""Change-log sources and the tables that documents are kept in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Operations; LOG has also what range deletes and changes within collections need: bounds, a text or
#: null for each clustering column, and collection_deltas, JSON of column -> {tombstone, remove, add}.
OPS = "seq long, stream_id string, op string, id string, partition_key string, writetime long, ttl long, payload_json string"

LOG = f"{OPS}, bounds array<string>, collection_deltas string"


def read_log(spark: SparkSession, path: str, start_micros: int | None = None, format: str = "json") -> DataFrame:
    """A log directory as a batch; operations before ``start_micros`` are left out."""
    df = spark.read.schema(LOG).format(format).load(path)
    return df if start_micros is None else df.where(F.col("writetime") >= start_micros)


def stream_log(spark: SparkSession, path: str, start_micros: int | None = None, format: str = "json", files_per_trigger: int = 100) -> DataFrame:
    """The same directory as a stream; Spark's checkpoint remembers what has been read."""
    df = spark.readStream.schema(LOG).format(format).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return df if start_micros is None else df.where(F.col("writetime") >= start_micros)


def products(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Made-up products for seeding and load tests; a row depends on its number and the seed only."""
    lists = {
        "brand": ["Acorn", "Birch", "Cedar", "Dune", "Ember"],
        "category": ["audio", "books", "garden", "kitchen", "office"],
        "kind": ["basic", "classic", "deluxe"],
        "adjective": ["compact", "durable", "foldable", "premium", "quiet", "wireless"],
        "noun": ["chair", "headphones", "keyboard", "lamp", "mouse", "speaker"],
        "colour": ["black", "blue", "green", "red", "white"],
    }
    number = lambda salt, size: F.pmod(F.xxhash64("id", F.lit(seed + salt)), F.lit(size))

    def pick(name: str, salt: int):
        return F.element_at(F.array(*[F.lit(x) for x in lists[name]]), (number(salt, len(lists[name])) + 1).cast("int"))

    name = F.concat_ws(" ", pick("brand", 0), pick("adjective", 1), pick("noun", 2))
    made = F.timestamp_seconds(F.lit(1_700_000_000) - number(10, 31_536_000))
    return spark.range(n).select(
        F.col("id").cast("string").alias("product_id"), name.alias("name"), F.concat(F.lit("A "), pick("adjective", 3), F.lit(" "), pick("noun", 2)).alias("description"),
        pick("brand", 0).alias("brand"), pick("category", 4).alias("category"), F.concat_ws(" ", pick("kind", 7), pick("category", 4)).alias("subcategory"), F.array_distinct(F.array(pick("adjective", 1), pick("adjective", 3))).alias("tags"),
        F.create_map(F.lit("colour"), pick("colour", 8), F.lit("weight_g"), (number(9, 5000) + 50).cast("string")).alias("attributes"),
        F.round(number(5, 100_000) / 100, 2).alias("price"), number(6, 500).cast("int").alias("stock_quantity"), F.round(number(11, 41) / 10 + 1, 1).alias("rating"), number(12, 2000).cast("int").alias("review_count"),
        made.alias("created_at"), F.timestamp_seconds(F.unix_seconds(made) + number(13, 2_592_000)).alias("updated_at"),
    )


def read_results(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Measurement files, newline-delimited or whole JSON documents, with the file of each row."""
    return spark.read.option("multiLine", multi_line).json(path).withColumn("filename", F.col("_metadata.file_path"))


def write_results(rows: DataFrame, path: str) -> None:
    """Measurements appended as newline-delimited JSON, as ``read_results`` reads them."""
    rows.write.mode("append").json(path)
