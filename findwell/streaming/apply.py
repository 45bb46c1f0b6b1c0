"""Streaming ingest: a change log is folded into versioned snapshots, batch by batch.

The state, documents and the tombstones that late operations are held against, lies in buckets of
partition keys. A micro-batch is applied by the same fold as a batch job, and only to the buckets
that its operations touch; they are written under the batch's number, and a manifest, written last,
names the directory of each bucket. A batch that is replayed after a failure starts from the
manifest before its own, so the outcome is the same. Nothing that a manifest names is overwritten.

Range deletes are resolved against the documents there are when their end arrives; a start whose end
is in a later batch is kept with the manifest of its batch.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findwell.operators.ingest import ROW, STATE, after_partition_deletes, classify, covered, open_starts, pair_ranges, replayed, with_deltas

BUCKETS = 32
#: Range rows that wait for their end.
PENDING = "seq long, stream_id string, op string, partition_key string, writetime long, bounds array<string>"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _manifests(spark: SparkSession, where: str) -> list[tuple[int, int]]:
    """(batch, how often it was pruned) of the finished manifests, oldest first."""
    fs, p = _fs(spark, f"{where}/manifest")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(tuple(int(x) for x in n[:-5].split(".")) for n in names if n.endswith(".json"))


def versions(spark: SparkSession, where: str) -> list[int]:
    """Batches with a finished snapshot, oldest first."""
    return sorted({n for n, _ in _manifests(spark, where)})


def _read(spark: SparkSession, where: str, which: tuple[int, int]) -> dict:
    rows = spark.read.text(f"{where}/manifest/{which[0]}.{which[1]}.json", wholetext=True).collect()
    return json.loads(rows[0]["value"])


def _write(spark: SparkSession, where: str, which: tuple[int, int], manifest: dict) -> None:
    """Written aside, then renamed: a manifest is there as a whole or not at all."""
    fs, final = _fs(spark, f"{where}/manifest/{which[0]}.{which[1]}.json")
    _, aside = _fs(spark, f"{where}/manifest/{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    fs.delete(final, False)
    if not fs.rename(aside, final):
        raise OSError(f"could not write the manifest of batch {which[0]}")


def _last(spark: SparkSession, where: str, before: int | None = None) -> tuple[tuple[int, int] | None, dict]:
    found = [w for w in _manifests(spark, where) if before is None or w[0] < before]
    return (found[-1], _read(spark, where, found[-1])) if found else (None, {"buckets": {}, "pending": None, "of": BUCKETS})


def _state(spark: SparkSession, where: str, manifest: dict, buckets: set[int] | None = None) -> DataFrame:
    paths = [f"{where}/data/{d}/bucket={k}" for k, d in sorted(manifest["buckets"].items()) if buckets is None or int(k) in buckets]
    return spark.read.schema(STATE).parquet(*paths) if paths else spark.createDataFrame([], STATE)


def state(spark: SparkSession, where: str, before: int | None = None) -> DataFrame:
    """The last state, or the last one older than a batch."""
    return _state(spark, where, _last(spark, where, before)[1])


def current(spark: SparkSession, where: str, now_micros: int | None = None) -> DataFrame:
    """Visible documents of the last snapshot."""
    docs = state(spark, where).where("not dead").drop("dead")
    return docs if now_micros is None else docs.where(F.col("expires_at") > now_micros)


def _pending(spark: SparkSession, where: str, manifest: dict) -> DataFrame:
    return spark.read.schema(PENDING).parquet(f"{where}/data/{manifest['pending']}") if manifest["pending"] else spark.createDataFrame([], PENDING)


def apply_batch(old: DataFrame, ops: DataFrame, clustering: tuple[str, ...] = (), pending: DataFrame | None = None) -> DataFrame:
    """The state after a batch. Stored rows enter as operations before all others: a document as an
    upsert of all it holds, a tombstone as a delete. ``clustering``: the types of the clustering
    columns, by which range deletes are resolved; ``pending``: range starts of earlier batches."""
    ops = with_deltas(ops)
    stored = old.select(F.lit(-1).cast("long").alias("seq"), F.when(F.col("dead"), "delete").otherwise("upsert").alias("op"), "id", "partition_key", "writetime", F.lit(None).cast("long").alias("ttl"), "payload_json", F.lit(None).cast("string").alias("collection_deltas"), "expires_at")
    new = ops.withColumn("op", classify(F.col("op"))).select("seq", "op", "id", F.coalesce("partition_key", "id").alias("partition_key"), "writetime", "ttl", "payload_json", "collection_deltas", F.lit(None).cast("long").alias("expires_at"))
    rows = stored.unionByName(new)
    if clustering:
        marks = ops.select("seq", "stream_id", "op", "partition_key", "writetime", "bounds")
        ranges = pair_ranges(marks if pending is None else pending.unionByName(marks), "bounds")
        came = rows.where("op = 'upsert'").groupBy("id", "partition_key").agg(F.min("seq").alias("seq"))
        gone = covered(came, ranges, clustering).withColumn("op", F.lit("delete"))
        rows = rows.unionByName(gone, allowMissingColumns=True)
    return replayed(after_partition_deletes(rows).select(*ROW, "expires_at"))


def _bucket(partition_key, of: int):
    return F.pmod(F.xxhash64(partition_key), F.lit(of)).cast("int")


def writer(where: str, keep: int = 3, clustering: tuple[str, ...] = ()):
    """A foreachBatch function that applies a batch to the buckets it touches."""

    def run(ops: DataFrame, number: int) -> None:
        spark = ops.sparkSession
        _, manifest = _last(spark, where, before=number)
        of = manifest["of"]
        touched = {r["b"] for r in ops.select(_bucket(F.coalesce("partition_key", "id"), of).alias("b")).distinct().collect() if r["b"] is not None}
        pending = _pending(spark, where, manifest)
        after = apply_batch(_state(spark, where, manifest, touched), ops, clustering, pending).withColumn("bucket", _bucket(F.coalesce("partition_key", "id"), of))
        after.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{where}/data/v={number}")
        marks = with_deltas(ops).select("seq", "stream_id", "op", "partition_key", "writetime", "bounds")
        open_starts(pending.unionByName(marks)).write.mode("overwrite").parquet(f"{where}/data/v={number}-pending")
        fs, p = _fs(spark, f"{where}/data/v={number}")
        there = {s.getPath().getName()[7:] for s in fs.listStatus(p) if s.getPath().getName().startswith("bucket=")}
        buckets = {k: d for k, d in manifest["buckets"].items() if int(k) not in touched} | {k: f"v={number}" for k in there}
        _write(spark, where, (number, 0), {"buckets": buckets, "pending": f"v={number}-pending", "of": of})
        _clean(spark, where, keep)

    return run


def _clean(spark: SparkSession, where: str, keep: int) -> None:
    """Delete manifests but the last ``keep`` and the directories that none of these names."""
    found = _manifests(spark, where)
    for which in found[:-keep]:
        fs, p = _fs(spark, f"{where}/manifest/{which[0]}.{which[1]}.json")
        fs.delete(p, False)
    used = set()
    for which in found[-keep:]:
        m = _read(spark, where, which)
        used |= set(m["buckets"].values()) | {m["pending"]}
    fs, p = _fs(spark, f"{where}/data")
    for s in fs.listStatus(p):
        if s.getPath().getName() not in used:
            fs.delete(s.getPath(), True)


def start(ops: DataFrame, where: str, checkpoint: str, once: bool = True, clustering: tuple[str, ...] = ()):
    """Run the ingest: everything there is now, or on and on."""
    w = ops.writeStream.foreachBatch(writer(where, clustering=clustering)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="5 seconds")).start()


def prune(spark: SparkSession, where: str, now_micros: int) -> None:
    """A snapshot without expired documents beside the last one, which stays until it is cleaned up;
    tombstones stay."""
    which, manifest = _last(spark, where)
    if which is None:
        return
    name = f"v={which[0]}-pruned-{which[1] + 1}"
    kept = _state(spark, where, manifest).where(F.col("dead") | (F.col("expires_at") > now_micros)).withColumn("bucket", _bucket(F.coalesce("partition_key", "id"), manifest["of"]))
    kept.write.mode("overwrite").partitionBy("bucket").parquet(f"{where}/data/{name}")
    fs, p = _fs(spark, f"{where}/data/{name}")
    there = {s.getPath().getName()[7:] for s in fs.listStatus(p) if s.getPath().getName().startswith("bucket=")}
    _write(spark, where, (which[0], which[1] + 1), {**manifest, "buckets": dict.fromkeys(there, name)})
