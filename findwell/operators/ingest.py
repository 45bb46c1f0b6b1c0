"""Change-log operators: from rows of a log of row-level changes to the current documents.

The relational fold works on a whole log at once: a partition delete hides what arrived before it,
a running maximum of write times tells which operations were accepted, and each column keeps the
value of its latest accepted writer after the last delete. Ties in write time go to the earlier
arrival, so replays change nothing. Deletes leave tombstones: an older upsert that arrives late
stays dead.

Columns of a log: seq, id, partition_key, op (upsert, delete, partition_delete; anything else is
skipped), writetime (microseconds), ttl (seconds or null) and the payload columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findwell.functions.keys import FOREVER, expires_at

KINDS = {
    "pre_image": "skip",
    "row_insert": "upsert",
    "row_update": "upsert",
    "post_image": "upsert",
    "row_delete": "delete",
    "partition_delete": "partition_delete",
    "range_del_incl_left": "range_start",
    "range_del_excl_left": "range_start",
    "range_del_incl_right": "range_end",
    "range_del_excl_right": "range_end",
}


def classify(op: Column) -> Column:
    """What is to be done with a log row of this kind; unknown kinds are skipped."""
    out = F.lit("skip")
    for action in sorted(set(KINDS.values()) - {"skip"}):
        out = F.when(op.isin([k for k, a in KINDS.items() if a == action]), action).otherwise(out)
    return out


def shard(partition_key: Column, shards: int) -> Column:
    """The shard of a partition: by MD5, so that any writer finds the same one."""
    return F.pmod(F.conv(F.substring(F.md5(partition_key), 1, 15), 16, 10).cast("long"), F.lit(shards)).cast("int")


def counters(ops: DataFrame) -> DataFrame:
    """Operations processed and skipped, as a batch reports them."""
    known = F.col("op").isin("upsert", "delete", "partition_delete")
    return ops.agg(F.count_if(known).alias("processed"), F.count_if(~F.coalesce(known, F.lit(False))).alias("skipped"))


def after_partition_deletes(ops: DataFrame) -> DataFrame:
    """Row operations that no later partition delete of their partition undoes. The deletes are
    first reduced to the last one of each partition."""
    last = ops.where(F.col("op") == "partition_delete").groupBy("partition_key").agg(F.max("seq").alias("__last"))
    rows = ops.where(F.col("op").isin("upsert", "delete")).withColumn("partition_key", F.coalesce("partition_key", "id"))
    return rows.join(last, "partition_key", "left").where(F.col("__last").isNull() | (F.col("seq") > F.col("__last"))).drop("__last")


def accepted(ops: DataFrame) -> DataFrame:
    """Operations newer than everything that arrived before them for their id."""
    before = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return ops.withColumn("__pm", F.max("writetime").over(before)).where(F.col("__pm").isNull() | (F.col("writetime") > F.col("__pm"))).drop("__pm")


def fold(ops: DataFrame, columns: list[str], tombstones: bool = True) -> DataFrame:
    """Current documents: id, partition_key, the payload columns, writetime, expires_at. A null in
    a payload column means that the operation did not touch it. Without tombstones, an accepted
    delete does not hold off older upserts that arrive after it."""
    rows = after_partition_deletes(ops)
    if tombstones:
        rows = accepted(rows)
        alive_after = F.max(F.when(F.col("op") == "delete", F.col("writetime"))).over(Window.partitionBy("id"))
        rows = rows.withColumn("__dead", alive_after).where(F.col("__dead").isNull() | (F.col("writetime") > F.col("__dead")))
    else:  # a delete is accepted against what is stored, then forgets its write time
        rows = _without_tombstones(rows)
    wt = F.col("writetime")
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), wt)).alias(c) for c in columns]
    return rows.where("op = 'upsert'").groupBy("id").agg(F.max_by("partition_key", wt).alias("partition_key"), *latest, F.max(wt).alias("writetime"), F.max_by(expires_at(wt, F.col("ttl")), wt).alias("expires_at"))


def _without_tombstones(rows: DataFrame) -> DataFrame:
    """Operations of each id since its last effective delete, accepted in order of arrival."""
    schema = rows.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, top = [], None
        for i, (op, wt) in enumerate(zip(*[pdf.sort_values("seq")[c] for c in ("op", "writetime")], strict=True)):
            if top is not None and wt <= top:
                continue
            if op == "delete":
                kept, top = [], None
            else:
                kept.append(i)
                top = wt
        return pdf.sort_values("seq").iloc[kept]

    return rows.groupBy("id").applyInPandas(run, schema)


def lww(ops: DataFrame, columns: list[str]) -> DataFrame:
    """Whole-row replacement: per id the accepted upsert with the latest write time."""
    rows = accepted(ops.where("op = 'upsert'"))
    best = F.max_by(F.struct("writetime", *columns), F.col("writetime")).alias("r")
    return rows.groupBy("id").agg(best).select("id", "r.*")


def pruned(docs: DataFrame, now_micros) -> DataFrame:
    """Documents that have not expired."""
    return docs.where(F.col("expires_at") > now_micros)


def apply_delta(base: Column, tombstoned: Column, removed: Column, added: Column) -> Column:
    """One collection delta: clear, then take out, then add what is not there yet; order is kept."""
    empty = F.array().cast("array<string>")
    start = F.when(F.coalesce(tombstoned, F.lit(False)), empty).otherwise(F.coalesce(base, empty))
    kept = F.filter(start, lambda x: ~F.array_contains(F.coalesce(removed, empty), x))
    return F.concat(kept, F.array_except(F.coalesce(added, empty), kept))


def fold_deltas(base: Column, deltas: Column) -> Column:
    """All deltas, an array of (tombstoned, removed, added) in order, applied to ``base``."""
    return F.aggregate(deltas, F.coalesce(base, F.array().cast("array<string>")), lambda acc, d: apply_delta(acc, d["tombstoned"], d["removed"], d["added"]))


def apply_map_delta(base: Column, tombstoned: Column, removed: Column, added: Column) -> Column:
    """The same for maps: keys are taken out, entries added or replaced."""
    empty = F.create_map().cast("map<string,string>")
    start = F.when(F.coalesce(tombstoned, F.lit(False)), empty).otherwise(F.coalesce(base, empty))
    more = F.coalesce(added, empty)
    kept = F.map_filter(start, lambda k, v: ~F.array_contains(F.coalesce(removed, F.array().cast("array<string>")), k) & ~F.array_contains(F.map_keys(more), k))
    return F.map_concat(kept, more)


def pair_ranges(ops: DataFrame, bound: str = "bound") -> DataFrame:
    """Range deletes: each start row with the end row that follows it in its stream, with the start's
    write time. A start that another start follows is dropped, and so is an end without a start.
    ``bound`` is one typed value, or an array of texts, one for each clustering column."""
    ends = Window.partitionBy("stream_id").orderBy("seq")
    rows = ops.where(F.col("op").startswith("range_del_"))
    nxt = rows.select("stream_id", "seq", "op", "partition_key", bound, "writetime", F.lead("op").over(ends).alias("end_op"), F.lead(bound).over(ends).alias("high"), F.lead("seq").over(ends).alias("end_seq"))
    return nxt.where(F.col("op").endswith("_left") & F.col("end_op").endswith("_right")).select(
        "stream_id", F.col("end_seq").alias("seq"), "partition_key", F.col(bound).alias("low"), "high",
        F.col("op").contains("_incl_").alias("low_in"), F.col("end_op").contains("_incl_").alias("high_in"), "writetime",
    )


def range_deletes(docs: DataFrame, ranges: DataFrame, clustering: str) -> DataFrame:
    """(id, seq, writetime) of documents that some range covers. A null bound is open. The join is on
    the partition key, the bounds are checked on the typed clustering column."""
    d, r = docs.alias("d"), ranges.alias("r")
    ck = F.col(f"d.{clustering}")
    low = F.col("r.low").isNull() | (ck > F.col("r.low")) | (F.col("r.low_in") & (ck == F.col("r.low")))
    high = F.col("r.high").isNull() | (ck < F.col("r.high")) | (F.col("r.high_in") & (ck == F.col("r.high")))
    return d.join(r, (F.col("d.partition_key") == F.col("r.partition_key")) & low & high).select("d.id", "r.seq", "r.writetime")


def without_ranges(docs: DataFrame, ranges: DataFrame, clustering: str) -> DataFrame:
    """Documents that no range written after them covers."""
    gone = range_deletes(docs, ranges, clustering).withColumnRenamed("writetime", "__wt")
    return docs.alias("d").join(gone.alias("g"), (F.col("d.id") == F.col("g.id")) & (F.col("g.__wt") > F.col("d.writetime")), "left_anti")


def deep_merge(base, patch):
    """Objects merge key by key; anything else in the patch, null and arrays too, replaces."""
    if isinstance(base, dict) and isinstance(patch, dict):
        return {**base, **{k: deep_merge(base[k], v) if k in base else v for k, v in patch.items()}}
    return patch


def open_starts(ops: DataFrame) -> DataFrame:
    """The last range row of each stream, where it is a start: its end may still come."""
    last = F.row_number().over(Window.partitionBy("stream_id").orderBy(F.desc("seq")))
    rows = ops.where(F.col("op").startswith("range_del_")).withColumn("__r", last).where("__r = 1").drop("__r")
    return rows.where(F.col("op").endswith("_left"))


def covered(docs: DataFrame, ranges: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Deletes (seq, id, partition_key, writetime) for the documents (id, partition_key, seq: when
    they came) that a range (low, high: arrays of bounds) covers at its time. Every clustering column
    is held against its own bound, as its own type; the columns are what an id has after its partition
    key. The join is on the partition key."""
    d, r = docs.alias("d"), ranges.alias("r")
    rest = F.col("d.id").substr(F.length("d.partition_key") + 2, F.length("d.id"))
    parts = F.split(rest, ":", len(kinds)) if len(kinds) > 1 else F.array(rest)
    inside = F.col("d.seq") < F.col("r.seq")
    for i, kind in enumerate(kinds):
        value, low, high = F.get(parts, i).try_cast(kind), F.get("r.low", i).try_cast(kind), F.get("r.high", i).try_cast(kind)
        inside = inside & (F.get("r.low", i).isNull() | (value > low) | (F.col("r.low_in") & (value == low)))
        inside = inside & (F.get("r.high", i).isNull() | (value < high) | (F.col("r.high_in") & (value == high)))
    found = d.join(r, (F.col("d.partition_key") == F.col("r.partition_key")) & inside)
    return found.select("r.seq", "d.id", "d.partition_key", "r.writetime")


def changed_collections(doc: dict, text: str | None) -> dict:
    """A document after its collection deltas, JSON of column -> {tombstone, remove, add}: cleared,
    then taken out of, then added to; ``add`` as an object makes the column a map. What is no such
    JSON is ignored, and a column that holds something else starts anew."""
    try:
        deltas = json.loads(text) if text else {}
    except ValueError:
        return doc
    for column, d in deltas.items() if isinstance(deltas, dict) else ():
        if not isinstance(d, dict):
            continue
        base, add = doc.get(column), d.get("add")
        gone = d.get("remove") if isinstance(d.get("remove"), list) else []
        if isinstance(add, dict) or (add is None and isinstance(base, dict)):
            start = {} if d.get("tombstone") or not isinstance(base, dict) else base
            doc = {**doc, column: {**{k: v for k, v in start.items() if k not in gone}, **(add or {})}}
            continue
        out = [] if d.get("tombstone") or not isinstance(base, list) else [x for x in base if x not in gone]
        for x in add if isinstance(add, list) else []:
            if x not in out:
                out.append(x)
        doc = {**doc, column: out}
    return doc


#: What a fold in order of arrival needs of an operation, and what it gives.
ROW = ("id", "partition_key", "seq", "op", "writetime", "ttl", "payload_json", "collection_deltas")
STATE = "id string, partition_key string, payload_json string, writetime long, expires_at long, dead boolean"


def _folded(tombstones: bool):
    """Operations (ROW, then the expires_at of a stored row or null), those of one id together and in
    order of arrival, -> STATE, one row of each id or none. Only one id's document is held."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, doc, top, part, ends, out = (), None, None, None, FOREVER, []

        def end() -> None:
            if at != () and top is not None:
                out.append((at, part, None if doc is None else json.dumps(doc, separators=(",", ":")), top, ends, doc is None))

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_STATE.types)], schema=_STATE)

        for b in it:
            for id, key, op, writetime, ttl, payload, text, known in zip(*[b.column(c).to_pylist() for c in _TAKEN], strict=True):
                if id != at:
                    end()
                    at, doc, top, part, ends = id, None, None, None, FOREVER
                if top is not None and writetime <= top:
                    continue
                if op == "delete":
                    doc, part, ends, top = None, key, FOREVER, writetime if tombstones else None
                    continue
                try:
                    patch = {} if text and payload is None else json.loads(payload)
                except (TypeError, ValueError):
                    continue
                if not isinstance(patch, dict):
                    continue
                doc = changed_collections(deep_merge(doc, patch) if doc is not None else patch, text)
                top, part = writetime, key
                ends = known if known is not None else FOREVER if ttl is None else min(FOREVER, top + ttl * 1_000_000)
            if out:
                yield done()
                out.clear()
        end()
        if out:
            yield done()

    return run


_TAKEN = ("id", "partition_key", "op", "writetime", "ttl", "payload_json", "collection_deltas", "expires_at")
_STATE = pa.schema([("id", pa.string()), ("partition_key", pa.string()), ("payload_json", pa.string()), ("writetime", pa.int64()), ("expires_at", pa.int64()), ("dead", pa.bool_())])


def replayed(rows: DataFrame, tombstones: bool = True) -> DataFrame:
    """The state (STATE) after operations (ROW, expires_at). Ids are dealt and sorted, and then each
    task runs through its rows once: no call and no table for an id by itself."""
    kinds = {"ttl": "long", "writetime": "long", "expires_at": "long"}
    rows = rows.select("seq", *[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in _TAKEN])
    return rows.repartition("id").sortWithinPartitions("id", F.asc_nulls_last("seq")).mapInArrow(_folded(tombstones), STATE)


def with_deltas(ops: DataFrame) -> DataFrame:
    """``ops`` with the columns of a log that may be left out."""
    for c, kind in (("bounds", "array<string>"), ("collection_deltas", "string"), ("stream_id", "string")):
        if c not in ops.columns:
            ops = ops.withColumn(c, F.lit(None).cast(kind))
    return ops


def fold_json(ops: DataFrame, tombstones: bool = True) -> DataFrame:
    """The fold for nested JSON payloads (payload_json, collection_deltas): id, partition_key,
    payload_json, writetime, expires_at. A payload that is no JSON object is skipped and the stored
    document stays. Needs the operations of one id at a time, in order of arrival."""
    rows = after_partition_deletes(with_deltas(ops)).select(*ROW, F.lit(None).cast("long").alias("expires_at"))
    return replayed(rows, tombstones).where("not dead").drop("dead")
