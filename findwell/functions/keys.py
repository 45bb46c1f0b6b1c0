"""Row identity and the JSON form of typed rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: expires_at of a document that never expires.
FOREVER = 9223372036854775807


@dataclass(frozen=True)
class TableSpec:
    """Which columns make up a table's key, in order."""

    partition_cols: tuple[str, ...]
    clustering_cols: tuple[str, ...] = ()

    @classmethod
    def discover(cls, catalog_rows: list[tuple[str, str, int]]) -> TableSpec:
        """From catalogue rows (column, kind, position), kind partition_key or clustering."""
        pick = lambda kind: tuple(c for _, c in sorted((p, c) for c, k, p in catalog_rows if k == kind))
        return cls(pick("partition_key"), pick("clustering"))


def joined_key(cols: tuple[str, ...]) -> Column:
    """The ':'-joined key string; a missing component is the word null."""
    return F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols])


def has_key(schema: T.StructType, cols: tuple[str, ...], key: str) -> Column:
    """Whether the joined key of typed columns is ``key``. The columns themselves are compared, so the
    scan can skip; the string is compared as well, as a text such as 07 is not the key of a 7. A key
    whose parts hold a ':' cannot be taken apart, so for that the string decides alone."""
    out, parts = joined_key(cols) == key, key.split(":")
    if len(parts) != len(cols):
        return out
    for c, p in zip(cols, parts, strict=True):
        kind = schema[c].dataType
        same = F.col(c) == (F.lit(p) if isinstance(kind, T.StringType) else F.lit(p).try_cast(kind))
        out = out & (same | F.col(c).isNull() if p == "null" else same)
    return out


def with_ids(rows: DataFrame, spec: TableSpec) -> DataFrame:
    return rows.withColumn("id", joined_key(spec.partition_cols + spec.clustering_cols)).withColumn("partition_key", joined_key(spec.partition_cols))


def uuid_micros(uuid: Column) -> Column:
    """Unix microseconds of a time-based (version 1) UUID string."""
    hexes = F.concat(F.substring(uuid, 16, 3), F.substring(uuid, 10, 4), F.substring(uuid, 1, 8))
    ticks = F.conv(hexes, 16, 10).cast("long")
    return F.floor((ticks - F.lit(122192928000000000)) / 10).cast("long")


def json_ready(col: Column, kind: T.DataType) -> Column:
    """A column in its JSON form: decimals as strings, timestamps as epoch milliseconds, blobs in
    base64, non-finite numbers as null, everything else as Spark's own JSON has it."""
    if isinstance(kind, T.DecimalType):
        return col.cast("string")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_millis(col.cast("timestamp"))
    if isinstance(kind, T.BinaryType):
        return F.base64(col)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(col) | (F.abs(col) == float("inf")), None).otherwise(col)
    if isinstance(kind, (T.ByteType, T.ShortType, T.DateType)):
        return col.cast("string")
    return col


def payload_json(rows: DataFrame, cols: list[str]) -> Column:
    """The JSON object of some columns; nulls are left out."""
    return F.to_json(F.struct(*[json_ready(F.col(c), rows.schema[c].dataType).alias(c) for c in cols]), {"ignoreNullFields": "true"})


def expires_at(writetime: Column, ttl: Column) -> Column:
    """Microseconds at which a document stops being visible; saturates instead of overflowing."""
    room = (F.lit(FOREVER) - writetime) / F.lit(1_000_000)
    return F.when(ttl.isNull() | (ttl >= room), F.lit(FOREVER)).otherwise(writetime + ttl * F.lit(1_000_000))
