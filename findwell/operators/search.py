"""Search over documents: hits, exact totals and facets as plans over one filtered frame."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from findwell.functions.keys import FOREVER, TableSpec, has_key
from findwell.plans.compile import B, Compiler, Field, Stats
from findwell.plans.query import SearchRequest, expanded, parse

#: Consistency of a request: any shard may answer, or every one must.
ANY, ALL = 1, 2


class SearchFailure(RuntimeError):
    """What a caller gets instead of hits: a message and the error of each shard."""

    def __init__(self, message: str, errors: list[str]):
        super().__init__(message)
        self.message, self.errors = message, errors


@dataclass
class SearchResponse:
    hits: list[dict]
    total_hits: int
    duration_ms: float
    facets: dict[str, list[tuple[str, int]]] = field(default_factory=dict)


def _kind(t: T.DataType) -> str | None:
    if isinstance(t, T.StringType):
        return "text"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(t, T.DecimalType):
        return "text"  # decimals are strings in documents, so ranges never match them
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
        return "array"
    return None


def _leaves(schema: T.StructType, at: str = "") -> dict[str, Field]:
    out: dict[str, Field] = {}
    for f in schema.fields:
        path = at + f.name
        if isinstance(f.dataType, T.StructType):
            out |= _leaves(f.dataType, path + ".")
        elif kind := _kind(f.dataType):
            col = F.col(".".join(f"`{p}`" for p in path.split(".")))
            out[path] = Field(col.cast("string") if isinstance(f.dataType, T.DecimalType) else col, kind)
    return out


class Documents:
    """A frame of documents with what is needed to search it: id, partition key, expiry, leaves."""

    def __init__(self, df: DataFrame, id: Column, partition: Column | None = None, expires: Column | None = None, fields: dict[str, Field] | None = None, cols: list[str] | None = None, spec: TableSpec | None = None):
        self.df, self.spec = df, spec
        cols = cols or [c for c in df.columns if c not in ("partition_key", "expires_at", "writetime")]
        self.fields = fields if fields is not None else _leaves(T.StructType([df.schema[c] for c in cols]))
        self.id, self.partition, self.expires = id, id if partition is None else partition, expires
        self.cols = cols

    @classmethod
    def of_variant(cls, df: DataFrame, paths: dict[str, str]) -> Documents:
        """Documents stored as a variant column; ``paths`` names the kind of each leaf searched."""
        types = {"text": "string", "number": "double", "bool": "boolean", "timestamp": "timestamp", "array": "array<string>"}
        fields = {p: Field(F.try_variant_get("document", f"$.{p}", types[k]), k) for p, k in paths.items()}
        return cls(df, F.col("id"), F.col("partition_key"), F.col("expires_at"), fields, ["document"])

    def visible(self, now_micros: int | Column | None) -> DataFrame:
        """Documents that have not expired. Without a time given nothing expires."""
        if self.expires is None or now_micros is None:
            return self.df
        return self.df.where(F.coalesce(self.expires, F.lit(FOREVER)) > now_micros)

    @property
    def compiler_fields(self) -> dict[str, Field]:
        return self.fields | {"id": Field(self.id.cast("string"), "raw"), "partition_key": Field(self.partition.cast("string"), "raw")}


def corpus_stats(docs: DataFrame, compiler: Compiler, node) -> Stats:
    """Everything that scoring a query needs, in one aggregation over only the leaves it names."""
    terms = sorted(compiler.terms(node))
    paths = sorted({p for p, _ in terms})
    if not terms:
        return Stats(0, {}, {})
    tok = docs.select(*[compiler.fields[p].tokens.alias(f"t{i}") for i, p in enumerate(paths)])
    at = {p: i for i, p in enumerate(paths)}
    aggs = [F.count("*").alias("n")]
    aggs += [F.avg(F.size(f"t{i}")).alias(f"len{i}") for i in range(len(paths))]
    aggs += [F.count_if(F.array_contains(f"t{at[p]}", t)).alias(f"df{k}") for k, (p, t) in enumerate(terms)]
    r = tok.agg(*aggs).first()
    return Stats(r["n"], {p: r[f"len{i}"] or 1.0 for p, i in at.items()}, {x: r[f"df{k}"] or 0 for k, x in enumerate(terms)})


def _labelled(name: str, values: Column) -> Column:
    """An array of values as an array of (field, value)."""
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(name).alias("field"), v.alias("value")))


class Search:
    """One request compiled against documents. ``hits``, ``total`` and ``facets`` are frames."""

    def __init__(self, docs: Documents, request: SearchRequest, now_micros: int | None = None, stats: Stats | None = None, b: float = B, group_cap: int | None = None, digits: int | None = None):
        self.docs, self.request, self.group_cap = docs, request, group_cap
        self.node = parse(expanded(request))
        self.compiler = Compiler(docs.compiler_fields, b)
        self.all = docs.visible(now_micros)
        self._stats = stats
        self.digits = digits

    @property
    def matched(self) -> DataFrame:
        return self.all.where(self.compiler.filter(self.node))

    @property
    def scored(self) -> DataFrame:
        """id, score, partition_key of every match, with the columns that its payload is made of."""
        stats = self._stats or corpus_stats(self.all, self.compiler, self.node)
        score = self.compiler.score(self.node, stats)
        score = F.round(score, self.digits) if self.digits is not None else score
        row = F.struct(*[F.col(f"`{c}`") for c in self.docs.cols]).alias("__row")
        return self.matched.select(self.docs.id.alias("id"), score.alias("score"), self.docs.partition.alias("partition_key"), row)

    @property
    def payload(self) -> Column:
        """The JSON of a row; made for the page only."""
        row = F.col("__row.document") if "document" in self.docs.cols else F.col("__row")
        return F.coalesce(F.to_json(row), F.lit("{}")).alias("payload_json")

    def hits(self) -> DataFrame:
        """The page asked for, best first, ties by id: a bounded top-k in each task, then one merge."""
        r, found, order = self.request, self.scored, [F.desc("score"), F.col("id")]
        if r.group_by_partition:
            if self.group_cap is not None:
                found = found.orderBy(*order).limit(self.group_cap)
            best = Window.partitionBy("partition_key").orderBy(*order)
            found = found.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")
        return found.orderBy(*order).offset(r.offset).limit(r.limit).select("id", "score", self.payload, "partition_key")

    def total(self) -> DataFrame:
        return self.matched.agg(F.count("*").alias("total_hits"))

    def facets(self) -> DataFrame:
        """(field, value, count) over every match: one scan and one partial aggregation for all fields."""
        cols = []
        for name in self.request.facet_fields:
            f = self.docs.fields.get(name.removeprefix("document."))
            if f is None:
                continue
            values = f.value if f.kind == "array" else F.array(f.value.cast("string"))
            cols.append(_labelled(name, values))
        if not cols:
            return self.docs.df.sparkSession.createDataFrame([], "field string, value string, count long")
        pairs = self.matched.select(F.explode(F.concat(*cols)).alias("p")).select("p.field", "p.value").where(F.col("value").isNotNull())
        return pairs.groupBy("field", "value").agg(F.count("*").alias("count"))

    def run(self) -> SearchResponse:
        began = time.perf_counter()
        hits = [r.asDict() for r in self.hits().collect()]
        total = self.total().first()["total_hits"]
        facets: dict[str, list[tuple[str, int]]] = {}
        if self.request.facet_fields and total:
            facets = {f: [] for f in self.request.facet_fields}
            for r in self.facets().orderBy("field", F.desc("count"), "value").collect():
                facets[r["field"]].append((r["value"], r["count"]))
        return SearchResponse(hits, total, (time.perf_counter() - began) * 1000, facets)


def search_shards(spark, paths: list[str], build, request: SearchRequest, **options) -> SearchResponse:
    """Search documents kept in several directories. With ALL, one that can't be read fails the
    request; otherwise those that can be read answer, if there is at least one. A shard may also fail
    while it is read; then each is read by itself to see which, and the others are asked again."""
    frames, errors = {}, []
    for p in paths:
        try:
            df = spark.read.parquet(p)
            df.schema
            frames[p] = df
        except Exception as e:
            errors.append(f"{p}: {type(e).__name__}")
    while True:
        if errors and (request.consistency == ALL or not frames):
            name = "ALL" if request.consistency == ALL else "ANY"
            raise SearchFailure(f"Consistency {name} failed: {len(frames)}/{len(paths)} nodes succeeded", errors)
        whole = None
        for f in frames.values():
            whole = f if whole is None else whole.unionByName(f, allowMissingColumns=True)
        try:
            return Search(build(whole), request, **options).run()
        except Exception:
            failed = []
            for p, f in frames.items():
                try:
                    f.write.format("noop").mode("overwrite").save()
                except Exception as e:
                    failed.append(p)
                    errors.append(f"{p}: {type(e).__name__}")
            if not failed:  # the request itself is at fault
                raise
            frames = {p: f for p, f in frames.items() if p not in failed}


def lookup(docs: Documents, id: str) -> DataFrame:
    if docs.spec is not None:
        return docs.df.where(has_key(docs.df.schema, docs.spec.partition_cols + docs.spec.clustering_cols, id))
    return docs.df.where(docs.id == id)


def list_ids(docs: Documents, partition_key: str) -> DataFrame:
    """Ids of a partition; where the key columns are known, they are compared with their own types."""
    own = docs.partition == partition_key if docs.spec is None else has_key(docs.df.schema, docs.spec.partition_cols, partition_key)
    return docs.df.where(own).select(docs.id.alias("id")).distinct()
