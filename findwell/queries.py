"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findwell.functions.keys import FOREVER, TableSpec, expires_at, payload_json, uuid_micros, with_ids
from findwell.operators import analysis as an
from findwell.operators import index, ingest
from findwell.operators.search import Documents, Search, list_ids, lookup
from findwell.plans.query import SearchRequest, parse
from findwell.streaming import apply

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, sf_dir) -> Documents:
    return Documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"), F.col("doc_id"), F.col("source"), cols=["text", "lang", "source", "n_chars"], spec=TableSpec(("doc_id",)))


def parts(spark, sf_dir) -> Documents:
    df = table(spark, sf_dir, "part").withColumn("tags", F.array(F.lower("p_type"), F.lower("p_brand")))
    return Documents(df, F.col("p_partkey"), F.col("p_brand"), cols=["p_name", "p_brand", "p_type", "p_size", "p_retailprice", "tags"])


def turns(spark, sf_dir) -> Documents:
    df = with_ids(table(spark, sf_dir, "conversations"), TableSpec(("conv_id",), ("turn",)))
    return Documents(df, F.col("id"), F.col("partition_key"), cols=["role", "text", "turn"], spec=TableSpec(("conv_id",), ("turn",)))


def search(make, query: str, **more):
    request = SearchRequest(query, more.pop("limit", 10), more.pop("offset", 0), **more)
    return lambda spark, sf_dir: Search(make(spark, sf_dir), request, digits=6)


def _matches(name: str, make, query: str, where: str, source: str, key: str, **more) -> None:
    """A query for the ids of all matches and its SQL."""
    run = search(make, query, **more)
    QUERIES[name] = lambda spark, sf_dir: (s := run(spark, sf_dir)).matched.select(s.docs.id.alias("id"))
    ORACLES[name] = f"SELECT {key} AS id FROM {source} WHERE {where}"


def TOK(c: str) -> str:
    return rf"list_filter(string_split_regex(lower({c}),'[^\p{{L}}\p{{N}}]+'), lambda x: x<>'' and octet_length(encode(x))<40)"


def has(c: str, w: str) -> str:
    return f"list_contains({TOK(c)}, '{w}')"


def phrase(c: str, words: str, more: str = " ") -> str:
    return f"contains(' ' || array_to_string({TOK(c)},' ') || ' ', ' {words}{more}')"


def anyof(c: str, cond: str) -> str:
    return f"len(list_filter({TOK(c)}, lambda t: {cond})) > 0"


# predicates

_PARTS = "(SELECT *, [lower(p_type), lower(p_brand)] AS tags FROM part)"
_matches("fts_term", docs, "document.text:The", has("text", "the"), "documents", "doc_id")
_matches("fts_term_bare", docs, "lang:fr", has("lang", "fr"), "documents", "doc_id")
_matches("fts_and", parts, "document.p_name:ring AND document.p_retailprice:[950 TO 1100]", f"{has('p_name', 'ring')} AND p_retailprice BETWEEN 950 AND 1100", "part", "p_partkey")
_matches("fts_or", docs, "document.lang:de OR document.lang:es", "lang IN ('de','es')", "documents", "doc_id")
_matches("fts_not", docs, "lang:en AND NOT text:the -source:src3", f"(lang='en' AND NOT {has('text', 'the')}) AND NOT {has('source', 'src3')}", "documents", "doc_id")
_matches("fts_group", parts, "document.p_name:(small red rod)", f"({has('p_name', 'small')} OR {has('p_name', 'red')} OR {has('p_name', 'rod')})", "part", "p_partkey")
_matches("fts_phrase", docs, 'document.text:"of the"', phrase("text", "of the"), "documents", "doc_id")
_matches("fts_phrase_prefix", docs, 'document.text:"of th"*', phrase("text", "of th", ""), "documents", "doc_id")
_matches("fts_phrase_slop", docs, 'document.text:"der die"~2', rf"regexp_matches(' ' || array_to_string({TOK('text')},' ') || ' ', ' der ([^ ]+ ){{0,2}}die ')", "documents", "doc_id")
_matches("fts_prefix", parts, "document.p_name:wid*", anyof("p_name", "starts_with(t,'wid')"), "part", "p_partkey")
_matches("fts_fuzzy1", parts, "document.p_name:wdiget~1", anyof("p_name", "damerau_levenshtein(t,'wdiget')<=1"), "part", "p_partkey")
_matches("fts_fuzzy2", parts, "document.p_name:plaet~2", anyof("p_name", "damerau_levenshtein(t,'plaet')<=2"), "part", "p_partkey")
_matches("fts_range", parts, "document.p_retailprice:{900 TO 1000]", "p_retailprice > 900 AND p_retailprice <= 1000", "part", "p_partkey")
_matches("fts_cmp", parts, "p_size:>=10 AND p_size:<20", "p_size >= 10 AND p_size < 20", "part", "p_partkey")
_matches("fts_in", parts, 'p_size:IN [3 5 8] OR p_name:IN ["rod" "bolt"]', f"p_size IN (3,5,8) OR {has('p_name', 'rod')} OR {has('p_name', 'bolt')}", "part", "p_partkey")
_matches("fts_exists", parts, "p_name:*", "p_name IS NOT NULL", "part", "p_partkey")
_matches("fts_regex", parts, "p_name:/r[eo]d/", anyof("p_name", "regexp_full_match(t,'r[eo]d')"), "part", "p_partkey")
_matches("fts_all", parts, "*", "true", "part", "p_partkey")
_matches("fts_array", parts, "document.tags:economy AND document.tags:brand", "lower(p_type)='economy'", "part", "p_partkey")
_matches("fts_bare", parts, "ring economy", f"{has('p_name', 'ring')} OR {has('p_type', 'ring')} OR {has('p_type', 'economy')} OR {has('p_name', 'economy')}", "part", "p_partkey")
_matches("fts_default_fields", parts, "red brand", f"({has('p_name', 'red')} OR {has('p_brand', 'red')}) AND ({has('p_name', 'brand')} OR {has('p_brand', 'brand')})", "part", "p_partkey", default_fields=("p_name", "p_brand"))
_matches("fts_multi_or", parts, "document.p_name:(hot plate) OR document.p_type:(hot plate) OR document.tags:(hot plate)", f"{has('p_name', 'hot')} OR {has('p_name', 'plate')}", "part", "p_partkey")
_matches("fts_raw", docs, "partition_key:src3", "source='src3'", "documents", "doc_id")
_NESTED = lambda spark, sf_dir: Documents.of_variant(
    table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("partition_key"), F.lit(FOREVER).alias("expires_at"),
        F.parse_json(F.to_json(F.struct(F.col("p_name").alias("name"), F.struct(F.col("p_size").alias("size"), F.struct(F.lower("p_type").alias("kind")).alias("more")).alias("spec")))).alias("document"),
    ), {"name": "text", "spec.size": "number", "spec.more.kind": "text"},
)
_matches("fts_nested_path", _NESTED, "document.spec.size:[10 TO 20] AND (document.name:ring OR spec.more.kind:economy)", f"p_size BETWEEN 10 AND 20 AND ({has('p_name', 'ring')} OR {has('p_type', 'economy')})", "part", "p_partkey")
_EVENTS = lambda spark, sf_dir: Documents(table(spark, sf_dir, "events"), F.col("event_id"), cols=["event_type", "ts", "value"])
_matches("fts_timerange", _EVENTS, "event_type:purchase AND document.ts:[1704500000000 TO 1705500000000]", "event_type='purchase' AND epoch_us(ts) BETWEEN 1704500000000000 AND 1705500000000000", "events", "event_id")

# ranking

_IDF = "ln(1+(n-df{i}+0.5)/(df{i}+0.5))"
_TF = "(len(list_filter(k,lambda x: x='{w}'))*2.2)/(len(list_filter(k,lambda x: x='{w}'))+1.2*(0.25+0.75*len(k)/al))"


def bm25(source: str, key: str, col: str, words: list[tuple[str, float]], extra: str = "") -> str:
    dfs = ", ".join(f"count(*) FILTER (WHERE list_contains(k,'{w}')) AS df{i}" for i, (w, _) in enumerate(words))
    score = " + ".join(f"{b} * {_IDF.format(i=i)} * {_TF.format(w=w)}" for i, (w, b) in enumerate(words))
    match = " OR ".join(f"list_contains(k,'{w}')" for w, _ in words)
    return f"WITH t AS (SELECT {key} AS id, {TOK(col)} AS k{extra} FROM {source}), s AS (SELECT count(*) AS n, avg(len(k)) AS al, {dfs} FROM t) SELECT id, round({score},6) AS score{extra and ', part'} FROM t, s WHERE {match}"


def _hits(name: str, make, query: str, sql: str, cols=("id", "score"), **more) -> None:
    run = search(make, query, **more)
    QUERIES[name] = lambda spark, sf_dir: run(spark, sf_dir).hits().select(*cols)
    ORACLES[name] = sql


def _indexed(name: str, query: str, sql: str, **more) -> None:
    """A page of hits from the persisted index of the documents' texts."""
    request = SearchRequest(query, more.pop("limit", 10), more.pop("offset", 0), **more)
    QUERIES[name] = lambda spark, sf_dir: index.opened(docs(spark, sf_dir), ["text"], f"{sf_dir}/documents.parquet").hits(request, digits=6)
    ORACLES[name] = sql


_ONE = bm25("documents", "doc_id", "text", [("der", 1)])
_MULTI = bm25("documents", "doc_id", "text", [("der", 1), ("die", 2), ("ein", 1)])
_indexed("bm25_single", "document.text:der", f"{_ONE} ORDER BY score DESC, id LIMIT 10")
_indexed("bm25_multi", "text:der text:die^2 text:ein", f"{_MULTI} ORDER BY score DESC, id LIMIT 20", limit=20)
_indexed("topk_page", "document.text:der", f"{_ONE} ORDER BY score DESC, id LIMIT 7 OFFSET 5", limit=7, offset=5)
_hits("bm25_scan", docs, "text:der text:die^2 text:ein", f"{_MULTI} ORDER BY score DESC, id LIMIT 20", limit=20)
_hits(
    "fts_boost", parts, "ring", boost_fields=(("p_name", 5.0), ("p_type", 1.0)), limit=25,
    sql=f"{bm25('part', 'p_partkey', 'p_name', [('ring', 5)])} ORDER BY score DESC, id LIMIT 25",
)
_hits(
    "group_by_partition", turns, "text:the", cols=("id", "score", "partition_key"), limit=20, group_by_partition=True,
    sql="SELECT id, score, part AS partition_key FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY score DESC, id) AS r FROM ("
    + bm25("conversations", "conv_id || ':' || turn", "text", [("the", 1)], ", CAST(conv_id AS VARCHAR) AS part")
    + ")) WHERE r = 1 ORDER BY score DESC, id LIMIT 20",
)


@_q("total_hits", f"SELECT count(*) AS total_hits FROM documents WHERE {has('text', 'der')}")
def _total(spark, sf_dir):
    return search(docs, "text:der")(spark, sf_dir).total()


def _from_index(name: str, query: str, sql: str, *cols: str) -> None:
    """Every match of a query by the persisted index."""
    QUERIES[name] = lambda spark, sf_dir: index.opened(docs(spark, sf_dir), ["text"], f"{sf_dir}/documents.parquet").answer(parse(query)).select("id", *[F.round(c, 6).alias(c) for c in cols])
    ORACLES[name] = sql


_from_index("index_any", "text:der text:die", bm25("documents", "doc_id", "text", [("der", 1), ("die", 1)]), "score")
_from_index("index_all", "text:der AND text:die -text:ein", f"SELECT doc_id AS id FROM documents WHERE {has('text', 'der')} AND {has('text', 'die')} AND NOT {has('text', 'ein')}")
_from_index("index_phrase", 'text:"of the"', f"SELECT doc_id AS id FROM documents WHERE {phrase('text', 'of the')}")
_from_index("index_prefix", "text:le*", f"SELECT doc_id AS id FROM documents WHERE {anyof('text', "starts_with(t,'le')")}")
_from_index("index_fuzzy", "text:dre~1", f"SELECT doc_id AS id FROM documents WHERE {anyof('text', "damerau_levenshtein(t,'dre')<=1")}")


# facets


def _facet(name: str, make, query: str, fields: tuple[str, ...], sql: str) -> None:
    run = search(make, query, facet_fields=fields)
    QUERIES[name] = lambda spark, sf_dir: run(spark, sf_dir).facets()
    ORACLES[name] = sql


def _facet_sql(table_: str, where: str, /, **fields: str) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS field, {e} AS value, count(*) AS count FROM {table_} WHERE {where} GROUP BY 2" for f, e in fields.items())


_facet("facet_string", docs, "text:the", ("lang",), _facet_sql("documents", has("text", "the"), lang="lang"))
_facet("facet_number", parts, "p_name:ring", ("p_size",), _facet_sql("part", has("p_name", "ring"), p_size="CAST(p_size AS VARCHAR)"))
_facet("facet_array", parts, "p_name:ring", ("tags",), _facet_sql(f"(SELECT p_name, unnest(tags) AS tag FROM {_PARTS})", has("p_name", "ring"), tags="tag"))
_facet("facet_multi", docs, "*", ("lang", "source", "missing"), _facet_sql("documents", "true", lang="lang", source="source"))

# keys and JSON


@_q("lookup_by_id", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = 42")
def _lookup(spark, sf_dir):
    return lookup(docs(spark, sf_dir), "42").select("doc_id", "lang", "n_chars")


@_q("list_ids_by_partition", "SELECT conv_id || ':' || turn AS id FROM conversations WHERE conv_id = 7")
def _list(spark, sf_dir):
    return list_ids(turns(spark, sf_dir), "7")


@_q("doc_ids", "SELECT coalesce(CAST(conv_id AS VARCHAR),'null') || ':' || coalesce(CAST(turn AS VARCHAR),'null') AS id, coalesce(CAST(conv_id AS VARCHAR),'null') AS partition_key FROM conversations")
def _ids(spark, sf_dir):
    return turns(spark, sf_dir).df.select("id", "partition_key")


@_q("cdc_to_json", "SELECT p_partkey, CAST(to_json({'p_partkey': p_partkey, 'p_name': p_name, 'p_size': p_size}) AS VARCHAR) AS payload_json FROM part")
def _json(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return df.select("p_partkey", payload_json(df, ["p_partkey", "p_name", "p_size"]).alias("payload_json"))


@_q("timeuuid_micros", "SELECT event_id, epoch_us(ts) AS micros FROM events")
def _uuid(spark, sf_dir):
    ticks = F.lpad(F.hex(F.unix_micros(F.col("ts").cast("timestamp")) * 10 + 122192928000000000), 15, "0")
    uuid = F.lower(F.concat(F.substring(ticks, 8, 8), F.lit("-"), F.substring(ticks, 4, 4), F.lit("-1"), F.substring(ticks, 1, 3), F.lit("-8000-000000000000")))
    return table(spark, sf_dir, "events").select("event_id", uuid_micros(uuid).alias("micros"))


# ingest: a log made of events, with write times out of order

_WT = "epoch_us(ts) - (event_id*7919 % 1000)*100000000"
OPS_SQL = f"""SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS id, CAST(user_id % 20 AS VARCHAR) AS partition_key,
 CASE WHEN event_type='error' THEN CASE WHEN event_id % 500 < 3 THEN 'partition_delete' ELSE 'delete' END ELSE 'upsert' END AS op,
 {_WT} AS writetime, CASE WHEN event_id % 5 = 0 THEN CAST(864000 AS BIGINT) END AS ttl,
 CAST(json_extract_string(props,'$.k') AS BIGINT) AS k, event_type, CASE WHEN event_id % 3 = 0 THEN value END AS value FROM events"""


def ops(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    kind = F.when(F.col("event_type") == "error", F.when(e % 500 < 3, "partition_delete").otherwise("delete")).otherwise("upsert")
    return table(spark, sf_dir, "events").select(
        e.alias("seq"), F.col("user_id").cast("string").alias("id"), (F.col("user_id") % 20).cast("string").alias("partition_key"), kind.alias("op"),
        (F.unix_micros(F.col("ts").cast("timestamp")) - (e * 7919 % 1000) * 100000000).alias("writetime"), F.when(e % 5 == 0, F.lit(864000).cast("long")).alias("ttl"),
        F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type", F.when(e % 3 == 0, F.col("value")).alias("value"),
    )


_PD = f"o AS ({OPS_SQL}), pd AS (SELECT partition_key AS pk, max(seq) AS last FROM o WHERE op='partition_delete' GROUP BY 1), live AS (SELECT o.* FROM o LEFT JOIN pd ON o.partition_key=pd.pk WHERE o.op<>'partition_delete' AND (last IS NULL OR seq > last))"
_ACC = "acc AS (SELECT * FROM (SELECT *, max(writetime) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM live) WHERE pm IS NULL OR writetime > pm)"
_ALIVE = "alive AS (SELECT * FROM (SELECT *, max(CASE WHEN op='delete' THEN writetime END) OVER (PARTITION BY id) AS dead FROM acc) WHERE dead IS NULL OR writetime > dead)"
_EXP = f"coalesce(writetime + ttl*1000000, {FOREVER})"
FOLD_SQL = f"WITH {_PD}, {_ACC}, {_ALIVE} SELECT id, arg_max(partition_key, writetime) AS partition_key, arg_max(k, writetime) FILTER (WHERE k IS NOT NULL) AS k, arg_max(event_type, writetime) AS event_type, arg_max(value, writetime) FILTER (WHERE value IS NOT NULL) AS value, max(writetime) AS writetime, arg_max({_EXP}, writetime) AS expires_at FROM alive WHERE op='upsert' GROUP BY id"


@_q("merge_latest", FOLD_SQL)
def _fold(spark, sf_dir):
    return ingest.fold(ops(spark, sf_dir), ["k", "event_type", "value"])


@_q("lww_upsert", f"WITH live AS (SELECT * FROM ({OPS_SQL}) WHERE op='upsert'), {_ACC} SELECT id, max(writetime) AS writetime, arg_max(k, writetime) AS k, arg_max(event_type, writetime) AS event_type FROM acc GROUP BY id")
def _lww(spark, sf_dir):
    return ingest.lww(ops(spark, sf_dir), ["k", "event_type"])


@_q("row_delete", f"WITH live AS (SELECT * FROM ({OPS_SQL}) WHERE op<>'partition_delete'), {_ACC}, {_ALIVE} SELECT id, max(writetime) AS writetime FROM alive WHERE op='upsert' GROUP BY id")
def _row_delete(spark, sf_dir):
    return ingest.fold(ops(spark, sf_dir).where("op <> 'partition_delete'"), ["k"]).select("id", "writetime")


@_q("partition_delete", f"WITH {_PD} SELECT seq, id FROM live")
def _partition_delete(spark, sf_dir):
    return ingest.after_partition_deletes(ops(spark, sf_dir)).select("seq", "id")


_NOW = "(SELECT min(epoch_us(ts)) + 1296000000000 FROM events)"


def _now(spark, sf_dir) -> int:
    return table(spark, sf_dir, "events").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0] + 1296000000000


@_q("ttl_stamp", f"SELECT seq, {_EXP} AS expires_at FROM ({OPS_SQL})")
def _stamp(spark, sf_dir):
    return ops(spark, sf_dir).select("seq", expires_at(F.col("writetime"), F.col("ttl")).alias("expires_at"))


@_q("ttl_visible", f"SELECT seq AS id FROM (SELECT seq, event_type, {_EXP} AS x FROM ({OPS_SQL})) WHERE event_type='click' AND x > {_NOW}")
def _visible(spark, sf_dir):
    df = ops(spark, sf_dir).withColumn("expires_at", expires_at(F.col("writetime"), F.col("ttl")))
    d = Documents(df, F.col("seq"), F.col("partition_key"), F.col("expires_at"), cols=["event_type", "k"])
    return Search(d, SearchRequest("event_type:click", 10), _now(spark, sf_dir)).matched.select(F.col("seq").alias("id"))


@_q("ttl_prune", f"SELECT id, writetime FROM ({FOLD_SQL}) WHERE expires_at > {_NOW}")
def _prune(spark, sf_dir):
    return ingest.pruned(ingest.fold(ops(spark, sf_dir), ["k"]), _now(spark, sf_dir)).select("id", "writetime")


_KINDS = list(ingest.KINDS)
_KIND = "CASE event_id % 11 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " ELSE 'unheard_of' END"


def _kinds(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(k) for k in [*_KINDS, "unheard_of"]]), (F.col("event_id") % 11 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), kind.alias("kind"))


@_q("cdc_classify", "SELECT event_id AS seq, CASE event_id % 11 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(ingest.KINDS.values())) + " ELSE 'skip' END AS action FROM events")
def _classify(spark, sf_dir):
    return _kinds(spark, sf_dir).select("seq", ingest.classify(F.col("kind")).alias("action"))


@_q("cdc_counters", f"SELECT count(*) FILTER (WHERE k IN ('row_insert','row_update','post_image','row_delete','partition_delete')) AS processed, count(*) FILTER (WHERE k NOT IN ('row_insert','row_update','post_image','row_delete','partition_delete')) AS skipped FROM (SELECT {_KIND} AS k FROM events)")
def _counters(spark, sf_dir):
    return ingest.counters(_kinds(spark, sf_dir).select(ingest.classify(F.col("kind")).alias("op")))


@_q("cdc_scan", f"SELECT count(*) AS n, max(writetime) AS last FROM ({OPS_SQL}) WHERE writetime >= {_NOW}")
def _scan(spark, sf_dir):
    now = _now(spark, sf_dir)
    return ops(spark, sf_dir).where(F.col("writetime") >= now).agg(F.count("*").alias("n"), F.max("writetime").alias("last"))


@_q("shard_route", "SELECT conv_id || ':' || turn AS id, CAST(CAST('0x' || substr(md5(CAST(conv_id AS VARCHAR)),1,15) AS BIGINT) % 8 AS INTEGER) AS shard FROM conversations")
def _route(spark, sf_dir):
    return turns(spark, sf_dir).df.select("id", ingest.shard(F.col("partition_key"), 8).alias("shard"))


_DELTA = "WITH e AS (SELECT event_id, ['a','b','a','t' || (event_id % 7)] AS base, event_id % 4 = 0 AS tomb, ['b','t' || (event_id % 3)] AS rem, ['a','c','t' || (event_id % 5)] AS add FROM events), s AS (SELECT event_id, add, list_filter(CASE WHEN tomb THEN [] ELSE base END, lambda x: NOT list_contains(rem, x)) AS kept FROM e) SELECT event_id, array_to_string(kept || list_filter(add, lambda x: NOT list_contains(kept, x)), ',') AS tags FROM s"


@_q("collection_delta", _DELTA)
def _delta(spark, sf_dir):
    e = F.col("event_id")
    tag = lambda n: F.concat(F.lit("t"), e % n)
    out = ingest.apply_delta(F.array(F.lit("a"), F.lit("b"), F.lit("a"), tag(7)), e % 4 == 0, F.array(F.lit("b"), tag(3)), F.array(F.lit("a"), F.lit("c"), tag(5)))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(out, ",").alias("tags"))


def _range_log(spark, sf_dir) -> DataFrame:
    """Ranges over turns: every third conversation from turn 1 (in) to turn 3 (out); every sixth has
    no end row."""
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct().where("conv_id % 3 = 0")
    row = lambda seq, op, bound: F.struct(seq.alias("seq"), F.lit(op).alias("op"), F.lit(bound).cast("long").alias("bound"))
    start, end = row(F.col("conv_id") * 2, "range_del_incl_left", 1), row(F.col("conv_id") * 2 + 1, "range_del_excl_right", 3)
    rows = c.select("conv_id", F.explode(F.when(F.col("conv_id") % 6 == 0, F.array(start)).otherwise(F.array(start, end))).alias("r"))
    return rows.select((F.col("conv_id") % 5).cast("string").alias("stream_id"), "r.seq", "r.op", F.col("conv_id").cast("string").alias("partition_key"), "r.bound", F.lit(100).cast("long").alias("writetime"))


_RANGES = "SELECT conv_id, conv_id*2+1 AS seq FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 3 = 0 AND conv_id % 6 <> 0)"


@_q("range_pair", f"SELECT CAST(conv_id % 5 AS VARCHAR) AS stream_id, seq, CAST(conv_id AS VARCHAR) AS partition_key, CAST(1 AS BIGINT) AS low, CAST(3 AS BIGINT) AS high, true AS low_in, false AS high_in, CAST(100 AS BIGINT) AS writetime FROM ({_RANGES})")
def _pair(spark, sf_dir):
    return ingest.pair_ranges(_range_log(spark, sf_dir))


@_q("range_delete", f"SELECT conv_id || ':' || turn AS id FROM conversations WHERE NOT (turn >= 1 AND turn < 3 AND conv_id IN (SELECT conv_id FROM ({_RANGES})))")
def _range(spark, sf_dir):
    d = turns(spark, sf_dir).df.withColumn("writetime", F.col("turn"))
    return ingest.without_ranges(d, ingest.pair_ranges(_range_log(spark, sf_dir)), "turn").select("id")


def _turn_log(spark, sf_dir) -> DataFrame:
    """Every turn as an upsert, in its order."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    key = F.col("conv_id").cast("string")
    payload = F.to_json(F.struct("turn", F.array(F.lit("a"), F.concat(F.lit("t"), F.col("turn") % 3)).alias("tags")))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.lit("row_insert").alias("op"), F.concat_ws(":", key, "turn").alias("id"), key.alias("partition_key"), F.lit(50).cast("long").alias("writetime"), F.lit(None).cast("long").alias("ttl"), payload.alias("payload_json"))


@_q("stream_range_delete", ORACLES["range_delete"].replace("SELECT conv_id", "SELECT DISTINCT conv_id", 1))
def _stream_range(spark, sf_dir):
    """The ranges of ``range_delete`` as a second batch on the state after the first."""
    first = apply.apply_batch(spark.createDataFrame([], apply.STATE), _turn_log(spark, sf_dir))
    log = _range_log(spark, sf_dir).withColumn("bounds", F.array(F.col("bound").cast("string"))).drop("bound")
    log = log.select("*", F.lit(None).cast("string").alias("id"), F.lit(None).cast("long").alias("ttl"), F.lit(None).cast("string").alias("payload_json"))
    return apply.apply_batch(first, log, ("long",)).where("not dead").select("id")


@_q(
    "stream_set_delta",
    "SELECT DISTINCT conv_id || ':' || turn AS id, CASE WHEN turn % 4 = 0 THEN 'b' WHEN turn % 4 = 1 THEN 't' || (turn % 3) || ',b' "
    "WHEN turn % 4 = 2 THEN 'a,t' || (turn % 3) ELSE 'a,t' || (turn % 3) || CASE WHEN turn % 3 = 1 THEN '' ELSE ',t1' END END AS tags FROM conversations",
)
def _stream_delta(spark, sf_dir):
    """Deltas on the stored tags [a, t0..t2]: clear and add b; remove a and add b; none; add t1."""
    first = apply.apply_batch(spark.createDataFrame([], apply.STATE), _turn_log(spark, sf_dir))
    deltas = F.element_at(F.array(*[F.lit(x) for x in ('{"tags":{"tombstone":true,"add":["b","b"]}}', '{"tags":{"remove":["a"],"add":["b"]}}', "no json", '{"tags":{"add":["t1","a"]}}')]), (F.substring_index("id", ":", -1).cast("int") % 4 + 1).cast("int"))
    log = _turn_log(spark, sf_dir).withColumn("op", F.lit("row_update")).withColumn("writetime", F.lit(60).cast("long")).withColumn("payload_json", F.lit(None).cast("string")).withColumn("collection_deltas", deltas)
    tags = F.array_join(F.from_json(F.get_json_object("payload_json", "$.tags"), "array<string>"), ",")
    return apply.apply_batch(first, log).where("not dead").select("id", tags.alias("tags"))


# analysis


@_q("an_group_stats", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice),2) AS total, round(avg(l_extendedprice),6) AS mean, min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(stddev_samp(l_extendedprice),6) AS sd FROM lineitem GROUP BY 1,2")
def _stats(spark, sf_dir):
    return an.group_stats(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


@_q("an_two_level_agg", "SELECT l_returnflag, round(sum(m),4) AS sum_of_means, count(*) AS groups FROM (SELECT l_returnflag, l_suppkey, avg(l_quantity) AS m FROM lineitem GROUP BY 1,2) GROUP BY 1")
def _two(spark, sf_dir):
    return an.two_level(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_suppkey"], ["l_returnflag"], "l_quantity")


def _progress(spark, sf_dir):
    done = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))
    return table(spark, sf_dir, "events").select("event_type", "event_id", done.alias("done"))


@_q("an_time_to_pct", "WITH p AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS done FROM events), m AS (SELECT *, max(done) OVER (PARTITION BY event_type) AS most FROM p) SELECT event_type, min(CASE WHEN done*100>=most*50 THEN event_id END) AS to_50, min(CASE WHEN done*100>=most*90 THEN event_id END) AS to_90, min(CASE WHEN done*100>=most*100 THEN event_id END) AS to_100 FROM m GROUP BY 1")
def _to_pct(spark, sf_dir):
    return an.time_to_share(_progress(spark, sf_dir), ["event_type"], "event_id", "done")


@_q("an_bucketed", "SELECT CAST(round(l_quantity/7,0) AS BIGINT) AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def _bucketed(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.round(F.col("l_quantity") / 7, 0).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


@_q("an_join_agg", "WITH c AS (SELECT c_nationkey AS k, count(*) AS customers, round(avg(c_acctbal),4) AS bal FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) SELECT n_name, customers, suppliers, bal FROM c JOIN s USING (k) JOIN nation ON n_nationkey = k")
def _join_agg(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("bal"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "k").join(table(spark, sf_dir, "nation"), F.col("k") == F.col("n_nationkey")).select("n_name", "customers", "suppliers", "bal")


@_q("an_pivot", "SELECT o_orderpriority, max(CASE WHEN o_orderstatus='O' THEN share END) AS o, max(CASE WHEN o_orderstatus='F' THEN share END) AS f, max(CASE WHEN o_orderstatus='P' THEN share END) AS p FROM (SELECT o_orderpriority, o_orderstatus, round(count(*)*1.0/t.n,6) AS share FROM orders CROSS JOIN (SELECT count(*) AS n FROM orders) t GROUP BY 1,2,t.n) GROUP BY 1")
def _pivot(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    counts = o.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("c"))
    share = counts.crossJoin(F.broadcast(o.agg(F.count("*").alias("n")))).withColumn("share", F.round(F.col("c") / F.col("n"), 6))
    return an.pivot(share, "o_orderpriority", "o_orderstatus", ["O", "F", "P"], F.col("share"))


@_q("an_quantiles", "SELECT event_type, round(quantile_cont(value,0.5),6) AS p50, round(quantile_cont(value,0.9),6) AS p90, round(quantile_cont(value,0.95),6) AS p95, round(quantile_cont(value,0.99),6) AS p99, round(quantile_cont(value,0.999),6) AS p99_9 FROM events GROUP BY 1")
def _quantiles(spark, sf_dir):
    return an.quantiles(table(spark, sf_dir, "events"), ["event_type"], "value")


@_q("an_ratios", "SELECT l_suppkey, round(sum(l_tax)/nullif(sum(CASE WHEN l_returnflag='R' THEN l_discount ELSE 0 END),0),6) AS ratio FROM lineitem GROUP BY 1")
def _ratios(spark, sf_dir):
    below = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_discount")).otherwise(0.0))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_tax") / F.nullif(below, F.lit(0.0)), 6).alias("ratio"))


@_q("an_unnest", "SELECT p_partkey, s.system AS system, unnest(s.samples) AS visible FROM (SELECT p_partkey, unnest([{'system':'x','samples':[p_size,p_size+1]},{'system':'y','samples':[p_size*2]}]) AS s FROM part)")
def _unnest(spark, sf_dir):
    one = F.struct(F.lit("x").alias("system"), F.array(F.col("p_size"), F.col("p_size") + 1).alias("samples"))
    two = F.struct(F.lit("y").alias("system"), F.array(F.col("p_size") * 2).alias("samples"))
    outer = table(spark, sf_dir, "part").select("p_partkey", F.inline(F.array(one, two)))
    return outer.select("p_partkey", "system", F.explode("samples").alias("visible"))


@_q("an_regex", "SELECT s_suppkey, CAST(regexp_extract(s_name,'#0*([0-9]+)$',1) AS BIGINT) AS number, CASE WHEN s_name LIKE '%1' THEN 'one' WHEN s_name LIKE '%2' THEN 'two' ELSE 'other' END AS ending FROM supplier")
def _regex(spark, sf_dir):
    ending = F.when(F.col("s_name").like("%1"), "one").when(F.col("s_name").like("%2"), "two").otherwise("other")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.regexp_extract("s_name", "#0*([0-9]+)$", 1).cast("long").alias("number"), ending.alias("ending"))


@_q("an_strptime", "SELECT o_orderkey, epoch(strptime(strftime(o_orderdate,'%Y/%m/%d') || ' 07:30:00','%Y/%m/%d %H:%M:%S'))::BIGINT AS seconds FROM orders")
def _strptime(spark, sf_dir):
    text = F.concat(F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit(" 07:30:00"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_seconds(F.to_timestamp(text, "yyyy/MM/dd HH:mm:ss")).alias("seconds"))


_COUNTED = ["customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier"]


@_q("an_views", "SELECT l_returnflag, count(*) AS n, round(sum(o_totalprice),2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def _views(spark, sf_dir):
    an.as_views(spark, {f"fw_{t}": f"{sf_dir}/{t}.parquet" for t in ("lineitem", "orders")})
    return spark.sql("SELECT l_returnflag, count(*) AS n, round(sum(o_totalprice),2) AS total FROM fw_lineitem JOIN fw_orders ON l_orderkey = o_orderkey GROUP BY 1")


@_q("an_union_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _COUNTED))
def _counts(spark, sf_dir):
    out = None
    for t in _COUNTED:
        one = table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@_q("an_nearest_rank", "SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r = least(floor(n*0.95), n-1) + 1")
def _nearest(spark, sf_dir):
    return an.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", 0.95)


@_q("an_peak_rate", "WITH s AS (SELECT event_type, t, max(c) AS c FROM (SELECT event_type, epoch_us(ts)//1000000 AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS c FROM events) GROUP BY 1,2), j AS (SELECT a.event_type, a.t, a.c, min(b.t) AS bt FROM s a JOIN s b ON a.event_type=b.event_type AND b.t-a.t>=3600 GROUP BY 1,2,3) SELECT j.event_type, round(max((s.c-j.c)*1.0/(j.bt-j.t)),6) AS peak FROM j JOIN s ON s.event_type=j.event_type AND s.t=j.bt GROUP BY 1")
def _peak(spark, sf_dir):
    c = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select("event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("t"), c.alias("c"))
    return an.peak_rate(rows.groupBy("event_type", "t").agg(F.max("c").alias("c")), ["event_type"], "t", "c", 3600)
