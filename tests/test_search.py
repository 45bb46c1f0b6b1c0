"""Search scenarios: predicates, ranking, paging, grouping, facets, expiry, failures."""

import duckdb
import pytest
from findwell.functions.text import literal_tokens, within_edits
from findwell.functions.keys import TableSpec, with_ids
from findwell.operators.search import ALL, ANY, Documents, Search, SearchFailure, list_ids, lookup, search_shards
from findwell.plans.query import QueryError, SearchRequest, expanded, parse
from pyspark.sql import functions as F


def ask(docs, query, **more):
    return Search(docs, SearchRequest(query, more.pop("limit", 10), **more)).run()


def ids(docs, query, **more):
    return sorted(h["id"] for h in ask(docs, query, **more).hits)


@pytest.fixture(scope="module")
def products(spark):
    rows = [
        ("a", "Rocket Engine Design", "general propulsion overview", 15.0, "electronics", ["legacy", "overridden"], 1577836800000),
        ("b", "General Propulsion Overview", "rocket engine design details", 75.0, "electronics", ["legacy"], 1655294400000),
        ("c", "Wireless Mouse", "active noise cancellation technology", 200.0, "books", None, 1735689599000),
        ("d", "Wired Headset", "great sound cancellation of noise", 59.99, None, [], None),
        ("e", "Bluetooth Speaker", None, None, "books", ["issue_005_keep"], None),
    ]
    df = spark.createDataFrame(rows, "doc_id string, title string, body string, price double, category string, tags array<string>, created long")
    df = df.withColumn("created_at", F.timestamp_millis("created")).drop("created")
    return Documents(df, F.col("doc_id"), cols=["title", "body", "price", "category", "tags", "created_at"])


def test_tokens_are_whole_words():
    assert literal_tokens("MARKER42") == ["marker42"]
    assert literal_tokens("quick-charge " + "x" * 40) == ["quick", "charge"]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("document.title:Rocket", "a"), ("rocket", "ab"), ("document.title:wire*", "cd"), ("document.title:wireless*", "c"), ("document.title:wireles~1", "c"),
        ("document.title:blutoth~1", ""), ("document.title:blutoth~2", "e"), ("document.title:teh~1", ""), ('document.body:"noise cancellation"', "c"),
        ('document.body:"technology cancellation"', ""), ("document.price:[40 TO 100]", "bd"), ("document.price:[1000 TO 2000]", ""), ("price:{75 TO *}", "c"),
        ("document.title:Overview AND document.price:[40 TO 100]", "b"), ("document.created_at:[1640995200000 TO 1672531200000]", "b"), ("document.tags:legacy AND document.tags:overridden", "a"),
        ("tags:issue_005_keep", "e"), ("title:(rocket OR mouse) AND NOT body:noise", "a"), ("+title:general -price:75", ""), ("id:c OR id:d", "cd"), ("*", "abcde"), ("-title:rocket", ""),
        ('body:"noise technology"~1', "c"), ("price:IN [15 200]", "ac"), ("body:*", "abcd"), ("nothing:here", ""), ("", ""), ("title:/wire.*/", "cd"),
    ],
)
def test_predicates(products, query, want):
    assert ids(products, query) == list(want)


def test_boosts_decide_the_order(products):
    hits = ask(products, "rocket", boost_fields=(("title", 5.0), ("body", 1.0))).hits
    assert [h["id"] for h in hits] == ["a", "b"]
    assert [h["id"] for h in ask(products, "document.title:rocket^0.1 OR document.body:rocket^5").hits] == ["b", "a"]


def test_expansion():
    r = SearchRequest("red chair", 1, default_fields=("title",), boost_fields=(("title", 5.0), ("body", 1.0)))
    assert expanded(r) == "(document.title:red^5 OR document.body:red^1) AND (document.title:chair^5 OR document.body:chair^1)"
    assert expanded(SearchRequest("a OR b", 1, default_fields=("t",))) == "(document.t:a) AND (document.t:OR) AND (document.t:b)"
    for q in ("title:red", '"red chair"', "  "):
        assert expanded(SearchRequest(q, 1, default_fields=("t",))) == q


def test_bad_requests():
    for q in ("(a", 'title:"x', "price:[1 TO", "a~3", "price:[x TO y"):
        with pytest.raises(QueryError):
            parse(q)
    with pytest.raises(QueryError):
        SearchRequest("a", 0)
    assert SearchRequest("a", 0, 3).offset == 3


def test_facets(products):
    r = ask(products, "*", limit=1, facet_fields=("category", "tags", "unknown"))
    assert r.total_hits == 5 and len(r.hits) == 1
    assert r.facets == {"category": [("books", 2), ("electronics", 2)], "tags": [("legacy", 2), ("issue_005_keep", 1), ("overridden", 1)], "unknown": []}
    assert ask(products, "zzz", facet_fields=("category",)).facets == {}


def test_grouping_paging_expiry(spark):
    rows = [("u1", 1, "Widget red", 10), ("u1", 2, "Widget", 10), ("u2", 1, "Widget blue", 10), ("u2", 2, "Widget green", 99)]
    df = spark.createDataFrame(rows, "user string, n int, title string, expires_at long").withColumn("id", F.concat_ws(":", "user", "n"))
    d = Documents(df, F.col("id"), F.col("user"), F.col("expires_at"), cols=["title"])
    r = ask(d, "title:widget", group_by_partition=True)
    assert r.total_hits == 4 and [h["id"] for h in r.hits] == ["u1:2", "u2:1"]
    assert [h["id"] for h in ask(d, "title:widget", limit=2, offset=1).hits] == ["u1:1", "u2:1"]
    assert [h["id"] for h in Search(d, SearchRequest("title:widget", 9), now_micros=10).run().hits] == ["u2:2"]
    assert ask(d, "title:gone", group_by_partition=True).hits == []


def test_variant_documents(spark):
    df = spark.createDataFrame([("a", '{"title":"Red Chair","spec":{"w":3},"tags":["x y"]}'), ("b", '{"title":5,"extra":null}')], "id string, j string")
    df = df.select("id", F.lit("p").alias("partition_key"), F.parse_json("j").alias("document"), F.lit(5).cast("long").alias("expires_at"))
    d = Documents.of_variant(df, {"title": "text", "spec.w": "number", "tags": "array"})
    assert ids(d, "title:chair AND spec.w:[2 TO 4] AND tags:y") == ["a"]
    assert '"w":3' in ask(d, "title:chair").hits[0]["payload_json"]


def test_shards(spark, tmp_path):
    df = spark.createDataFrame([("a", "one")], "doc_id string, title string")
    df.write.parquet(f"{tmp_path}/s0")
    make = lambda x: Documents(x, F.col("doc_id"), cols=["title"])
    paths = [f"{tmp_path}/s0", f"{tmp_path}/s1"]
    assert search_shards(spark, paths, make, SearchRequest("title:one", 5, consistency=ANY)).total_hits == 1
    with pytest.raises(SearchFailure, match="Consistency ALL failed: 1/2 nodes succeeded"):
        search_shards(spark, paths, make, SearchRequest("title:one", 5, consistency=ALL))


@pytest.mark.parametrize("name, column", [("fts_range", "p_retailprice"), ("fts_timerange", "ts"), ("fts_cmp", "p_size"), ("fts_raw", "source"), ("list_ids_by_partition", "conv_id"), ("lookup_by_id", "doc_id")])
def test_predicates_reach_the_scan(spark, name, column):
    from findwell.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    pushed = [x.split("]")[0] for x in plan.split("PushedFilters: [")[1:]]
    assert any(f"{op}({column}," in x for x in pushed for op in ("GreaterThan", "GreaterThanOrEqual", "EqualTo"))


def test_keys_are_compared_with_their_types(spark):
    rows = spark.createDataFrame([(7, "a"), (None, "b"), (8, "x:y")], "k long, c string")
    d = Documents(with_ids(rows, TableSpec(("k",), ("c",))), F.col("id"), F.col("partition_key"), cols=["c"], spec=TableSpec(("k",), ("c",)))
    assert [r["id"] for r in list_ids(d, "7").collect()] == ["7:a"] and list_ids(d, "07").count() == 0
    assert [r["id"] for r in list_ids(d, "null").collect()] == ["null:b"] and lookup(d, "8:x:y").count() == 1


def test_any_answers_when_a_shard_fails_while_it_is_read(spark, tmp_path):
    for i in (1, 2):
        spark.createDataFrame([(i, "red")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/s{i}")
    paths = [f"{tmp_path}/s1", f"{tmp_path}/s2"]
    bad = next((tmp_path / "s2").glob("*.parquet"))
    raw = bytearray(bad.read_bytes())
    raw[4 : len(raw) // 3] = bytes(len(raw) // 3 - 4)  # the footer stays, so its schema can be read
    bad.write_bytes(bytes(raw))
    for crc in (tmp_path / "s2").glob(".*.crc"):
        crc.unlink()
    make = lambda df: Documents(df, F.col("doc_id"), cols=["text"])
    assert [h["id"] for h in search_shards(spark, paths, make, SearchRequest("text:red", 5, consistency=1)).hits] == [1]
    with pytest.raises(SearchFailure, match="1/2"):
        search_shards(spark, paths, make, SearchRequest("text:red", 5, consistency=2))


def test_load_mix():
    from findwell.operators.load import measure, mixed

    got = mixed([["a"], ["b"], ["c"], ["d"]], 4000)
    assert got == mixed([["a"], ["b"], ["c"], ["d"]], 4000) and abs(got.count("a") / 4000 - 0.4) < 0.05
    seen = []
    out = measure(seen.append, got[:50], warm_up=5, threads=4)
    assert len(seen) == 55 and out["n"] == 50 and out["p50_ms"] <= out["p95_ms"] <= out["p99_ms"]


def test_peak_rate_against_pairs(spark):
    import random

    from findwell.operators.analysis import nearest_rank, peak_rate

    r = random.Random(4)
    rows = sorted({(k, t) for k in "ab" for t in (r.randrange(0, 4000) for _ in range(200))})
    rows = [(k, t, i) for i, (k, t) in enumerate(rows)]
    want = {}
    for k, t, c in rows:
        ahead = min(((u, d) for x, u, d in rows if x == k and u >= t + 300), default=None)
        if ahead:
            want[k] = max(want.get(k, -1), (ahead[1] - c) / (ahead[0] - t))
    got = {x["k"]: x["peak"] for x in peak_rate(spark.createDataFrame(rows, "k string, t long, c long"), ["k"], "t", "c", 300).collect()}
    assert {k: round(v, 6) for k, v in want.items()} == got
    values = [("a", float(r.randrange(50))) for _ in range(999)] + [("b", 1.0), ("c", None)]
    for share in (0.0, 0.5, 0.95, 1.0):
        got = {x["k"]: x["value"] for x in nearest_rank(spark.createDataFrame(values, "k string, v double"), ["k"], "v", share).collect()}
        own = sorted(v for k, v in values if k == "a")
        assert got == {"a": own[min(int(len(own) * share), len(own) - 1)], "b": 1.0, "c": None}


def test_fuzzy_counts_bytes_as_sql_does(spark):
    words = ["dre", "ère", "dré", "中re", "der", "édre", "dr", "rde", "d", "été", "éte", "tée", "ée", "téé", "eté"]
    got = spark.createDataFrame([(w,) for w in words], "t string").select("t", *[within_edits(F.col("t"), w, n).alias(f"{w}{n}") for w in ("dre", "été") for n in (0, 1, 2)])
    sql = ", ".join(f"damerau_levenshtein(t,'{w}')<={n}" for w in ("dre", "été") for n in (0, 1, 2))
    want = duckdb.sql(f"SELECT t, {sql} FROM (SELECT unnest({words}) AS t)").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
