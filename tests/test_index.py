"""The persisted index against the scan path, and registered queries against their SQL."""

import glob

import duckdb
import pytest
from findwell.operators.index import Index, build, opened
from findwell.operators.search import Documents, Search
from findwell.plans.query import Fuzzy, Prefix, QueryError, SearchRequest, Term, parse
from findwell.queries import ORACLES, QUERIES, docs, parts
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_index_equals_scan(spark, tmp_path):
    d = docs(spark, SF)
    build(d, ["text", "lang"], str(tmp_path))
    index = Index(spark, str(tmp_path))
    scan = {r["id"]: round(r["score"], 9) for r in Search(d, SearchRequest("text:der text:die", 1000)).hits().collect()}
    assert {r["id"]: round(r["score"], 9) for r in index.any_of("text", ["der", "die"]).collect()} == scan
    want = sorted(r["id"] for r in Search(d, SearchRequest('text:"of the"', 9)).matched.selectExpr("doc_id AS id").collect())
    assert sorted(r["id"] for r in index.phrase("text", ["of", "the"]).collect()) == want
    plan = index.any_of("text", ["der"])._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "token" in plan


def test_vocabulary(spark, tmp_path):
    d = parts(spark, SF)
    build(d, ["p_name"], str(tmp_path))
    index = Index(spark, str(tmp_path))
    assert [t for t, _ in index.tokens_of(Prefix("p_name", "wid"))] == ["widget"]
    assert [t for t, _ in index.tokens_of(Fuzzy("document.p_name", "wdiget", 1))] == ["widget"]
    assert index.tokens_of(Term("p_name", "Ring"))[0][0] == "ring"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {f.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{f}'")
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    places = [want.columns.index(c) for c in cols]
    assert sorted(str(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(str(tuple(r[i] for i in places)) for r in want.fetchall())


@pytest.mark.parametrize("query", ["text:der AND text:die", "text:der^2 text:die -text:ein", 'text:"of the" text:der', "text:le*", "text:dre~1 lang:de", "(text:der OR text:die) AND lang:de", 'text:"of the"^3'])
def test_answers_equal_scans(spark, query):
    d = docs(spark, SF)
    index = opened(d, ["text", "lang"], f"{SF}/documents.parquet")
    scan = {r["id"]: round(r["score"], 9) for r in Search(d, SearchRequest(query, 10_000)).hits().collect()}
    assert {r["id"]: round(r["score"], 9) for r in index.answer(parse(query)).collect()} == scan and scan


def test_an_index_is_made_once_and_anew_for_new_files(spark, tmp_path):
    spark.createDataFrame([(1, "one two")], "doc_id long, text string").write.parquet(f"{tmp_path}/t")
    make = lambda: opened(Documents(spark.read.parquet(f"{tmp_path}/t"), F.col("doc_id"), cols=["text"]), ["text"], f"{tmp_path}/t")
    first = make()
    assert make().postings.inputFiles() == first.postings.inputFiles()
    spark.createDataFrame([(2, "one")], "doc_id long, text string").write.mode("append").parquet(f"{tmp_path}/t")
    assert sorted(r["id"] for r in make().answer(parse("text:one")).collect()) == [1, 2]
    with pytest.raises(QueryError):
        first.answer(parse("text:/o.*/"))


def test_postings_of_a_common_token_are_spread_and_whole(spark, tmp_path):
    rows = [(i, f"the w{i % 7} the", ["a b", None, "a"]) for i in range(300)] + [(300, "", []), (301, None, None), (302, "-- !", [None]), (303, "ère the", ["a"])]
    df = spark.createDataFrame(rows, "id long, text string, tags array<string>")
    build(Documents(df, F.col("id"), cols=["text", "tags"]), ["text", "tags"], str(tmp_path), 8)
    index = Index(spark, str(tmp_path))
    got = {(r["path"], r["token"], r["id"]): (r["tf"], r["len"], r["positions"]) for r in index.postings.collect()}
    want = {}
    for i, text, tags in rows:
        for path, words in (("text", (text or "").replace("-", "").replace("!", "").split()), ("tags", " ".join(t for t in tags or [] if t).split())):
            for w in words:
                at = [k for k, x in enumerate(words) if x == w]
                want[path, w, i] = (len(at), len(words), at)
    assert got == want
    assert {(r["path"], r["n_docs"], round(r["mean_len"], 9)) for r in index.path_stats.collect()} == {("text", 304, round(902 / 303, 9)), ("tags", 304, round(901 / 303, 9))}
    assert {(r["path"], r["token"]): r["df"] for r in index.vocab.collect()}["text", "the"] == 301
    assert index.postings.where("token = 'the'").select(F.col("_metadata.file_path")).distinct().count() > 1
