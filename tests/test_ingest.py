"""Change-log operators against sequential folds; streaming against batch."""

import json
import random

import pytest
from findwell.functions.keys import FOREVER, TableSpec, expires_at, with_ids
from findwell.operators import ingest
from findwell.sources.oplog import LOG, OPS, read_log, stream_log
from findwell.streaming.apply import current, prune, start
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("base", "tomb", "removed", "added", "want"),
    [
        (["a"], False, None, ["b"], ["a", "b"]), (["a", "b"], False, ["a"], None, ["b"]), (["old"], True, None, ["new"], ["new"]), (["a"], False, None, ["a"], ["a"]),
        (None, False, None, ["x", "x"], ["x"]), (["a", "a"], False, None, ["b"], ["a", "a", "b"]), (["a"], True, ["b"], None, []), (None, None, None, None, []),
        (["premium", "starter"], False, ["premium"], None, ["starter"]), (["legacy"], False, ["legacy"], ["legacy"], ["legacy"]),
    ],
)
def test_collection_delta(spark, base, tomb, removed, added, want):
    df = spark.createDataFrame([(base, tomb, removed, added)], "b array<string>, t boolean, r array<string>, a array<string>")
    assert df.select(ingest.apply_delta(F.col("b"), F.col("t"), F.col("r"), F.col("a"))).first()[0] == want


def test_map_delta(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, False, ["a"], {"b": "3", "c": "4"})], "b map<string,string>, t boolean, r array<string>, a map<string,string>")
    assert df.select(ingest.apply_map_delta(F.col("b"), F.col("t"), F.col("r"), F.col("a"))).first()[0] == {"b": "3", "c": "4"}


def test_deep_merge():
    assert ingest.deep_merge({"a": {"x": 1, "y": 2}, "l": [1]}, {"a": {"y": None, "z": 3}, "l": [2]}) == {"a": {"x": 1, "y": None, "z": 3}, "l": [2]}
    assert ingest.deep_merge(1, {"a": 1}) == {"a": 1}


def test_ids_and_expiry(spark):
    spec = TableSpec.discover([("n", "clustering", 0), ("b", "partition_key", 1), ("a", "partition_key", 0)])
    assert spec == TableSpec(("a", "b"), ("n",))
    df = with_ids(spark.createDataFrame([("x", None, 3)], "a string, b string, n int"), spec)
    assert df.select("id", "partition_key").first() == ("x:null:3", "x:null")
    df = spark.createDataFrame([(10, 2), (10, None), (FOREVER - 5, 1), (0, FOREVER)], "w long, t long")
    assert [r[0] for r in df.select(expires_at(F.col("w"), F.col("t"))).collect()] == [2000010, FOREVER, FOREVER, FOREVER]


def log(seed, n=600):
    r = random.Random(seed)
    out = []
    for seq in range(n):
        kind = r.choices(["row_insert", "row_update", "row_delete", "partition_delete", "pre_image"], [6, 6, 3, 0.2, 1])[0]
        key = r.randrange(25)
        payload = {k: r.randrange(9) for k in r.sample("abc", r.randrange(1, 4))} | ({"n": {r.choice("pq"): 1}} if r.random() < 0.5 else {})
        text = "not json" if r.random() < 0.03 else json.dumps(payload)
        out.append((seq, "s", kind, f"i{key}", f"p{key % 5}", 1000 + seq * 3 + r.randrange(-40, 40), r.choice([None, None, 7]), text))
    return out


def sequential(rows):
    """Last writer wins with tombstones; partition deletes wipe what came before, tombstones too."""
    docs, wt = {}, {}
    for seq, _, kind, key, pk, w, ttl, text in rows:
        act = ingest.KINDS[kind]
        if act == "partition_delete":
            for i in [i for i in wt if int(i[1:]) % 5 == int(pk[1:])]:
                wt.pop(i)
                docs.pop(i, None)
        elif act in ("upsert", "delete") and (key not in wt or w > wt[key]):
            if act == "delete":
                docs.pop(key, None)
                wt[key] = w
                continue
            try:
                patch = json.loads(text)
            except ValueError:
                continue
            wt[key] = w
            docs[key] = (ingest.deep_merge(docs[key][0], patch) if key in docs else patch, w, FOREVER if ttl is None else w + ttl * 1_000_000)
    return docs


def as_docs(df):
    return {r["id"]: (json.loads(r["payload_json"]), r["writetime"], r["expires_at"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_json(spark, seed):
    rows = log(seed)
    df = spark.createDataFrame(rows, OPS).withColumn("op", ingest.classify(F.col("op")))
    assert as_docs(ingest.fold_json(df)) == sequential(rows)


def test_flat_fold_without_tombstones(spark):
    rows = [(1, "upsert", "i", "p", 10, 1), (2, "delete", "i", "p", 20, None), (3, "upsert", "i", "p", 15, 3)]
    df = spark.createDataFrame(rows, "seq long, op string, id string, partition_key string, writetime long, v int").withColumn("ttl", F.lit(None).cast("long"))
    assert ingest.fold(df, ["v"]).count() == 0
    assert [r["v"] for r in ingest.fold(df, ["v"], tombstones=False).collect()] == [3]


def test_range_delete_of_the_middle(spark):
    docs = spark.createDataFrame([("u:1", "u", 1, 5), ("u:2", "u", 2, 5), ("u:3", "u", 3, 5)], "id string, partition_key string, order_id long, writetime long")
    ops = [("s", 1, "range_del_excl_left", "u", 1, 9), ("s", 2, "range_del_excl_right", "u", 3, 9), ("t", 3, "range_del_incl_right", "u", 3, 9), ("t", 4, "range_del_incl_left", "u", None, 9), ("t", 5, "range_del_incl_left", "x", None, 9), ("t", 6, "range_del_incl_right", "x", None, 9)]
    pairs = ingest.pair_ranges(spark.createDataFrame(ops, "stream_id string, seq long, op string, partition_key string, bound long, writetime long"))
    assert pairs.count() == 2
    assert sorted(r["id"] for r in ingest.without_ranges(docs, pairs, "order_id").collect()) == ["u:1", "u:3"]


def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    rows = log(5, 240)
    src, where, check = (f"{tmp_path}/{d}" for d in ("log", "docs", "check"))
    for i, cut in enumerate((rows[:90], rows[90:91], rows[91:])):
        spark.createDataFrame(cut, OPS).coalesce(1).write.mode("append").json(src)
        start(stream_log(spark, src), where, check).awaitTermination()
        assert as_docs(current(spark, where)) == sequential(rows[: (90, 91, 240)[i]])
    assert read_log(spark, src, start_micros=1300).where("writetime < 1300").count() == 0
    prune(spark, where, 1500 + 7_000_000)
    assert as_docs(current(spark, where)) == {k: v for k, v in sequential(rows).items() if v[2] > 1500 + 7_000_000}


def test_range_deletes_and_deltas_in_the_stream(spark, tmp_path):
    """A range over two clustering columns whose end comes a batch later, a set and a map."""
    src, where, check = (f"{tmp_path}/{d}" for d in ("log", "docs", "check"))
    up = lambda seq, key, wt, doc, deltas=None: (seq, "s", "row_update", f"u:{key}", "u", wt, None, doc, None, deltas)
    mark = lambda seq, op, wt, *bounds: (seq, "s", op, None, "u", wt, None, None, list(bounds), None)
    batches = [
        [up(1, "1:a", 5, '{"x":1}'), up(2, "2:b", 5, '{"x":2,"tags":["p","q"],"m":{"k":1}}'), up(3, "10:b", 5, '{"x":3}'), up(4, "2:z", 5, '{"x":4}'), mark(5, "range_del_excl_left", 9, "1", "a")],
        [up(6, "2:c", 5, '{"x":5}'), mark(7, "range_del_incl_right", 9, "10", "b"), up(8, "2:b", 8, '{"late":1}')],
        [up(9, "2:b", 12, None, '{"tags":{"add":["r"]}}'), up(10, "2:b", 13, '{"tags":["p","q"],"m":{"k":1}}', '{"tags":{"remove":["p"],"add":["q","s"]},"m":{"remove":["k"],"add":{"j":2}},"bad":7}')],
    ]
    want = [{"u:1:a", "u:2:b", "u:10:b", "u:2:z"}, {"u:1:a", "u:2:z", "u:2:c"}, {"u:1:a", "u:2:z", "u:2:c", "u:2:b"}]
    for rows, ids in zip(batches, want, strict=True):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").json(src)
        start(stream_log(spark, src), where, check, clustering=("int", "string")).awaitTermination()
        assert {r["id"] for r in current(spark, where).collect()} == ids
    docs = as_docs(current(spark, where))
    assert docs["u:2:b"][0] == {"tags": ["q", "s"], "m": {"j": 2}}


def test_only_touched_buckets_are_written(spark, tmp_path):
    src, where, check = (f"{tmp_path}/{d}" for d in ("log", "docs", "check"))
    row = lambda seq, pk: (seq, "s", "row_insert", pk, pk, seq, None, '{"x":1}', None, None)
    for rows in ([row(i, f"p{i}") for i in range(50)], [row(99, "p3")]):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").json(src)
        start(stream_log(spark, src), where, check).awaitTermination()
    written = {d.name: sum(x.name.startswith("bucket=") for x in d.iterdir()) for d in (tmp_path / "docs" / "data").iterdir()}
    assert written["v=0"] > 5 and written["v=1"] == 1 and current(spark, where).count() == 50
    assert {r["id"]: r["writetime"] for r in current(spark, where).collect()}["p3"] == 99


def test_results_are_kept_and_seed_rows_are_stable(spark, tmp_path):
    from findwell.sources.oplog import products, read_results, write_results

    for n in (1, 2):
        write_results(spark.createDataFrame([("q", n * 1.5)], "query string, ms double"), f"{tmp_path}/r")
    assert sorted(r["ms"] for r in read_results(spark, f"{tmp_path}/r").collect()) == [1.5, 3.0]
    one, two = products(spark, 20).collect(), products(spark, 50).where("product_id < 20").collect()
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(one[0]) == 14
    assert all(1 <= r["rating"] <= 5 and r["updated_at"] >= r["created_at"] and r["attributes"]["colour"] for r in one)


def test_ids_are_folded_in_one_pass_over_sorted_rows(spark):
    """Operations of an id that lie in several Arrow batches, among many ids; nothing is run id by id."""
    rows = [(s, "s", "row_update", f"i{s % 7}", "p", 1000 + s, 5 if s % 2 else None, json.dumps({f"k{s % 5}": s})) for s in range(200)]
    rows += [(300 + i, "s", "row_insert", f"j{i}", "p", 2**60 + i, None, '{"x":1}') for i in range(50)]
    df = spark.createDataFrame(rows, OPS).withColumn("op", ingest.classify(F.col("op")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        done = ingest.fold_json(df)
        assert as_docs(done) == sequential(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in done._jdf.queryExecution().toString()
