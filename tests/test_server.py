"""From operations to answers over HTTP."""

import json
import threading
import urllib.error
import urllib.request

import pytest
from findwell.operators.search import Documents
from findwell.operators.server import Engine, serve
from findwell.sources.oplog import OPS, products
from pyspark.sql import functions as F


def test_engine_over_http(spark, tmp_path):
    make = lambda df: Documents.of_variant(df.withColumn("document", F.try_parse_json("payload_json")), {"title": "text", "price": "number"})
    engine = Engine(spark, f"{tmp_path}/docs", make)
    row = lambda seq, op, id, w, doc: (seq, "s", op, id, id.split(":")[0], w, None, json.dumps(doc))
    engine.apply_batch(spark.createDataFrame([row(1, "row_insert", "u:1", 10, {"title": "Red Gadget", "price": 15}), row(2, "row_insert", "u:2", 10, {"title": "Gadget", "price": 75})], OPS))
    engine.apply_batch(spark.createDataFrame([row(3, "row_update", "u:1", 20, {"price": 60}), row(4, "row_delete", "u:2", 9, {})], OPS))
    assert engine.list_ids("u") == ["u:1", "u:2"]
    server = serve(engine)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"

    def ask(body):
        return json.load(urllib.request.urlopen(urllib.request.Request(f"{at}/api/v1/search", json.dumps(body).encode())))

    base = {"query": "document.title:gadget AND document.price:[40 TO 70]", "limit": 5, "offset": 0, "consistency": 0}
    got = ask(base | {"facet_fields": ["price"]})
    assert got["total_hits"] == 1 and got["hits"][0]["id"] == "u:1" and json.loads(got["hits"][0]["payload_json"])["title"] == "Red Gadget"
    assert [h["id"] for h in ask(base | {"query": "gadget", "boost_fields": [{"field": "title", "boost": 2}]})["hits"]] == ["u:2", "u:1"]
    for bad in ({"query": "x"}, base | {"limit": 0}, base | {"query": "(x"}):
        with pytest.raises(urllib.error.HTTPError, match="400"):
            ask(bad)
    assert json.load(urllib.request.urlopen(f"{at}/api/health"))["status"] == "ok"
    server.shutdown()


def test_products(spark):
    a, b = products(spark, 50), products(spark, 50)
    assert a.collect() == b.collect() and a.count() == 50 and a.where("price < 0 OR name IS NULL").count() == 0
