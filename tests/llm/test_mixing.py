"""Targets by hand, balance of the flight phase, the mix of a skewed table."""

import re

import numpy as np
from findwell.llm.mixing import fly, mix, mix_stage, op5_mix_sources, targets


def test_targets():
    got = targets({"a": 100, "b": 100, "c": 1, None: 99})
    # c stops at 3; what it leaves goes to a : b : null as 1 : 2 : 1
    assert got["c"] == 3 and abs(got["a"] - 297 / 4) < 1e-9 and abs(got["b"] - 297 / 2) < 1e-9 and abs(got[None] - 297 / 4) < 1e-9
    assert targets({"a": 0, "b": 5}) == {"a": 0.0, "b": 5.0} and targets({}) == {}


def test_flight_keeps_both_sums():
    r = np.random.default_rng(1)
    size, p = r.integers(1, 1000, 500), np.full(500, 0.37)
    left = fly(size, p, r)
    assert len(left) <= 2 and sum(0 < x < 1 for x in p) == len(left)
    assert abs(p.sum() - 0.37 * 500) < 1e-6 and abs((p * size).sum() - 0.37 * size.sum()) < 1e-3


def table(spark):
    r = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(r.integers(0, 60))), "big" if i % 3 else "small", 1) for i in range(900)]
    rows += [(1000 + i, "x " * 5, None, 1) for i in range(20)] + [(2000, None, "empty", 1), (None, "no id here", "big", 1), (5, "twice", "big", 1), (5, "twice", "big", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_mix(spark, tmp_path):
    docs = table(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op5_mix_sources(spark, str(tmp_path)).collect()
    assert len(got) == docs.count()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(g["size"] for g in got) == sorted(words(r["text"]) for r in docs.collect())
    per = {}
    for g in got:
        assert 0 <= g["taken"] <= 3 * g["size"] and (g["size"] == 0 or g["taken"] % g["size"] == 0)
        per.setdefault((g["source_size"], g["target"]), []).append(g["taken"])
    assert len(per) == 4
    for (size, target), taken in per.items():
        assert abs(sum(taken) - target) <= 60 and target <= 3 * size
    docs.orderBy("text").repartition(7).write.parquet(f"{tmp_path}/other/documents.parquet")
    again = op5_mix_sources(spark, f"{tmp_path}/other").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op5_mix_sources(spark, f"{tmp_path}/none").count() == 0


def test_null_ids_and_repeated_rows_fill_no_block(spark, monkeypatch):
    """A third of the rows without an id, another third one row again and again, one long text."""
    monkeypatch.setattr("findwell.llm.mixing.BLOCK", 32)
    rows = [(i, "w " * (1 + i % 9), "a") for i in range(300)] + [(None, "v " * (1 + i % 7), "a") for i in range(300)] + [(7, "again and again", "b")] * 300 + [(8, "long " * 100_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    decided, sources = mix(docs)
    got = decided.collect()
    assert len(got) == 901
    for src, name, size, target in sources:
        own = [g for g in got if g["src"] == src]
        assert size == sum(g["size"] for g in own) and abs(sum(g["copies"] * g["size"] for g in own) - target) <= 60_000
    counts = sorted(g["copies"] for g in got if g["doc_id"] == 7 and not g["none"])
    out = mix_stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() == sum(g["copies"] for g in got)
    assert out.where("doc_id = 7 and source = 'b'").count() == sum(counts) - sum(g["copies"] for g in got if g["doc_id"] == 7 and g["size"] != 3)


def test_stage_takes_as_decided(spark, tmp_path):
    table(spark).write.parquet(f"{tmp_path}/d.parquet")
    docs = spark.read.parquet(f"{tmp_path}/d.parquet")
    out = mix_stage(spark, docs, "").collect()
    decided, _ = mix(docs)
    assert len(out) == sum(r["copies"] for r in decided.collect())
    assert {r["source"] for r in out} == {"big", "small", None}
    empty = spark.createDataFrame([], docs.schema)
    assert mix_stage(spark, empty, "").count() == 0
