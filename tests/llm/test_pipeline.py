"""The stages in order on a small table, each against what it must keep or take away."""

import random

import corpus_pipeline
from findwell.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __fw_text int"


def corpus():
    r = random.Random(9)
    english, german = ["th", "er", "on", "ing", "and", "re"], ["sch", "ung", "ein", "der", "ä", "z"]
    text = lambda parts, n: " ".join("".join(r.choice(parts) for _ in range(r.randrange(2, 6))) for _ in range(n))
    rows = []
    passage = text(english, 60)
    for i in range(60):
        body = text(english if i % 2 else german, 150)
        if i in (21, 31, 41):
            body = body + " " + passage
        rows.append((i, body, "en" if i % 2 else "de", f"s{i % 3}"))
    copy = rows[7][1].split()
    copy[70] = "changed"
    rows += [(100, rows[5][1], "en", "s0"), (101, " ".join(copy), "en", "s1"), (102, "12345 !!", "en", "s0"), (103, None, None, None)]
    return [(*x, len(x[1] or ""), 1) for x in rows]


def test_stages(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, ids = [n for n, _ in corpus_pipeline.STAGES], {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        ids[name] = sorted(r["doc_id"] for r in docs.collect())
        if name == "substring_dedup":
            n = {r["doc_id"]: len(r["text"].split()) for r in docs.collect()}
            assert n[21] == 210 and n[31] == n[41] == 150
    assert names == ["language_id", "near_dedup", "substring_dedup", "mixing", "packing"]
    assert set(ids["language_id"]) == {r[0] for r in rows} - {102, 103}
    assert set(ids["near_dedup"]) == set(range(60)) == set(ids["substring_dedup"])
    decided, _ = mixing.mix(spark.read.parquet(f"{tmp_path}/substring_dedup"))
    assert ids["mixing"] == sorted(r["doc_id"] for r in decided.collect() for _ in range(r["copies"]))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in packed if r["piece"] == 0) == ids["mixing"]
