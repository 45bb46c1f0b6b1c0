"""Held-out accuracy, rejection and the defined cases."""

import random

from findwell.llm.language import fold, language_stage, op6_language

SF = "/root/testdata/sf0.01"


def test_fold():
    assert fold("Été, 42\nDEUX!") == " été deux ".encode() and fold("12 .") == b"  "


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op6_language(spark, SF).collect()
    held = [g for g in got if g["held_out"]]
    assert len(got) == len(truth) and 0.25 < len(held) / len(got) < 0.42
    assert sum(g["lang_pred"] == truth[g["doc_id"]] for g in held) / len(held) > 0.97
    assert all(0 <= g["score"] <= 1 for g in got)


def corpus(spark):
    r = random.Random(2)
    make = lambda parts, n: " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(n))
    rows = [(i, make(["th", "er", "on", "ing"], 80), "en", 0) for i in range(60)] + [(100 + i, make(["ä", "sch", "ung", "ein"], 80), "de", 0) for i in range(60)]
    rows += [(300, None, "en", 0), (301, "", "en", 0), (302, "123 --", None, 0), (303, make(["sch", "ung", "ein"], 50), None, 0), (None, make(["th", "er"], 40), None, 0), (304, "Sch " * 60000, None, 0), (305, "½ ² ①② Ⅷ", "de", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


def test_defined_cases(spark, tmp_path):
    corpus(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = {g["doc_id"]: g for g in op6_language(spark, str(tmp_path)).collect()}
    assert [got[i]["lang_pred"] for i in (300, 301, 302, 305)] == ["und"] * 4 and got[300]["score"] == 0
    assert got[303]["lang_pred"] == got[304]["lang_pred"] == "de" and got[None]["lang_pred"] == "en" and not got[None]["held_out"]
    kept = language_stage(spark, corpus(spark), "")
    assert kept.columns == ["doc_id", "text", "lang", "score"]
    assert {r["doc_id"] for r in kept.collect()} == set(got) - {300, 301, 302, 305}


def test_nothing_to_learn_from(spark, tmp_path):
    rows = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language_stage(spark, rows, "").count() == 0 and language_stage(spark, rows.limit(0), "").count() == 0
    rows.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert op6_language(spark, str(tmp_path)).count() == 0
