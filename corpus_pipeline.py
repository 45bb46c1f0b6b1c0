"""The corpus pipeline: documents through language ID, near-dedup, substring dedup, mixing and packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the
documents that stay, with all their columns; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from findwell.llm.common import Scratch
from findwell.llm.language import language_stage
from findwell.llm.mixing import mix_stage
from findwell.llm.near_dedup import near_dedup_stage
from findwell.llm.packing import pack_stage
from findwell.llm.substrings import substring_stage

STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]

#: No stage can be written as SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
