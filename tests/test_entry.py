"""The driver contract, with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship(spark):
    df = e.entry(spark)
    assert df.columns == ["id", "score"] and df.count() == 10


def test_without_the_training_data_operators():
    code = "import sys; sys.modules['findwell.llm'] = None\nimport __spark_entry__ as e\nassert 'bm25_single' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
