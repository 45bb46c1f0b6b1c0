"""The folder that driver and executors share, for tables that the engine keeps for itself."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, without a trailing slash. Where it is unset, a local session gets a
    folder made and set; a cluster's session is refused, as its executors would not see one."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    path = found.get() if found.isDefined() else spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="findwell-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")
