"""Tables that cut lineage: written to the folder all executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session that names none gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = got.get() if got.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="weft-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def table(df: DataFrame, name: str = "t") -> DataFrame:
    """The frame, written as Parquet and read back. Its size is then known, so the planner can choose joins by it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
