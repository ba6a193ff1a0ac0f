"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new place in the folder of spark.checkpoint.dir. A local one is set only where the setting is absent in local mode (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='marlstone-')}")
    return f"{sc.getCheckpointDir().rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, at: str) -> DataFrame:
    """df as a table at a place: later steps read it there, so what it took to make it is done once."""
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
