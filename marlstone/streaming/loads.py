"""Files of a folder loaded as they arrive (an extra): each text once, however often a batch is run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import dedupe_first, new_only

SCHEMA = "path string, sha256 string, text string"


def loaded(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema(f"{SCHEMA}, batch long").parquet(at)


def load_new(spark: SparkSession, source: str, at: str, state: str, glob: str = "*") -> int:
    """Load the files below `source` that no run has seen, by a stream that ends when all are read; the number of batches.

    A batch is a partition of the table at `at`, overwritten if it is run again after a failure, and only holds texts (path, sha256,
    text) whose digest no other batch has; of equal texts in a batch the first path's comes in. `state` keeps the stream's
    place.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(source)
    rows = files.select("path", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))

    def write(batch: DataFrame, number: int) -> None:
        held = loaded(spark, at).where(F.col("batch") != number).select("sha256")
        new = new_only(dedupe_first(batch, ["sha256"], [F.col("path").alias("_by")]), held, ["sha256"])
        new.select("path", "sha256", "text", F.lit(number).cast("long").alias("batch")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(at)

    spark.createDataFrame([], f"{SCHEMA}, batch long").write.mode("append").partitionBy("batch").parquet(at)
    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] > 0 for p in query.recentProgress)
