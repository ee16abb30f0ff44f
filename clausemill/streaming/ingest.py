"""Incremental ingestion: files as they arrive, each processed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clausemill.functions import text as T
from clausemill.operators import documents as O


def stream_texts(spark: SparkSession, folder: str, output: str, checkpoint: str, files_per_trigger: int = 1000):
    """Redact and segment text files that arrive in ``folder`` into ``output`` (parquet), then stop.

    The checkpoint makes a file count once; a replayed batch overwrites its own part,
    so a restart after a failure repeats nothing.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.{txt,md}").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    texts = files.select(F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1).alias("document_id"), T.redact(F.col("content").cast("string")).alias("normalized_text"))

    def write(batch: DataFrame, number: int) -> None:
        O.segment(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_stages(log: DataFrame, delay: str = "7 days") -> DataFrame:
    """A stream of stage rows to counts by stage and day of update; rows logged later than ``delay`` are left out."""
    return log.withWatermark("updated_at", delay).groupBy(F.window("updated_at", "1 day").alias("day"), "completed_stage").agg(F.approx_count_distinct("document_id").alias("documents"))
