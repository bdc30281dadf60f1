"""Incremental form of the trigger-log scan.

The reference reads all logs of a finished run in one batch. When runs land
over time, the same parse runs as a Structured Streaming file source: each new
log file becomes parsed blocks appended to a Parquet table, with progress in a
checkpoint folder (restart-safe). ``trigger(availableNow=True)`` processes what
is there and stops, so it also serves as an exactly-once batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.triggers import parse_blocks, split_log
from ..sources.files import LOG_PATH_RE


def trigger_log_stream(spark: SparkSession, root: str) -> DataFrame:
    raw = (spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True)
           .option("pathGlobFilter", "*.trigger.log").load(root)
           .select(F.col("_metadata.file_path").alias("path"), "value"))
    keyed = raw.select(
        F.regexp_extract("path", LOG_PATH_RE, 1).alias("project"),
        F.regexp_extract("path", LOG_PATH_RE, 2).alias("system"),
        F.regexp_extract("path", LOG_PATH_RE, 3).cast("long").alias("bug_num"),
        F.regexp_extract("path", LOG_PATH_RE, 4).alias("tag"),
        F.posexplode(split_log("value")).alias("block_pos", "block"))
    return parse_blocks(keyed.filter(F.col("block") != ""))


def ingest_trigger_logs(spark: SparkSession, root: str, out: str, checkpoint: str):
    """Append newly arrived logs' blocks to ``out``; returns the finished query."""
    q = (trigger_log_stream(spark, root).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q
