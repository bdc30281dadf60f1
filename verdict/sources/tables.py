"""Driver tables: one parquet file per table under an ``sf`` folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# Tables whose rows feed text and regex work: their scan must not run in fewer
# tasks than there are cores. Numeric tables go straight into partial aggregates.
SPREAD_TABLES = {"documents", "pages", "conversations", "benchmark", "events"}
#: The splits of a scan that hold rows are counted up to this many splits a core.
COUNTED_SPLITS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in SPREAD_TABLES else df


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows over the cores when the rows of the scan come in too few tasks.

    A large input already has at least one task per core (one per file split),
    and then this is a no-op; a file of few row groups would otherwise run all
    text processing in a few tasks. A row group is read by one task however many
    splits its file has, so splits without rows don't count (only footers are read for that).
    """
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()
        if cores <= n <= COUNTED_SPLITS * cores:
            n = df.select(F.spark_partition_id().alias("p")).distinct().count()
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session: leave the plan as it is
        return df
    return df.repartition(cores) if n < cores else df
