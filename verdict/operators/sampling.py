"""Weighted sampling with replacement by row weights.

Every row owns an interval of length weight on [0, total): its prefix sum. A draw is a point there and
takes the row whose interval holds it. Neither step puts a table into one task:

* ``weight_intervals``: rows are range-partitioned by id, summed per task, and the task totals (one row a
  task) give the offsets;
* ``draw_rows``: interval starts and points are range-partitioned and sorted together, so that the row
  a point takes is the last start before it; the last start of earlier tasks (one row a task) is carried over.

A row with a third of the weight is one interval start: the points inside it spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Bits of a draw's random number.
BITS = 60


def _ranged(df: DataFrame, *order: str) -> DataFrame:
    """Sorted by range over the shuffle partitions and materialised, with the task (_pid) and the place in it (_mid)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                       .withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))


def weight_intervals(df: DataFrame, id_col: str, weight: str) -> DataFrame:
    """(id, start, weight) in id order of the rows with a weight above 0 (null: 0). Weights are whole numbers, so sums are
    exact whatever the deal; scale real weights first. A negative weight is an error when the plan runs."""
    w = F.coalesce(F.col(weight).cast("long"), F.lit(0))
    w = F.when(w < 0, F.raise_error(F.lit("a weight is negative")).cast("long")).otherwise(w)
    rows = _ranged(df.select(F.col(id_col), w.alias("weight")).filter("weight <> 0"), id_col)
    per_task = rows.groupBy("_pid").agg(F.sum("weight").alias("_sum")).withColumn("_all", F.lit(0))
    before = F.sum("_sum").over(Window.partitionBy("_all").orderBy("_pid")) - F.col("_sum")  # one row a task
    inside = F.sum("weight").over(Window.partitionBy("_pid").orderBy("_mid")) - F.col("weight")
    return (rows.withColumn("_in", inside).join(per_task.select("_pid", before.alias("_before")), "_pid")
            .select(id_col, (F.col("_before") + F.col("_in")).alias("start"), "weight"))


def uniform_bits(*parts: Column | str) -> Column:
    """A whole number below 2 ** BITS from the MD5 of the parts joined by '-': the same on any engine."""
    key = F.concat_ws("-", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def draw_rows(rows: DataFrame, draws: DataFrame, id_col: str, weight: str, draw_id: str, bits: str) -> DataFrame:
    """(draw_id, id) for each row of ``draws``: the row that its number (``bits``, below 2 ** BITS) takes, each with a chance in
    proportion to its weight. No rows with a weight: no draws."""
    starts = weight_intervals(rows, id_col, weight)
    total = starts.agg(F.sum("weight")).first()[0] or 0
    point = F.expr(f"CAST((CAST({bits} AS DECIMAL(19, 0)) * CAST({total} AS DECIMAL(19, 0))) DIV CAST({1 << BITS} AS DECIMAL(19, 0)) AS BIGINT)")
    points = draws.select(F.col(draw_id).alias("_draw"), point.alias("pos"), F.lit(1).alias("kind"))
    both = starts.select(F.col(id_col).alias("_row"), F.col("start").alias("pos"), F.lit(0).alias("kind")).unionByName(points, allowMissingColumns=True)
    swept = _ranged(both.withColumn("_owner", F.when(F.col("kind") == 0, F.struct("_row"))), "pos", "kind")
    here = F.last("_owner", ignorenulls=True).over(Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0))
    ends = swept.groupBy("_pid").agg(F.max_by("_owner", F.when(F.col("kind") == 0, F.col("_mid"))).alias("_end")).withColumn("_all", F.lit(0))
    earlier = F.last("_end", ignorenulls=True).over(Window.partitionBy("_all").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("_pid", earlier.alias("_carried"))  # one row a task
    return (swept.withColumn("_here", here).filter("kind = 1").join(carried, "_pid")
            .select(F.col("_draw").alias(draw_id), F.coalesce(F.col("_here._row"), F.col("_carried._row")).alias(id_col))
            .filter(F.lit(total) > 0))
