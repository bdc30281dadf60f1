"""Skew-safe positions and top-k inside groups.

A plain ``row_number().over(Window.partitionBy(g).orderBy(o))`` sends a whole
group to one task. When one bug (or one label) holds a third of all rows that
task is the job. The helpers here never do that:

* ``group_positions`` range-partitions on (group, order) so a hot group spans
  many tasks, counts rows per (task, group) segment, turns the small segment
  table into prefix offsets and adds the row's offset inside its task.
* ``topk_per_group`` salts each group into buckets, keeps the first k rows of
  every bucket, then ranks the at most ``buckets * k`` survivors per group.

Both need a total order (add a unique tie-break such as ``row_idx``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def _cols(xs: Sequence[Column | str]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def group_positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                    pos_col: str = "pos", n_partitions: int | None = None) -> DataFrame:
    """Add ``pos_col`` = 0-based position of the row inside its ``keys`` group by ``order``."""
    spark = df.sparkSession
    n = n_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_cols = _cols(order)
    key_cols = _cols(keys)
    ranged = (df.repartitionByRange(n, *key_cols, *order_cols)
              .sortWithinPartitions(*key_cols, *order_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    # Task ids and in-task offsets are only stable for one execution of the range
    # exchange; materialise them once (reliable checkpoint in the shared folder) so
    # that the segment table and the rows always agree, also after a lost executor.
    ensure_checkpoint_dir(spark)
    ranged = ranged.checkpoint(eager=True)
    seg = ranged.groupBy("_pid", *keys).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_pid")  # a group has at most n segments
    seg = seg.withColumn("_off", F.sum("_n").over(w) - F.col("_n")).drop("_n")
    # The segment table has one row per (task, group). AQE sees its real size
    # at run time and broadcasts it when small; otherwise it is a shuffle join.
    out = ranged.join(seg, ["_pid", *keys])
    out = out.withColumn(pos_col, F.col("_off") + F.col("_mid") - F.col("_first"))
    return out.drop("_pid", "_mid", "_first", "_off")


def topk_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int,
                   rank_col: str = "rank", salt_buckets: int | None = None, salt_of: Column | str | None = None) -> DataFrame:
    """Rows with rank <= k inside each ``keys`` group (1-based ``rank_col``).

    ``salt_of`` picks the column hashed into buckets (default: all order columns); there are as
    many buckets as shuffle partitions, so that one group can use every task.
    """
    salt_buckets = salt_buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order_cols = _cols(order)
    salt_src = _cols([salt_of])[0] if salt_of is not None else F.struct(*order_cols)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_src), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order_cols)
    first = salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k)
    w2 = Window.partitionBy(*keys).orderBy(*order_cols)  # <= salt_buckets * k rows per group
    return (first.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= k)
            .drop("_salt", "_r1"))
