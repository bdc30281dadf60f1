"""Result-table joins: unique names, keep-first dedup, one-to-one outer join,
positional join, update-only upsert, overlay merge, duplicate-key checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.positions import group_positions


def unique_test_names(df: DataFrame, file_col: str, name_col: str, order_col: str,
                      bug: Sequence[str] = ("project", "bug_num"), out: str = "unique_test_name") -> DataFrame:
    """name + 1-based running count per (bug, test file, name) in ``order_col`` order.

    Two (name, count) pairs can collide ('t1'+'11' = 't11'+'1'); ``duplicate_keys``
    on the result finds them.
    """
    keys = [*bug, file_col, name_col]
    pos = group_positions(df, keys, [order_col], pos_col="_n")
    file_part = F.regexp_replace(F.expr(f"substring({file_col}, 1, length({file_col}) - 5)"), "/", ".")
    qualified = F.when(F.col(file_col) == "", F.lit("")).otherwise(F.concat(file_part, F.lit("::")))
    return pos.withColumn(out, F.concat(qualified, F.col(name_col), (F.col("_n") + 1).cast("string"))).drop("_n")


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """One row per key: the one with the smallest ``order_col`` (nulls last).

    ``min_by`` over a struct is a partial aggregate, so a key held by a third
    of the rows is combined map-side instead of sorted in one task.
    """
    others = [c for c in df.columns if c not in keys]
    order = F.coalesce(F.col(order_col), F.lit(None))
    first = F.min_by(F.struct(*others), F.struct(F.col(order_col).isNull(), order))
    return df.groupBy(*keys).agg(first.alias("_r")).select(*keys, "_r.*")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def checked_one_to_one(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """The rows, one per key; a key that several rows hold is an error when the plan runs (no job while it is built)."""
    others = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.any_value(F.struct(*others)).alias("_r"), F.count(F.lit(1)).alias("_n"))
    ok = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{what}: keys {list(keys)} are not unique")).cast("boolean")).otherwise(F.lit(True))
    return one.filter(ok).select(*keys, "_r.*")


def outer_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], validate: bool = True) -> DataFrame:
    """Full outer join on ``keys``; with ``validate`` both sides must be unique on them."""
    if validate:
        left, right = checked_one_to_one(left, keys, "left side"), checked_one_to_one(right, keys, "right side")
    return left.join(right, list(keys), "full_outer")


def positional_join(left: DataFrame, right: DataFrame, row_idx: str, pad: bool = True) -> DataFrame:
    """Align two tables by an explicit row index: ``pad`` = full outer (concat),
    else inner (zip truncates to the shorter side)."""
    return left.join(right, row_idx, "full_outer" if pad else "inner")


def update_only_upsert(base: DataFrame, patch: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """Replace whole base rows whose key exists in ``patch``; keys only in ``patch``
    are not inserted. Duplicate keys collapse to one row: at the position of the
    first occurrence, with the values of the last occurrence.
    """
    value_cols = [c for c in base.columns if c not in keys and c != order_col]
    b = base.groupBy(*keys).agg(F.min(order_col).alias(order_col),
                                F.max_by(F.struct(*value_cols), F.col(order_col)).alias("_b"))
    p = patch.groupBy(*keys).agg(F.max_by(F.struct(*value_cols), F.col(order_col)).alias("_p"))
    j = b.join(p, list(keys), "left")
    merged = F.when(F.col("_p").isNotNull(), F.col("_p")).otherwise(F.col("_b"))
    return j.select(*keys, order_col, merged.alias("_m")).select(*keys, order_col, "_m.*")


def overlay_merge(base: DataFrame, patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Patch entries replace same-key base entries and new keys are added."""
    value_cols = [c for c in base.columns if c not in keys]
    has_p = F.col("_in_p").isNotNull()
    j = base.alias("b").join(patch.withColumn("_in_p", F.lit(True)).alias("p"), list(keys), "full_outer")
    return j.select(*keys, *[F.when(has_p, F.col(f"p.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in value_cols],
                    has_p.alias("from_patch"))
