"""Data-quality checks the pipeline enforces. Each returns a small DataFrame
(check, violations).

``check_table`` runs any number of row, key and alignment checks in one pass over a table, and
``write_checked`` counts them in the job that writes it (``observe``), with no pass of their own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def null_counts(df: DataFrame, name: str = "no_nulls") -> DataFrame:
    """V1: rows with a null in any column, in one aggregate."""
    any_null = F.lit(False)
    for c in df.columns:
        any_null = any_null | F.col(c).isNull()
    return df.agg(F.lit(name).alias("check"), F.count_if(any_null).alias("violations"))


def key_violations(df: DataFrame, keys: Sequence[str], name: str = "unique_key") -> DataFrame:
    """V2: number of keys held by more than one row."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return dup.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("violations"))


def alignment_violations(left: DataFrame, right: DataFrame, keys: Sequence[str], name: str = "aligned") -> DataFrame:
    """V4 / V5: keys present on one side only (equal row sets, aligned indexes)."""
    a = left.select(*keys).withColumn("_l", F.lit(1))
    b = right.select(*keys).withColumn("_r", F.lit(1))
    j = a.join(b, list(keys), "full_outer")
    return j.agg(F.lit(name).alias("check"), F.count_if(F.col("_l").isNull() | F.col("_r").isNull()).alias("violations"))


def index_mismatches(left: DataFrame, right: DataFrame, row: str, value: str, name: str = "same_index") -> DataFrame:
    """V5: rows whose ``value`` (the test index) differs between two tables aligned by ``row``, or that one side lacks."""
    a = left.select(F.col(row).alias("_r"), F.col(value).alias("_a"))
    b = right.select(F.col(row).alias("_r"), F.col(value).alias("_b"))
    return a.join(b, "_r", "full_outer").agg(F.lit(name).alias("check"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("violations"))


def any_null(columns: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def check_table(df: DataFrame, rows: Mapping[str, Column], keys: Mapping[str, Sequence[Column | str]] | None = None,
                key_rows: Column | None = None) -> DataFrame:
    """(check, violations) of every check, the table read once.

    ``rows``: name -> condition of a bad row. ``keys``: at most one key that must be unique among the rows where ``key_rows``
    holds; its groups carry the row counts, so that both come from one partial aggregate.
    """
    if keys and len(keys) > 1:
        raise ValueError("one key at a time: another key is another grouping")
    counts = {f"_c{i}": F.count_if(bad) for i, bad in enumerate(rows.values())}
    if not keys:
        total = df.agg(*[c.alias(n) for n, c in counts.items()])
        names = dict(zip(rows, counts))
    else:
        (key_name, key), = keys.items()
        named = [(F.col(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(key)]
        held = F.count_if(F.lit(True) if key_rows is None else key_rows).alias("_held")
        groups = df.groupBy(*named).agg(held, *[c.alias(n) for n, c in counts.items()])
        total = groups.agg(F.count_if(F.col("_held") > 1).alias("_dup"), *[F.sum(n).alias(n) for n in counts])
        names = dict(zip(rows, counts)) | {key_name: "_dup"}
    return total.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(F.col(c), F.lit(0)).alias("violations"))
                                           for n, c in names.items()])).alias("_r")).select("_r.*")


class QualityError(ValueError):
    """Checks that were violated, with their counts."""


def write_checked(df: DataFrame, path: str, rows: Mapping[str, Column], strict: bool = False, mode: str = "errorifexists") -> DataFrame:
    """Write the table as Parquet and return (check, violations), counted in the pass that writes it.

    ``strict``: a violated check raises ``QualityError``, after the write, so that the bad rows can be looked at.
    """
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("_rows"), *[F.count_if(bad).alias(name) for name, bad in rows.items()]).write.mode(mode).parquet(path)
    found = {name: int(seen.get[name]) for name in rows}
    bad = {name: n for name, n in found.items() if n}
    if strict and bad:
        raise QualityError(f"{path}: {bad}")
    return df.sparkSession.createDataFrame(list(found.items()), "check string, violations long")
