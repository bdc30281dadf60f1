"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# A word is a run of characters that are none of these six.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
A_Z, A_Z_LOWER = string.ascii_uppercase, string.ascii_lowercase


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole Parquet table; the path may be on any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words_of(text: Column) -> Column:
    """All words of the text in order (null: none)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def count_chars(text: Column, chars: str) -> Column:
    """Characters of ``text`` that are in ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def with_value(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    The lambda of a one-element ``transform`` binds the value; written plainly, Catalyst
    would put a copy of the expression at each place where ``body`` uses it.
    """
    return F.transform(F.array(value), body)[0]


def keep_copy(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, to use a small table twice."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(batches: Iterator[pa.RecordBatch], text: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``limit`` bytes of column ``text`` (one row at least), so that the arrays
    made from the texts of a slice stay small whatever the batch size."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.nonzero(part[1:] != part[:-1])[0] + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet under a new name in the shared folder and reread; the caller clears that folder."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
