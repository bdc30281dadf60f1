"""Trigger-log blocks: test name, category, per-test outcome flags.

A trigger log is a text of blocks separated by a newline followed by '---';
the first line of a block is the test name, the second the exception line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col_, py_strip
from .features import exception_line

TEST_KEYS = ("project", "bug_num", "test_name")


def block_text(raw: Column | str) -> Column:
    """Leading dashes of the first block removed (the log starts with '---')."""
    return F.regexp_replace(col_(raw), r"^-+", "")


def block_test_name(block: Column | str) -> Column:
    return py_strip(F.substring_index(col_(block), "\n", 1))


def trace_category(block: Column | str) -> Column:
    """'assertion' / 'exception' / 'none' (uncategorised, not counted as triggered)."""
    b = col_(block)
    start = exception_line(b)
    assertion = F.contains(b, F.lit("AssertionFailedError"))
    exception = (F.contains(b, F.lit("Exception")) | F.contains(b, F.lit("StackOverflowError"))
                 | F.contains(start, F.lit("MathInternalError")) | start.startswith("java.lang"))
    return F.when(assertion, "assertion").when(exception, "exception").otherwise("none")


def split_log(text: Column | str) -> Column:
    """Blocks of a whole log text (empty blocks kept; filter them after explode)."""
    return F.split(F.regexp_replace(col_(text), r"^-+", ""), "\n---", -1)


def parse_blocks(df: DataFrame, block: str = "block") -> DataFrame:
    """Add test name, exception line and category of each block."""
    return df.withColumns({
        "test_name": block_test_name(block),
        "start_line": exception_line(block),
        "category": trace_category(block),
        "n_lines": F.size(F.split(F.col(block), "\n", -1)),
    })


def complete_blocks(blocks: DataFrame) -> DataFrame:
    """The parsed blocks; one of fewer than two lines is an error when the plan runs."""
    ok = F.when(F.col("n_lines") < 2, F.raise_error(F.concat(F.lit("short trigger block: "), "block")).cast("boolean")).otherwise(F.lit(True))
    return blocks.filter(ok)


def outcome_flags(tests: DataFrame, buggy_blocks: DataFrame, fixed_blocks: DataFrame,
                  keys: Sequence[str] = TEST_KEYS) -> DataFrame:
    """Per test: triggered flags in the buggy and fixed logs, the buggy trace, TP/FP/TN/FN.

    Membership is a left join of per-test flag aggregates (``bool_or`` over the
    blocks of the test; the trace of the last block wins, as a dict would keep).
    """
    def flags(blocks: DataFrame, prefix: str, with_trace: bool) -> DataFrame:
        aggs = [F.bool_or(F.col("category") == "exception").alias(f"{prefix}_exception_triggered"),
                F.bool_or(F.col("category") == "assertion").alias(f"{prefix}_assertion_triggered")]
        if with_trace:
            aggs.append(F.max_by("block", "block_pos").alias("buggy_test_trace"))
        return blocks.groupBy(*keys).agg(*aggs)

    b = flags(buggy_blocks, "bug", True)
    f = flags(fixed_blocks, "fixed", False)
    out = tests.join(b, list(keys), "left").join(f, list(keys), "left")
    out = out.fillna(False, ["bug_exception_triggered", "bug_assertion_triggered",
                             "fixed_exception_triggered", "fixed_assertion_triggered"])
    out = out.fillna("", ["buggy_test_trace"])
    fb = F.col("bug_exception_triggered") | F.col("bug_assertion_triggered")
    ff = F.col("fixed_exception_triggered") | F.col("fixed_assertion_triggered")
    out = out.withColumn("failed_buggy", fb).withColumn("failed_fixed", ff)
    return out.withColumns(label_columns("failed_buggy", "failed_fixed"))


def label_columns(failed_buggy: str, failed_fixed: str) -> dict[str, Column]:
    """TP = fails buggy only, FP = fails both, TN = passes both, FN = fails fixed only."""
    b, f = F.col(failed_buggy), F.col(failed_fixed)
    return {"TP": b & ~f, "FP": b & f, "TN": ~b & ~f, "FN": ~b & f}
