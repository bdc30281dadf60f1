"""The result chain: predictions and run results of each generated test in one table.

* ``prediction_table`` (M9): the assertion classifier's output rows.
* ``rename_tests`` (W2): tests whose header fits the pattern, renamed with a running number.
* ``full_test_data`` / ``failed_test_data``: positional concat, validated one-to-one outer
  join with the results, rendering, keep-first dedup, the failing rows without nulls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col_
from ..functions.positions import group_positions
from .code_text import render_test
from .outcomes import dedup_keep_first, outer_one_to_one

# Header of a test case, split around its name; the name of a plain test method.
TEST_HEADER_RE = r"(?s)^(\s*@Test.*public void )(\w+)(\(\).+)"
TEST_NAME_RE = r"^public void (test[0-9]*)\(\)"
NO_NAME = "test-name-placeholder"


def prediction_table(df: DataFrame, idx: str, label: str, pred: str, l0: str, l1: str, test: str, focal: str, assertion: str,
                     truncation: str) -> DataFrame:
    """One row per scored candidate: idxs, true_lbl, pred_lbl, logits, test name (a placeholder when the
    text does not start with a plain test method), texts, truncation."""
    name = F.regexp_extract(col_(test), TEST_NAME_RE, 1)
    return df.select(
        F.col(idx).alias("idxs"), F.col(label).alias("true_lbl"), F.col(pred).alias("pred_lbl"), F.col(l0).alias("logit_0"),
        F.col(l1).alias("logit_1"), F.when(name != "", name).otherwise(F.lit(NO_NAME)).alias("test_name"),
        F.col(assertion).alias("pred_assertion"), F.col(truncation).alias("truncation"), F.col(test).alias("test"),
        F.col(focal).alias("fms"))


def rename_tests(df: DataFrame, file_col: str, test_col: str, order_col: str, bug: Sequence[str] = ("project", "bug_num")) -> DataFrame:
    """Tests whose header fits, with ``unique_test_name`` (file::name + running number) and the renamed text.
    Other tests are left out. ``order_col`` is cast to a number: test ids may be strings."""
    part = lambda i: F.regexp_extract(col_(test_col), TEST_HEADER_RE, i)
    named = df.withColumn("_name", part(2)).filter(F.col("_name") != "").withColumn("_order", F.col(order_col).cast("long"))
    pos = group_positions(named, [*bug, file_col, "_name"], ["_order"], pos_col="_n")
    unique = F.concat(F.col("_name"), (F.col("_n") + 1).cast("string"))
    path = F.regexp_replace(F.expr(f"substring({file_col}, 1, length({file_col}) - 5)"), "/", ".")
    return (pos.withColumn("unique_test_name", F.concat(path, F.lit("::"), unique))
            .withColumn("renamed_test", F.concat(part(1), unique, part(3))).drop("_name", "_order", "_n"))


def full_test_data(inputs: DataFrame, results: DataFrame, keys: Sequence[str], order_col: str, prefix: str = "test_prefix",
                   generator: str = "learned") -> DataFrame:
    """inputs (keys, order, prefix, predictions) outer-joined one to one with results (keys, outcomes); the rendered
    test ('' for results without an input); the first row of each (project, bug, rendered test)."""
    joined = outer_one_to_one(inputs, results, keys)
    rendered = F.when(F.col(prefix).isNull(), F.lit("")).otherwise(render_test(prefix, "except_pred", "assert_pred", generator))
    return dedup_keep_first(joined.withColumn("generated_test", rendered), ["project", "bug_num", "generated_test"], order_col)


def failed_test_data(full: DataFrame) -> DataFrame:
    """Rows that fail on the buggy version; a null in one of them is an error."""
    failed = full.filter(F.col("failed_buggy"))
    any_null = F.lit(False)
    for c in full.columns:
        any_null = any_null | F.col(c).isNull()
    ok = F.when(any_null, F.raise_error(F.lit("a failed test has a null")).cast("boolean")).otherwise(F.lit(True))
    return failed.filter(ok)
