"""Per-bug features of failed tests.

Every feature is a Column expression or a count inside the bug. Counts are a
``groupBy`` + join back instead of a window: the aggregate is partial
(map-side), and AQE splits a hot bug on the join (skew join) or broadcasts the
small count table, so a bug that holds a third of the rows never lands in one
task.

``add_features(df, names)`` resolves dependencies by name, like the lazy
feature extractor of the reference; unused features cost nothing because the
plan prunes them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col_, py_strip
from .lines import lone_lines
from .similarity import test_doc_similarity

BUG = ("project", "bug_num")

# The eleven ranking features, in reference order.
FEATURE_NAMES = [
    "focal_name_count",
    "distinct_line",
    "except_pred",
    "no_except_pred",
    "test_prefix_exception",
    "trace_exception_count",
    "trace_desc_count",
    "not_rare_e",
    "rare_exception_count",
    "focal_rare_e_count",
    "test_doc_sim",
]


# ---- trace text --------------------------------------------------------------

def exception_line(trace: Column | str) -> Column:
    """Second line of the stripped trace, stripped ('' when absent)."""
    lines = F.split(py_strip(trace), "\n", -1)
    return F.coalesce(py_strip(F.get(lines, 1)), F.lit(""))


def trace_exception(trace: Column | str) -> Column:
    """Exception class: text of the exception line before the first ':'."""
    return py_strip(F.substring_index(exception_line(trace), ":", 1))


def trace_desc(trace: Column | str) -> Column:
    """Description: everything after the first ':' of the exception line, stripped."""
    return py_strip(F.regexp_extract(exception_line(trace), r"^[^:]*:(.*)$", 1))


def exception_simple_name(exception: Column | str) -> Column:
    """Text after the last '.', with the 'Mock' prefix removed for evosuite classes."""
    exc = col_(exception)
    name = F.substring_index(exc, ".", -1)
    mock = exc.startswith("org.evosuite") & name.startswith("Mock")
    return F.when(mock, F.substring(name, 5, 1 << 30)).otherwise(name)


def exception_type(name: Column | str, exception: Column | str, project: Column | str) -> Column:
    """Origin of the exception, first match wins: java / project / evosuite / assert / other."""
    exc = col_(exception)
    dotless = F.replace(exc, F.lit("."), F.lit(""))
    return (F.when(exc.startswith("java."), "java")
            .when(F.contains(dotless, F.lower(col_(project))), "project")
            .when(exc.startswith("org.evosuite"), "evosuite")
            .when(col_(name) == "AssertionFailedError", "assert")
            .otherwise("other"))


# ---- counts inside the bug ----------------------------------------------------

def count_over(df: DataFrame, keys: Sequence[str], out: str, where: Column | None = None) -> DataFrame:
    """Add ``out`` = number of rows (optionally only rows with ``where``) sharing ``keys``."""
    return counts_over(df, [(list(keys), out, where)])


def counts_over(df: DataFrame, specs: Sequence[tuple[Sequence[str], str, Column | None]]) -> DataFrame:
    """Several "rows sharing these keys" counts, each a partial ``groupBy`` joined back.

    No window: a (bug, value) that holds a third of the rows is one row per map task in the
    aggregate, and adaptive execution broadcasts the count table or splits the hot key.
    """
    rows = df  # every count reads the rows as given, not the joins of the counts before
    for keys, out, where in specs:
        n = F.count(F.lit(1)) if where is None else F.count_if(where)
        counts = rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(n.cast("long").alias(out))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        df = df.join(counts, same, "left").drop(*[f"_k_{k}" for k in keys])
    return df


# ---- feature resolution ---------------------------------------------------------

def _catch_names(prefix: Column) -> Column:
    """Simple names of the exceptions in catch clauses of a test prefix."""
    found = F.regexp_extract_all(prefix, F.lit(r"catch\s*\(\s*(?:final\s+)?([\w.$|\s]+?)\s+\w+\s*\)"), 1)
    names = F.flatten(F.transform(found, lambda s: F.split(s, r"\s*\|\s*")))
    return F.array_distinct(F.transform(names, lambda s: F.substring_index(F.trim(s), ".", -1)))


def _derive(df: DataFrame, name: str, have: set[str], pending: list, after: list) -> DataFrame:
    """Add one feature; counts go to ``pending`` (and what follows them to ``after``), applied at the end."""
    def need(*deps: str) -> DataFrame:
        nonlocal df
        for d in deps:
            if d not in have:
                df = _derive(df, d, have, pending, after)
        return df

    if name in ("except_pred", "assert_pred"):
        pass  # recomputed as flags by add_features
    elif name == "no_except_pred":
        df = df.withColumn(name, ~F.col("assert_pred") & ~F.col("except_pred"))
    elif name == "trace_exception":
        df = df.withColumn(name, trace_exception("buggy_test_trace"))
    elif name == "trace_exception_name":
        df = need("trace_exception")
        df = df.withColumn(name, exception_simple_name("trace_exception"))
    elif name == "trace_desc":
        df = df.withColumn(name, trace_desc("buggy_test_trace"))
    elif name == "trace_exception_has_desc":
        df = need("trace_desc")
        df = df.withColumn(name, F.col("trace_desc") != "")
    elif name == "trace_exception_count":
        df = need("trace_exception")
        pending.append(([*BUG, "trace_exception"], name, None))
    elif name == "trace_desc_count":
        df = need("trace_desc")
        pending.append(([*BUG, "trace_desc"], name, None))
    elif name == "trace_exception_type":
        df = need("trace_exception_name")
        df = df.withColumn(name, exception_type("trace_exception_name", "trace_exception", "project"))
    elif name == "trace_exception_in_focal":
        df = need("trace_exception_name")
        df = df.withColumn(name, F.contains(F.col("focal_method"), F.col("trace_exception_name")))
    elif name == "trace_exception_in_doc":
        df = need("trace_exception_name")
        df = df.withColumn(name, F.contains(F.col("docstring"), F.col("trace_exception_name")))
    elif name == "not_rare_e":
        df = need("trace_exception_type", "trace_exception_in_focal", "trace_exception_in_doc")
        df = df.withColumn(name, (F.col("trace_exception_type") == "assert") | F.col("trace_exception_in_focal")
                           | F.col("trace_exception_in_doc"))
    elif name == "rare_exception_count":
        df = need("not_rare_e", "trace_exception_name")
        pending.append(([*BUG, "trace_exception_name"], "_rare_n", ~F.col("not_rare_e")))
        after.append((name, F.when(F.col("not_rare_e"), F.lit(0).cast("long")).otherwise(F.col("_rare_n")), "_rare_n"))
    elif name == "focal_rare_e_count":
        df = need("not_rare_e", "trace_exception_name")
        df = df.withColumn("_focal", F.md5("focal_method"))  # a digest travels in place of the method
        pending.append(([*BUG, "_focal", "trace_exception_name"], name, ~F.col("not_rare_e")))
    elif name == "focal_name":
        df = df.withColumn(name, method_name("focal_method"))
    elif name == "focal_name_count":
        df = need("focal_name")
        pending.append(([*BUG, "focal_name"], name, None))
    elif name == "prefix_e_names":
        df = df.withColumn(name, _catch_names(F.col("test_prefix")))
    elif name == "test_prefix_exception":
        df = need("prefix_e_names")
        df = df.withColumn(name, F.size("prefix_e_names") > 0)
    elif name in ("distinct_line", "test_doc_sim"):
        pass  # reads other rows' texts: added by add_features
    else:
        raise ValueError(f"unknown feature {name!r}")
    have.add(name)
    return df


def add_features(df: DataFrame, names: Sequence[str] = FEATURE_NAMES, keep: Sequence[str] = ()) -> DataFrame:
    """Original columns + the requested features (prediction flags recomputed first).

    ``keep`` lists intermediate columns (e.g. ``trace_exception_type``) to return as well.
    """
    for n in names:
        if n.endswith("_type") or n.endswith("_name"):
            raise ValueError(f"feature {n!r} is not numeric")
    original, given = list(df.columns), df
    # the prediction columns become flags before any feature reads them
    df = df.withColumn("assert_pred", py_strip(F.col("assert_pred")) != "")
    df = df.withColumn("except_pred", F.col("except_pred").cast("boolean"))
    have: set[str] = {"assert_pred", "except_pred"}
    pending: list = []
    after: list = []
    for n in names:
        if n not in have:
            df = _derive(df, n, have, pending, after)
    df = counts_over(df, pending)
    for out, expr, tmp in after:
        df = df.withColumn(out, expr).drop(tmp)
    # features that need the texts of other rows are found on the rows as given and joined last: what
    # travels through the joins is what the caller reads
    if "distinct_line" in names:
        df = df.join(lone_lines(given, BUG, "row_idx", "generated_test", "distinct_line"), [*BUG, "row_idx"], "left").fillna(0, ["distinct_line"])
    if "test_doc_sim" in names:
        df = test_doc_similarity(given, BUG, "row_idx", "test_doc_sim", onto=df)
    extra = [n for n in keep if n in have and n not in names and n not in original]
    return df.select(*original, *[F.col(n) for n in names if n not in original], *extra)


def method_name(code: Column | str) -> Column:
    """Name of the declared method or constructor: last identifier before '(' in
    the text before the first '{' ('' when absent)."""
    head = F.substring_index(col_(code), "{", 1)
    return F.regexp_extract(head, r"(?<![\w$])([\w$]+)\s*\([^()]*\)\s*(?:throws[\w.,\s]*)?$", 1)
