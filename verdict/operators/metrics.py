"""Outcome and classifier metrics.

All scorers of a report are evaluated in one aggregation. Per-bug sums are a
first ``groupBy`` (map-side partial aggregation keeps a hot bug cheap); the
report level is a second, tiny ``groupBy``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_true, f1, guarded_ratio, ratio

BUG_KEYS = ("project", "bug_num")

# Scorer registry: name -> (expression over the per-bug sums, direction).
# "g" = greater is better, "l" = lower is better.
SCORERS = {
    "bugs_found": (lambda: F.count_if(F.col("bug_tp") > 0).cast("long"), "g"),
    "tps": (lambda: F.sum("bug_tp").cast("long"), "g"),
    "fps": (lambda: F.sum("bug_fp").cast("long"), "l"),
    "tns": (lambda: F.sum("bug_tn").cast("long"), "g"),
    "fns": (lambda: F.sum("bug_fn").cast("long"), "l"),
}


def per_bug_sums(df: DataFrame, by: Sequence[str], bug_keys: Sequence[str] = BUG_KEYS) -> DataFrame:
    """Sum the four outcome flags per (report keys, bug)."""
    return df.groupBy(*by, *bug_keys).agg(
        count_true("tp").alias("bug_tp"), count_true("fp").alias("bug_fp"),
        count_true("tn").alias("bug_tn"), count_true("fn").alias("bug_fn"))


def outcome_metrics(df: DataFrame, by: Sequence[str], bug_keys: Sequence[str] = BUG_KEYS,
                    dedup: Sequence[str] | None = None) -> DataFrame:
    """Bugs found, TP/FP/TN/FN totals, FP rate, precision, recall and F1 per ``by``. ``dedup``: keys of which
    one row counts per ``by`` (default: every row counts, as in the reference, whose dedup has no effect)."""
    if dedup is not None:
        df = df.dropDuplicates([*by, *dedup])
    bugs = per_bug_sums(df, by, bug_keys)
    rep = bugs.groupBy(*by).agg(*[fn().alias(name) for name, (fn, _) in SCORERS.items()])
    rep = rep.withColumn("fp_rate", ratio("fps", F.col("fps") + F.col("tns")))
    rep = rep.withColumn("precision", ratio("tps", F.col("tps") + F.col("fps")))
    rep = rep.withColumn("recall", ratio("tps", F.col("tps") + F.col("fns")))
    p = ratio("tps", F.col("tps") + F.col("fps"), None)
    r = ratio("tps", F.col("tps") + F.col("fns"), None)
    return rep.withColumn("f1", f1(p, r))


def mean_over_runs(report: DataFrame, config: Sequence[str], run_col: str, metrics: Sequence[str],
                   expected_runs: Sequence[object] | None = None) -> DataFrame:
    """Mean of each metric over runs per configuration; nulls (0/0) are skipped.

    ``complete`` says whether every run of ``expected_runs`` (the fixed list of runs, not what
    the data happen to hold) is present and no other.
    """
    aggs = [F.count_distinct(run_col).alias("n_runs"), *[F.round(F.avg(m), 6).alias(f"mean_{m}") for m in metrics]]
    if expected_runs is not None:
        runs = sorted(set(expected_runs))
        known = F.count_distinct(F.when(F.col(run_col).isin(*runs), F.col(run_col)))
        aggs.append(((known == len(runs)) & (F.count_distinct(run_col) == len(runs))).alias("complete"))
    return report.groupBy(*config).agg(*aggs)


def found_bugs(df: DataFrame, by: Sequence[str], bug_keys: Sequence[str] = BUG_KEYS) -> DataFrame:
    """Bugs with at least one true positive (HAVING sum(tp) > 0)."""
    return (df.groupBy(*by, *bug_keys).agg(count_true("tp").alias("tp_count"))
            .filter(F.col("tp_count") > 0))


def found_intersection_mean(df: DataFrame, sys_col: str, left: str, right: str, run_col: str,
                            bug_keys: Sequence[str] = BUG_KEYS) -> DataFrame:
    """Mean over runs of |found(left) ∩ found(right)|; a run with no overlap counts 0."""
    found = found_bugs(df, [sys_col, run_col], bug_keys)
    a = found.filter(F.col(sys_col) == left).select(run_col, *bug_keys)
    b = found.filter(F.col(sys_col) == right).select(run_col, *bug_keys)
    both = a.join(b, [run_col, *bug_keys], "inner")  # natural join on all common columns
    per_run = both.groupBy(run_col).agg(F.count(F.lit(1)).alias("n_common"))
    runs = df.select(run_col).distinct()
    per_run = runs.join(per_run, run_col, "left").fillna(0, ["n_common"])
    return per_run.agg(F.count(F.lit(1)).alias("n_runs"),
                       F.round(F.avg("n_common"), 6).alias("mean_intersection"),
                       F.sum("n_common").cast("long").alias("total_intersection"))


def confusion(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """TP/FP/FN/TN counts of aligned label / prediction columns."""
    t, p = F.col(truth), F.col(pred)
    return df.groupBy(*by).agg(
        F.count_if((t == 1) & (p == 1)).cast("long").alias("tp"),
        F.count_if((t == 0) & (p == 1)).cast("long").alias("fp"),
        F.count_if((t == 1) & (p == 0)).cast("long").alias("fn"),
        F.count_if((t == 0) & (p == 0)).cast("long").alias("tn"))


def classifier_metrics(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, F1, their mean, and guarded precision / recall (0 denominator -> 1.0)."""
    c = confusion(df, truth, pred, by)
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    p_raw = ratio("tp", F.col("tp") + F.col("fp"), None)
    r_raw = ratio("tp", F.col("tp") + F.col("fn"), None)
    # F1 as the usual library computes it: 0 when there is no positive at all.
    f1_raw = F.coalesce(f1(p_raw, r_raw, None), F.lit(0.0))
    acc = ratio(F.col("tp") + F.col("tn"), n, None)
    return c.select(
        *by, "tp", "fp", "fn", "tn",
        F.round(acc, 6).alias("acc"),
        F.round(f1_raw, 6).alias("f1"),
        F.round((acc + f1_raw) / 2, 6).alias("acc_and_f1"),
        guarded_ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
        guarded_ratio("tp", F.col("tp") + F.col("fn")).alias("recall"))
