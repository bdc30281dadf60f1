"""Threshold sweep of the exception classifier and its class counters.

Each row is reduced to the number of thresholds it passes per method; the
4 x 20 grid meets the counts of those numbers, not the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let

# Class weights of the weighted threshold, keyed by
# (exception thrown, predicted label).
SWEEP_WEIGHTS = {
    "no_ex_t_1": 0.0035740565541890045,
    "ex_t_0": 0.005781562072952801,
    "ex_t_1": 0.21013350152423,
    "no_ex_t_0": 0.7805108798486282,
}
# The four methods and thresholds 0..19 (scaled per method).
SWEEP_METHODS = ("magnitude", "diff", "weighted", "ignore")
SWEEP_THRESHOLDS = range(20)


def thrown(t: Column, as_lbl: Column, ex_lbl: Column) -> Column:
    """An exception was thrown: positive label not explained by an assertion, or exception label."""
    return ((t == 1) & (as_lbl == 0)) | (ex_lbl == 1)


def _n_passed(method: str, p: Column, ex: Column, l0: Column, l1: Column) -> Column:
    """How many thresholds of the method the row passes; it passes the smallest ones."""
    w = (F.when(~ex & (p == 1), SWEEP_WEIGHTS["no_ex_t_1"]).when(ex & (p == 0), SWEEP_WEIGHTS["ex_t_0"])
         .when(ex & (p == 1), SWEEP_WEIGHTS["ex_t_1"]).otherwise(SWEEP_WEIGHTS["no_ex_t_0"]))
    mag = F.abs(l1) - F.abs(l0)
    value, scale = {"diff": (F.abs(l0 - l1), 1.0), "magnitude": (mag, 100.0), "weighted": (mag * w, 1000.0)}.get(method, (None, 1.0))
    if value is None:
        return F.lit(0)
    limits = F.array(*[F.lit(float(k)) / F.lit(scale) for k in SWEEP_THRESHOLDS])
    return let(value, lambda v: F.size(F.filter(limits, lambda x: v > x)))


def threshold_sweep(df: DataFrame, t: str = "t", p: str = "p", l0: str = "l0", l1: str = "l1",
                    as_lbl: str = "as_lbl", ex_lbl: str = "ex_lbl") -> DataFrame:
    """TP/FP/FN/TN and F1 per (method, threshold); a failing gate predicts 0.

    A row becomes one number per method (the thresholds it passes); the rows of each number
    are counted, and only these at most 4 x 21 x 4 counts meet the thresholds.
    """
    tc, pc = F.col(t), F.col(p)
    ex = thrown(tc, F.col(as_lbl), F.col(ex_lbl))
    per = F.array(*[F.struct(F.lit(m).alias("method"), _n_passed(m, pc, ex, F.col(l0), F.col(l1)).alias("n")) for m in SWEEP_METHODS])
    bins = (df.select(tc.alias("_t"), pc.alias("_p"), F.explode(per).alias("_g"))
            .groupBy("_t", "_p", "_g.method", "_g.n").agg(F.count(F.lit(1)).alias("_c")))
    grid = bins.withColumn("threshold", F.explode(F.array(*[F.lit(k) for k in SWEEP_THRESHOLDS])))
    pn, tt = F.when(F.col("threshold") < F.col("n"), F.col("_p")).otherwise(F.lit(0)), F.col("_t")
    rows = lambda c: F.sum(F.when(c, F.col("_c")).otherwise(F.lit(0))).cast("long")
    out = grid.groupBy("method", "threshold").agg(
        rows((tt == 1) & (pn == 1)).alias("tp"), rows((tt == 0) & (pn == 1)).alias("fp"),
        rows((tt == 1) & (pn == 0)).alias("fn"), rows((tt == 0) & (pn == 0)).alias("tn"))
    f1 = F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn"))
    return out.withColumn("f1", F.round(F.coalesce(f1, F.lit(0.0)), 6))


def class_probabilities(df: DataFrame, t: str = "t", as_lbl: str = "as_lbl", ex_lbl: str = "ex_lbl") -> DataFrame:
    """The four (exception thrown x label) counters and their shares."""
    tc = F.col(t)
    ex = thrown(tc, F.col(as_lbl), F.col(ex_lbl))
    out = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if((F.col(as_lbl) == 1) & (tc == 1)).cast("long").alias("no_ex_t_1"),
        F.count_if(ex & (tc == 0)).cast("long").alias("ex_t_0"),
        F.count_if(ex & (tc == 1)).cast("long").alias("ex_t_1"),
        F.count_if(~ex & (tc == 0)).cast("long").alias("no_ex_t_0"))
    for c in ("no_ex_t_1", "ex_t_0", "ex_t_1", "no_ex_t_0"):
        out = out.withColumn(f"{c}_share", F.round(F.try_divide(F.col(c).cast("double"), F.col("total")), 6))
    return out
