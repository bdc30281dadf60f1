"""Oracle prediction: pick one assertion candidate per test, gate it, scatter
the predictions back onto every test row, and the constant baseline.

The pick is one ``groupBy(idx)`` whose aggregates are all partial
(min/max over structs), so a test with very many candidates is combined
map-side and never collected into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Confidence thresholds keyed by (assertion kind, predicted label).
THRESHOLDS = [
    ("assertTrue", 1, 2.6),
    ("assertTrue", 0, 6.1),
    ("assertFalse", 1, 1.95),
    ("assertFalse", 0, 2.46),
    ("assertNotNull", 1, 6.05),
    ("assertNotNull", 0, 6.04),
    ("assertEquals", 1, 6.1),
    ("assertEquals", 0, 4.56),
]
# A picked candidate whose token truncation exceeds this is dropped.
MAX_TRUNCATION = 75
# The exception classifier also predicts 1 when logit_1 exceeds this.
EXCEPTION_LOGIT_1_FLOOR = -5.5


def threshold_table(spark: SparkSession) -> DataFrame:
    """Eight-row lookup table (kind, pred, threshold); size is fixed, so broadcast."""
    return spark.createDataFrame(THRESHOLDS, "t_kind string, t_pred int, threshold double")


def _score(method: str, l0: Column, l1: Column, for_best: bool) -> Column:
    if method == "mag":
        return l1 if for_best else l0
    if method == "diff":
        return F.abs(l0 - l1)
    raise ValueError(f"unknown score method {method!r}")


def pick_candidate(df: DataFrame, group: str = "idx", pos: str = "pos", pred: str = "pred",
                   l0: str = "l0", l1: str = "l1", carry: tuple[str, ...] = (), score: str = "mag") -> DataFrame:
    """One row per group: the picked candidate.

    Rule: exactly one positive -> it; no positive -> smallest score (first on
    ties); several -> among positives whose logit_0 is non-zero the largest
    score (first on ties); if none qualifies, the last candidate.
    ``score='diff'`` uses |l0 - l1| for both choices.
    """
    c0, c1, p, ps = F.col(l0), F.col(l1), F.col(pred), F.col(pos)
    fields = [ps.alias("pos"), p.alias("pred"), c0.alias("l0"), c1.alias("l1"), *[F.col(c) for c in carry]]
    row = F.struct(*fields)
    worst = F.min(F.struct(_score(score, c0, c1, False).alias("s"), ps.alias("o"), row.alias("r")))
    best = F.max(F.when((p == 1) & (c0 != 0),
                        F.struct(_score(score, c0, c1, True).alias("s"), (-ps).alias("o"), row.alias("r"))))
    one = F.max(F.when(p == 1, F.struct(ps.alias("o"), row.alias("r"))))
    last = F.max(F.struct(ps.alias("o"), row.alias("r")))
    agg = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.sum(p).cast("long").alias("n_positive"),
        worst.alias("_worst"), best.alias("_best"), one.alias("_one"), last.alias("_last"))
    chosen = (F.when(F.col("n_positive") == 1, F.col("_one.r"))
              .when(F.col("n_positive") == 0, F.col("_worst.r"))
              .otherwise(F.coalesce(F.col("_best.r"), F.col("_last.r"))))
    out = agg.withColumn("_pick", chosen)
    return out.select(group, "n_candidates", "n_positive",
                      *[F.col(f"_pick.{f}").alias(f"pick_{f}") for f in ("pos", "pred", "l0", "l1", *carry)])


def gate_pick(picked: DataFrame, thresholds: DataFrame, kind: str = "pick_kind", pred: str = "pick_pred",
              l0: str = "pick_l0", l1: str = "pick_l1", assertion: str = "pick_assertion",
              truncation: str = "pick_truncation", strict: bool = True) -> DataFrame:
    """Blank the picked assertion when its confidence is below the threshold of
    its (kind, pred) or its truncation is too large. Logits are kept."""
    j = picked.join(F.broadcast(thresholds), (F.col(kind) == F.col("t_kind")) & (F.col(pred) == F.col("t_pred")),
                    "left")
    thr = F.col("threshold")
    low = ((F.col(pred) == 1) & (F.col(l1) < thr)) | ((F.col(pred) == 0) & (F.col(l0) > thr))
    if strict:
        # a kind outside the table is an error in the reference; surface it
        low = F.when(thr.isNull(), F.raise_error(F.lit("no threshold for assertion kind"))).otherwise(low)
    blank = F.coalesce(low, F.lit(False)) | (F.col(truncation) > MAX_TRUNCATION)
    return (j.withColumn("assert_pred", F.when(blank, F.lit("")).otherwise(F.col(assertion)))
            .drop("t_kind", "t_pred", "threshold"))


def logit_decision(l0: Column, l1: Column, exception_variant: bool = False) -> Column:
    """Argmax of two logits (tie -> 0); the exception model also fires when l1 > -5.5."""
    d = l1 > l0
    if exception_variant:
        d = d | (l1 > F.lit(EXCEPTION_LOGIT_1_FLOOR))
    return d.cast("int")


def scatter(base: DataFrame, preds: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Sparse predictions onto every base row by ``key``; missing rows get defaults."""
    j = base.join(preds, key, "left")
    for c, v in defaults.items():
        j = j.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return j


def override(except_pred: str = "except_pred", assert_pred: str = "assert_pred") -> Column:
    """An exception prediction wins over an assertion prediction."""
    return F.when(F.col(except_pred) == 1, F.lit("")).otherwise(F.col(assert_pred))


def baseline_predictions(base: DataFrame) -> DataFrame:
    """Constant predictor: no exception, no assertion, logits (1.0, 0.0)."""
    return base.withColumns({
        "except_pred": F.lit(0), "except_logit_0": F.lit(1.0), "except_logit_1": F.lit(0.0),
        "assert_pred": F.lit(""), "assert_logit_0": F.lit(1.0), "assert_logit_1": F.lit(0.0)})
