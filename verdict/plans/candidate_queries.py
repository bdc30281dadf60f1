"""Oracle-prediction queries over the scored candidates (``scores`` view)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import md5_uniform
from ..functions.positions import group_positions
from ..operators import candidates as C
from ..operators import metrics as M
from ..operators import sweep as S
from ..operators import sampling as SP
from ..sources import views as V
from ..sources.tables import table
from ..sources.views import with_views
from .registry import register

_PICK_CTE = """
ranked AS (
  SELECT s.*,
    row_number() OVER (PARTITION BY idx ORDER BY {worst}, pos) AS r_worst,
    row_number() OVER (PARTITION BY idx ORDER BY CASE WHEN pred = 1 AND l0 <> 0 THEN 0 ELSE 1 END,
                       {best} DESC, pos) AS r_best,
    row_number() OVER (PARTITION BY idx ORDER BY pred DESC, pos) AS r_one,
    row_number() OVER (PARTITION BY idx ORDER BY pos DESC) AS r_last,
    count(*) OVER (PARTITION BY idx) AS n_candidates,
    CAST(sum(pred) OVER (PARTITION BY idx) AS BIGINT) AS n_positive,
    sum(CASE WHEN pred = 1 AND l0 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY idx) AS n_best
  FROM scores s),
picked AS (
  SELECT idx, n_candidates, n_positive, pos AS pick_pos, pred AS pick_pred, l0 AS pick_l0, l1 AS pick_l1,
         kind AS pick_kind, truncation AS pick_truncation, row_idx AS pick_row_idx
  FROM ranked
  WHERE (n_positive = 1 AND r_one = 1) OR (n_positive = 0 AND r_worst = 1)
     OR (n_positive > 1 AND n_best > 0 AND r_best = 1) OR (n_positive > 1 AND n_best = 0 AND r_last = 1))"""

_PICK_MAG = _PICK_CTE.format(worst="l0", best="l1")
_PICK_DIFF = _PICK_CTE.format(worst="abs(l0 - l1)", best="abs(l0 - l1)")

_CARRY = ("kind", "truncation", "row_idx")


def _picked(spark, sf_dir, score="mag"):
    return C.pick_candidate(V.scores(spark, sf_dir), carry=_CARRY, score=score)


@register("pick_candidate", with_views(
    "SELECT idx, n_candidates, n_positive, pick_pos, pick_pred, pick_l0, pick_l1, pick_kind, pick_truncation "
    "FROM picked", "scores", ctes=_PICK_MAG))
def pick_candidate(spark, sf_dir):
    """One candidate per test by the positive-count rule."""
    return _picked(spark, sf_dir).drop("pick_row_idx")


@register("pick_diff", with_views("SELECT idx, pick_pos, pick_l0, pick_l1 FROM picked", "scores", ctes=_PICK_DIFF))
def pick_diff(spark, sf_dir):
    """The same pick scored by |logit_0 - logit_1|."""
    return _picked(spark, sf_dir, score="diff").select("idx", "pick_pos", "pick_l0", "pick_l1")


_THRESHOLDS_SQL = "thresholds(t_kind, t_pred, threshold) AS (VALUES " + ", ".join(
    f"('{k}', {p}, {t})" for k, p, t in C.THRESHOLDS) + ")"

_GATE_CTE = _PICK_MAG + ",\n" + _THRESHOLDS_SQL + """,
gated AS (
  SELECT p.idx, p.pick_truncation, p.pick_l0, p.pick_l1, p.pick_pred, p.pick_kind,
         CASE WHEN (p.pick_pred = 1 AND p.pick_l1 < t.threshold) OR (p.pick_pred = 0 AND p.pick_l0 > t.threshold)
                   OR p.pick_truncation > 75 THEN ''
              ELSE concat(p.pick_kind, '(x', CAST(p.pick_row_idx AS VARCHAR), ')') END AS assert_pred
  FROM picked p LEFT JOIN thresholds t ON p.pick_kind = t.t_kind AND p.pick_pred = t.t_pred)"""


def _gated(spark, sf_dir):
    p = _picked(spark, sf_dir).withColumn(
        "pick_assertion", F.concat(F.col("pick_kind"), F.lit("(x"), F.col("pick_row_idx").cast("string"), F.lit(")")))
    return C.gate_pick(p, C.threshold_table(spark))


@register("gate_candidate", with_views(
    "SELECT idx, assert_pred, pick_truncation, pick_l0, pick_l1 FROM gated", "scores", ctes=_GATE_CTE))
def gate_candidate(spark, sf_dir):
    """W8b + J10 + M8: threshold lookup by (kind, pred) and truncation gate after the pick."""
    return _gated(spark, sf_dir).select("idx", "assert_pred", "pick_truncation", "pick_l0", "pick_l1")


@register("confusion", with_views("""
SELECT CAST(count_if(s.truth = 1 AND s.pos = p.pick_pos) AS BIGINT) AS tp,
       CAST(count_if(s.truth = 0 AND s.pos = p.pick_pos) AS BIGINT) AS fp,
       CAST(count_if(s.truth = 1 AND s.pos <> p.pick_pos) AS BIGINT) AS fn,
       CAST(count_if(s.truth = 0 AND s.pos <> p.pick_pos) AS BIGINT) AS tn,
       (SELECT count(*) FROM (SELECT s2.idx FROM scores s2 JOIN picked p2 ON s2.idx = p2.idx GROUP BY s2.idx
          HAVING bool_and((s2.pos = p2.pick_pos) = (s2.truth = 1)))) AS correct_tests,
       (SELECT count(DISTINCT idx) FROM scores) AS tests
FROM scores s JOIN picked p ON s.idx = p.idx""", "scores", ctes=_PICK_MAG))
def confusion(spark, sf_dir):
    """Confusion of the one-hot pick against candidate labels, and fully correct tests."""
    s = V.scores(spark, sf_dir)
    p = _picked(spark, sf_dir).select("idx", "pick_pos")
    j = s.join(p, "idx").withColumn("new_p", (F.col("pos") == F.col("pick_pos")).cast("int"))
    per_test = M.confusion(j, "truth", "new_p", by=["idx"])
    ok = (F.col("fp") == 0) & (F.col("fn") == 0)
    return per_test.agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")],
                        F.count_if(ok).alias("correct_tests"), F.count(F.lit(1)).alias("tests"))


_CLS_SQL = """
c AS (SELECT CAST(count_if(truth = 1 AND pred = 1) AS BIGINT) AS tp, CAST(count_if(truth = 0 AND pred = 1) AS BIGINT) AS fp,
             CAST(count_if(truth = 1 AND pred = 0) AS BIGINT) AS fn, CAST(count_if(truth = 0 AND pred = 0) AS BIGINT) AS tn
      FROM scores),
m AS (SELECT *, CAST(tp + tn AS DOUBLE) / NULLIF(tp + fp + fn + tn, 0) AS acc_raw,
             coalesce(2.0 * tp / NULLIF(2 * tp + fp + fn, 0), 0.0) AS f1_raw FROM c)"""


@register("guarded_precision_recall", with_views("""
SELECT tp, fp, fn, tn, coalesce(round(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 6), 1.0) AS precision,
       coalesce(round(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 6), 1.0) AS recall FROM m""", "scores", ctes=_CLS_SQL))
def guarded_precision_recall(spark, sf_dir):
    """A5: precision / recall of the candidate classifier, 1.0 on a zero denominator."""
    return M.classifier_metrics(V.scores(spark, sf_dir), "truth", "pred").select(
        "tp", "fp", "fn", "tn", "precision", "recall")


@register("accuracy_f1", with_views("""
SELECT round(acc_raw, 6) AS acc, round(f1_raw, 6) AS f1, round((acc_raw + f1_raw) / 2, 6) AS acc_and_f1
FROM m""", "scores", ctes=_CLS_SQL))
def accuracy_f1(spark, sf_dir):
    """Accuracy, F1 and their mean."""
    return M.classifier_metrics(V.scores(spark, sf_dir), "truth", "pred").select("acc", "f1", "acc_and_f1")


def _sweep_input(spark, sf_dir):
    s = V.scores(spark, sf_dir)
    return s.select(F.col("truth").alias("t"), F.col("pred").alias("p"), "l0", "l1",
                    F.when(F.col("kind") == "assertEquals", 1).otherwise(0).alias("as_lbl"),
                    F.when(F.col("truncation") > 40, 1).otherwise(0).alias("ex_lbl"))


_SWEEP_IN = """
sw AS (SELECT truth AS t, pred AS p, l0, l1, CASE WHEN kind = 'assertEquals' THEN 1 ELSE 0 END AS as_lbl,
              CASE WHEN truncation > 40 THEN 1 ELSE 0 END AS ex_lbl FROM scores),
sx AS (SELECT *, (t = 1 AND as_lbl = 0) OR ex_lbl = 1 AS ex FROM sw)"""


@register("threshold_sweep", with_views(f"""
SELECT method, threshold, CAST(count_if(t = 1 AND pn = 1) AS BIGINT) AS tp, CAST(count_if(t = 0 AND pn = 1) AS BIGINT) AS fp,
       CAST(count_if(t = 1 AND pn = 0) AS BIGINT) AS fn, CAST(count_if(t = 0 AND pn = 0) AS BIGINT) AS tn,
       round(coalesce(2.0 * count_if(t = 1 AND pn = 1)
             / NULLIF(2 * count_if(t = 1 AND pn = 1) + count_if(t = 0 AND pn = 1) + count_if(t = 1 AND pn = 0), 0), 0.0), 6) AS f1
FROM (
  SELECT t, method, threshold,
    CASE WHEN (CASE method WHEN 'diff' THEN abs(l0 - l1) > threshold
                           WHEN 'magnitude' THEN abs(l1) - abs(l0) > threshold / 100.0
                           WHEN 'weighted' THEN (abs(l1) - abs(l0)) *
                                (CASE WHEN NOT ex AND p = 1 THEN {S.SWEEP_WEIGHTS['no_ex_t_1']}
                                      WHEN ex AND p = 0 THEN {S.SWEEP_WEIGHTS['ex_t_0']}
                                      WHEN ex AND p = 1 THEN {S.SWEEP_WEIGHTS['ex_t_1']}
                                      ELSE {S.SWEEP_WEIGHTS['no_ex_t_0']} END) > threshold / 1000.0
                           ELSE false END) THEN p ELSE 0 END AS pn
  FROM sx, (SELECT unnest(['magnitude', 'diff', 'weighted', 'ignore']) AS method),
       (SELECT CAST(range AS INTEGER) AS threshold FROM range(20)))
GROUP BY method, threshold""", "scores", ctes=_SWEEP_IN))
def threshold_sweep(spark, sf_dir):
    """Four threshold methods x 20 thresholds -> confusion counts and F1."""
    return S.threshold_sweep(_sweep_input(spark, sf_dir))


@register("class_probabilities", with_views("""
SELECT count(*) AS total, CAST(count_if(as_lbl = 1 AND t = 1) AS BIGINT) AS no_ex_t_1,
       CAST(count_if(ex AND t = 0) AS BIGINT) AS ex_t_0, CAST(count_if(ex AND t = 1) AS BIGINT) AS ex_t_1,
       CAST(count_if(NOT ex AND t = 0) AS BIGINT) AS no_ex_t_0,
       round(count_if(as_lbl = 1 AND t = 1) / count(*), 6) AS no_ex_t_1_share,
       round(count_if(ex AND t = 0) / count(*), 6) AS ex_t_0_share,
       round(count_if(ex AND t = 1) / count(*), 6) AS ex_t_1_share,
       round(count_if(NOT ex AND t = 0) / count(*), 6) AS no_ex_t_0_share
FROM sx""", "scores", ctes=_SWEEP_IN))
def class_probabilities(spark, sf_dir):
    """(exception thrown x label) counters of the sweep input."""
    return S.class_probabilities(_sweep_input(spark, sf_dir))


@register("index_gather", with_views("""
SELECT e.event_id AS list_pos, s.row_idx, s.truth, s.pred, s.l0, s.l1
FROM events e JOIN scores s ON s.row_idx = e.user_id
WHERE e.event_type = 'click'""", "scores"))
def index_gather(spark, sf_dir):
    """Gather score rows by an index list (list order kept, repeats allowed)."""
    idx_list = (table(spark, sf_dir, "events").filter(F.col("event_type") == "click")
                .select(F.col("event_id").alias("list_pos"), F.col("user_id").alias("row_idx")))
    s = V.scores(spark, sf_dir).select("row_idx", "truth", "pred", "l0", "l1")
    return idx_list.join(s, "row_idx")


def _except_preds(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    l0 = F.col("quality").cast("double") * 2.0 - 1.0
    l1 = F.col("toxic").cast("double") * 3.0 - 6.0
    return lab.select(F.col("doc_id").alias("row_idx"), C.logit_decision(l0, l1, True).alias("except_pred"),
                      l0.alias("except_logit_0"), l1.alias("except_logit_1"))


_PRED_DEFAULTS = {"except_pred": 0, "except_logit_0": 0.0, "except_logit_1": 0.0,
                  "assert_pred": "", "assert_logit_0": 0.0, "assert_logit_1": 0.0}


@register("sparse_scatter", with_views("""
SELECT c.row_idx, c.project, c.bug_num, c.test_name,
       coalesce(e.except_pred, 0) AS except_pred, coalesce(e.except_logit_0, CAST(0.0 AS DOUBLE)) AS except_logit_0,
       coalesce(e.except_logit_1, CAST(0.0 AS DOUBLE)) AS except_logit_1,
       CASE WHEN coalesce(e.except_pred, 0) = 1 THEN '' ELSE coalesce(g.assert_pred, '') END AS assert_pred,
       coalesce(g.pick_l0, 0.0) AS assert_logit_0, coalesce(g.pick_l1, 0.0) AS assert_logit_1
FROM cases c
LEFT JOIN (SELECT doc_id AS row_idx,
                  CASE WHEN l1 > l0 OR l1 > -5.5 THEN 1 ELSE 0 END AS except_pred,
                  l0 AS except_logit_0, l1 AS except_logit_1
           FROM (SELECT doc_id, CAST(quality AS DOUBLE) * 2.0 - 1.0 AS l0, CAST(toxic AS DOUBLE) * 3.0 - 6.0 AS l1
                 FROM labels)) e
  ON c.row_idx = e.row_idx
LEFT JOIN gated g ON c.row_idx = g.idx""", "scores", "cases", ctes=_GATE_CTE))
def sparse_scatter(spark, sf_dir):
    """J2 + P12 + P26: exception and assertion predictions scattered onto every test row
    with defaults; an exception prediction blanks the assertion."""
    base = V.cases(spark, sf_dir, flags=False).select("row_idx", "project", "bug_num", "test_name")
    ex = _except_preds(spark, sf_dir)
    asr = _gated(spark, sf_dir).select(F.col("idx").alias("row_idx"), "assert_pred",
                                       F.col("pick_l0").alias("assert_logit_0"),
                                       F.col("pick_l1").alias("assert_logit_1"))
    j = C.scatter(C.scatter(base, ex, "row_idx", {}), asr, "row_idx", _PRED_DEFAULTS)
    return j.withColumn("assert_pred", C.override())


@register("baseline_pred", with_views("""
SELECT row_idx, project, bug_num, test_name, 0 AS except_pred, CAST(1.0 AS DOUBLE) AS except_logit_0,
       CAST(0.0 AS DOUBLE) AS except_logit_1, '' AS assert_pred, CAST(1.0 AS DOUBLE) AS assert_logit_0,
       CAST(0.0 AS DOUBLE) AS assert_logit_1 FROM cases""", "cases"))
def baseline_pred(spark, sf_dir):
    """Constant no-exception / no-assertion predictor."""
    return C.baseline_predictions(V.cases(spark, sf_dir, flags=False).select("row_idx", "project", "bug_num", "test_name"))


@register("class_weights", """
SELECT doc_id, quality, CAST(1.0 AS DOUBLE) / count(*) OVER (PARTITION BY quality <> 0) AS weight FROM labels""")
def class_weights(spark, sf_dir):
    """Inverse class-frequency weight per row (class = label is non-zero)."""
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    cls = (F.col("quality") != 0).alias("_cls")
    counts = lab.groupBy(cls).agg(F.count(F.lit(1)).alias("_n"))  # one row per class
    return (lab.withColumn("_cls", F.col("quality") != 0).join(counts, "_cls")
            .select("doc_id", "quality", (F.lit(1.0) / F.col("_n")).alias("weight")))


_SAMPLE_SEED = 7


@register("weighted_sample", f"""
WITH cls AS (SELECT doc_id, CASE WHEN quality <> 0 THEN 1 ELSE 0 END AS c FROM labels),
ranked AS (SELECT doc_id, c, row_number() OVER (PARTITION BY c ORDER BY doc_id) - 1 AS pos FROM cls),
classes AS (SELECT c, dense_rank() OVER (ORDER BY c) - 1 AS ci, count(*) AS n FROM cls GROUP BY c),
k AS (SELECT count(*) AS k FROM classes),
draws AS (
  SELECT doc_id AS draw_id,
    ('0x' || substr(md5(concat_ws('-', '{_SAMPLE_SEED}', CAST(doc_id AS VARCHAR), 'c')), 1, 8))::BIGINT / 4294967296.0 AS u1,
    ('0x' || substr(md5(concat_ws('-', '{_SAMPLE_SEED}', CAST(doc_id AS VARCHAR), 'r')), 1, 8))::BIGINT / 4294967296.0 AS u2
  FROM labels),
chosen AS (
  SELECT d.draw_id, cl.c, CAST(floor(d.u2 * cl.n) AS BIGINT) AS pos
  FROM draws d, k JOIN classes cl ON cl.ci = CAST(floor(d.u1 * k.k) AS BIGINT))
SELECT ch.draw_id, r.doc_id AS sampled_doc_id, ch.c AS sampled_class
FROM chosen ch JOIN ranked r ON r.c = ch.c AND r.pos = ch.pos""")
def weighted_sample(spark, sf_dir):
    """Sampling with replacement under inverse-frequency class weights.

    With weight 1/n_c every class carries the same total weight, so a draw picks
    class floor(u1*K) and then row floor(u2*n_c) of that class. Row positions
    inside a class come from the skew-safe ``group_positions`` (a class may hold
    most of the rows).
    """
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = lab.select("doc_id", F.when(F.col("quality") != 0, 1).otherwise(0).alias("c"))
    ranked = group_positions(rows, ["c"], ["doc_id"])
    classes = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    classes = group_positions(classes.withColumn("_all", F.lit(0)), ["_all"], ["c"], pos_col="ci").drop("_all")
    k = classes.count()  # number of classes: a scalar bounded by the label domain
    draws = lab.select(F.col("doc_id").alias("draw_id"),
                       md5_uniform(F.lit(_SAMPLE_SEED), "doc_id", F.lit("c")).alias("u1"),
                       md5_uniform(F.lit(_SAMPLE_SEED), "doc_id", F.lit("r")).alias("u2"))
    draws = draws.withColumn("ci", F.floor(F.col("u1") * F.lit(k)))
    chosen = draws.join(F.broadcast(classes), "ci").select(  # one row per class
        "draw_id", "c", F.floor(F.col("u2") * F.col("n")).alias("pos"))
    return chosen.join(ranked, ["c", "pos"]).select(
        "draw_id", F.col("doc_id").alias("sampled_doc_id"), F.col("c").alias("sampled_class"))


@register("weighted_documents", f"""
WITH w AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[a-z]+'))::HUGEINT AS weight FROM documents),
starts AS (SELECT doc_id, weight, sum(weight) OVER (ORDER BY doc_id) - weight AS start FROM w WHERE weight > 0),
draws AS (
  SELECT doc_id AS draw_id, CAST((('0x' || substr(md5(concat_ws('-', '{_SAMPLE_SEED}', CAST(doc_id AS VARCHAR), 'w')), 1, 15))::BIGINT::HUGEINT
                                  * (SELECT sum(weight) FROM starts)) // (1::HUGEINT << {SP.BITS}) AS BIGINT) AS pos
  FROM documents)
SELECT draw_id, s.doc_id FROM draws ASOF JOIN starts s ON draws.pos >= s.start""")
def weighted_documents(spark, sf_dir):
    """As many draws as documents, with replacement, each document with a chance in proportion to its words."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-z]+"), F.lit(0))).alias("weight"))
    draws = d.select(F.col("doc_id").alias("draw_id"), SP.uniform_bits(F.lit(_SAMPLE_SEED), "doc_id", F.lit("w")).alias("bits"))
    return SP.draw_rows(d, draws, "doc_id", "weight", "draw_id", "bits")
