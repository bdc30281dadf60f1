"""Run-level outcome metrics (bugs found, FP rate, precision, TPs, FPs)."""

from __future__ import annotations

from ..operators import metrics as M
from ..sources import views as V
from ..sources.views import with_views
from .registry import register

_PER_RUN_SQL = """
per_bug AS (
  SELECT system, run, project, bug_num,
         CAST(sum(CAST(tp AS BIGINT)) AS BIGINT) AS bug_tp, CAST(sum(CAST(fp AS BIGINT)) AS BIGINT) AS bug_fp,
         CAST(sum(CAST(tn AS BIGINT)) AS BIGINT) AS bug_tn, CAST(sum(CAST(fn AS BIGINT)) AS BIGINT) AS bug_fn
  FROM outcomes GROUP BY system, run, project, bug_num),
rep AS (
  SELECT system, run, CAST(count_if(bug_tp > 0) AS BIGINT) AS bugs_found,
         CAST(sum(bug_tp) AS BIGINT) AS tps, CAST(sum(bug_fp) AS BIGINT) AS fps,
         CAST(sum(bug_tn) AS BIGINT) AS tns, CAST(sum(bug_fn) AS BIGINT) AS fns
  FROM per_bug GROUP BY system, run),
per_run AS (
  SELECT *, round(CAST(fps AS DOUBLE) / NULLIF(fps + tns, 0), 6) AS fp_rate,
         round(CAST(tps AS DOUBLE) / NULLIF(tps + fps, 0), 6) AS precision,
         round(CAST(tps AS DOUBLE) / NULLIF(tps + fns, 0), 6) AS recall,
         round(2 * (CAST(tps AS DOUBLE) / NULLIF(tps + fps, 0)) * (CAST(tps AS DOUBLE) / NULLIF(tps + fns, 0))
               / NULLIF((CAST(tps AS DOUBLE) / NULLIF(tps + fps, 0)) + (CAST(tps AS DOUBLE) / NULLIF(tps + fns, 0)), 0),
               6) AS f1
  FROM rep)"""


def _by_run(spark, sf_dir):
    return M.outcome_metrics(V.outcomes(spark, sf_dir), ["system", "run"])


@register("outcome_metrics_by_run",
          with_views("SELECT * FROM per_run", "outcomes", ctes=_PER_RUN_SQL))
def outcome_metrics_by_run(spark, sf_dir):
    """One metrics row per (system, run)."""
    return _by_run(spark, sf_dir)


# The runs that every system must have.
EXPECTED_RUNS = range(1, 8)
_MEAN_METRICS = ["bugs_found", "fp_rate", "precision", "tps", "fps"]


@register("outcome_metrics_mean",
          with_views("""
SELECT system, count(DISTINCT run) AS n_runs,
       round(avg(bugs_found), 6) AS mean_bugs_found, round(avg(fp_rate), 6) AS mean_fp_rate,
       round(avg(precision), 6) AS mean_precision, round(avg(tps), 6) AS mean_tps,
       round(avg(fps), 6) AS mean_fps,
       count(DISTINCT run) = 7 AND count(DISTINCT CASE WHEN run BETWEEN 1 AND 7 THEN run END) = 7 AS complete
FROM per_run GROUP BY system""", "outcomes", ctes=_PER_RUN_SQL))
def outcome_metrics_mean(spark, sf_dir):
    """A9 + V6: mean of the run metrics per system, with a run-completeness flag."""
    o = V.outcomes(spark, sf_dir)
    rep = M.outcome_metrics(o, ["system", "run"])
    return M.mean_over_runs(rep, ["system"], "run", _MEAN_METRICS, expected_runs=EXPECTED_RUNS)


@register("found_groups", with_views("""
SELECT system, run, project, bug_num, CAST(sum(CAST(tp AS BIGINT)) AS BIGINT) AS tp_count
FROM outcomes GROUP BY system, run, project, bug_num HAVING sum(CAST(tp AS BIGINT)) > 0""", "outcomes"))
def found_groups(spark, sf_dir):
    """The bugs with at least one TP, per (system, run)."""
    return M.found_bugs(V.outcomes(spark, sf_dir), ["system", "run"])


@register("found_intersection_mean", with_views("""
SELECT count(*) AS n_runs, round(avg(coalesce(c.n_common, 0)), 6) AS mean_intersection,
       CAST(sum(coalesce(c.n_common, 0)) AS BIGINT) AS total_intersection
FROM runs r LEFT JOIN common c ON r.run = c.run""", "outcomes", ctes="""
found AS (
  SELECT system, run, project, bug_num FROM outcomes
  GROUP BY system, run, project, bug_num HAVING sum(CAST(tp AS BIGINT)) > 0),
common AS (
  SELECT a.run, count(*) AS n_common
  FROM (SELECT * FROM found WHERE system = 'naive') a
  JOIN (SELECT * FROM found WHERE system = 'learned') b
    ON a.run = b.run AND a.project = b.project AND a.bug_num = b.bug_num
  GROUP BY a.run),
runs AS (SELECT DISTINCT run FROM outcomes)"""))
def found_intersection_mean(spark, sf_dir):
    """Mean size of the found-bug intersection of the two systems."""
    return M.found_intersection_mean(V.outcomes(spark, sf_dir), "system", "naive", "learned", "run")
