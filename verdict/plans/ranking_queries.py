"""Ranking queries: seeded shuffle, top-k hits, averages over seeds and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as R
from ..session import written
from ..sources import views as V
from ..sources.tables import table
from ..sources.views import with_views
from .registry import register

_GROUP = ["system", "run", "project", "bug_num"]
_IDS = ["row_idx", "line_no"]
N_SEEDS = 10

_RANK_SQL = f"""
failed_t AS (SELECT * FROM outcomes WHERE tp OR fp),
seeded AS (SELECT f.*, s.seed FROM failed_t f, (SELECT CAST(range AS INTEGER) AS seed FROM range({N_SEEDS})) s),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY system, run, project, bug_num, seed
            ORDER BY md5(concat_ws('-', CAST(seed AS VARCHAR), CAST(row_idx AS VARCHAR), CAST(line_no AS VARCHAR))),
                     row_idx, line_no) AS rank
  FROM seeded),
hits AS (
  SELECT system, run, seed,
         CAST(sum(h1) AS BIGINT) AS top_1, CAST(sum(h3) AS BIGINT) AS top_3,
         CAST(sum(h5) AS BIGINT) AS top_5, CAST(sum(h10) AS BIGINT) AS top_10
  FROM (SELECT system, run, seed, project, bug_num,
               max(CASE WHEN rank <= 1 AND tp THEN 1 ELSE 0 END) AS h1,
               max(CASE WHEN rank <= 3 AND tp THEN 1 ELSE 0 END) AS h3,
               max(CASE WHEN rank <= 5 AND tp THEN 1 ELSE 0 END) AS h5,
               max(CASE WHEN rank <= 10 AND tp THEN 1 ELSE 0 END) AS h10
        FROM ranked GROUP BY system, run, seed, project, bug_num
        HAVING sum(CAST(tp AS INTEGER) + CAST(fp AS INTEGER)) > 0)
  GROUP BY system, run, seed)"""


def _failed(spark, sf_dir):
    o = V.outcomes(spark, sf_dir)
    return o.filter(F.col("tp") | F.col("fp")).select(*_GROUP, *_IDS, "tp", "fp")


@register("shuffle_rank", with_views("""
SELECT system, run, project, bug_num, seed, row_idx, line_no, rank FROM ranked""", "outcomes", ctes=_RANK_SQL))
def shuffle_rank(spark, sf_dir):
    """Seeded full shuffle of the failed tests of each bug, ten seeds in one job."""
    seeded = R.with_seeds(_failed(spark, sf_dir), N_SEEDS)
    return R.random_rank(seeded, _GROUP, _IDS).select(*_GROUP, "seed", *_IDS, "rank")


def _hits(spark, sf_dir):
    seeded = R.with_seeds(_failed(spark, sf_dir), N_SEEDS)
    top = R.random_topk(seeded, _GROUP, _IDS)
    return R.topk_hits(top, ["project", "bug_num"], ["system", "run", "seed"])


@register("topk_hits", with_views("SELECT * FROM hits", "outcomes", ctes=_RANK_SQL))
def topk_hits(spark, sf_dir):
    """Bugs with a TP among the first 1/3/5/10 ranked failed tests."""
    return _hits(spark, sf_dir)


@register("topk_mean_over_seeds", with_views("""
SELECT system, round(avg(top_1), 6) AS mean_top_1, round(avg(top_3), 6) AS mean_top_3,
       round(avg(top_5), 6) AS mean_top_5, round(avg(top_10), 6) AS mean_top_10
FROM (SELECT system, run, avg(top_1) AS top_1, avg(top_3) AS top_3, avg(top_5) AS top_5, avg(top_10) AS top_10
      FROM hits GROUP BY system, run)
GROUP BY system""", "outcomes", ctes=_RANK_SQL))
def topk_mean_over_seeds(spark, sf_dir):
    """Top-k averaged over seeds, then over runs, per system."""
    return R.mean_topk(_hits(spark, sf_dir), [["system", "run"], ["system"]])


def _isolated(spark, sf_dir):
    from ..operators import features as FT
    from ..operators import outlier as OUT
    feats = FT.add_features(written(V.failed(spark, sf_dir), "failed"), FT.FEATURE_NAMES)
    return OUT.isolation_rank(feats, ["project", "bug_num"], "row_idx", FT.FEATURE_NAMES)


@register("isolation_rank")
def isolation_rank(spark, sf_dir):
    """Isolation-forest rank of failed tests per bug, ten seeds, all eleven features."""
    return _isolated(spark, sf_dir).select("project", "bug_num", "seed", "row_idx", F.round("score", 6).alias("score"), "rank")


@register("topk_isolation")
def topk_isolation(spark, sf_dir):
    """The top-k report of the isolation ranker: per seed, bugs with a true positive (a test whose label is
    not toxic) among the first 1/3/5/10."""
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_idx"), (F.col("toxic") == 0).alias("tp"))
    ranked = _isolated(spark, sf_dir).filter(F.col("rank") <= max(R.TOPK)).join(lab, "row_idx").withColumn("fp", ~F.col("tp"))
    return R.topk_hits(ranked, ["project", "bug_num"], ["seed"])
