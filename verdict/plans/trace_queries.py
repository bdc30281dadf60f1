"""Trigger-log and ranking-feature queries (``traces`` / ``failed`` views)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import features as FT
from ..operators import triggers as TR
from ..session import ensure_checkpoint_dir, written
from ..sources import files as SF
from ..sources import views as V
from ..sources.tables import table
from ..sources.views import with_views
from .registry import register
from .similarity_queries import TFIDF_SQL

_WS = "' ' || chr(9) || chr(10) || chr(13)"

# Parsed trace columns in DuckDB; input ``src`` has row_idx, project, bug_num, block.
_PARSE_SQL = f"""
p0 AS (SELECT *, trim(split_part(trim(block, {_WS}), chr(10), 2), {_WS}) AS start_line FROM src),
p1 AS (SELECT *, trim(split_part(start_line, ':', 1), {_WS}) AS trace_exception,
              trim(regexp_extract(start_line, '^[^:]*:(.*)$', 1), {_WS}) AS trace_desc FROM p0),
p2 AS (SELECT *, regexp_extract(trace_exception, '([^.]*)$', 1) AS raw_name FROM p1),
parsed AS (
  SELECT *, CASE WHEN starts_with(trace_exception, 'org.evosuite') AND starts_with(raw_name, 'Mock')
                 THEN substr(raw_name, 5) ELSE raw_name END AS trace_exception_name,
         trim(split_part(block, chr(10), 1), {_WS}) AS block_test_name,
         CASE WHEN contains(block, 'AssertionFailedError') THEN 'assertion'
              WHEN contains(block, 'Exception') OR contains(block, 'StackOverflowError')
                   OR contains(start_line, 'MathInternalError') OR starts_with(start_line, 'java.lang')
              THEN 'exception' ELSE 'none' END AS category
  FROM p2)"""

_SRC_TRACES = "src AS (SELECT row_idx, project, bug_num, test_name, regexp_replace(trace, '^-+', '') AS block FROM traces)"


def _blocks(spark, sf_dir):
    t = V.traces(spark, sf_dir)
    return t.withColumn("block", TR.block_text("trace")).drop("trace")


def _parsed(spark, sf_dir):
    b = TR.complete_blocks(TR.parse_blocks(_blocks(spark, sf_dir).drop("test_name")))
    b = b.withColumns({"trace_exception": FT.trace_exception("block"), "trace_desc": FT.trace_desc("block")})
    return b.withColumn("trace_exception_name", FT.exception_simple_name("trace_exception"))


@register("trace_parse", with_views("""
SELECT row_idx, block_test_name AS test_name, trace_exception, trace_exception_name, trace_desc,
       trace_desc <> '' AS has_desc, category FROM parsed""", "traces", ctes=_SRC_TRACES + ",\n" + _PARSE_SQL))
def trace_parse(spark, sf_dir):
    """Test name, exception class, simple name, description, category per block."""
    return _parsed(spark, sf_dir).select(
        "row_idx", "test_name", "trace_exception", "trace_exception_name", "trace_desc",
        (F.col("trace_desc") != "").alias("has_desc"), "category")


# A log holds so many events at most, as a rotated log does; event ids deal them into the buggy and the fixed one.
_LOG_EVENTS = 100_000
_LOG_RE = r"project=([^/]+)/system=([^/]+)/bug_num=([0-9]+)/tag=([^/]+)/[^/]+$"


@register("trigger_log_scan", with_views(f"""
SELECT project, system, bug_num, tag, block_pos, block_test_name AS test_name, category, md5(block) AS block_md5
FROM parsed""", "traces", ctes=f"""
logged AS (SELECT *, 'log' || CAST(row_idx // {_LOG_EVENTS} AS VARCHAR) AS system, CASE WHEN contains(trace, 'Exception') THEN 'b' ELSE 'f' END AS tag FROM traces),
src AS (
  SELECT project, system, bug_num, tag, row_number() OVER w - 1 AS block_pos, regexp_replace(trace, '^-+', '')
         || CASE WHEN row_number() OVER w = count(*) OVER (PARTITION BY project, system, bug_num, tag) THEN chr(10) ELSE '' END AS block
  FROM logged WINDOW w AS (PARTITION BY project, system, bug_num, tag ORDER BY row_idx)),
""" + _PARSE_SQL))
def trigger_log_scan(spark, sf_dir):
    """The logs of all events written as text files to the shared folder, and scanned by their block separator."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trigger-logs-{uuid.uuid4().hex}"
    keys = ["project", "system", "bug_num", "tag"]
    t = V.traces(spark, sf_dir).withColumns({
        "system": F.concat(F.lit("log"), F.floor(F.col("row_idx") / _LOG_EVENTS).cast("string")),
        "tag": F.when(F.contains("trace", F.lit("Exception")), "b").otherwise("f")})
    t.repartition(*keys).sortWithinPartitions(*keys, "row_idx").select(*keys, "trace").write.partitionBy(*keys).text(root)
    blocks = SF.read_trigger_logs(spark, root, glob="*.txt", path_re=_LOG_RE)
    return blocks.select(*keys, "block_pos", "test_name", "category", F.md5("block").alias("block_md5"))


@register("trace_category", with_views("""
SELECT project, bug_num, category, count(*) AS n_blocks FROM parsed GROUP BY project, bug_num, category""",
                                       "traces", ctes=_SRC_TRACES + ",\n" + _PARSE_SQL))
def trace_category(spark, sf_dir):
    """Block count per (bug, category)."""
    return _parsed(spark, sf_dir).groupBy("project", "bug_num", "category").agg(
        F.count(F.lit(1)).alias("n_blocks"))


@register("trigger_counts", with_views("""
SELECT project, bug_num, count(*) AS total,
       count(DISTINCT CASE WHEN category <> 'none' THEN block_test_name END) AS unique_triggered,
       count(DISTINCT CASE WHEN category = 'exception' THEN block_test_name END) AS exception_tests,
       count(DISTINCT CASE WHEN category = 'assertion' THEN block_test_name END) AS assertion_tests
FROM parsed WHERE block <> '' GROUP BY project, bug_num""", "traces", ctes=_SRC_TRACES + ",\n" + _PARSE_SQL))
def trigger_counts(spark, sf_dir):
    """Total blocks and unique triggered tests per bug."""
    p = _parsed(spark, sf_dir).filter(F.col("block") != "")
    tn = F.col("test_name")
    return p.groupBy("project", "bug_num").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct(F.when(F.col("category") != "none", tn)).alias("unique_triggered"),
        F.count_distinct(F.when(F.col("category") == "exception", tn)).alias("exception_tests"),
        F.count_distinct(F.when(F.col("category") == "assertion", tn)).alias("assertion_tests"))


# Source tests: tests seen with a 'view', 'error' or 'signup' event. Buggy log =
# even event ids, fixed log = odd event ids.
_FLAGS_SQL = _SRC_TRACES + ",\n" + _PARSE_SQL + """,
tests AS (SELECT DISTINCT t.project, t.bug_num, t.test_name FROM traces t JOIN events e ON e.event_id = t.row_idx
          WHERE e.event_type IN ('view', 'error', 'signup')),
bl AS (SELECT project, bug_num, block_test_name AS test_name,
              bool_or(category = 'exception') AS bug_exception_triggered,
              bool_or(category = 'assertion') AS bug_assertion_triggered,
              arg_max(block, row_idx) AS buggy_test_trace
       FROM parsed WHERE row_idx % 2 = 0 GROUP BY ALL),
fl AS (SELECT project, bug_num, block_test_name AS test_name,
              bool_or(category = 'exception') AS fixed_exception_triggered,
              bool_or(category = 'assertion') AS fixed_assertion_triggered
       FROM parsed WHERE row_idx % 2 = 1 GROUP BY ALL),
flags AS (
  SELECT t.project, t.bug_num, t.test_name,
         coalesce(b.bug_exception_triggered, false) AS bug_exception_triggered,
         coalesce(b.bug_assertion_triggered, false) AS bug_assertion_triggered,
         coalesce(b.buggy_test_trace, '') AS buggy_test_trace,
         coalesce(f.fixed_exception_triggered, false) AS fixed_exception_triggered,
         coalesce(f.fixed_assertion_triggered, false) AS fixed_assertion_triggered
  FROM tests t LEFT JOIN bl b ON t.project = b.project AND t.bug_num = b.bug_num AND t.test_name = b.test_name
  LEFT JOIN fl f ON t.project = f.project AND t.bug_num = f.bug_num AND t.test_name = f.test_name),
labelled AS (
  SELECT *, bug_exception_triggered OR bug_assertion_triggered AS failed_buggy,
         fixed_exception_triggered OR fixed_assertion_triggered AS failed_fixed FROM flags)"""


def _tests_and_logs(spark, sf_dir):
    t = V.traces(spark, sf_dir)
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_idx"), "event_type")
    tests = (t.join(ev, "row_idx").filter(F.col("event_type").isin("view", "error", "signup"))
             .select("project", "bug_num", "test_name").distinct())
    blocks = _parsed(spark, sf_dir).withColumnRenamed("row_idx", "block_pos")
    buggy = blocks.filter(F.col("block_pos") % 2 == 0)
    fixed = blocks.filter(F.col("block_pos") % 2 == 1)
    return tests, buggy, fixed


@register("outcome_flags", with_views("""
SELECT *, failed_buggy AND NOT failed_fixed AS TP, failed_buggy AND failed_fixed AS FP,
       NOT failed_buggy AND NOT failed_fixed AS TN, NOT failed_buggy AND failed_fixed AS FN FROM labelled""",
                                      "traces", ctes=_FLAGS_SQL))
def outcome_flags(spark, sf_dir):
    """Per source test, triggered flags of both logs, buggy trace, TP/FP/TN/FN."""
    tests, buggy, fixed = _tests_and_logs(spark, sf_dir)
    return TR.outcome_flags(tests, buggy, fixed)


@register("flag_consistency", with_views("""
SELECT 'failed_equals_exception_or_assertion' AS check_name,
       CAST(count_if(failed_buggy <> (bug_exception_triggered OR bug_assertion_triggered)
             OR failed_fixed <> (fixed_exception_triggered OR fixed_assertion_triggered)) AS BIGINT) AS violations,
       count(*) AS checked
FROM labelled""", "traces", ctes=_FLAGS_SQL))
def flag_consistency(spark, sf_dir):
    """V3: failed flag = exception OR assertion for both versions (violations must be 0)."""
    tests, buggy, fixed = _tests_and_logs(spark, sf_dir)
    flags = TR.outcome_flags(tests, buggy, fixed)
    bad_b = F.col("failed_buggy") != (F.col("bug_exception_triggered") | F.col("bug_assertion_triggered"))
    bad_f = F.col("failed_fixed") != (F.col("fixed_exception_triggered") | F.col("fixed_assertion_triggered"))
    return flags.agg(F.lit("failed_equals_exception_or_assertion").alias("check_name"),
                     F.count_if(bad_b | bad_f).alias("violations"), F.count(F.lit(1)).alias("checked"))


@register("unmatched_triggers", with_views("""
SELECT DISTINCT p.project, p.bug_num, p.block_test_name AS test_name FROM parsed p
WHERE p.category <> 'none' AND p.row_idx % 2 = 0
  AND NOT EXISTS (SELECT 1 FROM tests t WHERE t.project = p.project AND t.bug_num = p.bug_num
                  AND t.test_name = p.block_test_name)""", "traces", ctes=_FLAGS_SQL))
def unmatched_triggers(spark, sf_dir):
    """Triggered tests of the buggy log with no source test."""
    tests, buggy, _ = _tests_and_logs(spark, sf_dir)
    trig = buggy.filter(F.col("category") != "none").select("project", "bug_num", "test_name").distinct()
    return trig.join(tests, ["project", "bug_num", "test_name"], "left_anti")


# ---- ranking features over the failed-tests view -----------------------------

_FEAT_SQL = f"""
src AS (SELECT row_idx, project, bug_num, buggy_test_trace AS block, focal_method, docstring, test_prefix,
               except_pred, assert_pred FROM failed),
{_PARSE_SQL.strip()},
f0 AS (
  SELECT *, CASE WHEN starts_with(trace_exception, 'java.') THEN 'java'
                 WHEN contains(replace(trace_exception, '.', ''), lower(project)) THEN 'project'
                 WHEN starts_with(trace_exception, 'org.evosuite') THEN 'evosuite'
                 WHEN trace_exception_name = 'AssertionFailedError' THEN 'assert' ELSE 'other' END AS trace_exception_type,
         contains(focal_method, trace_exception_name) AS in_focal,
         contains(docstring, trace_exception_name) AS in_doc,
         regexp_extract(split_part(focal_method, '{{', 1), '([\\w$]+)\\s*\\([^()]*\\)\\s*(?:throws[\\w.,\\s]*)?$', 1)
           AS focal_name
  FROM parsed),
f1 AS (SELECT *, trace_exception_type = 'assert' OR in_focal OR in_doc AS not_rare_e FROM f0),
feat AS (
  SELECT *,
    count(*) OVER (PARTITION BY project, bug_num, trace_exception) AS trace_exception_count,
    count(*) OVER (PARTITION BY project, bug_num, trace_desc) AS trace_desc_count,
    count(*) OVER (PARTITION BY project, bug_num, focal_name) AS focal_name_count,
    CASE WHEN not_rare_e THEN CAST(0 AS BIGINT)
         ELSE CAST(count_if(NOT not_rare_e) OVER (PARTITION BY project, bug_num, trace_exception_name) AS BIGINT) END
      AS rare_exception_count,
    CAST(count_if(NOT not_rare_e) OVER (PARTITION BY project, bug_num, focal_method, trace_exception_name) AS BIGINT)
      AS focal_rare_e_count,
    trim(assert_pred, {_WS}) <> '' AS assert_flag,
    CAST(except_pred AS BOOLEAN) AS except_flag,
    regexp_matches(test_prefix, 'catch\\s*\\(\\s*(?:final\\s+)?([\\w.$|\\s]+?)\\s+\\w+\\s*\\)') AS test_prefix_exception
  FROM f1)"""


def _features(spark, sf_dir, names, keep=()):
    # every count and text feature reads the rows again: build them once, compressed
    return FT.add_features(written(V.failed(spark, sf_dir), "failed"), names, keep)


@register("value_counts", with_views("""
SELECT row_idx, trace_exception_count, trace_desc_count, focal_name_count FROM feat""", "failed", ctes=_FEAT_SQL))
def value_counts(spark, sf_dir):
    """Same exception / description / focal name counts inside the bug."""
    return _features(spark, sf_dir, ["trace_exception_count", "trace_desc_count", "focal_name_count"]).select(
        "row_idx", "trace_exception_count", "trace_desc_count", "focal_name_count")


@register("rare_counts", with_views("""
SELECT row_idx, trace_exception_type, in_focal AS trace_exception_in_focal, in_doc AS trace_exception_in_doc,
       not_rare_e, rare_exception_count FROM feat""", "failed", ctes=_FEAT_SQL))
def rare_counts(spark, sf_dir):
    """Exception origin, name-in-text flags, rare-exception count."""
    keep = ["trace_exception_type", "trace_exception_in_focal", "trace_exception_in_doc"]
    return _features(spark, sf_dir, ["not_rare_e", "rare_exception_count"], keep).select(
        "row_idx", "trace_exception_type", "trace_exception_in_focal", "trace_exception_in_doc",
        "not_rare_e", "rare_exception_count")


@register("focal_rare_counts", with_views("""
SELECT row_idx, focal_rare_e_count FROM feat""", "failed", ctes=_FEAT_SQL))
def focal_rare_counts(spark, sf_dir):
    """Rare-exception count per (focal method, exception name), looked up for all rows."""
    return _features(spark, sf_dir, ["focal_rare_e_count"]).select("row_idx", "focal_rare_e_count")


_TABLE_SQL = _FEAT_SQL + f""",
base AS (SELECT row_idx, project, bug_num, focal_method, docstring, test_prefix, generated_test FROM failed),
{TFIDF_SQL.strip()},
body AS (
  SELECT row_idx, project, bug_num, CASE WHEN len(ls) > 3 THEN list_distinct(ls[3:len(ls) - 1]) ELSE [] END AS b FROM (
    SELECT row_idx, project, bug_num,
           list_filter(list_transform(string_split(trim(generated_test, {_WS}), chr(10)), lambda x: trim(x, {_WS})), lambda x: x <> '')
             AS ls FROM failed)),
ex AS (SELECT row_idx, project, bug_num, unnest(b) AS line FROM body),
u AS (SELECT row_idx, CAST(count(*) AS INTEGER) AS k
      FROM (SELECT project, bug_num, line, min(row_idx) AS row_idx FROM ex GROUP BY ALL HAVING count(*) = 1) GROUP BY row_idx)"""


@register("feature_table", with_views("""
SELECT f.row_idx, f.project, f.bug_num, focal_name_count, coalesce(u.k, 0) AS distinct_line, except_flag AS except_pred,
       NOT assert_flag AND NOT except_flag AS no_except_pred, assert_flag AS assert_pred,
       test_prefix_exception, trace_exception_count, trace_desc_count, not_rare_e,
       rare_exception_count, focal_rare_e_count, coalesce(s.sim, 0.0) AS test_doc_sim
FROM feat f LEFT JOIN u USING (row_idx) LEFT JOIN sims s USING (row_idx)""", "failed", ctes=_TABLE_SQL))
def feature_table(spark, sf_dir):
    """The ranking feature table, all eleven features."""
    df = _features(spark, sf_dir, FT.FEATURE_NAMES)
    return df.select("row_idx", "project", "bug_num", "assert_pred", *FT.FEATURE_NAMES)
