"""Per-test table queries over ``cases``: running ids, unique names, dedup,
one-to-one outer join, positional join, line features, splits and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.positions import group_positions
from ..operators import lines as L
from ..operators import outcomes as O
from ..sources import views as V
from ..sources.tables import table
from ..sources.views import with_views
from .registry import register


@register("running_id", with_views("""
SELECT row_idx, project, bug_num, row_number() OVER (PARTITION BY project, bug_num ORDER BY row_idx) - 1 AS test_id
FROM cases""", "cases"))
def running_id(spark, sf_dir):
    """0-based running test id per bug in input order (skew-safe positions)."""
    c = V.cases(spark, sf_dir, flags=False).select("row_idx", "project", "bug_num")
    return group_positions(c, ["project", "bug_num"], ["row_idx"], pos_col="test_id")


_FILE_SQL = "concat('pkg/', focal_method, '_ESTest.java')"


@register("unique_name", with_views(f"""
SELECT row_idx, project, bug_num,
       concat(replace(substr({_FILE_SQL}, 1, length({_FILE_SQL}) - 5), '/', '.'), '::', test_name,
              CAST(row_number() OVER (PARTITION BY project, bug_num, {_FILE_SQL}, test_name ORDER BY row_idx) AS VARCHAR))
         AS unique_test_name
FROM cases""", "cases"))
def unique_name(spark, sf_dir):
    """Name + 1-based running count per (bug, test file, name), in test-id order."""
    c = V.cases(spark, sf_dir, flags=False).withColumn("test_file", F.concat(F.lit("pkg/"), "focal_method", F.lit("_ESTest.java")))
    return O.unique_test_names(c, "test_file", "test_name", "row_idx").select(
        "row_idx", "project", "bug_num", "unique_test_name")


@register("dedup_keep_first", with_views("""
SELECT row_idx, project, bug_num, test_name FROM (
  SELECT *, row_number() OVER (PARTITION BY project, bug_num, generated_test ORDER BY row_idx) AS rn FROM cases)
WHERE rn = 1""", "cases"))
def dedup_keep_first(spark, sf_dir):
    """One row per (project, bug, generated test), the first in row order."""
    c = V.cases(spark, sf_dir, flags=False).select("row_idx", "project", "bug_num", "test_name", "generated_test")
    return O.dedup_keep_first(c, ["project", "bug_num", "generated_test"], "row_idx").select(
        "row_idx", "project", "bug_num", "test_name")


@register("uniqueness", with_views("""
SELECT project, bug_num, md5(generated_test) AS key_md5, count(*) AS n_rows FROM cases
GROUP BY project, bug_num, focal_method, generated_test HAVING count(*) > 1""", "cases"))
def uniqueness(spark, sf_dir):
    """Keys (project, bug, focal method, generated test) held by more than one row."""
    c = V.cases(spark, sf_dir)
    dup = O.duplicate_keys(c, ["project", "bug_num", "focal_method", "generated_test"])
    return dup.select("project", "bug_num", F.md5("generated_test").alias("key_md5"), "n_rows")


_NAMES_SQL = f"""
names AS (
  SELECT row_idx, project, bug_num,
         concat(test_name, CAST(row_number() OVER (PARTITION BY project, bug_num, test_name ORDER BY row_idx) AS VARCHAR))
           AS unique_test_name FROM cases),
results AS (
  SELECT project, bug_num,
         concat(test_name, CAST(row_number() OVER (PARTITION BY project, bug_num, test_name ORDER BY row_idx) AS VARCHAR))
           AS unique_test_name, failed_buggy, failed_fixed
  FROM cases WHERE failed_buggy IS NOT NULL)"""


def _names_and_results(spark, sf_dir):
    c = V.cases(spark, sf_dir)
    names = O.unique_test_names(c.withColumn("_f", F.lit("")), "_f", "test_name", "row_idx").select(
        "row_idx", "project", "bug_num", "unique_test_name")
    lab = c.filter(F.col("failed_buggy").isNotNull())
    results = O.unique_test_names(lab.withColumn("_f", F.lit("")), "_f", "test_name", "row_idx").select(
        "project", "bug_num", "unique_test_name", "failed_buggy", "failed_fixed")
    return names, results


@register("outer_one_to_one", with_views("""
SELECT coalesce(n.project, r.project) AS project, coalesce(n.bug_num, r.bug_num) AS bug_num,
       coalesce(n.unique_test_name, r.unique_test_name) AS unique_test_name, n.row_idx,
       r.failed_buggy, r.failed_fixed
FROM names n FULL OUTER JOIN results r
  ON n.project = r.project AND n.bug_num = r.bug_num AND n.unique_test_name = r.unique_test_name""",
                                         "cases", ctes=_NAMES_SQL))
def outer_one_to_one(spark, sf_dir):
    """J3 (+ V2 pre-check): full outer join of test names and results, validated one-to-one."""
    names, results = _names_and_results(spark, sf_dir)
    return O.outer_one_to_one(names, results, ["project", "bug_num", "unique_test_name"])


@register("positional_join", """
SELECT coalesce(d.doc_id, l.doc_id) AS row_idx, d.source AS project, l.quality, l.toxic
FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id""")
def positional_join(spark, sf_dir):
    """Rows aligned by explicit row index; padding (full outer) form."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), F.col("source").alias("project"))
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_idx"), "quality", "toxic")
    return O.positional_join(d, lab, "row_idx", pad=True)


@register("test_limit", with_views("""
SELECT row_idx, project, bug_num FROM cases ORDER BY project, bug_num, row_idx LIMIT 32""", "cases"))
def test_limit(spark, sf_dir):
    """The first 32 tasks in key order (the test-mode limit is the feature)."""
    return (V.cases(spark, sf_dir, flags=False).select("row_idx", "project", "bug_num")
            .orderBy("project", "bug_num", "row_idx").limit(32))


_WS = "' ' || chr(9) || chr(10) || chr(13)"


@register("distinct_lines", with_views("""
SELECT c.row_idx, c.project, c.bug_num, coalesce(u.k, 0) AS distinct_line FROM cases c LEFT JOIN u USING (row_idx)""",
                                       "cases", ctes=f"""
sets AS (
  SELECT row_idx, project, bug_num,
         list_filter(list_transform(string_split(trim(generated_test, {_WS}), chr(10)), lambda x: trim(x, {_WS})), lambda x: x <> '')
           AS ls FROM cases),
body AS (SELECT row_idx, project, bug_num,
                CASE WHEN len(ls) > 3 THEN list_distinct(ls[3:len(ls) - 1]) ELSE [] END AS b FROM sets),
ex AS (SELECT row_idx, project, bug_num, unnest(b) AS line FROM body),
cnt AS (SELECT project, bug_num, line, count(*) AS n FROM ex GROUP BY ALL),
u AS (SELECT e.row_idx, CAST(count(*) AS INTEGER) AS k FROM ex e JOIN cnt c USING (project, bug_num, line)
      WHERE c.n = 1 GROUP BY e.row_idx)"""))
def distinct_lines(spark, sf_dir):
    """Lines of a test (minus first two and last) that no other test of the bug has."""
    c = V.cases(spark, sf_dir, flags=False).select("row_idx", "project", "bug_num", "generated_test")
    return L.distinct_line_counts(c, ["project", "bug_num"], "row_idx", "generated_test", "distinct_line").select(
        "row_idx", "project", "bug_num", "distinct_line")


_MARKER = "the"


@register("marker_split", with_views(f"""
SELECT row_idx, split_no, has_marker, len(string_split(split_test, chr(10))) AS n_lines,
       md5(split_test) AS split_md5
FROM (
  SELECT row_idx, has_marker, split_test, row_number() OVER (PARTITION BY row_idx ORDER BY ord) - 1 AS split_no FROM (
    SELECT row_idx, true AS has_marker, CAST(i AS BIGINT) AS ord,
           array_to_string(list_concat(list_filter(ls[1:i - 1], lambda x: NOT contains(x, '{_MARKER}')), [ls[i], '}}']),
                           chr(10)) AS split_test
    FROM (SELECT row_idx, ls, generate_subscripts(ls, 1) AS i FROM lines_t)
    WHERE contains(ls[i], '{_MARKER}')
    UNION ALL
    SELECT row_idx, false, CAST(1099511627776 AS BIGINT),
           array_to_string(list_filter(ls, lambda x: NOT contains(x, '{_MARKER}')), chr(10)) FROM lines_t))""",
                                     "cases", ctes=f"""
lines_t AS (SELECT row_idx, list_filter(string_split(generated_test, chr(10)), lambda x: trim(x, {_WS}) <> '') AS ls
            FROM cases)"""))
def marker_split(spark, sf_dir):
    """One split test per marker line plus the full marker-free test."""
    c = V.cases(spark, sf_dir, flags=False).select("row_idx", "generated_test")
    s = L.marker_split(c, "row_idx", "generated_test", _MARKER)
    return s.select("row_idx", "split_no", "has_marker", F.size(F.split("split_test", "\n", -1)).cast("long").alias("n_lines"),
                    F.md5("split_test").alias("split_md5"))


_SIGNATURE = "^[A-E]"

_REPAIR_SQL = """
lines_t AS (
  SELECT doc_id AS file, CAST(i - 1 AS BIGINT) AS line_idx, ls[i] AS line
  FROM (SELECT doc_id, ls, generate_subscripts(ls, 1) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
ends AS (SELECT file, coalesce(max(CASE WHEN trim(line) = '}' THEN line_idx END), max(line_idx) + 1) AS last_brace
         FROM lines_t GROUP BY file),
starts AS (SELECT file, line_idx - 1 AS start FROM lines_t WHERE regexp_matches(line, '^[A-E]')),
spans AS (SELECT s.file, s.start, coalesce(lead(s.start) OVER (PARTITION BY s.file ORDER BY s.start), e.last_brace) AS "end"
          FROM starts s JOIN ends e USING (file)),
errs AS (SELECT DISTINCT user_id AS file, CAST(floor(value) AS BIGINT) AS err_idx
         FROM events WHERE event_type = 'error'),
bad AS (SELECT DISTINCT s.file, s.start, s."end" FROM spans s JOIN errs e
        ON s.file = e.file AND e.err_idx >= s.start AND e.err_idx < s."end"),
hdr AS (SELECT e.file, coalesce(min(s.start), max(en.last_brace)) AS header_end
        FROM ends en JOIN (SELECT DISTINCT file FROM lines_t) e USING (file) LEFT JOIN spans s USING (file)
        GROUP BY e.file),
bad_hdr AS (SELECT DISTINCT er.file, er.err_idx AS line_idx FROM errs er JOIN hdr h USING (file)
            JOIN lines_t l ON l.file = er.file AND l.line_idx = er.err_idx
            WHERE er.err_idx < h.header_end AND starts_with(l.line, 'import')),
kept AS (SELECT l.* FROM lines_t l
         WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.file = l.file AND l.line_idx >= b.start AND l.line_idx < b."end")
           AND NOT EXISTS (SELECT 1 FROM bad_hdr h WHERE h.file = l.file AND h.line_idx = l.line_idx))"""


def _files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.coalesce("text", F.lit("")).alias("text"))


def _errors(spark, sf_dir):
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    return ev.select(F.col("user_id").alias("file"),
                     F.floor("value").cast("long").alias("err_idx")).distinct()


@register("spans", with_views("SELECT file, start, \"end\" FROM spans", ctes=_REPAIR_SQL))
def spans(spark, sf_dir):
    """Method spans from signature lines to the next start / last lone brace."""
    return L.method_spans(_files(spark, sf_dir), "file", "text", _SIGNATURE)


@register("range_anti_join", with_views("""
SELECT file, count(*) AS kept_lines, md5(string_agg(line, chr(10) ORDER BY line_idx)) AS kept_md5
FROM kept GROUP BY file""", ctes=_REPAIR_SQL))
def range_anti_join(spark, sf_dir):
    """Files after dropping every method span that holds a failing line."""
    kept = L.repair_files(_files(spark, sf_dir), _errors(spark, sf_dir), "file", "text", _SIGNATURE).filter(F.size("kept") > 0)
    return kept.select("file", F.size("kept").cast("long").alias("kept_lines"),
                       F.md5(F.array_join(F.transform("kept", lambda z: z["line"]), "\n")).alias("kept_md5"))


@register("quality_checks", with_views("""
SELECT 'no_nulls' AS "check", CAST(count_if(row_idx IS NULL OR project IS NULL OR bug_num IS NULL
                                       OR test_name IS NULL OR focal_method IS NULL OR generated_test IS NULL
                                       OR failed_buggy IS NULL OR failed_fixed IS NULL) AS BIGINT)
         AS violations FROM cases
UNION ALL
SELECT 'unique_key', count(*) FROM (SELECT project, bug_num, test_name, generated_test FROM cases
                                    GROUP BY ALL HAVING count(*) > 1)
UNION ALL
SELECT 'aligned', count(*) FROM (SELECT doc_id FROM documents) d FULL OUTER JOIN (SELECT doc_id FROM labels) l
                                ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""", "cases"))
def quality_checks(spark, sf_dir):
    """V1 / V2 / V4: nulls in the test table, duplicate keys, rows present on one side only."""
    from ..operators import checks as CK
    c = V.cases(spark, sf_dir, flags=False).withColumn("_l", F.lit(True))
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_id"), (F.col("quality") == 0).alias("failed_buggy"),
                                                (F.col("toxic") == 1).alias("failed_fixed"), F.lit(True).alias("_r"))
    both = c.join(lab, F.col("row_idx") == F.col("_id"), "full_outer")  # each table once, every check on its rows
    case = F.col("_l").isNotNull()
    columns = ["row_idx", "project", "bug_num", "test_name", "focal_method", "generated_test", "failed_buggy", "failed_fixed"]
    return CK.check_table(both, {"no_nulls": case & CK.any_null(columns), "aligned": F.col("_l").isNull() | F.col("_r").isNull()},
                          {"unique_key": ["project", "bug_num", "test_name", F.md5("generated_test")]}, case)


@register("failed_tests", with_views("""
SELECT row_idx, project, bug_num, test_name, failed_fixed FROM (
  SELECT *, row_number() OVER (PARTITION BY project, bug_num, generated_test ORDER BY row_idx) AS rn FROM cases)
WHERE rn = 1 AND failed_buggy""", "cases"))
def failed_tests(spark, sf_dir):
    """P25 after U5: the deduplicated tests that fail on the buggy version (null flags excluded)."""
    c = V.cases(spark, sf_dir).select("row_idx", "project", "bug_num", "test_name", "generated_test",
                                      "failed_buggy", "failed_fixed")
    d = O.dedup_keep_first(c, ["project", "bug_num", "generated_test"], "row_idx")
    return d.filter(F.col("failed_buggy")).select("row_idx", "project", "bug_num", "test_name", "failed_fixed")
