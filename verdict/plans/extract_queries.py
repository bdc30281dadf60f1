"""Extraction-side queries: test-name filter and labels, names from code, method
spans by brace depth, import lines, template rendering, import checks, failed
runs, pending tasks and name collisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FT
from ..operators import methods as MT
from ..operators import outcomes as O
from ..operators import render as RD
from ..sources import views as V
from ..sources.files import pending_tasks as pending
from ..sources.tables import table
from ..sources.views import with_views
from .registry import register

_WS = "' ' || chr(9) || chr(10) || chr(13)"

# Test-method name pattern and the exception-label pattern of the extractor.
_TEST_NAME_RE = r"public void (test[0-9]*)\(\)"
_LABEL_FAIL_RE = r"(?s)fail\(.*\).*}\s*catch"
_FIRST_ASSERT_RE = r"assert\w*\(.*\)"


@register("extraction_labels", with_views(r"""
SELECT row_idx, regexp_extract(test, 'public void (test[0-9]*)\(\)', 1) AS test_name,
       regexp_matches(test, '(?s)fail\(.*\).*}\s*catch') AS exception_lbl,
       regexp_extract(test, 'assert\w*\(.*\)') AS assertion_lbl,
       -1 AS exception_bug, -1 AS assertion_bug, '' AS assert_err
FROM code
WHERE regexp_matches(test, 'public void (test[0-9]*)\(\)')
  AND len(string_split(test, '@Test')) - 1 <= 1""", "code"))
def extraction_labels(spark, sf_dir):
    """Test methods named test<N>() with one @Test, their exception label
    (fail ... catch present) and first assertion; bug columns fixed at -1."""
    c = V.code(spark, sf_dir)
    n_tests = F.size(F.split("test", "@Test", -1)) - 1
    kept = c.filter(F.col("test").rlike(_TEST_NAME_RE) & (n_tests <= 1))
    return kept.select("row_idx", F.regexp_extract("test", _TEST_NAME_RE, 1).alias("test_name"),
                       F.col("test").rlike(_LABEL_FAIL_RE).alias("exception_lbl"),
                       F.regexp_extract("test", _FIRST_ASSERT_RE, 0).alias("assertion_lbl"),
                       F.lit(-1).alias("exception_bug"), F.lit(-1).alias("assertion_bug"),
                       F.lit("").alias("assert_err"))


# Names that are not focal-method candidates.
_NOT_FOCAL = ["fail", "verifyException"]
_KEYWORDS = ["if", "for", "while", "switch", "catch", "synchronized", "return", "new"]
_CALL_RE = r"(?<![@\w.])([@\w.]+)\s*\("  # tried at the start of a name only: linear in long names


def _invoked(test):
    found = F.regexp_extract_all(test, F.lit(_CALL_RE), 1)
    names = F.transform(F.filter(found, lambda x: ~x.startswith("@")), lambda x: F.substring_index(x, ".", -1))
    keep = F.filter(names, lambda x: ~x.isin(*_NOT_FOCAL, *_KEYWORDS) & ~F.contains(x, F.lit("assert"))
                    & ~x.rlike(r"^test[0-9]*$") & (x != ""))
    return F.reverse(keep)


@register("names_from_code", with_views(r"""
SELECT row_idx,
  regexp_extract(split_part(focal_method, '{', 1), '([\w$]+)\s*\([^()]*\)\s*(?:throws[\w.,\s]*)?$', 1) AS focal_name,
  array_to_string(list_sort(list_distinct(list_transform(
      regexp_extract_all(test, 'catch\s*\(\s*(?:final\s+)?([\w.$|\s]+?)\s+\w+\s*\)', 1),
      lambda s: regexp_extract(trim(s), '([^.]*)$', 1)))), ',') AS catch_names,
  array_to_string(list_reverse(list_filter(
      list_transform(list_filter(regexp_extract_all(test, '([@\w.]+)\s*\(', 1), lambda x: NOT starts_with(x, '@')),
                     lambda x: regexp_extract(x, '([^.]*)$', 1)),
      lambda x: x NOT IN ('fail', 'verifyException', 'if', 'for', 'while', 'switch', 'catch', 'synchronized',
                          'return', 'new')
                AND NOT contains(x, 'assert') AND NOT regexp_matches(x, '^test[0-9]*$') AND x <> '')), ',')
    AS invoked_names
FROM code""", "code"))
def names_from_code(spark, sf_dir):
    """Focal method name, catch-clause exception names, invoked names last-first
    (re-aimed from a syntax tree to text patterns)."""
    c = V.code(spark, sf_dir)
    catch = FT._catch_names(F.col("test"))
    return c.select("row_idx", FT.method_name("focal_method").alias("focal_name"),
                    F.array_join(F.array_sort(catch), ",").alias("catch_names"),
                    F.array_join(_invoked(F.col("test")), ",").alias("invoked_names"))


@register("method_spans", with_views("""
SELECT id AS row_idx, CAST(arg_min(s, i) AS BIGINT) AS start_line, CAST(arg_min(e, i) AS BIGINT) AS end_line FROM found GROUP BY id""",
                                     "code", ctes="tests_ AS (SELECT row_idx AS id, test AS body FROM code)," + MT.scan_sql("tests_", in_type=False)))
def method_spans(spark, sf_dir):
    """First and last line of the test method of a text, by the lexical scan."""
    c = V.code(spark, sf_dir).select("row_idx", "test")
    return MT.methods_of(c, "row_idx", "test", in_type=False).filter("member = 0").select("row_idx", "start_line", "end_line")


_IMPORTS_SQL = r"""
lines_t AS (SELECT row_idx, project, package, class_name, test,
                   list_transform(string_split(file_text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))) AS ls
            FROM test_files),
imp AS (SELECT *, list_filter(CASE WHEN list_position(list_transform(ls, lambda x: starts_with(x, '@RunWith')), true) > 0
                                   THEN ls[1:list_position(list_transform(ls, lambda x: starts_with(x, '@RunWith')), true) - 1]
                                   ELSE ls END, lambda x: starts_with(x, 'import')) AS imports FROM lines_t)"""


@register("import_lines", with_views("""
SELECT row_idx, len(imports) AS n_imports, array_to_string(imports, '|') AS imports FROM imp""",
                                     "test_files", ctes=_IMPORTS_SQL))
def import_lines(spark, sf_dir):
    """Import lines of a test file up to the @RunWith line."""
    f = V.test_files(spark, sf_dir).select("row_idx", RD.import_lines("file_text").alias("imports"))
    return f.select("row_idx", F.size("imports").cast("long").alias("n_imports"), F.array_join("imports", "|").alias("imports"))


def _harness_sql() -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in RD.template_imports()) + "]"


def _template_sql() -> str:
    return "'" + RD.ESTEST_TEMPLATE.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@register("render_template", with_views(f"""
SELECT row_idx, md5(replace(replace(replace(replace({_template_sql()}, '{{TEST_PACKAGE}}', package),
                   '{{TEST_IMPORTS}}', array_to_string(extra, chr(10))), '{{TEST_CLASS_NAME}}', class_name),
                   '{{TEST_CASES}}', test)) AS rendered_md5,
       array_to_string(list_transform(extra, lambda i: '"' || replace(i, 'import ', '') || '"'), ', ') AS support_classes,
       array_to_string(extra, '|') AS extra_imports
FROM (SELECT *, list_sort(list_filter(list_distinct(imports), lambda i: NOT list_contains({_harness_sql()}, i))) AS extra
      FROM imp)""", "test_files", ctes=_IMPORTS_SQL))
def render_template(spark, sf_dir):
    """Test-class template filled with package, extra imports (file
    imports minus template imports), class name and test case; scaffolding list."""
    f = V.test_files(spark, sf_dir)
    extra = RD.extra_imports(F.array_distinct(RD.import_lines("file_text")))
    r = f.select("row_idx", "package", "class_name", "test", extra.alias("extra"))
    rendered = RD.render_template(F.col("package"), F.col("extra"), F.col("class_name"), F.col("test"))
    return r.select("row_idx", F.md5(rendered).alias("rendered_md5"),
                    RD.support_classes("extra").alias("support_classes"),
                    F.array_join("extra", "|").alias("extra_imports"))


@register("import_consistency", with_views("""
SELECT project, count(*) AS members,
       count(DISTINCT array_to_string(list_sort(list_distinct(imports)), chr(10))) = 1 AS same_imports
FROM imp GROUP BY project""", "test_files", ctes=_IMPORTS_SQL))
def import_consistency(spark, sf_dir):
    """U4: do all tests aggregated into one file share the same import set?"""
    f = V.test_files(spark, sf_dir).withColumn("imports", RD.import_lines("file_text"))
    return RD.import_consistency(f, ["project"], "imports")


_RUNS_SQL = """
runs AS (
  SELECT concat('/w/gen/proj', CAST(user_id % 10 AS VARCHAR), '/learned/', CAST(user_id % 7 AS VARCHAR)) AS gen_dir,
         concat('run ', event_type, CASE WHEN event_type = 'error' THEN ' FAILED' ELSE '' END) AS stdout,
         CASE WHEN event_type = 'purchase' THEN concat('pkg/C', CAST(event_id % 9 AS VARCHAR), '_ESTest.java:3: error: x FAILED')
              ELSE '' END AS stderr,
         value > 450 AS timed_out, event_id
  FROM events)"""


@register("failed_runs", with_views("""
SELECT event_id, split_part(gen_dir, '/', -3) AS project, split_part(gen_dir, '/', -2) AS method,
       split_part(gen_dir, '/', -1) AS bug_id,
       CASE WHEN timed_out THEN NULL ELSE stderr END AS error_msg
FROM runs
WHERE timed_out OR contains(stdout, 'FAILED') OR contains(stderr, 'FAILED')""", ctes=_RUNS_SQL))
def failed_runs(spark, sf_dir):
    """Runs that failed ('FAILED' in stdout or stderr) or timed out -> (project,
    method, bug_id, error message; none for a time-out)."""
    ev = table(spark, sf_dir, "events")
    runs = ev.select(
        "event_id",
        F.concat(F.lit("/w/gen/proj"), (F.col("user_id") % 10).cast("string"), F.lit("/learned/"),
                 (F.col("user_id") % 7).cast("string")).alias("gen_dir"),
        F.concat(F.lit("run "), "event_type", F.when(F.col("event_type") == "error", " FAILED").otherwise(""))
        .alias("stdout"),
        F.when(F.col("event_type") == "purchase",
               F.concat(F.lit("pkg/C"), (F.col("event_id") % 9).cast("string"), F.lit("_ESTest.java:3: error: x FAILED")))
        .otherwise("").alias("stderr"),
        (F.col("value") > 450).alias("timed_out"))
    failed = F.contains("stdout", F.lit("FAILED")) | F.contains("stderr", F.lit("FAILED"))
    keep = runs.filter(F.col("timed_out") | failed)
    parts = F.split("gen_dir", "/")
    return keep.select("event_id", F.element_at(parts, -3).alias("project"), F.element_at(parts, -2).alias("method"),
                       F.element_at(parts, -1).alias("bug_id"),
                       F.when(F.col("timed_out"), F.lit(None).cast("string")).otherwise(F.col("stderr"))
                       .alias("error_msg"))


@register("pending_tasks", with_views("""
SELECT t.project, t.bug_num, CASE WHEN f.project IS NULL THEN 'pending' ELSE 'skip' END AS status
FROM (SELECT DISTINCT project, bug_num FROM traces) t
LEFT JOIN (SELECT DISTINCT t.project, t.bug_num FROM traces t JOIN events e ON e.event_id = t.row_idx
           WHERE e.event_type = 'signup' AND e.value > 250) f
  ON t.project = f.project AND t.bug_num = f.bug_num""", "traces"))
def pending_tasks(spark, sf_dir):
    """Tasks whose output already exists are skipped; the rest are pending (anti join)."""
    t = V.traces(spark, sf_dir)
    tasks = t.select("project", "bug_num").distinct()
    ev = table(spark, sf_dir, "events").filter((F.col("event_type") == "signup") & (F.col("value") > 250))
    done = t.join(ev.select(F.col("event_id").alias("row_idx")), "row_idx").select("project", "bug_num").distinct()
    todo = pending(tasks, done, ["project", "bug_num"]).withColumn("status", F.lit("pending"))
    skip = tasks.join(done, ["project", "bug_num"], "left_semi").withColumn("status", F.lit("skip"))
    return todo.unionByName(skip)


@register("name_collisions", with_views("""
SELECT project, bug_num, unique_test_name, count(*) AS n_rows FROM (
  SELECT project, bug_num,
         concat(test_name, CAST(row_number() OVER (PARTITION BY project, bug_num, test_name ORDER BY row_idx) AS VARCHAR))
           AS unique_test_name FROM cases)
GROUP BY ALL HAVING count(*) > 1""", "cases"))
def name_collisions(spark, sf_dir):
    """Unique names that collide (name + counter without a separator)."""
    c = V.cases(spark, sf_dir, flags=False).withColumn("_f", F.lit(""))
    names = O.unique_test_names(c, "_f", "test_name", "row_idx")
    return O.duplicate_keys(names, ["project", "bug_num", "unique_test_name"])
