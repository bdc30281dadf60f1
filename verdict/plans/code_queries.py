"""Test-code text queries: cleaning, exception-oracle classification and model
inputs, assertion separation, header standardisation, rendering, reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import clean_ws, keep_non_null
from ..operators import code_text as CT
from ..sources import views as V
from ..sources.tables import table
from ..sources.views import with_views
from .registry import register

_CLEAN = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


@register("clean_text", f"""
SELECT doc_id, md5({_CLEAN.format(c="text")}) AS clean_md5, length({_CLEAN.format(c="text")}) AS clean_len
FROM documents""")
def clean_text(spark, sf_dir):
    """Every whitespace run to one space, then strip (whole texts)."""
    d = table(spark, sf_dir, "documents").select("doc_id", clean_ws("text").alias("c"))
    return d.select("doc_id", F.md5("c").alias("clean_md5"), F.length("c").cast("long").alias("clean_len"))


@register("exception_kind", with_views(f"""
SELECT row_idx, kind, CASE WHEN kind = 'none' THEN 0 ELSE 1 END AS label FROM (
  SELECT row_idx, CASE WHEN contains(t, 'assertThrows') THEN 'assertThrows'
                       WHEN regexp_matches(t, '^@Test.*(expected\\s*=.*Exception.class)') THEN 'expected'
                       WHEN contains(t, 'assertThatThrownBy') THEN 'assertThatThrownBy'
                       WHEN regexp_matches(t, 'fail\\(.*\\).*}}\\s*catch') THEN 'fail_catch'
                       WHEN contains(t, 'isThrownBy') THEN 'isThrownBy' ELSE 'none' END AS kind
  FROM (SELECT row_idx, {_CLEAN.format(c="test")} AS t FROM code))""", "code"))
def exception_kind(spark, sf_dir):
    """Expected-exception classification, first matching rule wins."""
    c = V.code(spark, sf_dir)
    k = CT.exception_kind("test")
    return c.select("row_idx", k.alias("kind"), F.when(k == "none", 0).otherwise(1).alias("label"))


_RFIND = "CASE WHEN strpos({s}, '{c}') = 0 THEN 0 ELSE length({s}) - strpos(reverse({s}), '{c}') + 1 END"


def _rfind3(s: str) -> str:
    return "greatest(" + ", ".join(_RFIND.format(s=s, c=c) for c in (";", "{", "}")) + ")"


_EXC_SQL = r"""
e0 AS (SELECT row_idx, focal_method, trim(regexp_replace(test, '\s+', ' ', 'g')) AS t FROM code),
e1 AS (SELECT *, CASE WHEN contains(t, 'assertThrows') THEN 'assertThrows'
                      WHEN regexp_matches(t, '^@Test.*(expected\s*=.*Exception.class)') THEN 'expected'
                      WHEN contains(t, 'assertThatThrownBy') THEN 'assertThatThrownBy'
                      WHEN regexp_matches(t, 'fail\(.*\).*}\s*catch') THEN 'fail_catch'
                      WHEN contains(t, 'isThrownBy') THEN 'isThrownBy' ELSE 'none' END AS kind,
              regexp_extract(t, 'assert[a-zA-z]*\(.*\);') AS am FROM e0),
b1 AS (SELECT row_idx, part, unnest(string_split(part, '')) AS ch, generate_subscripts(string_split(part, ''), 1) AS i
       FROM (SELECT row_idx, split_part(t, kind, 2) AS part FROM e1 WHERE kind IN ('assertThatThrownBy', 'isThrownBy'))),
b2 AS (SELECT *, sum(CASE ch WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY row_idx ORDER BY i) AS d FROM b1),
b3 AS (SELECT row_idx, split_part(substr(any_value(part), 1, min(i) FILTER (ch = ')' AND d = 0) - 1), '->', 2) AS inside
       FROM b2 GROUP BY row_idx),
e2 AS (SELECT *, CASE WHEN am <> '' THEN substr(t, 1, strpos(t, am) - 1) ELSE '' END AS before FROM e1),
e3 AS (SELECT *, CASE WHEN am <> '' THEN substr(t, 1, RF_BEFORE) || substr(t, strpos(t, am) + length(am)) ELSE t END AS cut
       FROM e2),
e4 AS (SELECT *, regexp_replace(trim(cut), '[;} ]+$', '') AS stripped FROM e3),
e5 AS (SELECT *, substr(cut, RF_STRIPPED + 1) AS last_stmt, RF_STRIPPED AS st FROM e4),
e6 AS (SELECT *, CASE WHEN strpos(last_stmt, '=') = 0 THEN cut
                      ELSE substr(cut, 1, st) || substr(last_stmt, strpos(last_stmt, '=') + 1) END AS negative FROM e5),
e7 AS (SELECT *, CASE kind
         WHEN 'assertThrows' THEN CASE WHEN regexp_matches(split_part(t, 'assertThrows', 2), '^.*\(\s*\)\s*->\s*(.*)\s*\)')
              THEN split_part(t, 'assertThrows', 1)
              || regexp_extract(split_part(t, 'assertThrows', 2), '^.*\(\s*\)\s*->\s*(.*)\s*\)', 1) || '; }' || chr(10) END
         WHEN 'expected' THEN replace(t, regexp_extract(t, '^@Test.*(expected\s*=.*Exception.class)', 1), '')
         WHEN 'assertThatThrownBy' THEN split_part(t, kind, 1) || inside || '; }' || chr(10)
         WHEN 'isThrownBy' THEN split_part(t, kind, 1) || inside || '; }' || chr(10)
         WHEN 'fail_catch' THEN CASE WHEN regexp_matches(t, '(?s)try\s*\{(.*;) fail\(.*\)\s*;\s*\}\s*catch') THEN
              substr(t, 1, strpos(t, regexp_extract(t, '(?s)try\s*\{(.*;) fail\(.*\)\s*;\s*\}\s*catch', 0)) - 1)
              || trim(regexp_extract(t, '(?s)try\s*\{(.*;) fail\(.*\)\s*;\s*\}\s*catch', 1), ' ' || chr(9) || chr(10) || chr(13))
              || ' }' || chr(10) END
         ELSE negative END AS norm FROM e6 LEFT JOIN b3 USING (row_idx)),
e8 AS (SELECT *, trim(regexp_replace(array_to_string(list_filter(string_split(replace(norm, '// Undeclared exception! ', ''),
                                                                              ';'), lambda x: x <> ''), ';'),
                                     '\s+', ' ', 'g')) AS pruned,
              regexp_extract(split_part(trim(regexp_replace(focal_method, '\s+', ' ', 'g')), '{', 1),
                             '(?s)^.*\s+([\w\d$]+)\(.*\)\s*(throws.*)?$', 1) AS fm FROM e7),
e9 AS (SELECT *, CASE WHEN fm <> '' AND strpos(pruned, '{') > 0
                      THEN 'public void test' || upper(substr(fm, 1, 1)) || substr(fm, 2) || '() {' || substr(pruned, strpos(pruned, '{') + 1)
                 END AS model_test FROM e8)""".replace("RF_BEFORE", _rfind3("before")).replace(
    "RF_STRIPPED", _rfind3("stripped"))


@register("exception_inputs", with_views(r"""
SELECT row_idx, kind, CASE WHEN kind = 'none' THEN 0 ELSE 1 END AS label,
       CASE WHEN kind = 'none' AND regexp_matches(norm, '^@Test (public )?void \S*\(.*\)\s*\{\s*}') THEN 'empty_test'
            WHEN kind = 'none' AND contains(t, 'verifyException') THEN 'error'
            WHEN norm IS NULL OR model_test IS NULL THEN 'error' END AS reason,
       kind = 'none' AND regexp_matches(t, '[eE]xception') AS missed,
       md5(model_test) AS model_md5, CAST(length(model_test) AS INTEGER) AS model_len
FROM e9""", "code", ctes=_EXC_SQL))
def exception_inputs(spark, sf_dir):
    """P3a-P3e / P4 / P5 / P6 / P21: exception-model inputs (label, normalised and
    standardised test) with the drop reason of rejected rows."""
    c = V.code(spark, sf_dir)
    out = CT.exception_inputs(c, "test", "focal_method")
    return out.select("row_idx", "kind", "label", "reason", "missed", F.md5("model_test").alias("model_md5"),
                      F.length("model_test").alias("model_len"))


@register("reason_counts", with_views(r"""
SELECT 'exception_inputs' AS stage, r AS reason, count(*) AS n FROM (
SELECT unnest([reason, CASE WHEN missed THEN 'missed' END]) AS r FROM (
  SELECT coalesce(CASE WHEN kind = 'none' AND regexp_matches(norm, '^@Test (public )?void \S*\(.*\)\s*\{\s*}') THEN 'empty_test'
                       WHEN kind = 'none' AND contains(t, 'verifyException') THEN 'error'
                       WHEN norm IS NULL OR model_test IS NULL THEN 'error' END, 'kept') AS reason,
         kind = 'none' AND regexp_matches(t, '[eE]xception') AS missed FROM e9))
WHERE r IS NOT NULL GROUP BY r""", "code", ctes=_EXC_SQL))
def reason_counts(spark, sf_dir):
    """Rows kept and dropped per stage and reason; negative tests that speak of an exception."""
    out = CT.exception_inputs(V.code(spark, sf_dir), "test", "focal_method")
    # counted before a row becomes two: a filter on the exploded rows would run every step again
    n = out.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason"), "missed").agg(F.count(F.lit(1)).alias("n"))
    reasons = F.array_compact(F.array(F.struct("reason", "n"), F.when(F.col("missed"), F.struct(F.lit("missed").alias("reason"), "n"))))
    return n.select(F.inline(reasons)).groupBy(F.lit("exception_inputs").alias("stage"), "reason").agg(F.sum("n").alias("n"))


@register("prune_pieces", with_views("""
SELECT row_idx, md5(array_to_string(list_filter(string_split(test, ';'), lambda x: x <> ''), ';')) AS pruned_md5,
       len(list_filter(string_split(test, ';'), lambda x: x <> '')) AS n_pieces FROM code""", "code"))
def prune_pieces(spark, sf_dir):
    """P5: split on ';', drop empty pieces, join again."""
    c = V.code(spark, sf_dir)
    p = CT.prune_pieces("test")
    return c.select("row_idx", F.md5(p).alias("pruned_md5"),
                    F.size(F.filter(F.split("test", ";", -1), lambda x: x != "")).cast("long").alias("n_pieces"))


@register("standardise_header", with_views(f"""
SELECT row_idx, CASE WHEN name <> '' AND strpos(t, '{{') > 0 THEN
         concat('public void test', upper(substr(name, 1, 1)), substr(name, 2), '() {{', substr(t, strpos(t, '{{') + 1))
       END AS header
FROM (SELECT row_idx, {_CLEAN.format(c="test")} AS t,
             regexp_extract(split_part({_CLEAN.format(c="focal_method")}, '{{', 1),
                            '(?s)^.*\\s+([\\w\\d$]+)\\(.*\\)\\s*(throws.*)?$', 1) AS name FROM code)""", "code"))
def standardise_header(spark, sf_dir):
    """P6: 'public void test' + focal name + '() {' + body after the first '{'."""
    c = V.code(spark, sf_dir)
    return c.select("row_idx", CT.standardize_header(clean_ws("test"), "focal_method").alias("header"))


@register("assertion_split", with_views("""
SELECT row_idx, substr(test, 1, strpos(test, regexp_extract(test, 'assert\\w*\\(.*\\)')) - 1)
         || '"<AssertPlaceHolder>" ; ' || chr(10) || ' }' AS prefix,
       regexp_extract(test, 'assert\\w*\\(.*\\)') AS assertion
FROM code WHERE regexp_matches(test, 'assert\\w*\\(.*\\)')""", "code"))
def assertion_split(spark, sf_dir):
    """Prefix up to the first assertion (+ placeholder) and the assertion; tests
    without an assertion are dropped."""
    c = V.code(spark, sf_dir)
    prefix, assertion = CT.separate_assertion("test")
    return c.select("row_idx", prefix.alias("prefix"), assertion.alias("assertion")).filter(
        F.col("assertion").isNotNull())


_LIT_SQL = r"""
l0 AS (SELECT row_idx, regexp_extract(test, 'assert\w*\(.*\)') AS a0 FROM code
       WHERE regexp_matches(test, 'assert\w*\(.*\)')),
l1 AS (SELECT row_idx, regexp_replace(regexp_replace(a0, '^assertEquals\(\((-\d+)\)(.*)', 'assertEquals(\1\2'),
                                      '^assertEquals\(([-]?[0-9]+)L(,.*)', 'assertEquals(\1\2') AS a1 FROM l0),
l2 AS (SELECT row_idx, CASE WHEN regexp_matches(a1, '^assertEquals\(true, (.*)\)')
                            THEN regexp_replace(a1, '^assertEquals\(true, (.*)\)', 'assertTrue(\1)')
                            WHEN regexp_matches(a1, '^assertEquals\(false, (.*)\)')
                            THEN regexp_replace(a1, '^assertEquals\(false, (.*)\)', 'assertFalse(\1)')
                            ELSE a1 END AS assertion FROM l1),
l3 AS (SELECT *, string_split(regexp_extract(assertion, 'assert\w*\s*\((.*)\)', 1), ',') AS args FROM l2),
l4 AS (SELECT *, trim(args[1]) AS s FROM l3),
l5 AS (SELECT *, CASE WHEN starts_with(s, '(') AND ends_with(s, ')') AND length(s) >= 2
                      THEN substr(s, 2, length(s) - 2) ELSE s END AS u FROM l4),
l6 AS (SELECT *, CASE WHEN ends_with(u, 'L') THEN substr(u, 1, length(u) - 1) ELSE u END AS ib,
              CASE WHEN ends_with(u, 'F') OR ends_with(u, 'D') THEN substr(u, 1, length(u) - 1) ELSE u END AS fb,
              trim(s, ' ' || chr(9) || chr(10) || chr(13)) AS st FROM l5)"""


@register("literal_type", with_views(r"""
SELECT row_idx, assertion, CAST(len(args) AS INTEGER) AS n_args,
       CASE WHEN regexp_matches(ib, '^\s*[-+]?\d+(_\d+)*\s*$') THEN 'int'
            WHEN regexp_matches(fb, '^\s*[-+]?((\d+(_\d+)*)?\.?\d+(_\d+)*([eE][-+]?\d+)?|\d+\.|(?i:inf|infinity|nan))\s*$')
            THEN 'float'
            WHEN substr(st, 1, 1) IN ('"', chr(39)) AND substr(st, length(st), 1) IN ('"', chr(39)) THEN 'String' END
         AS first_arg_type
FROM l6""", "code", ctes=_LIT_SQL))
def literal_type(spark, sf_dir):
    """Normalised assertion, its arguments, and the literal type of the first."""
    c = V.code(spark, sf_dir)
    _, assertion = CT.separate_assertion("test")
    a = c.select("row_idx", assertion.alias("_a0")).filter(F.col("_a0").isNotNull())
    a = a.withColumn("assertion", CT.normalize_assertion("_a0")).drop("_a0")
    args = F.split(F.regexp_extract("assertion", r"assert\w*\s*\((.*)\)", 1), ",")
    return a.select("row_idx", "assertion", F.size(args).alias("n_args"),
                    CT.literal_kind(F.trim(F.get(args, 0))).alias("first_arg_type"))


_RENDER_SQL = r"""
r0 AS (SELECT row_idx, test, CASE WHEN row_idx % 3 = 0 THEN 1 ELSE 0 END AS except_pred,
              CASE WHEN row_idx % 3 = 1 THEN 'assertTrue(s1.isEmpty())' ELSE '' END AS assert_pred FROM code),
r1 AS (SELECT *, CASE WHEN NOT contains(substr(test, 1, strpos(test, '{') - 1), 'throws ')
                      THEN substr(test, 1, strpos(test, '{') - 1) || ' throws Exception ' || substr(test, strpos(test, '{'))
                      ELSE test END AS t0 FROM r0),
r2 AS (SELECT *, replace(t0, '// Undeclared exception!', '') AS t FROM r1),
r3 AS (SELECT *, regexp_extract(t, '(?s)try\s*\{(.*;).*fail\(.*\)\s*;\s*\}\s*catch', 0) AS tc_m,
              regexp_extract(t, '(?s)try\s*\{(.*;).*fail\(.*\)\s*;\s*\}\s*catch', 1) AS tc_g,
              regexp_extract(t, 'assert\w*\s*\((.*)\)', 0) AS as_m FROM r2),
r4 AS (SELECT *, '@Test' || chr(10) ||
              CASE WHEN tc_m <> '' THEN substr(t, 1, strpos(t, tc_m) - 1) || ' ' || trim(tc_g, ' ' || chr(9) || chr(10) || chr(13))
                   WHEN as_m <> '' THEN substr(t, 1, strpos(t, as_m) - 1)
                   ELSE substr(t, 1, CASE WHEN strpos(t, '}') > 0 THEN length(t) - strpos(reverse(t), '}') ELSE length(t) - 1 END)
              END AS prefix FROM r3),
r5 AS (SELECT *,
         CASE WHEN contains(test, 'assertEquals') AND (contains(assert_pred, 'assertTrue') OR contains(assert_pred, 'assertFalse'))
              THEN 'assertEquals(' || CASE WHEN contains(assert_pred, 'assertTrue') THEN 'true' ELSE 'false' END || ', '
                   || substr(trim(assert_pred), strpos(trim(assert_pred), '(') + 1,
                             length(trim(assert_pred)) - strpos(reverse(trim(assert_pred)), ')') + 1 - strpos(trim(assert_pred), '(') - 1) || ')'
              ELSE assert_pred END AS assertion FROM r4),
r6 AS (SELECT row_idx,
         CASE WHEN except_pred = 1
              THEN substr(prefix, 1, strpos(prefix, '{') - 1) || '{' || chr(10) || chr(9) || 'try ' || substr(prefix, strpos(prefix, '{'))
                   || chr(10) || chr(9) || chr(9) || 'fail("Expecting exception"); } catch (Exception e) { }' || chr(10) || chr(9) || '}'
              WHEN assert_pred <> ''
              THEN trim(prefix, ' ' || chr(9) || chr(10) || chr(13)) || chr(10) || '      ' || assertion || ';' || chr(10) || '}'
              ELSE prefix || chr(10) || '    }' END AS learned,
         prefix || chr(10) || '    }' AS naive FROM r5)"""


@register("render_test", with_views("""
SELECT row_idx, md5(learned) AS learned_md5, CAST(length(learned) AS INTEGER) AS learned_len, md5(naive) AS naive_md5
FROM r6""", "code", ctes=_RENDER_SQL))
def render_test(spark, sf_dir):
    """Learned and naive renderings of each test prefix with its
    predicted oracle (exception -> try/fail/catch, assertion appended, else closed)."""
    c = V.code(spark, sf_dir)
    ex = (F.col("row_idx") % 3 == 0).cast("int")
    ap = F.when(F.col("row_idx") % 3 == 1, F.lit("assertTrue(s1.isEmpty())")).otherwise(F.lit(""))
    r = c.select("row_idx", "test", ex.alias("except_pred"), ap.alias("assert_pred"))
    learned = CT.render_test("test", "except_pred", "assert_pred", "learned")
    naive = CT.render_test("test", "except_pred", "assert_pred", "naive")
    r = r.withColumns({"_learned": learned, "_naive": naive})
    return r.select("row_idx", F.md5("_learned").alias("learned_md5"), F.length("_learned").alias("learned_len"),
                    F.md5("_naive").alias("naive_md5"))


_MSG_SQL = r"""
msgs AS (
  SELECT event_id,
         CASE event_type
           WHEN 'error' THEN concat('/w/gen/x/y/pkg/C', CAST(user_id % 9 AS VARCHAR), '_ESTest.java:',
                                    CAST(CAST(floor(value) AS BIGINT) % 50 + 1 AS VARCHAR), ': error: cannot find symbol',
                                    chr(10), chr(10), '  symbol: x')
           WHEN 'click' THEN concat('/w/gen/x/y/pkg/C', CAST(user_id % 9 AS VARCHAR), '_ESTest.java:3: warning: unchecked')
           ELSE concat('compiling C', CAST(user_id % 9 AS VARCHAR), '_ESTest.java failed') END AS error_msg
  FROM events),
ls AS (SELECT event_id, unnest(regexp_split_to_array(error_msg, '\n+')) AS l FROM msgs)"""


@register("compile_errors", with_views(r"""
SELECT event_id,
       CASE WHEN regexp_matches(l, '^.*?(\S*_ESTest\.java):(\d+):\s+error:.*')
            THEN array_to_string(string_split(regexp_extract(l, '^.*?(\S*_ESTest\.java):(\d+):\s+error:.*', 1), '/')[5:], '/')
       END AS file,
       CASE WHEN regexp_matches(l, '^.*?(\S*_ESTest\.java):(\d+):\s+error:.*')
            THEN CAST(regexp_extract(l, '^.*?(\S*_ESTest\.java):(\d+):\s+error:.*', 2) AS INTEGER) END AS line_no,
       CASE WHEN regexp_matches(l, '^.*?(\S*_ESTest\.java):(\d+):\s+error:.*') THEN 'error'
            WHEN regexp_matches(l, '^.*?(\S*_ESTest\.java):(\d+):\s+warning:.*') THEN 'warning'
            ELSE 'unparsed' END AS status
FROM ls WHERE contains(l, '_ESTest.java')""", ctes=_MSG_SQL))
def compile_errors(spark, sf_dir):
    """(file, line) of compiler error lines; warnings ignored, the rest unparsed."""
    from ..operators import lines as L
    ev = table(spark, sf_dir, "events")
    k = (F.col("user_id") % 9).cast("string")
    msg = (F.when(F.col("event_type") == "error",
                  F.concat(F.lit("/w/gen/x/y/pkg/C"), k, F.lit("_ESTest.java:"),
                           (F.floor("value").cast("long") % 50 + 1).cast("string"),
                           F.lit(": error: cannot find symbol\n\n  symbol: x")))
           .when(F.col("event_type") == "click",
                 F.concat(F.lit("/w/gen/x/y/pkg/C"), k, F.lit("_ESTest.java:3: warning: unchecked")))
           .otherwise(F.concat(F.lit("compiling C"), k, F.lit("_ESTest.java failed"))))
    return L.compile_error_lines(ev.select("event_id", msg.alias("error_msg")), ["event_id"], "error_msg")


_ET_SQL = _LIT_SQL.split(",\nl3 AS")[0] + r""",
e1 AS (SELECT l2.row_idx, l2.assertion, c.focal_method,
              string_split(substr(assertion, strpos(assertion, '(') + 1,
                                  (length(assertion) - strpos(reverse(assertion), ')') + 1) - strpos(assertion, '(') - 1),
                           ',') AS args
       FROM l2 JOIN code c ON c.row_idx = l2.row_idx),
e2 AS (SELECT *, len(args) AS n,
              CASE WHEN len(args) = 1 THEN trim(args[1], ' ' || chr(9) || chr(10) || chr(13)) ELSE args[1] END AS s,
              CASE WHEN len(args) = 1 THEN trim(args[1], ' ' || chr(9) || chr(10) || chr(13))
                   WHEN len(args) = 2 THEN trim(args[2], ' ' || chr(9) || chr(10) || chr(13)) ELSE args[2] END AS v,
              regexp_replace(split_part(trim(regexp_replace(focal_method, '\s+', ' ', 'g')), '{', 1),
                             '^\s*(?:(?:public|protected|private|static|final|synchronized|abstract|native)\s+)*', '')
                AS head FROM e1),
e3 AS (SELECT *, CASE WHEN starts_with(s, '(') AND ends_with(s, ')') AND length(s) >= 2
                      THEN substr(s, 2, length(s) - 2) ELSE s END AS u,
              regexp_extract(head, '^(?:<[^>]*>\s+)?([\w.$<>\[\]]+)\s+[\w$]+\s*\(', 1) AS ret,
              regexp_extract(head, '^([\w$]+)\s*\(', 1) AS ctor FROM e2),
e4 AS (SELECT *, CASE WHEN ends_with(u, 'L') THEN substr(u, 1, length(u) - 1) ELSE u END AS ib,
              CASE WHEN ends_with(u, 'F') OR ends_with(u, 'D') THEN substr(u, 1, length(u) - 1) ELSE u END AS fb,
              trim(s, ' ' || chr(9) || chr(10) || chr(13)) AS st FROM e3),
e5 AS (SELECT *, CASE WHEN regexp_matches(ib, '^\s*[-+]?\d+(_\d+)*\s*$') THEN 'int'
                      WHEN regexp_matches(fb, '^\s*[-+]?((\d+(_\d+)*)?\.?\d+(_\d+)*([eE][-+]?\d+)?|\d+\.|(?i:inf|infinity|nan))\s*$')
                      THEN 'float'
                      WHEN substr(st, 1, 1) IN ('"', chr(39)) AND substr(st, length(st), 1) IN ('"', chr(39))
                      THEN 'String' END AS lit FROM e4),
e6 AS (SELECT row_idx, assertion,
              CASE WHEN (regexp_matches(v, '^\w+$') OR regexp_matches(v, '^\w+\.\w+\(\)$'))
                        AND split_part(assertion, '(', 1) IN ('assertTrue', 'assertFalse', 'assertEquals', 'assertNotNull',
                                                             'assertNull')
                   THEN CASE WHEN starts_with(assertion, 'assertTrue') OR starts_with(assertion, 'assertFalse') THEN 'boolean'
                             WHEN lit IS NOT NULL THEN lit
                             WHEN ret <> '' THEN ret WHEN ctor <> '' THEN ctor END END AS expected_type
       FROM e5)"""


@register("expected_type", with_views("SELECT * FROM e6 WHERE expected_type IS NOT NULL", "code", ctes=_ET_SQL))
def expected_type(spark, sf_dir):
    """Expected type of each test's first assertion (rows without one are dropped)."""
    c = V.code(spark, sf_dir)
    _, assertion = CT.separate_assertion("test")
    # one column per step, so no step's regex is repeated inside the next expression
    a = c.select("row_idx", "focal_method", assertion.alias("_a0")).filter(F.col("_a0").isNotNull())
    a = a.withColumn("assertion", CT.normalize_assertion("_a0")).drop("_a0")
    out = CT.with_expected_type(a, "assertion", "focal_method").select("row_idx", "assertion", "expected_type")
    return keep_non_null(out, "expected_type")
