"""The result chain, the prediction table, renamed tests, all methods of a file, scaffolding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outcomes as O
from ..operators import render as RD
from ..operators import methods as MT
from ..operators import results as RS
from ..sources import views as V
from ..sources.tables import table
from ..sources.views import with_views
from .code_queries import _RENDER_SQL
from .registry import register

_CLEAN = r"trim(regexp_replace(test, '\s+', ' ', 'g'))"


@register("prediction_table", with_views(rf"""
SELECT s.idx AS idxs, s.truth AS true_lbl, s.pred AS pred_lbl, s.l0 AS logit_0, s.l1 AS logit_1,
       CASE WHEN regexp_extract(t.test, '^public void (test[0-9]*)\(\)', 1) <> ''
            THEN regexp_extract(t.test, '^public void (test[0-9]*)\(\)', 1) ELSE 'test-name-placeholder' END AS test_name,
       concat(s.kind, '(x', CAST(s.row_idx AS VARCHAR), ')') AS pred_assertion, s.truncation, md5(t.test) AS test_md5, md5(t.fms) AS fms_md5
FROM scores s JOIN (SELECT row_idx, CASE WHEN row_idx % 3 = 0 THEN {_CLEAN} ELSE regexp_replace({_CLEAN}, '^@Test\([^)]*\) ', '') END AS test,
                           trim(regexp_replace(focal_method, '\s+', ' ', 'g')) AS fms FROM code) t ON t.row_idx = s.idx""", "scores", "code"))
def prediction_table(spark, sf_dir):
    """M9 / M8: the assertion classifier's output, one row per candidate with texts and truncation."""
    from ..functions.columns import clean_ws
    c = V.code(spark, sf_dir)
    cleaned = c.select(F.col("row_idx").alias("_t"), clean_ws("test").alias("test"), clean_ws("focal_method").alias("fms"))
    cleaned = cleaned.withColumn("test", F.when(F.col("_t") % 3 == 0, F.col("test")).otherwise(
        F.regexp_replace("test", r"^@Test\([^)]*\) ", "")))
    s = V.scores(spark, sf_dir).withColumn("assertion", F.concat("kind", F.lit("(x"), F.col("row_idx").cast("string"), F.lit(")")))
    out = RS.prediction_table(s.join(cleaned, F.col("idx") == F.col("_t")), "idx", "truth", "pred", "l0", "l1", "test", "fms",
                              "assertion", "truncation")
    return out.select("*", F.md5("test").alias("test_md5"), F.md5("fms").alias("fms_md5")).drop("test", "fms")


@register("renamed_tests", with_views(r"""
SELECT row_idx, replace(substr(file, 1, length(file) - 5), '/', '.') || '::' || name || CAST(n AS VARCHAR) AS unique_test_name,
       md5(a || name || CAST(n AS VARCHAR) || z) AS renamed_md5
FROM (SELECT *, row_number() OVER (PARTITION BY project, bug_num, file, name ORDER BY row_idx) AS n FROM (
  SELECT c.row_idx, s.project, s.bug_num, 'pkg/C' || CAST(c.row_idx % 9 AS VARCHAR) || '_ESTest.java' AS file,
         regexp_extract(test, '(?s)^(\s*@Test.*public void )(\w+)(\(\).+)', 1) AS a,
         regexp_extract(test, '(?s)^(\s*@Test.*public void )(\w+)(\(\).+)', 2) AS name,
         regexp_extract(test, '(?s)^(\s*@Test.*public void )(\w+)(\(\).+)', 3) AS z
  FROM (SELECT row_idx, CASE WHEN row_idx % 10 = 7 THEN replace(test, 'public void ', 'public int ') ELSE test END AS test FROM code) c
  JOIN cases s ON s.row_idx = c.row_idx) WHERE name <> '')""", "code", "cases"))
def renamed_tests(spark, sf_dir):
    """Unique names by (bug, file, name) in numeric id order, the renamed body; tests whose header does not fit are left out."""
    c = V.code(spark, sf_dir).withColumn("test", F.when(F.col("row_idx") % 10 == 7, F.replace(
        F.col("test"), F.lit("public void "), F.lit("public int "))).otherwise(F.col("test")))
    c = c.join(V.cases(spark, sf_dir, flags=False).select("row_idx", "project", "bug_num"), "row_idx")
    c = c.withColumn("file", F.concat(F.lit("pkg/C"), (F.col("row_idx") % 9).cast("string"), F.lit("_ESTest.java")))
    c = c.withColumn("test_id", F.col("row_idx").cast("string"))
    return RS.rename_tests(c, "file", "test", "test_id").select("row_idx", "unique_test_name", F.md5("renamed_test").alias("renamed_md5"))


_CHAIN_SQL = _RENDER_SQL.strip() + """,
inputs AS (SELECT c.row_idx, c.project, c.bug_num, r.learned,
                  concat(c.test_name, '_', CAST(row_number() OVER (PARTITION BY project, bug_num, test_name ORDER BY c.row_idx) AS VARCHAR)) AS name
           FROM cases c JOIN r6 r ON r.row_idx = c.row_idx),
results AS (SELECT i.project, i.bug_num, i.name, l.quality = 0 AS failed_buggy, l.toxic = 1 AS failed_fixed
            FROM inputs i JOIN labels l ON l.doc_id = i.row_idx
            UNION ALL SELECT 'bench', item_id, 'extra', false, length(text) % 2 = 0 FROM benchmark),
joined AS (SELECT coalesce(i.project, r.project) AS project, coalesce(i.bug_num, r.bug_num) AS bug_num, coalesce(i.name, r.name) AS name,
                  i.row_idx, coalesce(i.learned, '') AS generated_test, r.failed_buggy, r.failed_fixed
           FROM inputs i FULL OUTER JOIN results r ON i.project = r.project AND i.bug_num = r.bug_num AND i.name = r.name),
full_t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, bug_num, generated_test ORDER BY row_idx NULLS LAST) AS rn
           FROM joined) WHERE rn = 1)"""


def _full(spark, sf_dir):
    cases = V.cases(spark, sf_dir, flags=False).select("row_idx", "project", "bug_num", "test_name")
    code = V.code(spark, sf_dir).select(F.col("row_idx").alias("_c"), F.col("test").alias("test_prefix"))
    named = O.unique_test_names(cases.withColumns({"_f": F.lit(""), "test_name": F.concat("test_name", F.lit("_"))}), "_f", "test_name", "row_idx")
    named = named.select("row_idx", "project", "bug_num", "unique_test_name")
    r = F.col("row_idx")
    inputs = named.join(code, r == F.col("_c")).select(
        "project", "bug_num", "unique_test_name", "row_idx", "test_prefix", (r % 3 == 0).cast("int").alias("except_pred"),
        F.when(r % 3 == 1, F.lit("assertTrue(s1.isEmpty())")).otherwise(F.lit("")).alias("assert_pred"))
    lab = table(spark, sf_dir, "labels")
    results = named.join(lab, r == F.col("doc_id")).select(
        "project", "bug_num", "unique_test_name", (F.col("quality") == 0).alias("failed_buggy"), (F.col("toxic") == 1).alias("failed_fixed"))
    extra = table(spark, sf_dir, "benchmark").select(
        F.lit("bench").alias("project"), F.col("item_id").alias("bug_num"), F.lit("extra").alias("unique_test_name"),
        F.lit(False).alias("failed_buggy"), (F.length("text") % 2 == 0).alias("failed_fixed"))
    return RS.full_test_data(inputs, results.unionByName(extra), ["project", "bug_num", "unique_test_name"], "row_idx")


@register("full_test_data", with_views("""
SELECT project, bug_num, name AS unique_test_name, row_idx, md5(generated_test) AS test_md5, failed_buggy, failed_fixed FROM full_t""",
                                       "code", "cases", ctes=_CHAIN_SQL))
def full_test_data(spark, sf_dir):
    """J1 / J3 / P14 / U5 / V2 as one chain: names, inputs and predictions, validated outer join with the results,
    rendering ('' for results without an input), keep-first dedup."""
    return _full(spark, sf_dir).select("project", "bug_num", "unique_test_name", "row_idx", F.md5("generated_test").alias("test_md5"),
                                       "failed_buggy", "failed_fixed")


@register("failed_test_data", with_views("""
SELECT project, bug_num, name AS unique_test_name, row_idx, md5(generated_test) AS test_md5, failed_fixed FROM full_t WHERE failed_buggy""",
                                         "code", "cases", ctes=_CHAIN_SQL))
def failed_test_data(spark, sf_dir):
    """P25 / V1 at the end of the chain: tests that fail on the buggy version; a null in one is an error."""
    return RS.failed_test_data(_full(spark, sf_dir)).select(
        "project", "bug_num", "unique_test_name", "row_idx", F.md5("generated_test").alias("test_md5"), "failed_fixed")


# A class file around the sentences of a document: a member each, in forms that a scan has to tell apart.
# {C}: class, {N}: name; the number picks the form.
_MEMBERS = [
    "  public {C}(int n) {\n    init(\"}\"); // }\n  }",
    "  /** Says {N}. { */\n  protected static String {N}(String s) {\n    if (s != null) {\n      call(s);\n    }\n  }",
    "  public void {N}() {\n    // @Test and @Test\n  }",
    "  /* } { */ @Deprecated(since = \"}\")\n  public\n  Map<String, List<int[]>> {N}(\n      @Named(\"{\") String s, char c)\n      throws IOException {\n    char a = '{', b = '\\'', d = '\\u007d';\n"
    "    return of(\"\\\\\", \"\\\"}\"); /* }\n    } */ }",
    "  abstract void {N}(int n);\n  int[] {N}_a = { 1, 2 };\n  Runnable {N}_r = new Runnable() { public void run() { } };",
    "  static class {N} {\n    void inner() { }\n  }\n  static { init(); }",
    "  void {N}() { for (;;) { break; } }",
]


_FILES_SQL = r"""
files AS (
  SELECT id, cls, '// class x {' || chr(10) || 'public class ' || cls || ' {' || chr(10) || array_to_string(list_transform(names, lambda x, i:
    replace(replace(CASE WHEN i = 1 THEN FORM0 ELSE CASE (i - 2) % 6 WHEN 0 THEN FORM1 WHEN 1 THEN FORM2 WHEN 2 THEN FORM3
                                                                    WHEN 3 THEN FORM4 WHEN 4 THEN FORM5 ELSE FORM6 END END,
                    '{N}', x), '{C}', cls)), chr(10)) || chr(10) || '}' || chr(10) || 'class Other { void late() { } }' AS body
  FROM (SELECT doc_id AS id, 'C' || CAST(doc_id % 9 AS VARCHAR) AS cls,
               list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '[.\n]+'),
                                          lambda x: array_to_string(regexp_extract_all(x, '[a-z]+'), '_')), lambda x: x <> '') AS names
        FROM documents)),"""
for _i, _m in enumerate(_MEMBERS):
    _FILES_SQL = _FILES_SQL.replace(f"FORM{_i}", "'" + _m.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")


def source_files(spark, sf_dir):
    """(row_idx, cls, body): the class file of each document."""
    d = table(spark, sf_dir, "documents").select("doc_id", V.sentence_names(F.col("text")).alias("names"))
    cls = F.concat(F.lit("C"), (F.col("doc_id") % 9).cast("string"))

    def member(x, i):
        form = F.when(i == 0, F.lit(_MEMBERS[0]))
        for k, m in enumerate(_MEMBERS[1:]):
            form = form.when((i - 1) % 6 == k, F.lit(m))
        return F.replace(F.replace(form, F.lit("{N}"), x), F.lit("{C}"), cls)

    body = F.concat(F.lit("// class x {\npublic class "), cls, F.lit(" {\n"), F.array_join(F.transform("names", member), "\n"),
                    F.lit("\n}\nclass Other { void late() { } }"))
    return d.select(F.col("doc_id").alias("row_idx"), cls.alias("cls"), body.alias("body"))


@register("file_methods", "WITH " + _FILES_SQL.strip() + MT.scan_sql("files") + r"""
SELECT id AS row_idx, CASE WHEN name = cls THEN 0 ELSE 1 END AS kind_order, name, CAST(s AS BIGINT) AS start_line, CAST(e AS BIGINT) AS end_line,
       md5(t) AS method_md5, md5(doc) AS doc_md5
FROM found WHERE len(string_split(t, '@Test')) <= 2""")
def file_methods(spark, sf_dir):
    """Every constructor and method of a file's first type with its text; those with more than one @Test are left out."""
    out = MT.file_methods(source_files(spark, sf_dir), "row_idx", "body")
    return out.select("row_idx", "kind_order", "name", "start_line", "end_line", F.md5("method_text").alias("method_md5"),
                      F.md5("docstring").alias("doc_md5"))


# A scaffolding template with the placeholders of the real one; callers pass their own file's text.
_SCAFFOLD = "package {TEST_PACKAGE};\n\npublic class {TEST_CLASS}_scaffolding {\n  String name = \"{TEST_CLASS}\";\n  String[] support = { {SUPPORT_CLASSES} };\n}\n"


@register("render_scaffolding", with_views(r"""
SELECT row_idx, md5('package ' || package || ';' || chr(10) || chr(10) || 'public class ' || class_name || '_scaffolding {' || chr(10)
                    || '  String name = "' || class_name || '";' || chr(10) || '  String[] support = { '
                    || array_to_string(list_transform(list_sort(list_distinct(imports)), lambda i: '"' || replace(i, 'import ', '') || '"'), ', ')
                    || ' };' || chr(10) || '}' || chr(10)) AS scaffolding_md5
FROM (SELECT *, list_filter(string_split(split_part(file_text, '@RunWith', 1), chr(10)),
                            lambda x: starts_with(x, 'import') AND x <> 'import org.junit.Test;') AS imports FROM test_files)""", "test_files"))
def render_scaffolding(spark, sf_dir):
    """The scaffolding class of a test, its template given by the caller."""
    f = V.test_files(spark, sf_dir)
    extra = RD.extra_imports(F.array_distinct(RD.import_lines("file_text")))
    r = f.select("row_idx", "package", "class_name", extra.alias("extra"))
    text = RD.fill(_SCAFFOLD, {"{TEST_PACKAGE}": F.col("package"), "{TEST_CLASS}": F.col("class_name"),
                               "{SUPPORT_CLASSES}": RD.support_classes("extra")})
    return r.select("row_idx", F.md5(text).alias("scaffolding_md5"))
