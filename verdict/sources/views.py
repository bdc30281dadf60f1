"""Pipeline-shaped views over the driver tables.

The reference pipeline reads per-run CSV files (outcome tables, trigger logs,
scored candidates, prefix/assertion pairs). The driver ships TPC-H-like
tables instead, so each pipeline table is a deterministic projection of one of
them. Every view is a pure DataFrame plan: Catalyst prunes the unused columns
and pushes later filters into the parquet scan.

``VIEW_SQL`` holds the same definitions as SQL text for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# Scale applied to the first two embedding elements so that the
# logits span the range of the confidence thresholds of the candidate gate.
LOGIT_SCALE = 40.0


def _s(c: Column) -> Column:
    return c.cast("string")


def cases(spark: SparkSession, sf_dir: str, flags: bool = True) -> DataFrame:
    """One generated test per document; with ``flags``, the nullable outcomes from ``labels``
    (Catalyst cannot drop an outer join on a key it does not know to be unique)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    out = [
        F.col("doc_id").alias("row_idx"),
        F.col("source").alias("project"),
        (F.floor(F.col("doc_id") / 20) % 5).alias("bug_num"),
        F.concat(F.lit("test"), _s(F.col("doc_id") % 3)).alias("test_name"),
        F.col("lang").alias("focal_method"),
        F.col("text").alias("generated_test"),
    ]
    if not flags:
        return d.select(*out)
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return d.join(lab, "doc_id", "left").select(
        *out, (F.col("quality") == 0).alias("failed_buggy"), (F.col("toxic") == 1).alias("failed_fixed"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trigger-log block per event: test name line, exception line, frame."""
    return table(spark, sf_dir, "events").select(*_trace_columns())


def _trace_columns() -> list[Column]:
    """The columns of ``traces``, made of an event's id, user and type."""
    test = F.concat(F.lit("pkg.C"), _s(F.col("user_id") % 9), F.lit("::t"), _s(F.col("event_id") % 400))
    exc = (F.when(F.col("event_type") == "error", "java.lang.IllegalStateException")
           .when(F.col("event_type") == "click", "org.evosuite.runtime.mock.java.io.MockIOException")
           .when(F.col("event_type") == "view", "junit.framework.AssertionFailedError")
           .when(F.col("event_type") == "purchase", "org.proj1.CartException")
           .otherwise("lib.Other"))
    desc = F.when(F.col("event_id") % 4 == 0, F.lit("")).otherwise(
        F.concat(F.lit(": k"), _s(F.col("event_id") % 5)))
    return [
        F.col("event_id").alias("row_idx"),
        F.concat(F.lit("proj"), _s(F.col("user_id") % 10)).alias("project"),
        (F.col("user_id") % 7).alias("bug_num"),
        test.alias("test_name"),
        F.concat(F.lit("--- "), test, F.lit("\n"), exc, desc, F.lit("\n  at x")).alias("trace"),
    ]


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled test outcomes of every (system, run); one row per line item."""
    li = table(spark, sf_dir, "lineitem")
    disc, tax = F.col("l_discount"), F.col("l_tax")
    return li.select(
        F.col("l_linenumber").alias("run"),
        F.when(F.col("l_returnflag") == "A", "naive").otherwise("learned").alias("system"),
        F.col("l_suppkey").alias("project"),
        (F.col("l_partkey") % 10).alias("bug_num"),
        F.col("l_orderkey").alias("row_idx"),
        F.col("l_linenumber").alias("line_no"),
        ((disc > 0.08) & (tax < 0.05)).alias("tp"),
        ((disc > 0.08) & (tax >= 0.05)).alias("fp"),
        ((disc <= 0.08) & (tax < 0.05)).alias("tn"),
        ((disc <= 0.08) & (tax >= 0.05)).alias("fn"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user turn, following assistant turn) text pairs."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    a = c.filter(F.col("role") == "user").alias("a")
    b = c.filter(F.col("role") == "assistant").alias("b")
    j = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    return j.select(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn"),
                    F.col("a.text").alias("text_a"), F.col("b.text").alias("text_b"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored assertion candidates: ``idx`` = test, ``pos`` = candidate slot."""
    emb = table(spark, sf_dir, "embeddings")
    e0 = F.col("embedding")[0].cast("double")
    e1 = F.col("embedding")[1].cast("double")
    e2 = F.col("embedding")[2].cast("double")
    kind = (F.when(F.col("label") % 4 == 0, "assertTrue").when(F.col("label") % 4 == 1, "assertFalse")
            .when(F.col("label") % 4 == 2, "assertNotNull").otherwise("assertEquals"))
    return emb.select(
        F.col("vec_id").alias("row_idx"),
        F.floor(F.col("vec_id") / 3).alias("idx"),
        (F.col("vec_id") % 3).alias("pos"),
        (e0 * LOGIT_SCALE).alias("l0"),
        (e1 * LOGIT_SCALE).alias("l1"),
        F.when(e1 > e0, 1).otherwise(0).alias("pred"),
        kind.alias("kind"),
        (F.col("label") % 2).alias("truth"),
        F.floor(F.abs(e2) * 500).cast("int").alias("truncation"),
    )


def failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed tests with trace, focal method, docstring, prefix, generated test and predictions
    (the input of the ranking features): a trigger block and the whole text of one document, the first
    half of its lines as docstring and the others as generated test."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # code and trace are made after the join, which moves a text once and three short columns of an event
    j = _with_code(d.join(events, F.col("doc_id") == F.col("event_id"))).select("text", "test", "focal_method", *_trace_columns())
    r = F.col("row_idx")
    throws = F.when(r % 3 == 0, " throws IllegalStateException {").otherwise(" {")
    doc = F.when(r % 5 == 0, " Throws CartException if empty").otherwise("")
    lines = F.split("text", "\n", -1)
    half = F.ceil(F.size(lines) / 2).cast("int")
    assert_pred = F.when(r % 3 == 0, "assertTrue(x)").when(r % 3 == 1, "  ").otherwise("")
    return j.select(
        "row_idx", "project", "bug_num", "test_name",
        F.regexp_replace("trace", r"^-+", "").alias("buggy_test_trace"),
        F.replace(F.col("focal_method"), F.lit(" {"), throws).alias("focal_method"),
        F.concat(F.array_join(F.slice(lines, F.lit(1), half), "\n"), doc).alias("docstring"), F.col("test").alias("test_prefix"),
        F.array_join(F.slice(lines, half + 1, F.size(lines)), "\n").alias("generated_test"),
        (r % 2).cast("int").alias("except_pred"), assert_pred.alias("assert_pred"))


def _name_line(text: Column) -> Column:
    """The names of ``sentence_names`` in order, one space between them; in two passes over the whole text."""
    words = F.regexp_replace(F.concat(F.lit("."), F.lower(F.coalesce(text, F.lit(""))), F.lit(".")), "[^a-z.\n]+", "_")
    return F.trim(F.regexp_replace(words, "_?[.\n][._\n]*", " "))


def _names_in(line: Column) -> Column:
    return F.array_remove(F.split(line, " ", -1), "")


def sentence_names(text: Column) -> Column:
    """One identifier per sentence or line of the text: its words joined by '_' (sentences without a word: none)."""
    return _names_in(_name_line(text))


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated-test-shaped code: every sentence of the document is a statement, followed by
    an oracle; its form cycles over assertions, the six exception forms, forms that the
    classifier must reject, and no oracle."""
    d = _with_code(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select(F.col("doc_id").alias("row_idx"), "test", "focal_method")


def _with_code(d: DataFrame) -> DataFrame:
    """The documents (doc_id, text and what else they have) with the code that ``code`` makes of each, and the line of its names."""
    d = d.withColumn("name_line", _name_line(F.col("text"))).withColumn("_names", _names_in(F.col("name_line")))
    w = F.coalesce(F.get("_names", 0), F.lit("x"))
    k = F.size("_names").cast("string")
    call = F.concat(F.lit("cart."), w, F.lit("()"))
    stmts = F.transform("_names", lambda x, i: F.concat(
        F.lit("String s"), i.cast("string"), F.lit(" = cart."), x, F.lit("("), F.length(x).cast("string"), F.lit(");")))
    exc = "IllegalStateException"
    tails = [
        F.concat(F.lit("assertEquals("), k, F.lit(", s0.length());")),
        F.concat(F.lit("try { "), call, F.lit(f'; fail("Expecting exception: {exc}"); }} catch({exc} e) {{ verifyException("pkg.Cart", e); }}')),
        F.concat(F.lit(f"assertThrows({exc}.class, () -> "), call, F.lit(");")),
        F.concat(call, F.lit("; // no exception")),
        F.concat(F.lit(f"assertThrows({exc}.class, cart::"), w, F.lit(");")),
        F.concat(call, F.lit("; // expects")),
        F.concat(F.lit("assertThatThrownBy(() -> "), call, F.lit(f").isInstanceOf({exc}.class);")),
        F.concat(F.lit("Thrower t = thrower("), k, F.lit("); t.isThrownBy(() -> "), call, F.lit(");")),
        F.concat(F.lit("assertEquals(NaN, s0.ratio()); assertTrue(s1.isEmpty());")),
        F.concat(F.lit('try { fail("empty"); } catch(Exception e) { String m = e.getMessage(); }')),
        F.concat(F.lit('assertEquals("'), w, F.lit('", s0); assertFalse('), call, F.lit(");")),
    ]
    v = F.col("doc_id") % len(tails)
    tail = tails[-1]
    for i, t in enumerate(tails[:-1]):
        tail = F.when(v == i, t).otherwise(tail)
    head = F.when(v == 5, F.lit(f"@Test(expected = {exc}.class)")).otherwise(F.lit("@Test(timeout = 4000)"))
    test = F.concat(head, F.lit("\n  public void test"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"),
                    F.lit("()  throws Throwable  {\n      "), F.array_join(stmts, "\n      "), F.lit("\n      "), tail, F.lit("\n  }"))
    focal = F.concat(F.lit("public String "), w, F.lit("(int n) {\n    return \""), w, F.lit("\";\n  }"))
    return d.withColumns({"test": test, "focal_method": focal}).drop("_names")


def test_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test-class files around all words of a document: package, one import per word (the last
    one after the @RunWith line), class header and one test case."""
    d = _with_code(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).withColumnRenamed("doc_id", "row_idx")
    words = F.replace(F.col("name_line"), F.lit("_"), F.lit(" "))
    none = F.col("name_line") == ""
    imports = F.when(none, "").otherwise(F.concat(F.lit("import pkg."), F.replace(words, F.lit(" "), F.lit(";\nimport pkg.")), F.lit(";")))
    cls = F.concat(F.lit("C"), (F.col("row_idx") % 9).cast("string"))
    late = F.when(none, "x").otherwise(F.substring_index(F.substring_index("name_line", " ", -1), "_", -1))
    body = F.concat_ws("\n", F.concat(F.lit("package pkg."), F.col("source"), F.lit(";")), F.lit(""),
                       imports, F.lit("import org.junit.Test;"),
                       F.lit("@RunWith(EvoRunner.class)"), F.concat(F.lit("import late."), late, F.lit(";")),
                       F.concat(F.lit("public class "), cls, F.lit("_ESTest {")), F.col("test"), F.lit("}"))
    return d.select("row_idx", F.col("source").alias("project"),
                                       F.concat(F.lit("pkg."), F.col("source")).alias("package"),
                                       cls.alias("class_name"), "test", body.alias("file_text"))


# SQL text of the same views for DuckDB (array index base 1 there).
VIEW_SQL = {
    "cases": """
SELECT d.doc_id AS row_idx, d.source AS project, CAST(floor(d.doc_id / 20) AS BIGINT) % 5 AS bug_num,
       concat('test', CAST(d.doc_id % 3 AS VARCHAR)) AS test_name, d.lang AS focal_method,
       d.text AS generated_test, l.quality = 0 AS failed_buggy, l.toxic = 1 AS failed_fixed
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "traces": """
SELECT event_id AS row_idx, concat('proj', CAST(user_id % 10 AS VARCHAR)) AS project, user_id % 7 AS bug_num,
       concat('pkg.C', CAST(user_id % 9 AS VARCHAR), '::t', CAST(event_id % 400 AS VARCHAR)) AS test_name,
       concat('--- pkg.C', CAST(user_id % 9 AS VARCHAR), '::t', CAST(event_id % 400 AS VARCHAR), chr(10),
         CASE event_type WHEN 'error' THEN 'java.lang.IllegalStateException'
           WHEN 'click' THEN 'org.evosuite.runtime.mock.java.io.MockIOException'
           WHEN 'view' THEN 'junit.framework.AssertionFailedError'
           WHEN 'purchase' THEN 'org.proj1.CartException' ELSE 'lib.Other' END,
         CASE WHEN event_id % 4 = 0 THEN '' ELSE concat(': k', CAST(event_id % 5 AS VARCHAR)) END,
         chr(10), '  at x') AS trace
FROM events""",
    "outcomes": """
SELECT l_linenumber AS run, CASE WHEN l_returnflag = 'A' THEN 'naive' ELSE 'learned' END AS system,
       l_suppkey AS project, l_partkey % 10 AS bug_num, l_orderkey AS row_idx, l_linenumber AS line_no,
       l_discount > 0.08 AND l_tax < 0.05 AS tp, l_discount > 0.08 AND l_tax >= 0.05 AS fp,
       l_discount <= 0.08 AND l_tax < 0.05 AS tn, l_discount <= 0.08 AND l_tax >= 0.05 AS fn
FROM lineitem""",
    "pairs": """
SELECT a.conv_id AS conv_id, a.turn AS turn, a.text AS text_a, b.text AS text_b
FROM conversations a JOIN conversations b
  ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant'""",
    "scores": f"""
SELECT vec_id AS row_idx, CAST(floor(vec_id / 3) AS BIGINT) AS idx, vec_id % 3 AS pos,
       CAST(embedding[1] AS DOUBLE) * {LOGIT_SCALE} AS l0, CAST(embedding[2] AS DOUBLE) * {LOGIT_SCALE} AS l1,
       CASE WHEN CAST(embedding[2] AS DOUBLE) > CAST(embedding[1] AS DOUBLE) THEN 1 ELSE 0 END AS pred,
       CASE label % 4 WHEN 0 THEN 'assertTrue' WHEN 1 THEN 'assertFalse' WHEN 2 THEN 'assertNotNull'
         ELSE 'assertEquals' END AS kind,
       label % 2 AS truth,
       CAST(floor(abs(CAST(embedding[3] AS DOUBLE)) * 500) AS INTEGER) AS truncation
FROM embeddings""",
    "code": r"""
SELECT row_idx,
  concat(CASE WHEN row_idx % 11 = 5 THEN '@Test(expected = IllegalStateException.class)' ELSE '@Test(timeout = 4000)' END,
         chr(10) || '  public void test', lpad(CAST(row_idx % 100 AS VARCHAR), 2, '0'),
         '()  throws Throwable  {' || chr(10) || '      ',
         array_to_string(list_transform(names, lambda x, i: concat('String s', CAST(i - 1 AS VARCHAR), ' = cart.', x, '(',
                                        CAST(length(x) AS VARCHAR), ');')), chr(10) || '      '),
         chr(10) || '      ',
         CASE row_idx % 11
           WHEN 0 THEN concat('assertEquals(', k, ', s0.length());')
           WHEN 1 THEN concat('try { cart.', w, '(); fail("Expecting exception: IllegalStateException"); } catch(IllegalStateException e) { verifyException("pkg.Cart", e); }')
           WHEN 2 THEN concat('assertThrows(IllegalStateException.class, () -> cart.', w, '());')
           WHEN 3 THEN concat('cart.', w, '(); // no exception')
           WHEN 4 THEN concat('assertThrows(IllegalStateException.class, cart::', w, ');')
           WHEN 5 THEN concat('cart.', w, '(); // expects')
           WHEN 6 THEN concat('assertThatThrownBy(() -> cart.', w, '()).isInstanceOf(IllegalStateException.class);')
           WHEN 7 THEN concat('Thrower t = thrower(', k, '); t.isThrownBy(() -> cart.', w, '());')
           WHEN 8 THEN 'assertEquals(NaN, s0.ratio()); assertTrue(s1.isEmpty());'
           WHEN 9 THEN 'try { fail("empty"); } catch(Exception e) { String m = e.getMessage(); }'
           ELSE concat('assertEquals("', w, '", s0); assertFalse(cart.', w, '());') END,
         chr(10) || '  }') AS test,
  concat('public String ', w, '(int n) {' || chr(10) || '    return "', w, '";' || chr(10) || '  }') AS focal_method
FROM (SELECT row_idx, names, coalesce(names[1], 'x') AS w, CAST(len(names) AS VARCHAR) AS k
      FROM (SELECT doc_id AS row_idx,
                   list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '[.\n]+'),
                                              lambda x: array_to_string(regexp_extract_all(x, '[a-z]+'), '_')), lambda x: x <> '') AS names
            FROM documents))""",
    "test_files": r"""
SELECT d.doc_id AS row_idx, d.source AS project, 'pkg.' || d.source AS package,
       'C' || CAST(d.doc_id % 9 AS VARCHAR) AS class_name, c.test,
       concat_ws(chr(10), 'package pkg.' || d.source || ';', '',
                 array_to_string(list_transform(d.w, lambda w: 'import pkg.' || w || ';'), chr(10)),
                 'import org.junit.Test;', '@RunWith(EvoRunner.class)', 'import late.' || coalesce(d.w[-1], 'x') || ';',
                 'public class C' || CAST(d.doc_id % 9 AS VARCHAR) || '_ESTest {', c.test, '}') AS file_text
FROM (SELECT doc_id, source, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM documents) d
JOIN code c ON c.row_idx = d.doc_id""",
    "failed": """
SELECT t.row_idx, project, bug_num, test_name, regexp_replace(trace, '^-+', '') AS buggy_test_trace,
       replace(c.focal_method, ' {', CASE WHEN t.row_idx % 3 = 0 THEN ' throws IllegalStateException {' ELSE ' {' END) AS focal_method,
       array_to_string(lines[1:(len(lines) + 1) // 2], chr(10)) || CASE WHEN t.row_idx % 5 = 0 THEN ' Throws CartException if empty' ELSE '' END AS docstring,
       c.test AS test_prefix, array_to_string(lines[(len(lines) + 1) // 2 + 1:], chr(10)) AS generated_test,
       CAST(t.row_idx % 2 AS INTEGER) AS except_pred,
       CASE t.row_idx % 3 WHEN 0 THEN 'assertTrue(x)' WHEN 1 THEN '  ' ELSE '' END AS assert_pred
FROM traces t JOIN (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) d ON d.doc_id = t.row_idx JOIN code c ON c.row_idx = t.row_idx""",
}


def with_views(sql: str, *names: str, ctes: str | None = None) -> str:
    """Prefix an oracle query with the CTEs of the views it reads (+ extra CTEs)."""
    if "failed" in names:
        names = (*(n for n in ("traces", "code") if n not in names), *names)
    if "test_files" in names and "code" not in names:
        names = ("code", *names)
    parts = [f"{n} AS ({VIEW_SQL[n]}\n)" for n in names]
    if ctes:
        parts.append(ctes.strip())
    return "WITH " + ",\n".join(parts) + "\n" + sql.strip()
