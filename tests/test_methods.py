"""The lexical method scan: literals, comments, nesting, long tokens, odd rows; DuckDB parity on the same files."""

from __future__ import annotations

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from verdict.operators import features as FT
from verdict.operators import methods as MT

FILES = {
    "plain": "package p;\nimport a.B;\npublic class A extends B {\n  private int n = 1;\n  public A() { this.n = 2; }\n\n  /** Adds. */\n  public int add(int x) {\n    return n + x;\n  }\n}\n",
    "literals": 'class A {\n  String s = "{ \\" }";\n  char c = \'{\';\n  char d = \'\\\'\';\n  char e = \'\\u007b\';\n  void f() { g("}", \'}\', "\\\\"); }\n  void h() { }\n}',
    "comments": "// class X {\n/* class Y { */\nclass A {\n  // }\n  /* { void no() { } */\n  void f() { /* } */ // }\n  }\n  /** old */ /** Doc { */\n  @Test // (\n  void g() { }\n}",
    "block": 'class A {\n  String s = """\n    { "a" } void no() { }\n    \\""" }\n  """;\n  void f() { }\n}',
    "members": "class A {\n  static { init(); }\n  { init(); }\n  int[] a = { 1, 2 };\n  Runnable r = new Runnable() { public void run() { } };\n  Runnable q = () -> { go(); };\n"
               "  abstract void none();\n  class B { void inner() { } }\n  enum E { X(1) { void in() { } }, Y(2) { } }\n  <T extends C<T>> Map<String, List<T[]>> g(@N(\"(\") T t) throws X, Y { }\n  void last() { if (a) { } }\n}\nclass Z { void z() { } }",
    "enum": "public enum E { A(1) { void in() { } }, B(2) { }; E(int n) { }\n  final int f() { return 1; } }",
    "interface": "@FunctionalInterface interface I {\n  void a();\n  default void b() { }\n}",
    "annotation": "class A {\n  @Test(timeout = 4000, expected = X.class)\n  public\n  void t() throws Throwable  {\n  }\n  @A(@B(c = \"}\")) @C void u() { }\n}",
    "open": "class A { void f() { if (x) { } ",
    "extra": "} } class A { void f() { } } }",
    "two tests": "class A {\n void f() { /* @Test @Test */ }\n void g() { /* @Test */ }\n}",
    "prose": "don't { it's 'quoted } text { (a) }",
    "empty": "", "null": None,
}
NAMES = {"plain": ["A", "add"], "literals": ["f", "h"], "comments": ["f", "g"], "block": ["f"], "members": ["g", "last"], "enum": ["E", "f"],
         "interface": ["b"], "annotation": ["t", "u"], "open": [], "extra": [], "two tests": ["f", "g"], "prose": [], "empty": [], "null": []}


@pytest.mark.parametrize("name", FILES)
def test_names(name):
    assert [m[0] for m in MT.scan(FILES[name] or "")] == NAMES[name]


def test_text_lines_and_comment():
    assert MT.scan(FILES["plain"]) == [("A", "A", 4, 4, "  public A() { this.n = 2; }", ""),
                                       ("add", "A", 7, 9, "  public int add(int x) {\n    return n + x;\n  }", "/** Adds. */")]
    assert MT.scan(FILES["comments"])[1][2:] == (9, 9, "  void g() { }", "/** Doc { */")
    assert MT.scan(FILES["annotation"])[0][2:4] == (3, 4)


def test_spark_matches_duckdb(spark):
    rows = list(FILES.items())
    df = spark.createDataFrame(rows + [("plain", FILES["plain"])], "id string, body string").repartition(3)
    out = MT.file_methods(df, "id", "body")
    assert out.columns == ["id", "kind_order", "member", "name", "start_line", "end_line", "method_text", "docstring"]
    got = sorted((r.id, r.kind_order, r.name, r.start_line, r.end_line, r.method_text, r.docstring) for r in out.collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE files(id VARCHAR, body VARCHAR)")
    con.executemany("INSERT INTO files VALUES (?, ?)", rows)
    want = con.execute("WITH " + MT.scan_sql("files") + " SELECT id, CASE WHEN name = cls THEN 0 ELSE 1 END, name, s, e, t, doc FROM found "
                       "WHERE len(string_split(t, '@Test')) <= 2").fetchall()
    assert got == sorted([tuple(r) for r in want] + [tuple(r) for r in want if r[0] == "plain"])
    assert ("two tests", "f") not in {(r[0], r[2]) for r in got}
    assert MT.file_methods(df.limit(0), "id", "body").count() == 0


def test_fragments(spark):
    df = spark.createDataFrame([(1, "@Test(timeout = 4000)\n  public void test01()  throws Throwable  {\n   f(\"}\");\n  }"), (2, "x();"), (3, None)], "id int, test string")
    got = MT.methods_of(df, "id", "test", in_type=False).collect()
    assert [(r.id, r.name, r.start_line, r.end_line) for r in got] == [(1, "test01", 1, 3)]


def test_long_tokens_take_linear_time(spark):
    """Literals, comments and names of 100,000 characters and many members, in one file each."""
    files = ['class A {\n void f() { String s = "' + "\\\\x{" * 100_000 + '"; }\n}', "class A {\n /*" + "{" * 300_000 + "*/ void f() { } }",
             "class A {\n" + " int a = 1;\n" * 30_000 + " void f() { } }", "class A { void " + "f" * 100_000 + "() { } }",
             "class A {" + " void f() { }" * 20_000 + "}", "class A { void f() { " + "{" * 50_000 + "}" * 50_000 + "} }",
             'class A { String s = """' + '\\"x' * 100_000 + '"""; void f() { } }']
    start = time.monotonic()
    counts = [len(MT.scan(f)) for f in files]
    assert counts == [1, 1, 1, 1, 20_000, 1, 1] and time.monotonic() - start < 5
    df = spark.createDataFrame(list(enumerate(files)), "id int, body string")
    assert MT.methods_of(df, "id", "body").count() == sum(counts)


def test_method_name_of_long_heads(spark):
    head = "public " + "a" * 60_000
    df = spark.createDataFrame([(head + "(int n) {",), (head,), ("void f$1 (int a) throws X, y.Z {",), ("f(a)(b) {",)], "s string")
    start = time.monotonic()
    got = [r[0] for r in df.select(FT.method_name("s")).collect()]
    assert got == ["a" * 60_000, "", "f$1", ""] and time.monotonic() - start < 10


def test_class_headers(spark):
    from verdict.operators import lookup as LK

    files = [("import a.b.P;\nimport static x.Y;\npublic final class A<T extends Q> extends P<T> implements I {",), ("class B extends P { }",), ("interface I { }",),
             ("// class Z extends P\nimport p.*;\nabstract class C { }",), (None,), ("",)]
    got = LK.class_headers(spark.createDataFrame(files, "body string"), "body").collect()
    assert sorted((r["class"], r["extends"], r["imported"]) for r in got) == [("A", "P", True), ("B", "P", False), ("C", None, False)]


def test_focal_methods(spark):
    """Own class before superclass, last call first, constructors before methods; a parent that is not imported isn't walked."""
    from verdict.operators import lookup as LK

    files = [("import p.P;\nclass A extends P {\n  A(int n) { }\n  /** own */ int f() { return 1; }\n}",),
             ("import p.Q;\nclass P extends Q {\n  int f() { }\n  int g() { }\n}",), ("class Q extends R { void h() { } }",), ("class R { void far() { } }",)]
    tests = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (4, "A"), (5, "None"), (6, "P")], "id int, cls string")
    names = spark.createDataFrame([(1, "f", 0), (1, "g", 1), (2, "x", 0), (2, "h", 1), (3, "A", 0), (3, "f", 0), (4, "far", 0), (5, "f", 0), (6, "f", 2), (6, "h", 1)],
                                  "id int, name string, name_pos int")
    got = {r.id: (r["class"], r.name, r.depth, r.text, r.doc) for r in LK.focal_methods(tests, names, spark.createDataFrame(files, "body string"), "id", "cls", "body").collect()}
    assert got == {1: ("A", "f", 0, "  /** own */ int f() { return 1; }", "/** own */"), 2: ("Q", "h", 2, " void h() { }", ""),
                   3: ("A", "A", 0, "  A(int n) { }", ""), 6: ("Q", "h", 1, " void h() { }", "")}
    # repeated rows of files and names, a name declared twice: the same result
    again = LK.focal_methods(tests, names.unionByName(names.withColumn("name_pos", F.col("name_pos") + 5)), spark.createDataFrame(files * 3, "body string"), "id", "cls", "body")
    assert {r.id: (r["class"], r.name, r.depth, r.text, r.doc) for r in again.collect()} == got


def test_first_match_in_rounds(spark):
    """Equal to the one-pass lookup: long name lists, hits in every round, repeated names, no hit at all, null names, no rows."""
    from verdict.operators import lookup as LK

    rng = random.Random(5)
    names = [(i, f"n{rng.randrange(400)}", p) for i in range(60) for p in range(rng.choice([0, 1, 3, 9, 70, 700]))] + [(99, "n1", 600), (98, "none", 0), (97, None, 0)]
    classes = [(i, f"C{(i + k) % 9}", k) for i in [*range(60), 97, 98, 99] for k in range(3)]
    decls = [(f"C{c}", f"n{n}", rng.randrange(2), p, f"text {c} {n}", "") for c in range(9) for p, n in enumerate(rng.sample(range(2, 2000), 40))] + [
        ("C1", "n1", 1, 900, "t", "d"), ("C1", None, 1, 901, "t", "d")]
    tables = [spark.createDataFrame(*x) for x in (
        (names, "id int, name string, name_pos int"), (classes, "id int, class string, depth int"),
        (decls, "class string, name string, kind_order int, decl_pos int, text string, doc string"))]
    once = [tuple(r[c] for c in ("id", "class", "name_pos", "depth", "text", "doc")) for r in LK.first_match(*tables, "id").orderBy("id").collect()]
    got = LK.first_match_in_rounds(*tables, "id").select("id", "class", "name_pos", "depth", "text", "doc").orderBy("id").collect()
    assert [tuple(r) for r in got] == once and 10 < len(once) < 63
    assert LK.first_match_in_rounds(tables[0].limit(0), *tables[1:], "id").collect() == []


def test_offsets_are_the_methods(spark):
    """Spans cut the same members out of every file as the scan with texts, characters beyond the BMP and split names included."""
    files = [(k, v) for k, v in FILES.items()] + [("wide", "class A {\n  // \U0001f600 é\n  /** \U0001f600 d */ void f() { g(\"\U0001f600\"); }\n  void h/* x */i() { }\n}"),
                                                  ("none", None), ("empty", ""), ("tests", "class A { void a() { /* @Test @Test */ } void b() { } }")]
    df = spark.createDataFrame(files, "id string, body string")
    cut = MT.method_offsets(df, "id", "body").join(df, "id").select(
        "id", "kind_order", "member", F.coalesce(MT.sliced("body", "name_span"), "name").alias("name"), "name", MT.sliced("body", "span").alias("text"), MT.sliced("body", "doc_span").alias("doc"))
    first = MT.file_methods(df, "id", "body").groupBy("id", "name").agg(F.min(F.struct("member", "kind_order", "method_text", "docstring")).alias("m"))
    whole = first.select("id", "name", "m.*").select("id", "kind_order", "member", "name", "name", "method_text", "docstring")
    rows = sorted(map(tuple, cut.collect()))
    assert rows == sorted(map(tuple, whole.collect())) and any(r[0] == "wide" and r[3] == "hi" for r in rows)
