"""File sources: code-safe CSV round trip, trigger logs (batch and incremental)."""

from __future__ import annotations

import os
import tempfile

import pandas as pd

from verdict.sources import files as S
from verdict.streaming.logs import ingest_trigger_logs

LOG = ("--- pkg.Foo_ESTest::test001\njava.lang.IllegalStateException: broken state\n\tat pkg.Foo.run(Foo.java:10)\n"
       "--- pkg.Foo_ESTest::test012\njunit.framework.AssertionFailedError: expected:<1> but was:<2>\n\tat x\n"
       "--- pkg.Foo_ESTest::test001\nlib.Other\n\tat y\n")


def _logs(root):
    d = os.path.join(root, "Lang", "learned")
    os.makedirs(d)
    with open(os.path.join(d, "7b.7.trigger.log"), "w") as f:
        f.write(LOG)
    with open(os.path.join(d, "7f.7.trigger.log"), "w") as f:
        f.write("")


def test_code_csv_roundtrip(spark):
    root = tempfile.mkdtemp(prefix="verdict-csv-", dir="/tmp")
    pdf = pd.DataFrame({"focal_method": ["int f() {\n  return \"a,b\";\n}", "null", ""],
                        "test_prefix": ['x = "q\\"";\n', "y\\", "NA"], "docstring": ["d", None, "e"]})
    path = os.path.join(root, "inputs.csv")
    pdf.to_csv(path, index=False)
    got = S.read_code_csv(spark, path, "focal_method string, test_prefix string, docstring string").collect()
    assert got[0]["focal_method"] == pdf["focal_method"][0]
    assert got[0]["test_prefix"] == pdf["test_prefix"][0]
    assert got[1]["focal_method"] == "" and got[1]["docstring"] == "" and got[1]["test_prefix"] == "y\\"
    assert got[2]["test_prefix"] == ""


def test_trigger_logs_batch_and_stream(spark):
    root = tempfile.mkdtemp(prefix="verdict-logs-", dir="/tmp")
    _logs(root)
    blocks = S.read_trigger_logs(spark, root).collect()
    assert len(blocks) == 3
    assert {(b["project"], b["system"], b["bug_num"], b["tag"]) for b in blocks} == {("Lang", "learned", 7, "b")}
    cats = sorted((b["block_pos"], b["test_name"], b["category"]) for b in blocks)
    assert cats == [(0, "pkg.Foo_ESTest::test001", "exception"), (1, "pkg.Foo_ESTest::test012", "assertion"),
                    (2, "pkg.Foo_ESTest::test001", "none")]
    out = tempfile.mkdtemp(prefix="verdict-out-", dir="/tmp")
    ingest_trigger_logs(spark, root, os.path.join(out, "t"), os.path.join(out, "ck"))
    assert spark.read.parquet(os.path.join(out, "t")).count() == 3


def test_missing_input_is_empty(spark):
    df = S.read_or_empty(spark, "/tmp/verdict-does-not-exist-*/x.parquet", "a string")
    assert df.count() == 0 and df.columns == ["a"]


def test_bug_lists_project_from_file_name(spark):
    root = tempfile.mkdtemp(prefix="verdict-meta-", dir="/tmp")
    for proj, rows in (("Lang", [(1, "org.a"), (3, "org.a")]), ("Cli", [(2, "org.b")])):
        pd.DataFrame(rows, columns=["bug.id", "package.name"]).to_csv(os.path.join(root, f"{proj}.csv"), index=False)
    df = S.read_bug_lists(spark, os.path.join(root, "*.csv"), S.parse_projects("Lang", ["Lang", "Cli"]))
    got = sorted((r["project"], int(r["bug_id"])) for r in df.collect())
    assert got == [("Lang", 1), ("Lang", 3)]
    assert S.parse_projects(None, ["A"]) == ["A"] and S.parse_projects(["X", "Y"], []) == ["X", "Y"]


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_string_csv_with_and_without_header(spark, tmp_path):
    _write(f"{tmp_path}/a.csv", 'x,y\n1,"a ""q"" \nb"\n')
    assert [tuple(r) for r in S.read_string_csv(spark, f"{tmp_path}/a.csv").collect()] == [("1", 'a "q" \nb')]
    _write(f"{tmp_path}/b.csv", "1,2\n3,4\n")
    got = S.read_string_csv(spark, f"{tmp_path}/b.csv", header=False, names=["p", "q"])
    assert got.columns == ["p", "q"] and [tuple(r) for r in got.collect()] == [("1", "2"), ("3", "4")]


def test_keyed_csv_keeps_the_last_row_of_a_key(spark, tmp_path):
    _write(f"{tmp_path}/k.csv", "id,v,w\n1,a,x\n2,b,y\n1,c,z\n")
    got = sorted(tuple(r) for r in S.read_keyed(spark, f"{tmp_path}/k.csv", ["id"], ["v"]).collect())
    assert got == [("1", "c"), ("2", "b")]


def test_prediction_and_input_schemas(spark, tmp_path):
    _write(f"{tmp_path}/e.csv", "a,b,c,d\n1,0,0.5,-1.5\n\n0,1,2,3\n")
    got = sorted(tuple(r) for r in S.read_predictions(spark, f"{tmp_path}/e.csv", S.EXCEPTION_PREDICTIONS).collect())
    assert got == [(0, 1, 2.0, 3.0), (1, 0, 0.5, -1.5)]
    row = '7,1,0,0.1,0.2,test0,"assertEquals(1, x)",3,"public void test0() {\n}","int f()"\n'
    _write(f"{tmp_path}/p.csv", "c0,c1,c2,c3,c4,c5,c6,c7,c8,c9\n" + row)
    r = S.read_predictions(spark, f"{tmp_path}/p.csv", S.ASSERTION_PREDICTIONS).first()
    assert (r.idxs, r.truncation, r.pred_assertion, r.test) == (7, 3, "assertEquals(1, x)", "public void test0() {\n}")
    _write(f"{tmp_path}/i.csv", "idx,docstring,fm,test,label\n4,,int f(),t(),1\n")
    assert [tuple(r) for r in S.read_model_inputs(spark, f"{tmp_path}/i.csv").collect()] == [(1, "t()", "int f()", "", 4)]


def test_sweep_inputs_through_an_index_list(spark):
    scores = spark.createDataFrame([(0, 0.5), (1, 0.6), (2, 0.7)], "row_idx long, l0 double")
    lab = lambda xs: spark.createDataFrame(list(enumerate(xs)), "row_idx long, label int")
    idx = spark.createDataFrame([(0, 3), (1, 0), (2, 3)], "row_idx long, idx long")
    got = sorted(tuple(r) for r in S.join_sweep_inputs(scores, lab([1, 0, 0, 5]), lab([0, 1, 1, 7]), idx).select(
        "row_idx", "as_lbl", "ex_lbl").collect())
    assert got == [(0, 5, 7), (1, 1, 0), (2, 5, 7)]


def test_source_files_with_keys_and_unmatched_count(spark, tmp_path):
    for p in ("Lang/1/C_ESTest.java", "Lang/2/D_ESTest.java", "odd.java", "Lang/3/E_scaffolding.java"):
        _write(f"{tmp_path}/src/{p}", "class " + p)
    pattern = r"/([A-Z]\w+)/([0-9]+)/(\w+)_ESTest\.java$"
    got = sorted((r.project, r.bug, r.name) for r in S.read_source_files(spark, f"{tmp_path}/src", pattern, ["project", "bug", "name"]).collect())
    assert got == [("Lang", "1", "C"), ("Lang", "2", "D")]
    assert tuple(S.count_unmatched(spark, f"{tmp_path}/src", pattern).first()) == ("file_name_not_matched", 1)


def test_archive_keys(spark, tmp_path):
    _write(f"{tmp_path}/g/Lang/evo/1/Lang-7f-evo.1.tar.bz2", "x")
    r = S.list_archives(spark, f"{tmp_path}/g").first()
    assert (r.project, r.method, r.test_id, r.bug_num) == ("Lang", "evo", "1", 7)


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b",\nc'), (2, "")], "k int, t string")
    S.export_csv(df, f"{tmp_path}/out")
    assert sorted(tuple(r) for r in S.read_code_csv(spark, f"{tmp_path}/out", "k int, t string").collect()) == [(1, 'a "b",\nc'), (2, "")]
    S.write_results(df, f"{tmp_path}/pq", ["k"])
    assert spark.read.parquet(f"{tmp_path}/pq").filter("k = 1").count() == 1 and os.path.isdir(f"{tmp_path}/pq/k=1")


def test_short_block_fails(spark, tmp_path):
    _write(f"{tmp_path}/l/Lang/learned/7b.7.trigger.log", "--- only a name")
    try:
        S.read_trigger_logs(spark, f"{tmp_path}/l").collect()
    except Exception as ex:  # noqa: BLE001
        assert "short trigger block" in str(ex)
    else:
        raise AssertionError("a short block was read")

