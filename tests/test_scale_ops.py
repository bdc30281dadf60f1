"""Operators that must not grow with one key: sweep anti-join, streamed splits, median by selection, weighted draws,
splittable log scan, resumable runs, checks in one pass; each against a plain version."""

from __future__ import annotations

import random
import re
import time
from bisect import bisect_right
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdict.operators import checks as CK
from verdict.operators import lines as L
from verdict.operators import packing as P
from verdict.operators import sampling as SP
from verdict.sources import files as S

SIG = r"\s*public\s+void\s+(\S+)\(\)\s+throws\s+Throwable\s+\{\s*"


# ------------------------------------------------------------------ J12

def plain_repair(text, errors):
    lines, starts, last = text.split("\n"), [], None
    last = len(lines)
    for i, line in enumerate(lines):
        if line.strip() == "}":
            last = i
        if re.match(SIG, line):
            starts.append(i - 1)
    spans = list(zip(starts, [*starts[1:], last]))
    header = starts[0] if starts else last
    gone = {i for i in errors if i < header and 0 <= i < len(lines) and lines[i].startswith("import")}
    for s, e in spans:
        if any(s <= x < e for x in errors):
            gone |= set(range(s, e))
    return [(i, x) for i, x in enumerate(lines) if i not in gone]


def test_repair_matches_plain_version(spark):
    rnd, files, errors = random.Random(3), [], []
    for f in range(60):
        lines = [rnd.choice(["import a;", "import b;", "  public void t() throws Throwable {", "}", "x();", "", " }"]) for _ in range(rnd.randrange(1, 40))]
        files.append((f, "\n".join(lines)))
        errors += [(f, rnd.randrange(-2, 45)) for _ in range(rnd.randrange(8))] * 2
    errors += [(None, 1), (99, 1), (3, None)]
    got = {r.file: [tuple(z) for z in r.kept] for r in L.repair_files(
        spark.createDataFrame(files, "file long, text string"), spark.createDataFrame(errors, "file long, err_idx long"), "file", "text", SIG).collect()}
    assert got == {f: plain_repair(t, {e for g, e in errors if g == f and e is not None}) for f, t in files}


def test_repair_one_file_with_many_errors(spark):
    """100,000 failing lines, each twice, in one file of 300,000 lines and 30,000 methods."""
    method = ["@Test", "  public void t() throws Throwable {"] + ["  x();"] * 7 + ["  }"]
    text = "\n".join(["import a;"] * 10 + method * 30_000 + ["}"])
    errors = spark.range(100_000).select(F.lit(0).cast("long").alias("file"), (F.col("id") * 2).alias("err_idx"))
    start = time.monotonic()
    r = L.repair_files(spark.createDataFrame([(0, text)], "file long, text string"), errors.union(errors), "file", "text", SIG).select(
        F.size("kept").alias("n"), F.element_at("kept", 1)["line_idx"].alias("first")).first()
    # methods start at 10 + 10 k; every one before line 200,000 holds an even line; even import lines go
    assert (r.n, r.first) == (5 + (30_000 - 19_999) * 10 + 1, 1) and time.monotonic() - start < 60


# ------------------------------------------------------------------ W3

def test_marker_split_many_markers(spark):
    text = "\n".join(x for i in range(10_000) for x in (f"int a{i} = 0;", f"assert(a{i});"))
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "assert(1);")], "id long, t string")
    out = L.marker_split(df, "id", "t", "assert")
    # the sizes only: all splits together are gigabytes
    rows = {(r.id, r.split_no): (r.has_marker, r.n) for r in out.select("id", "split_no", "has_marker", F.length("split_test").alias("n")).collect()}
    assert len(rows) == 10_001 + 1 + 2
    size, plain = 0, 0
    for i in range(10_000):
        plain += len(f"int a{i} = 0;") + 1
        assert rows[1, i] == (True, plain + len(f"assert(a{i});") + 2)
    assert rows[1, 10_000] == (False, plain - 1) and rows[3, 0] == (False, 0) and rows[4, 0] == (True, 12)


# ------------------------------------------------------------------ A15

@pytest.mark.parametrize("p", [0.0, 0.5, 0.9, 1.0])
def test_percentile_is_that_of_numpy(spark, p, monkeypatch):
    monkeypatch.setattr(P, "FEW", 5)
    monkeypatch.setattr(P, "BINS", 7)
    rng = np.random.default_rng(4)
    for values in ([3.0], [1.0, 2.0], [5.0] * 50, [0.0] * 30 + [1e300], [1.0] * 40 + [2.0] * 40, rng.integers(0, 9, 101).tolist(),
                   rng.normal(size=200).tolist(), (10.0 ** rng.uniform(-9, 9, 150)).tolist()):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(4)
        assert P.exact_percentile(df, "v", p) == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-300)
    assert P.exact_percentile(spark.createDataFrame([(None,)], "v double"), "v", p) is None


def test_truncation_stats_without_rows(spark):
    assert tuple(P.truncation_stats(spark.createDataFrame([], "a int"), "a").first()) == (0, 0, None, None, None)
    assert tuple(P.truncation_stats(spark.createDataFrame([(0,), (4,), (5,)], "a int"), "a").first()) == (3, 2, 3.0, 4.0, 5)


# ------------------------------------------------------------------ T7

def test_weighted_draws(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice([0, 1, 5, None, 40])) for i in range(200)] + [(500, 4000)]  # one row with most of the weight
    draws = [(i, rnd.randrange(1 << 60)) for i in range(3000)] + [(9000, 0), (9001, (1 << 60) - 1)]
    got = SP.draw_rows(spark.createDataFrame(rows, "id long, w long").repartition(5), spark.createDataFrame(draws, "d long, bits long").repartition(3),
                       "id", "w", "d", "bits").collect()
    ids, ends, total = [], [], 0
    for i, w in sorted(rows):
        if w:
            ids.append(i)
            total += w
            ends.append(total)
    want = {d: ids[bisect_right(ends, (b * total) >> 60)] for d, b in draws}
    assert {r.d: r.id for r in got} == want and len(got) == len(draws)
    share = Counter(want.values())[500] / len(draws)
    assert abs(share - 4000 / total) < 0.05


def test_weighted_draws_odd_rows(spark):
    draws = spark.createDataFrame([(1, 5)], "d long, bits long")
    rows = spark.createDataFrame([("a", 0), ("b", None)], "id string, w int")
    assert SP.draw_rows(rows, draws, "id", "w", "d", "bits").count() == 0
    assert SP.draw_rows(rows.limit(0), draws, "id", "w", "d", "bits").count() == 0
    one = spark.createDataFrame([("a", 0), ("b", 2)], "id string, w int")
    assert [tuple(r) for r in SP.draw_rows(one, draws, "id", "w", "d", "bits").collect()] == [(1, "b")]
    assert SP.draw_rows(one, draws.limit(0), "id", "w", "d", "bits").count() == 0
    with pytest.raises(Exception, match="negative"):
        SP.draw_rows(spark.createDataFrame([("a", -1)], "id string, w int"), draws, "id", "w", "d", "bits").collect()


# ------------------------------------------------------------------ S8

def test_log_scan_by_splits(spark, tmp_path):
    """Logs cut into splits of some bytes give the blocks of a whole-file parse, in their order."""
    rnd, want = random.Random(2), []
    for n, name in enumerate(["p/s/1b.1", "p/s/1f.1", "q/s/22b.9"]):
        blocks = [f" C{rnd.randrange(9)}::t{i}\njava.lang.E{'x' * rnd.randrange(60)}: é--\n-- at x\n" for i in range([40, 0, 7][n])]
        text = "---" + "\n---".join(b.rstrip("\n") if rnd.random() < 0.5 else b for b in blocks) if blocks else ""
        if n == 0:
            text = "-" + text + "\n---\n---"  # more dashes, and two empty blocks at the end
        path = tmp_path / f"{name}.trigger.log"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
        parts = re.sub(r"^-+", "", text).split("\n---")
        want += [(name.split("/")[0], i, b) for i, b in enumerate(parts) if b]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("128m", "97b", "31b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            df = S.read_trigger_logs(spark, str(tmp_path))
            got = df.collect()
            assert sorted((r.project, r.block_pos, r.block) for r in got) == sorted(want)
            assert {(r.project, r.system, r.bug_num, r.tag) for r in got} == {("p", "s", 1, "b"), ("q", "s", 22, "b")}
            if size == "31b":
                assert spark.read.option("recursiveFileLookup", True).text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_log_without_separator_or_second_line(spark, tmp_path):
    (tmp_path / "p" / "s").mkdir(parents=True)
    (tmp_path / "p" / "s" / "3b.1.trigger.log").write_text("A::t\njava.lang.E")
    assert [(r.block_pos, r.test_name, r.category) for r in S.read_trigger_logs(spark, str(tmp_path)).collect()] == [(0, "A::t", "exception")]
    (tmp_path / "p" / "s" / "4b.1.trigger.log").write_text("--- A::t\njava.lang.E\n--- short")
    with pytest.raises(Exception, match="short trigger block"):
        S.read_trigger_logs(spark, str(tmp_path)).collect()


# ------------------------------------------------------------------ S14, S15

def test_rerun_takes_what_is_not_done(spark, tmp_path):
    tasks = spark.createDataFrame([("p", i) for i in range(8)] + [("p", 3)], "project string, bug long")
    out, manifest, asked = str(tmp_path / "out"), str(tmp_path / "manifest"), []

    def compute(broken=()):
        def run(todo):
            asked.append(sorted(r.bug for r in todo.collect()))
            bad = F.when(F.col("bug").isin(*broken), F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("bug") * 10)
            return todo.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("y", bad)
        return run

    def status(df):
        return {r.bug: r.status for r in df.collect()}

    first = status(S.run_pending(tasks, ["project", "bug"], compute([5]), out, manifest, "a", waves=4, strict=False))
    failed = sorted(b for b, s in first.items() if s == "failed")
    assert 5 in failed and set(first) == set(range(8)) and set(first.values()) == {"done", "failed"}
    assert sorted({r.bug for r in spark.read.parquet(out).collect()}) == sorted(set(range(8)) - set(failed))
    # a partition written by a run that was killed before its manifest entry is replaced, not doubled
    spark.createDataFrame([("p", 5, 7, 7)], "project string, bug long, x int, y long").write.mode("append").partitionBy("project", "bug").parquet(out)
    asked.clear()
    second = status(S.run_pending(tasks, ["project", "bug"], compute(), out, manifest, "b"))
    assert asked == [failed] and second == {b: "done" if b in failed else "skip" for b in range(8)}
    assert sorted((r.bug, r.x, r.y) for r in spark.read.parquet(out).collect()) == [(b, x, b * 10) for b in range(8) for x in (1, 2)]
    asked.clear()
    assert set(status(S.run_pending(tasks, ["project", "bug"], compute(), out, manifest, "c")).values()) == {"skip"} and asked == []
    with pytest.raises(Exception, match="killed"):
        S.run_pending(spark.createDataFrame([("q", 5)], "project string, bug long"), ["project", "bug"], compute([5]), out, manifest, "d")


# ------------------------------------------------------------------ V1 to V7

def test_checks_in_one_pass(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (None, "a", 3), (None, "a", 4), (2, None, 5)], "k long, s string, n long")
    got = {r["check"]: r["violations"] for r in CK.check_table(df, {"nulls": CK.any_null(["k", "s"]), "big": F.col("n") > 3}, {"key": ["k", "s"]}).collect()}
    assert got == {"nulls": 3, "big": 2, "key": 2}
    got = CK.check_table(df, {"nulls": CK.any_null(["k"])}, {"key": ["k"]}, F.col("k").isNotNull()).collect()
    assert sorted(tuple(r) for r in got) == [("key", 1), ("nulls", 2)]
    assert [tuple(r) for r in CK.check_table(df.limit(0), {"nulls": CK.any_null(["k"])}).collect()] == [("nulls", 0)]
    with pytest.raises(ValueError):
        CK.check_table(df, {}, {"a": ["k"], "b": ["s"]})


def test_checks_of_the_write(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "k long, s string")
    rows = {"nulls": CK.any_null(["k", "s"]), "empty": F.col("s") == ""}
    got = CK.write_checked(df, str(tmp_path / "a"), rows)
    assert sorted(tuple(r) for r in got.collect()) == [("empty", 0), ("nulls", 1)] and spark.read.parquet(str(tmp_path / "a")).count() == 2
    with pytest.raises(CK.QualityError, match="nulls"):
        CK.write_checked(df, str(tmp_path / "b"), rows, strict=True)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2  # there to be looked at
    CK.write_checked(df.filter("k = 1"), str(tmp_path / "c"), rows, strict=True)


# ------------------------------------------------------------------ steps of a text run once

def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_negative_test_patterns_run_once(spark):
    """The cut text of a negative test is bound: its pattern stands in the plan to find and to measure it, not once for each use."""
    from verdict.operators import code_text as CT
    df = spark.createDataFrame([("@Test void a() { int x = 1; int y = f(2); assertEquals(x, g(y)); }",), ("@Test void b() { s = q; }",), (None,)], "t string")
    out = df.select(CT.normalize_negative(F.col("t")).alias("n"))
    assert [r.n for r in out.collect()] == ["@Test void a() { int x = 1; f(2); }", "@Test void b() { q; }", None]
    assert _plan(out).count("assert[a-zA-z]*") <= 2


def test_reasons_are_counted_before_rows_are_doubled(spark, tmp_path):
    from verdict.plans.registry import QUERIES, load_all
    load_all()
    spark.createDataFrame([(i, f"one exception {i}. two {i}.", "s") for i in range(33)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["reason_counts"](spark, str(tmp_path))
    assert _plan(out).count("fail\\(.*\\).*}\\s*catch") == 1
    rows = {r.reason: r.n for r in out.collect()}
    inputs = QUERIES["exception_inputs"](spark, str(tmp_path)).collect()
    assert rows == Counter(r.reason or "kept" for r in inputs) + Counter("missed" for r in inputs if r.missed)
    assert sum(n for k, n in rows.items() if k != "missed") == 33


@pytest.mark.parametrize("text", [None, "", "import a;", " import  a.B ; \r\n import c;\u0085\nx import d;\nimport\nimports \n@RunWith(x)\nimport late;",
                                  "\t@RunWith\nimport a;", "import a;\n@Run\n  import b; @RunWith\n　@RunWithin"])
def test_import_lines_in_one_pass(spark, text):
    from verdict.operators import render as RD
    want = None
    if text is not None:
        want = []
        for line in text.split("\n"):
            if line.strip().startswith("@RunWith"):
                break
            if line.strip().startswith("import"):
                want.append(line.strip())
    out = spark.createDataFrame([(text,)], "t string").select(RD.import_lines("t").alias("i"))
    assert out.first().i == want
    assert "lambda" not in _plan(out)


def test_import_sets_meet_by_digest(spark):
    from verdict.operators import render as RD
    df = spark.createDataFrame([("a", ["x", "y"]), ("a", ["y", "x", "x"]), ("b", ["x"]), ("b", []), ("c", None), (None, ["x"])], "g string, i array<string>")
    out = RD.import_consistency(df, ["g"], "i")
    assert {tuple(r) for r in out.collect()} == {("a", 2, True), ("b", 2, False), ("c", 1, False), (None, 1, True)}
    assert "sha2" in _plan(out)


@pytest.mark.parametrize("text", [None, "", "..\n", " Äa b.c_d\n\ne1f . 9", "_a_.", "a.\r\nb \U0001F600 c", ". _ . z"])
def test_sentence_names_in_two_passes(spark, text):
    from verdict.sources import views as V
    parts = re.split(r"[.\n]+", (text or "").lower())
    want = [n for n in ("_".join(re.findall("[a-z]+", p)) for p in parts) if n]
    out = spark.createDataFrame([(text,)], "t string").select(V.sentence_names(F.col("t")).alias("n"))
    assert out.first().n == want
    assert "lambda" not in _plan(out)


def test_a_line_set_splits_its_text_once(spark):
    df = spark.createDataFrame([("a\nb\n c \n\n d\nc\ne",), ("a\nb\nc",), (None,)], "t string")
    out = df.select(L.test_line_set("t").alias("s"))
    assert [r.s for r in out.collect()] == [["c", "d"], [], []]
    assert _plan(out).count("split(") == 1


def test_rows_of_one_row_group_are_spread(spark, tmp_path):
    """A file of many splits and one row group: only one split has rows."""
    from verdict.sources.tables import table
    spark.range(20000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.option(
        "parquet.block.size", 1 << 30).parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    try:
        rows = table(spark, str(tmp_path), "documents").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) >= 4 and sum(r["count"] for r in rows) == 20000
