"""Edge-case fixtures for the order-, tie- and null-sensitive operators, checked
against plain-Python versions of the reference semantics."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from verdict.functions.positions import group_positions, topk_per_group
from verdict.operators import candidates as C
from verdict.operators import code_text as CT
from verdict.operators import lines as L
from verdict.operators import outcomes as O
from verdict.operators import packing as P
from verdict.operators import ranking as R


def _pick_py(cands):
    """cands: list of (pred, l0, l1) in position order -> picked position."""
    ps = [c[0] for c in cands]
    if sum(ps) == 1:
        return ps.index(1)
    if sum(ps) == 0:
        best, at = None, -1
        for i, (_, l0, _) in enumerate(cands):
            if best is None or l0 < best:
                best, at = l0, i
        return at
    best, at = None, -1
    for i, (p, l0, l1) in enumerate(cands):
        if not p or not l0:
            continue
        if best is None or l1 > best:
            best, at = l1, i
    return at if at >= 0 else len(cands) - 1


def test_pick_candidate_edge_cases(spark):
    groups = {
        0: [(0, 1.0, 0.0), (0, -2.0, 0.5), (0, -2.0, 0.1)],  # none positive, tie on l0
        1: [(0, 1.0, 0.0), (1, 0.3, 0.2)],                   # exactly one
        2: [(1, 0.5, 2.0), (1, 0.4, 2.0), (1, 0.0, 9.0)],    # several, tie, l0 == 0 skipped
        3: [(1, 0.0, 1.0), (1, 0.0, 3.0)],                   # all positives have l0 == 0 -> last
        4: [(1, 0.2, 0.1)],                                  # single candidate
    }
    rows = [(g, i, p, l0, l1) for g, cs in groups.items() for i, (p, l0, l1) in enumerate(cs)]
    df = spark.createDataFrame(rows, "idx long, pos long, pred int, l0 double, l1 double")
    got = {r["idx"]: r["pick_pos"] for r in C.pick_candidate(df).collect()}
    assert got == {g: _pick_py(cs) for g, cs in groups.items()}


def test_gate_threshold_and_truncation(spark):
    rows = [(0, 1, 0.0, 2.6, "assertTrue", 10, "a0"), (1, 1, 0.0, 2.59, "assertTrue", 10, "a1"),
            (2, 0, 6.1, 0.0, "assertTrue", 75, "a2"), (3, 0, 6.2, 0.0, "assertTrue", 10, "a3"),
            (4, 1, 0.0, 9.0, "assertEquals", 76, "a4")]
    df = spark.createDataFrame(rows, "idx long, pick_pred int, pick_l0 double, pick_l1 double, pick_kind string, "
                                     "pick_truncation int, pick_assertion string")
    got = {r["idx"]: r["assert_pred"] for r in C.gate_pick(df, C.threshold_table(spark)).collect()}
    assert got == {0: "a0", 1: "", 2: "a2", 3: "", 4: ""}


def test_update_only_upsert(spark):
    base = spark.createDataFrame([("k1", 0, "a"), ("k2", 1, "b"), ("k1", 2, "c"), ("k3", 3, "d")],
                                 "k string, pos long, v string")
    patch = spark.createDataFrame([("k2", 0, "x"), ("k2", 1, "y"), ("k9", 2, "z")], "k string, pos long, v string")
    got = sorted(tuple(r) for r in O.update_only_upsert(base, patch, ["k"], "pos").collect())
    # k1: first position, last values; k2 replaced by the last patch row; k9 not inserted
    assert got == [("k1", 0, "c"), ("k2", 1, "y"), ("k3", 3, "d")]


def test_dedup_keep_first(spark):
    df = spark.createDataFrame([(1, "p", 0, "t", True), (0, "p", 0, "t", False), (2, "p", 0, "u", True),
                                (None, "p", 0, "t", True)],
                               "row_idx long, project string, bug_num long, text string, flag boolean")
    got = sorted(tuple(r) for r in O.dedup_keep_first(df, ["project", "bug_num", "text"], "row_idx")
                 .select("row_idx", "text", "flag").collect())
    assert got == [(0, "t", False), (2, "u", True)]
    again = O.dedup_keep_first(O.dedup_keep_first(df, ["project", "bug_num", "text"], "row_idx"),
                               ["project", "bug_num", "text"], "row_idx")
    assert again.count() == 2  # idempotent


def test_group_positions_skewed(spark):
    # one hot group with most rows, plus small groups; positions must be 0..n-1 in order
    rows = [("hot", i) for i in range(3000)] + [(f"g{j}", i) for j in range(20) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, o long")
    out = group_positions(df, ["g"], ["o"], n_partitions=8).collect()
    for r in out:
        assert r["pos"] == r["o"]


def test_topk_per_group(spark):
    rows = [("a", i) for i in range(500)] + [("b", i) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, o long")
    got = sorted((r["g"], r["o"], r["rank"]) for r in topk_per_group(df, ["g"], ["o"], 4, salt_buckets=8).collect())
    assert got == [("a", i, i + 1) for i in range(4)] + [("b", i, i + 1) for i in range(3)]


def test_topk_hits_monotone(spark):
    rows = []
    for bug in range(30):
        for t in range(bug % 13 + 1):
            tp = (t * 7 + bug) % 5 == 0
            rows.append(("s", 1, "p", bug, bug * 100 + t, 0, tp, not tp))
    df = spark.createDataFrame(rows, "system string, run int, project string, bug_num long, row_idx long, "
                                     "line_no int, tp boolean, fp boolean")
    seeded = R.with_seeds(df, 3)
    hits = R.topk_hits(R.random_topk(seeded, ["system", "run", "project", "bug_num"], ["row_idx", "line_no"]),
                       ["project", "bug_num"], ["system", "run", "seed"]).collect()
    for h in hits:
        assert h["top_1"] <= h["top_3"] <= h["top_5"] <= h["top_10"]


def _trunc_pair_py(a, b, m):
    a, b = list(range(a)), list(range(b))
    while len(a) + len(b) > m:
        (a if len(a) > len(b) else b).pop()
    return len(a), len(b)


def _trunc_triple_py(a, b, c, m):
    while a + b + c > m:
        if a > b and a > c:
            a -= 1
        elif b > a and b > c:
            b -= 1
        else:
            c -= 1
    return a, b, c


def test_pair_truncation_closed_form(spark):
    cases = [(a, b, m) for a, b, m in itertools.product(range(0, 30, 3), range(0, 40, 4), (5, 17, 40))]
    df = spark.createDataFrame(cases, "a int, b int, m int")
    ca, cb = P.pair_cuts(F.col("a"), F.col("b"), 0)  # limit applied per row below
    rows = df.select("a", "b", "m").collect()
    for r in rows:
        one = df.filter((F.col("a") == r["a"]) & (F.col("b") == r["b"]) & (F.col("m") == r["m"]))
        x, y = P.pair_cuts(F.col("a"), F.col("b"), r["m"])
        got = one.select((F.col("a") - x).alias("ka"), (F.col("b") - y).alias("kb")).first()
        assert (got["ka"], got["kb"]) == _trunc_pair_py(r["a"], r["b"], r["m"])
        break  # one row through Spark per limit is enough; the rest below in one job
    for m in (5, 17, 40):
        x, y = P.pair_cuts(F.col("a"), F.col("b"), m)
        got = df.filter(F.col("m") == m).select("a", "b", (F.col("a") - x).alias("ka"), (F.col("b") - y).alias("kb"))
        for r in got.collect():
            assert (r["ka"], r["kb"]) == _trunc_pair_py(r["a"], r["b"], m)


def test_triple_truncation(spark):
    # only inputs where the pop loop never empties a side (the reference raises there)
    cases = [(a, b, c) for a, b, c in itertools.product((0, 5, 50), (3, 60, 300), (1, 20, 90))
             if min(_trunc_triple_py(a, b, c, 100)) >= 0]
    df = spark.createDataFrame(cases, "a int, b int, c int")
    got = df.select("a", "b", "c", P.triple_cuts(F.col("a"), F.col("b"), F.col("c"), 100).alias("k")).collect()
    assert len(got) > 10
    for r in got:
        assert (r["k"]["a"], r["k"]["b"], r["k"]["c"]) == _trunc_triple_py(r["a"], r["b"], r["c"], 100)
    assert _trunc_triple_py(50, 300, 20, 196) == (50, 126, 20)


def test_marker_split(spark):
    text = "a\n\nassert x\nb\nassert y\n   \nc"
    df = spark.createDataFrame([(1, text), (2, "only\nplain"), (3, "assert first\nz")], "id long, t string")
    got = {(r["id"], r["split_no"]): r["split_test"] for r in L.marker_split(df, "id", "t", "assert").collect()}
    assert got[(1, 0)] == "a\nassert x\n}"
    assert got[(1, 1)] == "a\nb\nassert y\n}"
    assert got[(1, 2)] == "a\nb\nc"
    assert got[(2, 0)] == "only\nplain"
    assert got[(3, 0)] == "assert first\n}" and got[(3, 1)] == "z"


def test_distinct_lines(spark):
    t1 = "h1\nh2\nshared\nmine\nmine\nend"
    t2 = "h1\nh2\nshared\nother\nend"
    t3 = "x\ny\nz"
    df = spark.createDataFrame([(0, "p", 0, t1), (1, "p", 0, t2), (2, "p", 0, t3)],
                               "row_idx long, project string, bug_num long, t string")
    got = {r["row_idx"]: r["d"] for r in L.distinct_line_counts(df, ["project", "bug_num"], "row_idx", "t", "d")
           .collect()}
    assert got == {0: 1, 1: 1, 2: 0}


def test_repair_files_range_anti_join(spark):
    code = ["import a;", "import b;", "class X {", "@Test", "  public void t1() throws Throwable {", "  x();", "  }",
            "@Test", "  public void t2() throws Throwable {", "  y();", "  }", "}", "tail"]
    files = spark.createDataFrame([(0, "\n".join(code)), (1, "import a;\n}")], "file long, text string")
    sig = r"\s*public\s+void\s+(\S+)\(\)\s+throws\s+Throwable\s+\{\s*"
    errors = spark.createDataFrame([(0, 1), (0, 2), (0, 5), (0, 12)], "file long, err_idx long")
    out = {r["file"]: r["kept"] for r in L.repair_files(files, errors, "file", "text", sig).collect()}
    kept = [z["line_idx"] for z in out[0]]
    assert [z["line"] for z in out[1]] == ["import a;", "}"]
    # import b (idx 1) dropped, class line kept, method t1 (3..6) dropped, t2 kept, tail kept
    assert kept == [0, 2, 7, 8, 9, 10, 11, 12]


def test_exception_classification_and_negative(spark):
    tests = [
        "@Test public void t() { x(); assertThrows(E.class, () -> foo.bar(1)); }",
        "@Test(expected = IllegalStateException.class) public void t() { x(); }",
        "@Test public void t() { try { a(); fail(\"x\"); } catch(E e) { } }",
        "@Test public void t() { int v = a(); assertEquals(1, v); }",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tests)], "id long, t string")
    got = {r["id"]: (r["k"], r["n"]) for r in df.select(
        "id", CT.exception_kind("t").alias("k"), CT.normalize_exception_test("t").alias("n")).collect()}
    assert got[0] == ("assertThrows", "@Test public void t() { x(); foo.bar(1); }\n")
    assert got[1][0] == "expected" and "expected" not in got[1][1]
    assert got[2] == ("fail_catch", "@Test public void t() { a(); }\n")
    assert got[3] == ("none", "@Test public void t() { a(); }")


def test_outcome_flags_and_labels(spark):
    from verdict.operators import triggers as TR
    tests = spark.createDataFrame([("p", 1, "A::t1"), ("p", 1, "A::t2"), ("p", 1, "A::t3")],
                                  "project string, bug_num long, test_name string")
    blocks = spark.createDataFrame(
        [("p", 1, 0, " A::t1\njava.lang.IllegalStateException: x\n at"), ("p", 1, 1, " A::t2\nlib.Other\n at"),
         ("p", 1, 2, " A::t1\njunit.framework.AssertionFailedError\n at")],
        "project string, bug_num long, block_pos long, block string")
    b = TR.parse_blocks(blocks)
    fixed = b.filter(F.col("block_pos") == 2)
    out = {r["test_name"]: r for r in TR.outcome_flags(tests, b, fixed).collect()}
    assert out["A::t1"]["failed_buggy"] and out["A::t1"]["FP"]
    assert not out["A::t2"]["failed_buggy"] and out["A::t2"]["TN"]
    assert out["A::t1"]["buggy_test_trace"].startswith(" A::t1\njunit")  # last block wins
    for r in out.values():
        assert sum([r["TP"], r["FP"], r["TN"], r["FN"]]) == 1


def test_expected_type_rules(spark):
    rows = [
        (0, "assertTrue(s.isEmpty())", "public int f(int n) {"),            # boolean
        (1, "assertEquals(3, x)", "public String f() {"),                   # int literal
        (2, "assertEquals(2.5F, x)", "public String f() {"),                # float literal
        (3, 'assertEquals("a", x)', "public int f() {"),                    # String literal
        (4, "assertNotNull(x)", "public Cart(int n) {"),                    # constructor name
        (5, "assertEquals(y, x)", "protected static List<String> f() {"),  # return type
        (6, "assertEquals(y, x + 1)", "public int f() {"),                  # not a variable -> dropped
        (7, "assertSame(y, x)", "public int f() {"),                        # kind not accepted -> dropped
        (8, "assertEquals(a, b, c)", "public int f() {"),                   # middle arg keeps its blank -> dropped
    ]
    df = spark.createDataFrame(rows, "id long, a string, f string")
    got = {r["id"]: r["t"] for r in CT.with_expected_type(df, "a", "f", "t").collect()}
    assert got == {0: "boolean", 1: "int", 2: "float", 3: "String", 4: "Cart", 5: "List<String>",
                   6: None, 7: None, 8: None}


def test_exception_forms_that_do_not_fit(spark):
    rows = [(0, "@Test public void t() { x(); assertThrows(E.class, cart::size); }"),
            (1, "@Test public void t() { try { fail(\"x\"); } catch(E e) { } }"),
            (2, "@Test public void t() { assertThatThrownBy(() -> a.b(c(1))).isInstanceOf(E.class); }"),
            (3, "@Test public void t() { r(); // no Exception here\n }")]
    df = spark.createDataFrame([(i, t, "int size() {") for i, t in rows], "id long, t string, f string")
    got = {r["id"]: r for r in CT.exception_inputs(df, "t", "f").collect()}
    assert (got[0]["kind"], got[0]["reason"], got[0]["model_test"]) == ("assertThrows", "error", None)
    assert (got[1]["kind"], got[1]["reason"]) == ("fail_catch", "error")
    assert got[2]["model_test"] == "public void testSize() { a.b(c(1)); }" and got[2]["reason"] is None
    assert got[3]["missed"] and not got[2]["missed"] and got[3]["label"] == 0


def test_literal_words_and_casts(spark):
    rows = [("NaN", "float"), ("Infinity", "float"), ("inf", "float"), ("(-Infinity)", "float"), ("nano", None), ("1L", "int"),
            ("\"a\"", "String")]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, a string")
    assert [r["k"] for r in df.select("i", CT.literal_kind("a").alias("k")).orderBy("i").collect()] == [k for _, k in rows]
    c = spark.createDataFrame([("assertEquals((byte)3, x)", []), ("assertEquals((3), x)", []), ("assertEquals((3), x)", ["assertEquals((3), x)"])],
                              "a string, c array<string>")
    assert [r["s"] for r in c.select(CT.strip_cast("a", "c").alias("s")).collect()] == [
        "assertEquals(3, x)", "assertEquals(3, x)", "assertEquals((3), x)"]


def test_counts_of_a_hot_bug(spark):
    """One bug with most of the rows: no window in the plan, right counts."""
    from verdict.operators import features as FT
    df = spark.range(3000).select((F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 50)).alias("bug"), (F.col("id") % 7).alias("v"))
    out = FT.counts_over(df, [(["bug"], "n", None), (["bug", "v"], "m", F.col("v") > 2)])
    assert "Window" not in out._jdf.queryExecution().toString()
    want = {}
    for r in df.collect():
        want[r["bug"]] = want.get(r["bug"], 0) + 1
    assert all(r["n"] == want[r["bug"]] for r in out.collect()) and out.count() == 3000


def test_result_chain_checks(spark):
    from verdict.operators import results as RS
    df = spark.createDataFrame([("p", 1, "a"), ("p", 1, "b")], "project string, bug_num long, x string")
    try:
        O.checked_one_to_one(df, ["project", "bug_num"], "left").collect()
    except Exception as ex:  # noqa: BLE001
        assert "are not unique" in str(ex)
    else:
        raise AssertionError("duplicate keys passed")
    full = spark.createDataFrame([(True, None), (False, None)], "failed_buggy boolean, y string")
    try:
        RS.failed_test_data(full).collect()
    except Exception as ex:  # noqa: BLE001
        assert "has a null" in str(ex)
    else:
        raise AssertionError("a null passed")


def test_pack_variants(spark):
    df = spark.createDataFrame([(["a", "b"], ["c"], ["d"])], "x array<string>, y array<string>, z array<string>")
    end = P.pack(df, ["x", "y"], [0, 1], 8, cls_at_end=True, cls_segment=2).first()
    assert end["input_tokens"] == ["a", "b", "[SEP]", "c", "[SEP]", "[CLS]", "[PAD]", "[PAD]"]
    assert end["segment_ids"] == [0, 0, 0, 1, 1, 2, 0, 0] and end["input_mask"] == [1] * 6 + [0] * 2
    left = P.pack(df, ["x", "y", "z"], [0, 1, 2], 10, pad_on_left=True, pad_segment=4).first()
    assert left["input_tokens"] == ["[PAD]", "[PAD]", "[CLS]", "a", "b", "[SEP]", "c", "[SEP]", "d", "[SEP]"]
    assert left["segment_ids"] == [4, 4, 0, 0, 0, 0, 1, 1, 2, 2] and left["input_mask"] == [0, 0] + [1] * 8


def test_positional_join_without_padding(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "i long, a string")
    b = spark.createDataFrame([(0, "p")], "i long, b string")
    assert O.positional_join(a, b, "i", pad=False).count() == 1 and O.positional_join(a, b, "i").count() == 2


def test_features_refuse_names_and_types(spark):
    from verdict.operators import features as FT
    df = spark.createDataFrame([("1", " ")], "except_pred string, assert_pred string")
    for name in ("focal_name", "trace_exception_type"):
        try:
            FT.add_features(df, [name])
        except ValueError as ex:
            assert "not numeric" in str(ex)
        else:
            raise AssertionError(name)


def test_metrics_dedup_and_checks(spark):
    from verdict.operators import checks as CK
    from verdict.operators import metrics as M
    rows = [("s", 1, "p", 0, 5, True, False), ("s", 1, "p", 0, 5, True, False), ("s", 1, "p", 0, 6, False, True)]
    df = spark.createDataFrame(rows, "system string, run int, project string, bug_num long, test long, tp boolean, fp boolean").withColumns(
        {"tn": F.lit(False), "fn": F.lit(False)})
    assert M.outcome_metrics(df, ["system", "run"]).first()["tps"] == 2
    assert M.outcome_metrics(df, ["system", "run"], dedup=["project", "bug_num", "test"]).first()["tps"] == 1
    rep = M.outcome_metrics(df, ["system", "run"])
    assert not M.mean_over_runs(rep, ["system"], "run", ["tps"], [1, 2]).first()["complete"]  # a run is missing everywhere
    assert M.mean_over_runs(rep, ["system"], "run", ["tps"], [1]).first()["complete"]
    a = spark.createDataFrame([(0, 5), (1, 6), (2, 7)], "r long, idx long")
    b = spark.createDataFrame([(0, 5), (1, 9)], "r long, idx long")
    assert tuple(CK.index_mismatches(a, b, "r", "idx").first()) == ("same_index", 2)
