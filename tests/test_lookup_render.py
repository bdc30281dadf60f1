"""Candidate generation, first-match lookup, superclass walk, brace spans,
imports/template, isolation forest: fixtures vs plain-Python semantics."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from verdict.operators import lookup as LK
from verdict.operators import outlier as OUT
from verdict.operators import render as RD


def _gen_variants_py(_type, arg, vars_, vocab):
    values = list(vocab.get(_type, [])) + list(vars_)
    out = []
    for v in values:
        if v == arg.strip():
            continue
        out.append(f"assertEquals({v}, {arg.strip()})")
    if _type in ("bool", "boolean"):
        out += [f"assertTrue({arg.strip()})", f"assertFalse({arg.strip()})"]
    elif _type not in ("int", "float", "double"):
        out.append(f"assertNotNull({arg.strip()})")
    return set(out)


def test_generate_candidates(spark):
    vocab = {"String": ['""', '"a"'], "int": ["0", "1", "-1"]}
    vdf = spark.createDataFrame([(t, i + 1, v) for t, vs in vocab.items() for i, v in enumerate(vs)],
                                "type string, rank int, value string")
    tests = [(0, "String", "s", ["t", "s", "u"]), (1, "int", "n", ["1", "m"]), (2, "bool", "b", []),
             (3, "Foo", "f", ["g", "g"])]
    tdf = spark.createDataFrame(tests, "id long, type string, arg string, vars array<string>")
    got = {}
    for r in LK.generate_candidates(tdf, vdf, "id", "type", "arg", "vars").collect():
        got.setdefault(r["id"], []).append((r["cand_order"], r["candidate"]))
    for tid, typ, arg, vs in tests:
        cands = [c for _, c in sorted(got[tid])]
        assert set(cands) == _gen_variants_py(typ, arg, vs, vocab)
        assert len(cands) == len(set(cands))
    # vocabulary first, in rank order
    assert [c for _, c in sorted(got[1])][:2] == ["assertEquals(0, n)", "assertEquals(1, n)"]


def test_first_match_priority(spark):
    names = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (2, "zz", 0), (3, "a", 0)],
                                  "id long, name string, name_pos long")
    classes = spark.createDataFrame([(1, "C", 0), (1, "P", 1), (2, "C", 0), (3, "P", 1), (3, "C", 0)],
                                    "id long, class string, depth int")
    decls = spark.createDataFrame([("C", "a", 1, 5, "C.a()"), ("P", "b", 1, 1, "P.b()"), ("C", "b", 1, 9, "C.b()"),
                                   ("C", "b", 0, 20, "new C.b"), ("P", "a", 0, 0, "P.a")],
                                  "class string, name string, kind_order int, decl_pos long, text string")
    decls = decls.withColumn("doc", F.concat(F.lit("doc of "), "text"))
    rows = LK.first_match(names, classes, decls, "id").collect()
    got = {r["id"]: r["text"] for r in rows}
    assert all(r["doc"] == "doc of " + r["text"] for r in rows)
    # test 1: name 'b' first; own class C before P; constructor (kind 0) before method
    assert got == {1: "new C.b", 3: "C.a()"}


def test_superclass_chain(spark):
    classes = spark.createDataFrame(
        [("A", "B", True), ("B", "C", True), ("C", "D", False), ("D", None, False), ("E", "Missing", True),
         ("F", "A", True)], "class string, extends string, imported boolean")
    got = sorted(tuple(r) for r in LK.superclass_chain(classes).collect())
    assert got == [("A", "B", 1), ("A", "C", 2), ("B", "C", 1), ("F", "A", 1), ("F", "B", 2), ("F", "C", 3)]


def test_superclass_chain_has_no_limit(spark):
    n = 81
    rows = [(f"C{i}", f"C{i + 1}" if i < n - 1 else None, True) for i in range(n)] + [("X", "Y", True), ("Y", "X", True), ("Z", "X", True)]
    got = LK.superclass_chain(spark.createDataFrame(rows, "class string, extends string, imported boolean")).collect()
    chain = [tuple(r) for r in got if r["class"].startswith("C")]
    assert len(chain) == n * (n - 1) // 2 and ("C0", "C80", 80) in chain
    # a cycle gives each ancestor once
    assert sorted(tuple(r) for r in got if not r["class"].startswith("C")) == [
        ("X", "X", 2), ("X", "Y", 1), ("Y", "X", 1), ("Y", "Y", 2), ("Z", "X", 1), ("Z", "Y", 2)]


def test_import_lines_and_template(spark):
    text = "package p;\nimport a.B;\n  import c.D;  \n@RunWith(X.class)\nimport late.E;\nclass T {}"
    df = spark.createDataFrame([(text,)], "t string")
    imps = df.select(RD.import_lines("t").alias("i")).first()["i"]
    assert imps == ["import a.B;", "import c.D;"]
    extra = df.select(RD.extra_imports(F.array(F.lit("import org.junit.Test;"), F.lit("import z.Y;"),
                                               F.lit("import a.B;"))).alias("e")).first()["e"]
    assert extra == ["import a.B;", "import z.Y;"]
    r = df.select(RD.render_template(F.lit("pkg"), F.array(F.lit("import a.B;")), F.lit("Foo"),
                                     F.lit("@Test public void t() {}")).alias("r")).first()["r"]
    assert r.startswith("package pkg;") and "import a.B;" in r and "class Foo_ESTest extends Foo_ESTest_scaffolding" in r
    assert "{" + "TEST_CASES}" not in r


def test_isolation_forest_planted_outlier(spark):
    rng = np.random.default_rng(1)
    rows = []
    for bug in range(3):
        for i in range(60):
            feats = rng.integers(0, 4, size=3).astype(float).tolist()
            if i == 7:
                feats = [50.0, 60.0, 70.0]
            rows.append(("p", bug, bug * 1000 + i, *feats))
    df = spark.createDataFrame(rows, "project string, bug_num long, row_idx long, a double, b double, c double")
    ranked = OUT.isolation_rank(df, ["project", "bug_num"], "row_idx", ["a", "b", "c"], seeds=range(4), n_trees=30)
    top = ranked.filter(F.col("rank") == 1).collect()
    hits = sum(1 for r in top if r["row_idx"] % 1000 == 7)
    assert len(top) == 12 and hits >= 11
    again = OUT.isolation_rank(df, ["project", "bug_num"], "row_idx", ["a", "b", "c"], seeds=range(4), n_trees=30)
    a = sorted((r["bug_num"], r["seed"], r["row_idx"], r["rank"]) for r in ranked.collect())
    b = sorted((r["bug_num"], r["seed"], r["row_idx"], r["rank"]) for r in again.collect())
    assert a == b  # same seeds -> same ranking


def test_isolation_blocks_and_partitions(spark):
    """Any block size and any deal of the rows give the same scores; ids may be strings."""
    rng = np.random.default_rng(2)
    rows = [("p", 0, f"t{i}", *rng.normal(size=2).tolist()) for i in range(300)]
    rows[13] = ("p", 0, "t13", 40.0, -40.0)
    df = spark.createDataFrame(rows, "project string, bug_num long, row_idx string, a double, b double")
    run = lambda deal=df, **k: {(r["row_idx"], r["seed"]): r["mean_path"] for r in OUT.isolation_scores(
        deal, ["project", "bug_num"], "row_idx", ["a", "b"], seeds=[0, 1], n_trees=20, **k).collect()}
    one, many = run(), run(block_rows=64)
    assert one == many == run(df.repartition(7)) and len(one) == 600
    assert min(one, key=one.get)[0] == "t13"
    assert run(max_samples=40) == run(df.repartition(5), max_samples=40) != one


def test_isolation_draws_over_the_whole_bug(spark):
    """Rows beyond the first 4,096 by id hash shape trees, and every path length is that of a plain forest over all rows."""
    ids = spark.range(6000).select(F.col("id"), F.xxhash64("id").alias("h")).orderBy("h", "id").collect()
    value = {r["id"]: float(k if k >= 4096 else 0) for k, r in enumerate(ids)}
    df = spark.createDataFrame([("p", 0, i, v) for i, v in value.items()], "project string, bug_num long, row_idx long, a double")
    scored = OUT.isolation_scores(df, ["project", "bug_num"], "row_idx", ["a"], seeds=[0, 1], n_trees=8).collect()
    got = {(r["seed"], r["row_idx"]): r["mean_path"] for r in scored}
    assert len(got) == 12000
    x, h = np.array([[value[r["id"]]] for r in ids]), np.array([r["h"] for r in ids])
    name = df.limit(1).select(F.to_json(F.struct("project", "bug_num")).alias("g")).first()["g"]
    for seed in (0, 1):
        u = OUT.priorities(h, seed, np.arange(8))
        picks = np.argsort(u, axis=0)[:256].T  # the whole column sorted: no limit, no merge
        assert all(len(set(p)) == 256 for p in picks.tolist()) and picks.max() >= 4096
        assert (np.sort(u, axis=0)[255] < OUT.sample_limit(np.array([6000]), 256)).all()
        growth = int(np.random.default_rng([seed, zlib.crc32(name.encode())]).integers(2 ** 62))
        plain = OUT.mean_path(x, OUT.pack_forest(OUT.grow_forest(x[picks.ravel()], np.repeat(np.arange(8), 256), growth)), 8)
        assert [got[seed, r["id"]] for r in ids] == plain.tolist()
        assert len(set(plain.tolist())) > 100


def test_forests_travel_packed():
    """Features, splits, children and leaf paths come back from the packed form; two trees, one of them a single leaf."""
    x = np.random.default_rng(5).normal(size=(41, 3))
    nodes = OUT.grow_forest(x, np.repeat([0, 1], [40, 1]), 9)
    feature, split, left, path = OUT.unpack_forest(OUT.pack_forest(nodes), 2)
    order = np.argsort(nodes["node"])
    inner = feature >= 0
    assert inner.any() and not inner[1]
    assert (feature == nodes["feature"][order]).all() and (left == nodes["left"][order]).all()
    assert (left[inner] + 1 == nodes["right"][order][inner]).all() and (split == nodes["split"][order]).all()
    assert (path[~inner] == (nodes["depth"] + OUT.avg_path_length(nodes["size"]))[order][~inner].astype("f4")).all()


def test_isolation_repeated_ids(spark):
    """Rows that share an id are scored one by one: one row out per row and seed; an empty table gives no rows."""
    rows = [("p", None if i % 2 else 1, i % 10, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "project string, bug_num long, row_idx long, a double")
    got = OUT.isolation_scores(df, ["project", "bug_num"], "row_idx", ["a"], seeds=[0, 1], n_trees=4)
    assert got.count() == 80 and got.filter("bug_num is null").count() == 40
    assert OUT.isolation_scores(df.limit(0), ["project", "bug_num"], "row_idx", ["a"], seeds=[0], n_trees=4).count() == 0


def test_priorities_are_uniform():
    """Shares of rows below a quarter, and no two trees or seeds alike."""
    h = np.random.default_rng(3).integers(-2 ** 62, 2 ** 62, 20_000)
    u = np.concatenate([OUT.priorities(h, s, np.arange(10)) for s in (0, 1, 9)], axis=1)
    assert np.abs((u < 2.0 ** 62).mean(axis=0) - 0.25).max() < 0.015
    corr = np.corrcoef(u.astype(float).T)
    assert np.abs(corr - np.eye(30)).max() < 0.04
