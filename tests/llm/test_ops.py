"""Operators against brute force and DuckDB, on odd rows and on the smallest tables."""

from __future__ import annotations

import collections
import hashlib
import html as html_lib
import math
import random
import re
import textwrap
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from scripts.check_oracle import rows_of
from verdict.llm import (
    op1_license,
    op2_quality,
    op3_mixing,
    op4_tokens,
    op5_jaccard,
    op6_suffix,
    op7_html,
    op8_decontaminate,
    op9_url,
    op10_language,
    queries,
)
from verdict.llm.components import components
from verdict.llm.shingles import shingle_sets

from llm_cases import APACHE_TEXT, BSD_TEXT, GPL_TEXT, MIT_TEXT, WORD, brute_groups, brute_set, brute_targets, edit_distance, edited, empty, prose

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels")


def run_sql(sql: str, **frames):
    con = duckdb.connect()
    for name, df in frames.items():
        con.register(name, df.toArrow())
    return con.execute(sql)


def same(df, res) -> None:
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())


# ------------------------------------------------------------------ SQL parity

@pytest.mark.parametrize("key", sorted(queries.ORACLE_SQL))
def test_matches_duckdb(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    same(E.queries()[key](spark, SF), con.execute(queries.ORACLE_SQL[key]))


def test_registered():
    names = E.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert "pipeline" in names


def test_bench_times_every_query():
    import bench

    assert bench.to_time(E.queries()) == sorted(E.queries())
    assert bench.to_time(E.queries(), ["pipeline"]) == ["pipeline"]


# ------------------------------------------------------------------ 1 license scan

def test_license_odd_rows(odd_docs):
    same(op1_license.scan(odd_docs), run_sql(op1_license.SQL, documents=odd_docs))
    assert op1_license.scan(empty(odd_docs)).count() == 0


def test_license_rules_take_their_order(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.",
        "LICENSED UNDER THE APACHE LICENSE,\tVersion 2.0!\nReleased under the MIT license.",
        "Some other licence text stands here.\nAll rights reserved.",
        "This license is my own.", "no cue", None,
        "This work is licensed under the GNU General Public License, version 3. Either version 3 of the License, or (at your option) "
        "any later version.",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.sentence_ids, r.licenses, r.license) for r in op1_license.scan(df).collect()}
    assert got[0] == ("APACHE_2,APACHE_LIMITS", "Apache-2.0", "Apache-2.0")
    assert got[1] == ("APACHE_2,MIT_NAME", "MIT,Apache-2.0", "MIT")
    assert got[2] == ("ALL_RIGHTS", "Proprietary", "Proprietary")
    assert got[3] == ("", "", "UNKNOWN")
    assert got[4] == got[5] == ("", "", None)
    assert got[6] == ("GPL_3,GPL_LATER", "GPL-3.0-or-later", "GPL-3.0-or-later")


def wrapped(text: str, leader: str, width: int = 72) -> str:
    lines = [line for part in text.split("\n\n") for line in [*textwrap.wrap(part, width), ""]]
    return "\n".join((leader + line).rstrip() for line in lines)


def test_license_published_texts(spark):
    """Full texts, unwrapped, wrapped and behind comment leaders; lines that end without a stop; near misses."""
    texts = {"MIT": MIT_TEXT, "BSD-3-Clause": BSD_TEXT, "Apache-2.0": APACHE_TEXT, "GPL-3.0-or-later": GPL_TEXT}
    rows, want = [], []
    for name, text in texts.items():
        for form in (text, wrapped(text, ""), wrapped(text, "# "), wrapped(text, " * "), wrapped(text, "// ", 40), wrapped(text, "").replace("\n", "\r\n"),
                     text.replace("the copyright holder nor", "Example Labs Inc. nor")):
            rows.append(form)
            want.append(name)
    for text, name in (("// SPDX-License-Identifier: MIT\n#include <a.h>", "MIT"), ("By somebody\nAll rights reserved\nmore", "Proprietary"),
                       ("This work is in the public\ndomain.", "CC0-1.0"), ("spdx-license-identifier: MIT OR Apache-2.0", "UNKNOWN"),
                       ("released under the\n\nMIT license", "UNKNOWN"), (GPL_TEXT.replace("version 3", "version 2"), "UNKNOWN"),
                       ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", "GPL-3.0")):
        rows.append(text)
        want.append(name)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in op1_license.scan(df).collect()}
    assert [got[i].license for i in range(len(rows))] == want
    assert {got[i].sentence_ids for i in range(6)} == {"MIT_GRANT,MIT_NOTICE,NO_WARRANTY"}
    assert {got[i].sentence_ids for i in range(7, 14)} == {"ALL_RIGHTS,BSD_REDIST,BSD_3,NO_WARRANTY"}


def test_license_table_is_checked():
    with pytest.raises(ValueError):
        op1_license._check({"A": ("Not Normal",)})
    with pytest.raises(ValueError):
        op1_license._check({"A": ("no word that the scan looks for",)})


# ------------------------------------------------------------------ 2 quality

def brute_quality(text):
    w = WORD.findall(text or "")
    wins = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    count, covered = collections.Counter(wins), set()
    for i, x in enumerate(wins):
        if count[x] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(odd_docs):
    led = op2_quality.apply_policy(op2_quality.ledger(odd_docs)).collect()
    want = sorted(brute_quality(r.text) for r in odd_docs.select("text").collect())
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in led) == want
    for r in led:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert op2_quality.ledger(empty(odd_docs)).count() == 0


def test_quality_sql_on_odd_rows(odd_docs):
    same(op2_quality.apply_policy(op2_quality.ledger(odd_docs)), run_sql(op2_quality.SQL, documents=odd_docs))


def test_quality_stage_follows_the_ledger(plain_docs):
    """keep_good keeps the documents whose stored bits the policy lets pass, for every policy."""
    led = op2_quality.ledger(plain_docs)
    for policy in op2_quality.POLICIES:
        want = sorted(r.doc_id for r in op2_quality.apply_policy(led, policy).filter("kept").collect())
        got = op2_quality.keep_good(plain_docs, policy)
        assert got.columns == plain_docs.columns and sorted(r.doc_id for r in got.collect()) == want


def test_quality_policy_and_ablation(odd_docs):
    led = op2_quality.ledger(odd_docs)
    rows = led.collect()
    v1 = op2_quality.apply_policy(led, "v1").filter("kept").count()
    v2 = op2_quality.apply_policy(led, "v2").filter("kept").count()
    assert v1 == sum(not r.fail_bits & op2_quality.mask(op2_quality.BASE) for r in rows) >= v2
    for r in op2_quality.ablation(led).collect():
        bit = op2_quality.bit(r.rule)
        assert r.n_failed == sum(bool(x.fail_bits & bit) for x in rows)
        assert r.n_sole == sum(x.fail_bits == bit for x in rows)


def test_quality_stage_keeps_what_the_ledger_keeps(odd_docs):
    kept = op2_quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == op2_quality.apply_policy(op2_quality.ledger(odd_docs)).filter("kept").count()


# ------------------------------------------------------------------ 3 mixing

def test_mixing(odd_docs):
    rows = op3_mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    sizes, taken, longest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in odd_docs.select("source", "text").collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    for r in rows:
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
    targets = brute_targets(sizes)
    for r in rows:
        assert r.target == pytest.approx(targets[r.source])
        assert abs(taken[r.source] - r.target) <= longest[r.source] / 2 + 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, op3_mixing.mix(odd_docs).collect()))
    assert op3_mixing.mix(empty(odd_docs)).count() == 0


def test_mixing_sql_on_odd_rows(plain_docs):
    same(op3_mixing.mix(plain_docs), run_sql(op3_mixing.SQL, documents=plain_docs))


def test_mixing_cuts_crowded_ranges(spark):
    """Keys that crowd at one end (texts of symbols), one key many times, and ranges cut down to a row give the same rows as SQL."""
    texts = ["# $ % & " * 3 if i % 3 else f"word {i} " * (i % 7 + 1) for i in range(300)]
    docs = spark.createDataFrame([(i if i < 280 else 5, t, None if i % 11 == 0 else "ab"[i % 5 == 0]) for i, t in enumerate(texts)],
                                 "doc_id long, text string, source string").repartition(4)
    for split_rows, buckets in ((op3_mixing.SPLIT_ROWS, op3_mixing.BUCKETS), (1, 4), (20, 2), (1, 4096)):
        same(op3_mixing.mix(docs, split_rows=split_rows, buckets=buckets), run_sql(op3_mixing.SQL, documents=docs))


def test_mixing_fills_sources_up(spark):
    df = spark.createDataFrame([(1, "big", "w " * 1000), (2, "a", "w w"), (3, None, "w w w w")], "doc_id long, source string, text string")
    got = {r.source: r.target for r in op3_mixing.mix(df).collect()}
    assert got == pytest.approx(brute_targets({"big": 1000, "a": 2, None: 4}))
    assert max(got["a"] / 2, got["big"] / 1000, got[None] / 4) <= 2 + 1e-9


def test_mixing_prefers_quality():
    heavy = [-math.log(1 - u) / 1.0 for u in np.linspace(0.01, 0.99, 50)]
    light = [-math.log(1 - u) / 0.2 for u in np.linspace(0.01, 0.99, 50)]
    assert np.median(heavy) < np.median(light)


# ------------------------------------------------------------------ 4 tokens

@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return public_tokenizers.path("byte_bpe_50k.json"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_tokens_as_the_library(spark, odd_docs, tokenizer):
    path, lib = tokenizer
    rnd = random.Random(4)
    alphabet = "ab'stré 1٣²  \n\t\u00a0!?日😀\u0301<|endoftext|>"
    fuzz = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(400)]
    extra = ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "   lead", "trail   ", "don't can'T it's 'll", "\n\n\n x", "a" * 5000]
    texts = [r.text for r in odd_docs.select("text").collect()] + extra + fuzz
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in op4_tokens.count_tokens(df, path).collect()}
    for i, t in enumerate(texts):
        want = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes) == (want, len((t or "").encode())), t
        assert got[i].over_limit == (want > 512)
    assert op4_tokens.count_tokens(empty(df), path).count() == 0


def test_whole_tokens_are_single(tokenizer):
    path, lib = tokenizer
    v = op4_tokens.Vocabulary(path)
    assert len(v.whole) > 40_000
    for t in random.Random(1).sample(sorted(v.whole), 500):
        assert len(lib.encode(t, add_special_tokens=False).ids) == 1


# ------------------------------------------------------------------ 5 Jaccard

def test_shingles_are_sets():
    texts = [t.encode() for t in ("", "a b", "A  b", "a b c d e", "a b c d e f", "b a", " a b c d\te ", "x " * 9, prose(4, 700))]
    row, h = shingle_sets(texts)
    got = [frozenset(h[row == i].tolist()) for i in range(len(texts))]
    want = [brute_set(t.decode()) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(got[i] & got[j]) == len(want[i] & want[j])
    long = (prose(5, 300_000)).encode()  # over one segment
    row, h = shingle_sets([b"q", long, b"q"])
    assert np.bincount(row).tolist() == [1, len(brute_set(long.decode())), 1]


def test_overlap_bound_is_a_bound():
    rnd = np.random.default_rng(3)
    for n, m, c in ((5, 5, 4), (100, 110, 90), (700, 900, 10), (2000, 2000, 1990), (64, 70, 0)):
        h = rnd.integers(0, 2 ** 64, n + m - c, dtype=np.uint64)
        a, b = h[:n], h[n - c:]
        bound = op5_jaccard.overlap_bound(op5_jaccard.signature(a), op5_jaccard.signature(b), n, m)
        assert bound >= c
        if c == 10:
            assert bound < 500


def test_jaccard_groups(spark, odd_texts):
    texts = list(odd_texts)
    for s in range(12):  # chains: each a little further from the first
        base = prose(100 + s, 120 + 10 * s)
        for step in range(6):
            texts.append(base)
            base = edited(base, 1000 + 10 * s + step, 2 + s % 3)
    df = spark.createDataFrame([(i, t, "clash", 3) for i, t in enumerate(texts)], "doc_id long, text string, v string, n int").repartition(4)
    sets = [brute_set(t) for t in texts]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op5_jaccard.join_report(df).collect()}
    assert got == {i: (len(s), g) for i, (s, g) in enumerate(zip(sets, brute_groups(sets)))}
    assert op5_jaccard.join_report(empty(df)).count() == 0


def test_jaccard_tiles_of_any_size(spark):
    """Blocks of two rows find the pairs that one block finds."""
    rows = [(h, r, 20 + (r * 7) % 30, r % 3, r % 5) for h in (1, 2) for r in range(25)]
    df = spark.createDataFrame(rows, "h long, r long, n long, i int, c long")
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[4] != b[4] and 4 * max(a[2], b[2]) <= 5 * min(a[2], b[2])
            and 9 * min(a[2] - a[3], b[2] - b[3]) >= 4 * (a[2] + b[2])}
    for size in (2, 7, 4096):
        t = op5_jaccard.tiles(df, size).repartition(3, "tile").sortWithinPartitions("tile")
        got = {tuple(r) for r in t.mapInArrow(op5_jaccard.tile_pairs, "a long, b long").collect()}
        assert got == want


def test_jaccard_repeated_and_null_ids(odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    sets = [brute_set(r.text) for r in rows]
    group = brute_groups(sets)
    least = {}
    for r, g in zip(rows, group):
        if r.doc_id is not None:
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    want = sorted(str((r.doc_id, len(s), r.doc_id if not s else least.get(g))) for r, s, g in zip(rows, sets, group))
    assert sorted(str(tuple(r)) for r in op5_jaccard.join_report(odd_docs).collect()) == want
    kept = op5_jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    kept = [brute_set(r.text) for r in kept.collect()]
    assert len(kept) == sum(not s for s in sets) + len({g for g, s in zip(group, sets) if s})


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (200, 200)]
    random.Random(2).shuffle(links)
    got = {r.v: r.c for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100, 200: 200}


# ------------------------------------------------------------------ 6 suffix dedup

def brute_dedup(rows):
    """[(id, bytes)] -> [(id, n_bytes, n_removed, n_spans, sha256)]: strings at a smaller (id, start); null ids last."""
    place = {}
    key = lambda d: (d is None, d or 0)
    for d, t in rows:
        for i in range(len(t) - 99):
            w = t[i:i + 100]
            if w not in place or (key(d), i) < place[w]:
                place[w] = (key(d), i)
    out = []
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - 99):
            if place[t[i:i + 100]] < (key(d), i):
                gone[i:i + 100] = b"\1" * 100
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup(plain_docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in plain_docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op6_suffix.dedup_report(plain_docs).collect()), key=str) == brute_dedup(rows)
    assert op6_suffix.dedup_report(empty(plain_docs)).count() == 0


def test_suffix_dedup_repeated_and_null_ids(odd_docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in odd_docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op6_suffix.dedup_report(odd_docs).collect()), key=str) == brute_dedup(rows)


def test_suffix_segments_do_not_matter(monkeypatch, odd_texts):
    texts = [(t or "").encode() for t in odd_texts]
    whole = op6_suffix.anchors(texts)
    monkeypatch.setattr(op6_suffix, "SEGMENT", 700)
    cut = op6_suffix.anchors(texts)
    pairs = lambda x: sorted(zip(*(c.tolist() for c in x)))
    assert pairs(whole) == pairs(cut)


def test_every_string_has_an_anchor(odd_texts):
    for t in odd_texts:
        t = (t or "").encode()
        _, pos, _, _ = op6_suffix.anchors([t])
        pos = np.sort(pos)
        start = np.arange(max(0, len(t) - 99))
        nearest = np.searchsorted(pos, start)
        assert (nearest < len(pos)).all() and (pos[nearest] - start <= op6_suffix.LEFT).all()


def test_suffix_stage_cuts_whole_characters(plain_docs):
    cut = op6_suffix.cut_documents(plain_docs, length_col="n_chars")
    assert cut.columns == plain_docs.columns
    before = {r.doc_id: r.text for r in plain_docs.collect()}
    report = {r.doc_id: r for r in op6_suffix.dedup_report(plain_docs).collect()}
    for r in cut.collect():
        if not report[r.doc_id].n_removed:
            assert r.text == before[r.doc_id]
        else:
            assert len(r.text.encode()) - (report[r.doc_id].n_bytes - report[r.doc_id].n_removed) in range(0, 6 * report[r.doc_id].n_spans + 1)
            assert r.n_chars == len(r.text)


# ------------------------------------------------------------------ 7 html

def test_html_article():
    page = """<!DOCTYPE html><html><head><title>t &amp; t</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
    <main><article><h1>Head &lt;1&gt;</h1><p>First&nbsp;  para <b>bold</b>graph &eacute;&#33;<br>next<p>unclosed <!-- no <p> --> end
    <div class="ad-box"><p>buy</p></div><form><input name=a>send</form><p>x < y &amp &copy; &am</p><aside>side</aside></article>
    <section id="comments"><article class="c"><p>nice</p></article></section></main><footer>foot</footer></body></html>"""
    has, blocks = op7_html.blocks_of(page)
    assert has
    assert op7_html.article_text(blocks).split("\n") == ["Head <1>", "First para boldgraph é!", "next", "unclosed end", "x < y & © &am"]


@pytest.mark.parametrize("inner, want", [
    ("<p>a</p><script>var x=1;", "a"), ("<p>a</p><style>p { }<p>b</p>", "a"), ("<p>a<script>x</p><b>y</script>b</p>", "ab"), ("<p>a<textarea>b<p>c", "a"),
    ("<p>a <span class='ad'>buy <span>this</span> now</span> b</p>", "a b"), ("<p class=notice>old<p>a</p>", "a"), ("<p class=\"notice\">old</p>a<p>b</p>", "a\nb"),
    ("<p>a</p><div hidden><p>b</p></div><p>c</p>", "a\nc"), ("<p hidden>b<p>c", "c"), ("<p style='color:red; DISPLAY : none'>b</p><p>c</p>", "c"),
    ("<h1 class=header>a</h1><p data-x='hidden' title=\"is hidden here\">b</p>", "a\nb"), ("<p>a<a class='related'>b</a></p>", "ab"), ("<header><h1>h</h1></header><p>a</p>", "a"),
    ("<p>a <i class=ad>x</p><p>b</p></div><p>c</i> d</p>", "a\nd"), ("<p>a<img class=ad>b<br class=ad />c", "ab\nc"), ("<ul><li class=ads>x<li>a</ul>", "a"), ("<table><td class=ad>x<ul><li>y</ul><td>a</table>", "a"), ("<ul><li class=ads>x<ul><li>y</ul></li><li>a</ul>", "a"),
    ("<button>a<button>b<p>c</p>", "ab\nc"), ("<p>a<button>go</button >b", "ab"), ("<p>a</p><p id=cookie-notice>n</p><blockquote>q</blockquote>", "a\nq"),
])
def test_html_elements(inner, want):
    has, blocks = op7_html.blocks_of(f"<nav>menu</nav><article>{inner}")
    assert has and op7_html.article_text(blocks) == want


@pytest.mark.parametrize("piece", ["<button>", "<script", "<svg>x", "<p hidden>", "<span class=ad>", "<div class=ad>", "</div>", "<a href='", "<!-", "&", "<select><p>", "<div class=ad></b>", "<span class=ad></div>", "<li class=ad>", "<div hidden>"])
def test_html_many_unclosed_tags(piece):
    """16,000 of them in one page take a second at most."""
    start = time.monotonic()
    op7_html.blocks_of("<article><p>a</p>" + piece * 16_000 + "<p>b</p></article>")
    assert time.monotonic() - start < 1


def test_html_odd_pages(spark):
    body = "<article><p>the text</p></article>"
    pages = [None, "", "<", "<p", body, body, "<nav><p>never closed " + body, "<!-- open <article>a</article>", "<ARTICLE>a<SCRIPT>b</SCRIPT></ARTICLE>",
             "<article>" + "<p>long word </p>" * 20_000, "plain text only", "<article><p a='>'>q</p><p b=\"x>y\">r</p>"]
    df = spark.createDataFrame([(i if i != 5 else 4, None if i == 1 else "http://h.org/", p, "clash") for i, p in enumerate(pages)],
                               "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text) for r in op7_html.extract(df).collect())
    want = {0: "", 1: "", 2: "<", 3: "", 4: "the text", 6: "the text", 7: "", 8: "a", 9: "\n".join(["long word"] * 20_000),
            10: "plain text only", 11: "q\nr"}
    assert got == sorted([*want.items(), (4, "the text")])
    assert all(r.n_chars == len(r.text) for r in op7_html.extract(df).collect())
    assert op7_html.extract(empty(df)).count() == 0


def test_html_host_runs(spark):
    """Without an article element, what other pages of the host repeat goes; other hosts don't count."""
    line = "read more from our friends today and tomorrow"
    rows = [(i, f"http://{'a' if i < 4 else 'b'}.org/{i}", f"<div>{line}</div><div>{prose(i, 30)}</div><nav>home news about us all</nav>") for i in range(5)]
    got = {r.page_id: r.text for r in op7_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        lines = [" ".join(prose(i, 30).split())]
        assert got[i].split("\n") == (lines if i < 4 else [line, *lines])


def test_html_large_host_keeps_articles(spark):
    """Without an article element: shared phrases, a shared passage and a copied article stay, boilerplate goes."""
    menu, notice, passage = "home news", prose(900, 30).replace("\n", " "), prose(901, 40).replace("\n", " ")
    phrase = "on the other hand it is"
    body = lambda i: [f"{prose(i, 25)} {phrase} {prose(i + 400, 25)}", prose(i + 800, 30) + (f" {passage}" if i < 3 else "")]
    page = lambda i: f"<div>{menu}</div>" + "".join(f"<div>{x}</div>" for x in body(i)) + f"<div>{notice}</div>"
    rows = [(i, f"http://big.org/{i}", page(i)) for i in range(60)]
    rows += [(60 + k, f"http://big.org/copy{k}", rows[5][2]) for k in range(100)]  # 100 copies are one page
    rows += [(200 + k, f"http://two.org/{k}", page(6)) for k in range(2)]
    rows += [(300, "http://big.org/c", page(7).replace(menu, "<!-- <article> --><script><article></script>" + menu))]  # no article element
    got = {r.page_id: r.text for r in op7_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    flat = lambda i: [" ".join(x.split()) for x in body(i)]
    assert len(got) == len(rows)
    for i in range(60):
        assert got[i].split("\n") == flat(i)
    assert {got[60 + k] for k in range(100)} == {"\n".join(flat(5))}
    assert {got[200], got[201]} == {"\n".join([menu, *flat(6), " ".join(notice.split())])}
    assert got[300].split("\n") == flat(7)


def test_html_marked_pages_use_the_hosts_repeats(spark):
    """Pages that mark an article: it loses whole blocks of what the host repeats outside articles. Passages and copies that
    articles share, a quoted boilerplate string and an article that a sidebar quotes stay."""
    flat = lambda seed, n: " ".join(prose(seed, n).split())
    notice, passage, lead = flat(950, 30), flat(951, 40), flat(952, 30)
    body = lambda i: [lead if i == 4 else flat(i, 30), passage, flat(i + 200, 25) + (f" {notice} so they say" if i == 5 else "")]
    page = lambda i, n, parts: "<nav>home</nav><article>" + "".join(f"<p>{x}</p>" for x in parts) + f"</article><aside>{lead}</aside><footer>{n} {notice}</footer>"
    rows = [(i, f"http://h.org/{i}", page(i, i, [*body(i), *([notice] if i < 3 else [])])) for i in range(8)]
    rows += [(20 + i, f"http://h.org/copy{i}", page(6, 20 + i, body(6))) for i in range(30)]
    rows += [(60 + i, f"http://two.org/{i}", page(i, i, [*body(i), notice])) for i in range(2)]
    got = {r.page_id: r.text.split("\n") for r in op7_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: body(i) for i in range(8)} | {20 + i: body(6) for i in range(30)} | {60 + i: [*body(i), notice] for i in range(2)}


def test_html_notice_in_every_article(spark):
    """Without a mark of its own, too: nine in ten of the host's articles, ten at least; copies of an article count once,
    near copies stay whole."""
    flat = lambda seed, n: " ".join(prose(seed, n).split())
    notice, passage = flat(950, 30), flat(951, 40)
    page = lambda i, parts: f"<nav>home {i}</nav><article>" + "".join(f"<p>{x}</p>" for x in parts) + "</article>"
    body = lambda i: [flat(i, 30), *([passage] if i < 16 else []), flat(i + 200, 35)]
    rows = [(i, "http://h.org/", page(i, [*body(i), *([notice] if i else [])])) for i in range(20)]
    rows += [(30 + i, "http://h.org/", page(30 + i, body(0))) for i in range(20)]
    rows += [(60 + i, "http://nine.org/", page(i, [*body(i), notice])) for i in range(9)]
    near = lambda i: [flat(500, 60), flat(501, 60) + f" edit {i}", f"{i} more"]
    rows += [(80 + i, "http://near.org/", page(i, near(i))) for i in range(15)]
    got = {r.page_id: r.text.split("\n") for r in op7_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == ({i: body(i) for i in range(20)} | {30 + i: body(0) for i in range(20)} | {60 + i: [*body(i), notice] for i in range(9)}
                   | {80 + i: near(i) for i in range(15)})


def test_html_suffix_array():
    rnd = random.Random(7)
    codes = op7_html.np.array([rnd.randrange(1, 4) for _ in range(400)] + [1] * 30)
    order, rank = op7_html.suffix_array(codes, 20)
    prefix = [codes[i:i + 20].tolist() for i in range(len(codes))]
    assert [prefix[i] for i in order] == sorted(prefix)
    assert all((rank[i] == rank[k]) == (prefix[i] == prefix[k]) for i in range(0, 430, 3) for k in range(430))


def _html_repeats(pages, least):
    """Brute force: {key: pages} of blocks and RUN-token strings of pages (lists of streams)."""
    held = {}
    for k, streams in enumerate(pages):
        for s in streams:
            words = s.replace("\n", " ").split(" ")
            for u in [op7_html._hash(t, b"block") for t in s.split("\n") if t] + [
                    int(op7_html._run_keys(words[i:i + op7_html.RUN])[0]) for i in range(len(words) - op7_html.RUN + 1)]:
                held.setdefault(u, set()).add(k)
    return {u: len(k) for u, k in held.items() if len(k) >= least}


def test_html_repeated_strings():
    parts = [" ".join(prose(i, 12).split()) for i in range(6)]
    rnd = random.Random(3)
    pages = [["\n".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 7))) for _ in range(rnd.randrange(1, 3))] for _ in range(40)]
    for least in (1, 3, 20):
        assert op7_html.repeated_strings(pages, least) | op7_html.repeated_blocks(pages, least) == _html_repeats(pages, least)
    once = [["x " * 50 + "x"]]
    assert op7_html.repeated_strings(once, 1) | op7_html.repeated_blocks(once, 1) == _html_repeats(once, 1)
    assert op7_html.repeated_strings([[""], [""]], 1) == {}


@pytest.mark.parametrize("chunk_pages", [3, 2_000])
def test_html_chunks_of_a_host(spark, monkeypatch, chunk_pages):
    """The boilerplate of a host is the same in how many chunks ever it is counted."""
    monkeypatch.setattr(op7_html, "CHUNK_PAGES", chunk_pages)
    flat = lambda seed, n: " ".join(prose(seed, n).split())
    rnd = random.Random(11)
    lines = [(flat(700 + k, 24), share) for k, share in enumerate((0.3, 0.4, 0.45, 0.5, 0.5, 0.55, 0.6, 0.9, 1))] + [("short line", 0.52), ("other line", 0.48)]
    pages = [[x for x, share in lines if rnd.random() < share] + [flat(i, 25)] for i in range(45)]
    pages += pages[:5]  # the same pages again
    rows = [(i, "http://big.org/", "".join(f"<div>{x}</div>" for x in p)) for i, p in enumerate(pages)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = set(_html_repeats([["\n".join(p)] for p in pages[:45]], 22.5))
    found = [(r.host, r.unit) for r in op7_html.boilerplate(df.withColumn("host", op7_html._host(df.url)).fillna("", ["html"])).collect()]
    assert sorted(found) == sorted(("big.org", u) for u in want) and len(want) > 20


def test_html_as_a_plain_parser(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    pages = {r.page_id: r.html for r in df.collect()}
    for r in op7_html.extract(df).collect():
        inner = re.search("<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        parts = [" ".join(html_lib.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?p>|<br>|</?h1>", inner)]
        assert r.text == "\n".join(x for x in parts if x)


# ------------------------------------------------------------------ 8 decontamination

def test_myers_is_the_distance():
    rnd = random.Random(8)
    for _ in range(60):
        item = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 90)))
        text = "".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 120)))
        assert op8_decontaminate.Pattern(item).best(text)[0] == edit_distance(item, text)


def test_leaks(spark):
    rnd = random.Random(9)
    items = [(0, prose(50, 30)), (1, prose(51, 60)), (2, None), (3, "short"), (4, prose(50, 30)), (5, prose(52, 12)), (6, " Ten  chars"), (7, "a"), (8, " \n"), (9, "(x)"), (10, prose(53, 4)[:31])]
    texts = [None, "", prose(60, 500), "SHORT", "shorts", "a-short one", "ashort short9 shor t", "ten\nchars.", "often chars ten charset", "a", "(x)y", "q " + prose(53, 4)[:31]]
    for i, item in items:
        for edits in (0, 1, 3, 6, 10, 25):
            if item and len(item) > 31:
                t = list(item)
                for _ in range(edits):
                    k = rnd.randrange(len(t))
                    t[k:k + 1] = rnd.choice([[], ["q"], [t[k], "w"]])
                texts.append(prose(70 + i, 40) + "\n " + "".join(t).upper().replace(" ", "\n") + " " + prose(80 + edits, 20))
    texts.append(items[1][1][:100])
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in enumerate(texts):
        for i, item in items:
            n = op8_decontaminate.normal(item)
            if 0 < len(n) < 32 and re.search(("(?<![^\\W_])" if n[0].isalnum() else "") + re.escape(n) + ("(?![^\\W_])" if n[-1].isalnum() else ""), op8_decontaminate.normal(t)):
                want.add((d, i, 0))
            if len(n) >= 32 and (dist := edit_distance(n, op8_decontaminate.normal(t))) <= op8_decontaminate.budget(len(n)):
                want.add((d, i, dist))
    assert 10 < len(want) < len(texts) * 4 and {i for _, i, _ in want} == {0, 1, 3, 4, 5, 6, 7, 9, 10}
    for size in (10, 4_000_000):  # many blocks, one block
        assert {tuple(r)[:3] for r in op8_decontaminate.find_leaks(docs, bench, block_chars=size).collect()} == want
        kept = op8_decontaminate.drop_leaks(docs, bench, block_chars=size)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _, _ in want}
    assert {r.item_id for r in op8_decontaminate.find_leaks(docs, bench, least_chars=32).collect()} == {0, 1, 4, 5}
    assert op8_decontaminate.find_leaks(docs, empty(bench)).count() == 0
    assert op8_decontaminate.find_leaks(empty(docs), bench).count() == 0


# ------------------------------------------------------------------ 9 urls

def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "https://A.Example.ORG/es/1?x#y", "http://example.org/en/12", "http://notexample.org/es/", "http://x.com",
            "http://x.com/fr/", "http://x.com/de/a", "http://cheap-pills.net/a", "http://cheap-pillsx.net/a", "http://a.net/free/win", "http://a.net/freedom/win",
            "ftp://u@h.net:80/p?q=http://org/", "http://a.org?x", "http://org/", "http://b.net/" + "casino" * 3, "http://b.net/CASINO", "a://b://c.org/d"]
    df = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, weight int")
    same(op9_url.judge(df), run_sql(op9_url.SQL, pages=df))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op9_url.judge(df).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[4] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[5][2:] == ("example.org/en/1", "block") and got[6][2:] == ("org/", "allow")
    assert got[7][2:] == (None, "allow") and got[8][2:] == ("com/fr/", "allow") and got[9][2:] == ("com/de/", "block")
    assert [got[i][3] for i in (10, 11, 12, 13)] == ["block", "allow", "block", "allow"]
    assert got[14][:2] == ("u@h.net:80", "/p") and got[15][1:3] == ("", None)
    assert got[17][3] == "allow" and got[18][3] == "block"
    assert op9_url.judge(empty(df)).count() == 0


# ------------------------------------------------------------------ 10 language

def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = op10_language.fit(docs.filter("doc_id % 2 = 0"))
    held = docs.filter("doc_id % 2 = 1 and n_chars > 60")
    wrong = n = 0
    for r in held.collect():
        n += 1
        wrong += model.languages[int(op10_language.evidence(model.log, r.text).argmax())] != r.lang
    assert n > 300 and wrong <= 0.02 * n


def test_language_model_does_not_depend_on_the_deal(spark):
    """The same sample and model after any repartition, with or without ids, and about the bound of rows."""
    rows = [(i, prose(i, 30), ["en", "fr", None][i % 3]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for some in (df, df.drop("doc_id")):
        a, b, c = (op10_language.fit(d, train_rows=100) for d in (some.repartition(1), some.repartition(7), some.orderBy(F.desc("text"))))
        assert a.languages == b.languages == ["en", "fr"] and np.array_equal(a.log, b.log) and np.array_equal(a.log, c.log)
        assert not np.array_equal(a.log, op10_language.fit(some).log)


def brute_language(rows, model):
    """Rows (text evidence, said, suffix, domain, host) -> posterior scores, by plain loops."""
    k, langs = op10_language.STRENGTH, model.languages
    post = [np.exp(e - e.max()) / np.exp(e - e.max()).sum() for e, *_ in rows]
    out = []
    for n, (e, said, *levels) in enumerate(rows):
        p = (sum(post) - post[n] + k / len(langs)) / (len(rows) - 1 + k)
        for i, x in enumerate(levels):
            own = [q for m, q in enumerate(post) if rows[m][2 + i] == x and m != n]
            p = (sum(own, np.zeros(len(langs))) + k * p) / (len(own) + k)
        words = {r[1] for r in rows}
        seen = sum((q for m, q in enumerate(post) if rows[m][1] == said), np.zeros(len(langs)))
        out.append(e - e.max() + np.log(p) + np.log((seen + k) / (sum(post) + k * len(words))))
    return out


def test_language_fusion(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = op10_language.fit(docs)
    text = {x: next(r.text for r in docs.filter(f"lang = '{x}' and n_chars > 400").take(1)) for x in model.languages}
    page = lambda lang, t: f'<html lang="{lang}"><body><article><p>{t}</p></article></body></html>'
    rows = [(i, f"http://{'de' if i % 3 else 'fr'}.site.org/{i}", page(x, text[x][:300])) for i, x in enumerate(["de", "de", "fr", "en"] * 5) if x in text]
    rows += [(50, "http://de.site.org/x", page("de", "")), (51, None, None), (52, "http://new.net/", ""), (None, "x", "<p>" + text["en"][:200]),
             (53, "http://de.site.org/", page("xx", "zzz")), (53, "http://de.site.org/", page("xx", "zzz"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lang", op10_language.F.lit("clash"))
    got = op10_language.identify(df, model).collect()
    plain = []
    for _, url, html in rows:
        shown = " ".join(t for place, t in op7_html.blocks_of(html or "")[1] if place != op7_html.FURNITURE)
        m = re.search(r"://([^/?#]*)", url or "")
        host = m[1].lower() if m else ""
        d = re.search(r'lang="([a-z]+)"', html or "")
        said = "" if not d else d[1] if d[1] in model.languages else "?"
        plain.append((op10_language.evidence(model.log, shown), said, host.split(".")[-1], ".".join(host.split(".")[-2:]), host))
    want = []
    for f, (i, *_), r in zip(brute_language(plain, model), rows, plain):
        want.append((str(i), model.languages[int(f.argmax())], round(float(1 / np.exp(f - f.max()).sum()), 6), r[4]))
    assert sorted((str(r.page_id), r.lang, round(r.confidence, 6), r.host) for r in got) == sorted(want)
    assert op10_language.identify(empty(df), model).count() == 0


def test_language_declared_after_a_long_start(spark):
    """The html tag may start anywhere: after a long comment, licence block or white space."""
    tag = '<HTML class="a"\n lang="De-at"><body><p>x</p>'
    pages = [tag, "<!-- " + prose(1, 2000) + " -->\n" + tag, " \n" * 50_000 + tag, "<!DOCTYPE html>" + "<!-- a -->" * 3000 + tag, "<p>" + prose(2, 2000), None]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    got = df.select("page_id", op10_language.declared_of(op10_language.F.col("html")).alias("d")).collect()
    assert [r.d for r in sorted(got)] == ["de"] * 4 + ["", ""]


def test_language_without_labels(spark):
    none = spark.createDataFrame([(None, "text"), ("en", None)], "lang string, text string")
    model = op10_language.fit(none)
    df = spark.createDataFrame([(1, "http://a.b", "<p>x")], "page_id long, url string, html string")
    assert [r.lang for r in op10_language.identify(df, model).collect()] == [None]
