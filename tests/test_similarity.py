"""TF-IDF over packed vectors against a plain version: groups of any size, parts, odd rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from verdict.operators import similarity as SIM

GROUP = ["project", "bug_num"]


def brute(rows, stop):
    """{(group, id): similarity}, straight from the definition."""
    def terms(t):
        return Counter(w for w in re.findall(r"\w\w+", (t or "").lower()) if w not in stop)

    groups = defaultdict(list)
    for r in rows:
        if r[0] is not None and r[1] is not None:
            groups[r[0], r[1]].append(r)
    out = {(r[0], r[1], r[2]): 0.0 for r in rows}
    for g, mine in groups.items():
        corpus = [t for t in {r[3] for r in mine}] + [t for t in {r[4] for r in mine}] + [r[5] for r in mine] + [r[6] for r in mine]
        df = Counter(w for t in corpus for w in terms(t))
        idf = {w: math.log((1 + len(corpus)) / (1 + n)) + 1 for w, n in df.items()}
        for r in mine:
            x, y = terms(r[6]), terms(r[4])
            xy = sum(x[w] * y[w] * idf[w] ** 2 for w in x)
            norm = math.sqrt(sum((c * idf[w]) ** 2 for w, c in x.items()) * sum((c * idf[w]) ** 2 for w, c in y.items()))
            out[r[0], r[1], r[2]] = xy / norm if norm else 0.0
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    words = ["cart", "Total", "the", "été", "x", "日本", "item_1", "sum", "of", "straße", "a1"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(rnd.randrange(n)))
    docs = [text(12) for _ in range(5)] + ["", None]
    return [(rnd.choice(["p", "p", "p", "q", None]), rnd.choice([0, 0, 0, 1]), i, text(4), rnd.choice(docs), text(9), rnd.choice([text(20), text(20), "", None, "x . !"]))
            for i in range(400)]


@pytest.mark.parametrize("block_rows", [SIM.BLOCK_ROWS, 40, 7])
def test_matches_plain_version(spark, rows, block_rows):
    """One part a group, and hot groups cut by token and by row."""
    df = spark.createDataFrame(rows, "project string, bug_num long, row_idx long, focal_method string, docstring string, test_prefix string, generated_test string").repartition(5)
    got = SIM.tfidf_similarity(df, GROUP, "row_idx", SIM.FEATURE_CORPUS, "t", "d", "sim", block_rows=block_rows)
    assert got.columns == [*df.columns, "sim"]
    want = brute(rows, set(SIM.english_stop_words()))
    out = {(r.project, r.bug_num, r.row_idx): r.sim for r in got.collect()}
    assert out.keys() == want.keys()
    assert all(abs(out[k] - want[k]) < 1e-6 for k in want) and sum(v > 0.1 for v in want.values()) > 50


def test_string_ids_own_stop_words_and_no_rows(spark, rows):
    df = spark.createDataFrame([(r[0], r[1], f"t{r[2]}", *r[3:]) for r in rows],
                               "project string, bug_num long, row_idx string, focal_method string, docstring string, test_prefix string, generated_test string")
    out = SIM.tfidf_similarity(df, GROUP, "row_idx", SIM.FEATURE_CORPUS, "t", "d", stop_words=["cart", "sum"]).collect()
    want = brute(rows, {"cart", "sum"})
    assert all(abs(r.sim - want[r.project, r.bug_num, int(r.row_idx[1:])]) < 1e-6 for r in out) and len(out) == len(rows)
    assert SIM.tfidf_similarity(df.limit(0), GROUP, "row_idx", SIM.FEATURE_CORPUS, "t", "d").count() == 0
