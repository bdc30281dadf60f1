"""The pipeline against a brute-force version of its stages."""

from __future__ import annotations

import collections

import pytest

import corpus_pipeline
from verdict.llm import op2_quality, op3_mixing, op8_decontaminate
from verdict.llm.op8_decontaminate import budget, normal

from llm_cases import WORD, brute_groups, brute_set, brute_targets, edit_distance, edited, prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    item = prose(900, 40)
    passage = prose(901, 70)
    texts = [prose(i, 60 + 5 * i) for i in range(20)]
    texts += [texts[3], edited(texts[4], 1, 1), texts[5] + " " + passage, passage + "\n" + prose(30, 50), prose(31, 40) + " " + item + " " + prose(32, 40),
              "too short", None, "", "line\n" * 40, "### " * 30, prose(33, 30) + item.replace(" ", "  ") + "."]
    rows = [(i, t, "en", None if i % 5 == 4 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    return rows, [(0, item), (1, prose(950, 30))]


def cut(rows):
    """Passages of 100 bytes at a smaller (id, start) go; ASCII texts."""
    place, out = {}, {}
    for d, t in rows:
        for i in range(len(t) - 99):
            place.setdefault(t[i:i + 100], (d, i))
    for d, t in rows:
        gone = set()
        for i in range(len(t) - 99):
            if place[t[i:i + 100]] < (d, i):
                gone.update(range(i, i + 100))
        out[d] = "".join(c for i, c in enumerate(t) if i not in gone)
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, items = corpus()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_against_brute_force(spark, folder):
    rows, items = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality rules"](spark, docs, folder)
    good = {r.doc_id for r in op2_quality.apply_policy(op2_quality.ledger(docs)).filter("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == good and set(range(20)) <= good
    assert good.isdisjoint({25, 26, 27, 28, 29})

    now = [r for r in rows if r[0] in good]
    one = stages["near duplicates"](spark, kept, folder)
    group = brute_groups([brute_set(r[1]) for r in now])
    now = [r for i, r in enumerate(now) if group[i] == i]
    assert {r.doc_id for r in one.collect()} == {r[0] for r in now}
    assert {20, 21}.isdisjoint({r[0] for r in now})

    texts = cut([(r[0], r[1]) for r in now])
    rest = stages["repeated passages"](spark, one, folder)
    assert {r.doc_id: (r.text, r.n_chars) for r in rest.collect()} == {d: (t, len(t)) for d, t in texts.items()}

    clean = stages["decontamination"](spark, rest, folder)
    leaks = {d for d, t in texts.items() for _, item in items
             if edit_distance(normal(item), normal(t)) <= budget(len(normal(item)))}
    assert leaks and {r.doc_id for r in clean.collect()} == set(texts) - leaks
    assert kept.columns == one.columns == rest.columns == clean.columns == docs.columns

    mixed = stages["source mix"](spark, clean, folder).collect()
    size = {d: len(WORD.findall(texts[d])) for d in set(texts) - leaks}
    sources = {r[0]: r[3] for r in rows}
    sums = collections.Counter()
    for d, n in size.items():
        sums[sources[d]] += n
    targets = brute_targets(sums)
    assert {r.doc_id: r.size for r in mixed} == size
    for r in mixed:
        assert r.target == pytest.approx(targets[r.source]) and r.source_size == sums[r.source]


def test_run_is_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, docs.collect()))


def test_stages_on_no_rows_and_extra_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "'x' as d", "1 as spans", "2.0 as taken", "'k' as kept")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert out.count() > 0
        assert stage(spark, docs.limit(0), folder).count() == 0
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, docs, folder).count() == docs.count()
    assert op3_mixing.mix(docs.limit(0)).count() == 0
    assert op8_decontaminate.drop_leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == docs.count()
