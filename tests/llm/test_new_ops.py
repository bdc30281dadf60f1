"""Operators 11 to 13 against the library, DuckDB and brute force, on odd rows and on the smallest tables."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as E
from verdict.llm import op11_bpe, op12_phrases, op13_runs

from llm_cases import WORD, empty, prose
from test_ops import SF, run_sql, same


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_registered():
    assert {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in E.queries() if n.startswith("op") and n[2].isdigit()}


# ------------------------------------------------------------------ 11 BPE

@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def wanted(library, text):
    e = library.encode(text or "", add_special_tokens=False)
    return e.ids, library.decode(e.ids, skip_special_tokens=False)


@pytest.fixture(scope="module")
def fuzzed():
    rnd = random.Random(3)
    odd = "aAéÉß ΣσςİıΏ\x85 \x1c'sdlvemr!?12½日本😀͸՘́Å<|endoftext|>  \n\t\x00"
    return ["", "it's we'll THEY'RE '' ''s 'S", "<|endoftext|>", "a<|endoftext|><|startoftext|>b <|endoftext", "ΟΔΟΣ ΑΣ.", "x" * 20_000,
            "café CAFÉ", *("".join(rnd.choice(odd) for _ in range(rnd.randrange(50))) for _ in range(1500))]


@pytest.mark.parametrize("frequent", [op11_bpe.FREQUENT, 40, 0])
def test_bpe_matches_the_library(spark, path, library, fuzzed, frequent):
    """All words sent, few of them, none: the joined ids are the same."""
    df = spark.createDataFrame(list(enumerate(fuzzed)), "doc_id long, text string").repartition(4)
    rows = op11_bpe.decode(op11_bpe.encode(df, path, frequent=frequent), path).collect()
    assert len(rows) == len(fuzzed)
    for r in rows:
        assert (list(r.ids), r.decoded) == wanted(library, fuzzed[r.doc_id])


def test_bpe_odd_rows(odd_docs, path, library):
    want = []
    for r in odd_docs.collect():
        ids, text = wanted(library, r.text)
        want.append((r.doc_id, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(text.encode())))
    for frequent in (op11_bpe.FREQUENT, 3):
        got = [tuple(r) for r in op11_bpe.report(odd_docs, path, frequent=frequent).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert op11_bpe.report(empty(odd_docs), path).count() == 0
    assert op11_bpe.decode(op11_bpe.encode(empty(odd_docs), path), path).columns == ["doc_id", "ids", "decoded"]


def test_bpe_query(spark, library):
    df = E.queries()["op11_bpe_ids"](spark, SF)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = df.collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, text = wanted(library, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(np.array(ids, "<u4").tobytes()), digest(text.encode()))


def test_bpe_words_are_merged_once(spark, path):
    df = spark.createDataFrame([("again again Again",), ("again more",), (None,)], "text string")
    table = op11_bpe.word_table(df.filter("text <> ''"), op11_bpe.Vocabulary(path)).collect()
    assert sorted((r.word, r.n) for r in table) == [("again", 4), ("more", 1)]


def test_bpe_direct_split_is_the_pattern(path):
    vocab, rnd = op11_bpe.Vocabulary(path), random.Random(8)
    coder = op11_bpe.WordCodes((vocab.pattern, vocab.added, vocab.library_parts))
    for _ in range(800):
        texts = ["".join(rnd.choice("aAéÉß sdlvemrt'''!?12½ \x85\xa0µΩİ<") for _ in range(rnd.randrange(25))) for _ in range(rnd.randrange(4))]
        words, codes, sizes = coder(texts)
        words, split = words.to_pylist(), [coder.split(t) for t in texts]
        assert [words[c] for c in codes] == [w for s in split for w in s] and list(sizes) == [len(s) for s in split]


def test_bpe_refuses_other_files():
    import public_tokenizers

    with pytest.raises(ValueError):
        op11_bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


# ------------------------------------------------------------------ 12 collocations

@pytest.fixture(scope="module")
def phrase_docs(spark):
    """Texts of few words, so that much reaches the least count; null, empty and blank texts, odd langs, clashing names."""
    rnd, rows = random.Random(4), []
    words = ["a", "b", "B", "c", "dé", "e\x1cf", "日本", "x\x00y"]
    for i in range(240):
        n = rnd.choice([0, 1, 3, 40, 120])
        text = "".join(rnd.choices(words, [9, 5, 4, 3, 2, 1, 1, 1])[0] + rnd.choice([" ", " ", " ", "\t ", ". ", "\n", "\x0b", "!?"]) for _ in range(n))
        rows.append((i % 200, rnd.choice(["en", "en", "en", "fr", None, ""]), rnd.choice([text, text, None]) if n < 4 else text, 1, "p", 2))
    rows += [(1, "de", "The Same Line again and again. " * 3, 1, "p", 2)] * 40 + [(2, None, "und is a lang, too", 1, "p", 2)] * 35 + [(3, "und", "too", 1, "p", 2)]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string, n int, phrase string, rank int").repartition(3)


def test_phrases_match_sql(phrase_docs):
    same(op12_phrases.collocations(phrase_docs), run_sql(op12_phrases.SQL, documents=phrase_docs))
    same(op12_phrases.collocations(empty(phrase_docs)), run_sql(op12_phrases.SQL, documents=empty(phrase_docs)))


@pytest.mark.parametrize("bucket_words, fan_out", [(50, 1 << 12), (40, 4)])
def test_phrases_whatever_the_deal(phrase_docs, bucket_words, fan_out, monkeypatch):
    """Heavy prefixes spread over buckets, and two rounds of dealing."""
    monkeypatch.setattr(op12_phrases, "FAN_OUT", fan_out)
    monkeypatch.setattr(op12_phrases, "HEAVY", 1 << 5)
    same(op12_phrases.collocations(phrase_docs, bucket_words=bucket_words), run_sql(op12_phrases.SQL, documents=phrase_docs))


def test_stripes_compact():
    """Stripes held beyond the limit are added up on the way, to the same counts."""
    import zstandard

    lines, stripes, held = [b"a b", b"a b c", b"a b c d", b"q r s t"], op12_phrases.Stripes(), op12_phrases.HELD
    op12_phrases.HELD = 8
    try:
        for _ in range(50):
            stripes.add(zstandard.compress(b"\n".join(lines)), zstandard.compress(np.array([1, 2, 3, 4], "<i8").tobytes()))
        assert len(stripes.texts) < 10
        words, rows, n = stripes.merged()
    finally:
        op12_phrases.HELD = held
    named = [" ".join(words.to_pylist()[c] for c in r if c >= 0).encode() for r in rows]
    assert dict(zip(named, n.tolist())) == dict(zip(lines, (50, 100, 150, 200)))


def test_phrase_scores_are_exact(spark):
    """Counts near the 64-bit limit would overflow in products; the score expression keeps them whole."""
    a, l, r = 10 ** 17 + 7, 3 * 10 ** 17 + 1, 10 ** 17 + 9
    got = spark.sql(f"SELECT (CAST(2000000 AS DECIMAL(18, 0)) * a) DIV (CAST(l AS DECIMAL(20, 0)) + r) AS s FROM VALUES ({a}L, {l}L, {r}L) t(a, l, r)").first().s
    assert got == 2000000 * a // (l + r)


# ------------------------------------------------------------------ 13 runs

def brute_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return {(s, n, q) for (s, n), q in out.items()}


def brute_report(doc_id, text, plant):
    w = WORD.findall(text or "")
    if plant and doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            digest("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), digest(" ".join(x for i, x in enumerate(w) if i not in drop).encode()))


def test_runs_match_brute_force():
    rnd = random.Random(5)
    for k in range(1500):
        n, a = rnd.randrange(60), rnd.choice([1, 2, 2, 3, 5])
        w = [rnd.randrange(a) for _ in range(n)]
        if k % 2 and n:
            s = rnd.randrange(n)
            p = 1 + (n - s) // rnd.randrange(3, 11)
            w = w[:s] + [w[s + (i - s) % p] for i in range(s, n)]
        want = brute_runs(w)
        assert op13_runs.runs_of(w) == want
        before, after = [rnd.randrange(a) for _ in range(rnd.randrange(9))], w[:5]
        got = set()  # between neighbours of a batch
        for lo, hi in op13_runs.stretches(np.array(before + w + after, np.int64), np.array([0] * len(before) + [1] * n + [2] * len(after))):
            if len(before) <= lo < len(before) + n:
                got |= op13_runs.runs_of(w, lo - len(before), hi - len(before))
        assert got == want


def test_last_occurrences_are_those_of_brute_force():
    """The access gives, for each suffix that stood before, the end of its last occurrence."""
    rnd = random.Random(6)
    for _ in range(300):
        w = [rnd.randrange(3) for _ in range(rnd.randrange(14))]
        got = {}
        for i, e, longest in op13_runs.last_occurrences(w):
            got.setdefault(i, {}).setdefault(e, longest)
        for i in range(len(w)):
            classes = {}
            for n in range(1, i + 2):
                ends = [j for j in range(n - 1, i) if w[j - n + 1:j + 1] == w[i - n + 1:i + 1]]
                if ends:
                    classes[max(ends)] = n
            assert got.get(i, {}) == classes


def test_runs_odd_rows(odd_docs):
    for plant in (None, op13_runs.planted):
        got = [tuple(r) for r in op13_runs.find_runs(odd_docs, plant=plant).collect()]
        want = [brute_report(r.doc_id, r.text, plant) for r in odd_docs.filter("length(text) < 20000 OR text IS NULL").collect()]
        assert not set(want) - set(got) and len(got) == odd_docs.count()
    assert op13_runs.find_runs(empty(odd_docs)).count() == 0


def test_runs_long_texts(spark):
    """Whole texts that repeat: long and short periods, a broken one, one just too short, nested ones."""
    rnd = random.Random(9)
    unit = [f"w{rnd.randrange(300)}" for _ in range(500)]
    cases = [["z"] * 30_000, unit * 40, unit * 4, (unit * 4)[:-1], unit * 3 + ["x"] + unit * 3, (["a"] * 7 + ["b"]) * 5, ["a", "b"] * 3, ["a", "b"] * 4, ["a"] * 5, ["a"] * 6]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli) for r in op13_runs.find_runs(df).collect()}
    assert got == {0: (1, 0, 30_000, 1, 30_000_000), 1: (1, 0, 20_000, 500, 40_000), 2: (1, 0, 2000, 500, 4000), 3: (0, None, None, None, None),
                   4: (0, None, None, None, None), 5: (6, 0, 40, 8, 5000), 6: (0, None, None, None, None), 7: (1, 0, 8, 2, 4000),
                   8: (0, None, None, None, None), 9: (1, 0, 6, 1, 6000)}


def test_runs_query(spark):
    rows = E.queries()["op13_word_runs"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    short = [r for r in docs if len(r.text or "") < 6000]
    got = {r.doc_id: tuple(r) for r in rows}
    assert len(rows) == len(docs) and len(short) > 100
    assert all(got[r.doc_id] == brute_report(r.doc_id, r.text, True) for r in short)
    assert sum(t[1] > 0 for t in got.values()) > len(docs) // 20
