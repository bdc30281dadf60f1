"""TF-IDF cosine similarity fitted per group (bug) over packed term vectors.

Corpus of a group = its distinct focal methods + distinct docstrings + all test
prefixes + all generated tests. Tokens: lower-cased runs of two or more word
characters, minus a stop-word table. idf = ln((1 + n) / (1 + df)) + 1, raw term
counts, L2-normalised vectors; similarity = dot product.

There is no (document, token) table. Texts become sorted arrays of 64-bit token hashes inside
the task that reads them; what is shuffled is one count per (group, token) and task, and one packed
vector per row, which meets its group's document frequencies in a sorted stream. A group with many
rows is cut into parts by token and by row, so a hot group is many tasks; which groups those are
(at most ``HEAVY`` of them) is all that the driver sees.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import written

TOKEN = re.compile(r"\w\w+")  # Unicode word characters, two at least
#: Rows of a group dealt to one task, groups that may have more, and the most token parts of a group.
BLOCK_ROWS, HEAVY, TOKEN_PARTS = 20_000, 10_000, 16


@lru_cache(maxsize=1)
def english_stop_words() -> tuple[str, ...]:
    """Spark's default English stop-word list (exported from StopWordsRemover)."""
    path = os.path.join(os.path.dirname(os.path.dirname(__file__)), "resources", "stopwords_en.txt")
    with open(path, encoding="utf-8") as f:
        return tuple(w for w in f.read().split("\n") if w)


class _Terms:
    """text -> its token hashes; the hash of a token is remembered while the table stays small."""

    def __init__(self, stop: Sequence[str]):
        import xxhash

        self.digest, self.known, self.stop = xxhash.xxh3_64_intdigest, {}, dict.fromkeys(stop)

    def __call__(self, text: str | None) -> list[int]:
        if len(self.known) > 500_000:
            self.known.clear()
        found, known = TOKEN.findall((text or "").lower()), self.known
        for w in set(found).difference(known):
            known[w] = None if w in self.stop else self.digest(w) - (1 << 63)
        return [h for h in map(known.__getitem__, found) if h is not None]


def _count_documents(stop: Sequence[str]):
    """(group, text) -> (group, token or null, documents); null counts the documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(stop)
        for b in batches:
            counts: dict[int, Counter] = {}
            for g, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                mine = counts.setdefault(g, Counter())
                mine.update(set(terms(text)))
                mine[None] += 1
            for g, mine in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(mine), pa.int64()), pa.array(mine.keys(), pa.int64()),
                                                  pa.array(mine.values(), pa.int64())], names=["_g", "token", "n"])
    return run


def _parts_of(plan: dict[int, tuple[int, int]], g: int) -> tuple[int, int]:
    return plan.get(g, (1, 1))


_STREAM = "_g long, part int, kind int, {id} {type}, tokens binary, counts binary, more binary, n long"


def _frequencies(plan: dict[int, tuple[int, int]], id_name: str, id_type: pa.DataType):
    """Document frequencies packed per (group, part): every part of the rows gets its tokens' counts and the number of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, n = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            token, whole = b.column(1).fill_null(0).to_numpy(zero_copy_only=False), b.column(1).is_null().to_numpy(zero_copy_only=False)
            order, rows = np.argsort(g, kind="stable"), []
            for at in np.split(order, np.nonzero(np.diff(g[order]))[0] + 1) if len(order) else ():
                key = int(g[at[0]])
                by_token, by_row = _parts_of(plan, key)
                docs = n[at[whole[at]]]
                at = at[~whole[at]]
                slot = token[at].astype(np.uint64) % np.uint64(by_token)
                for t in range(by_token):
                    mine = at[slot == t]
                    for r in range(by_row):
                        if len(mine):
                            rows.append((key, t * by_row + r, 0, token[mine].tobytes(), n[mine].tobytes(), None))
                        if len(docs):
                            rows.append((key, t * by_row + r, 0, b"", b"", int(docs.sum())))
            if rows:
                g_, part, kind, tokens, counts, n_ = zip(*rows)
                yield _stream_batch(g_, part, kind, pa.nulls(len(rows), id_type), tokens, counts, [None] * len(rows), n_, id_name)
    return run


def _stream_batch(g, part, kind, ids, tokens, counts, more, n, id_name) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(g, pa.int64()), pa.array(part, pa.int32()), pa.array(kind, pa.int32()), ids, pa.array(tokens, pa.binary()), pa.array(counts, pa.binary()),
         pa.array(more, pa.binary()), pa.array(n, pa.int64())], names=["_g", "part", "kind", id_name, "tokens", "counts", "more", "n"])


def _vectors(plan: dict[int, tuple[int, int]], stop: Sequence[str], id_name: str):
    """(group, id, text, text, hash of the id) -> the distinct tokens of both texts and how often each text has them, per part of the group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(stop)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                some, at, rows = b.slice(lo, 1000), [], []
                for i, (g, a, c, h) in enumerate(zip(*(some.column(k).to_pylist() for k in (0, 2, 3, 4)))):
                    left, right = terms(a), terms(c)
                    if not left or not right:
                        continue  # the product is zero
                    token, group = np.unique(np.array(left + right, np.int64), return_inverse=True)
                    x, y = np.bincount(group[:len(left)], minlength=len(token)), np.bincount(group[len(left):], minlength=len(token))
                    by_token, by_row = _parts_of(plan, g)
                    slot, r = token.astype(np.uint64) % np.uint64(by_token), h % by_row
                    for t in range(by_token):
                        mine = slice(None) if by_token == 1 else slot == t
                        if len(token[mine]):
                            at.append(i)
                            rows.append((g, t * by_row + r, 1, token[mine].tobytes(), x[mine].astype("<u4").tobytes(), y[mine].astype("<u4").tobytes(), None))
                if rows:
                    g_, part, kind, tokens, x_, y_, n_ = zip(*rows)
                    yield _stream_batch(g_, part, kind, some.column(1).take(pa.array(at)), tokens, x_, y_, n_, id_name)
    return run


def _products(id_name: str):
    """A stream sorted by (group, part, kind): frequencies first, then the rows' vectors -> partial products of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, token, idf = None, [], None, None
        for b in batches:
            out, at = [], []
            cols = [b.column(k).to_pylist() for k in (0, 1, 2, 4, 5, 6, 7)]
            for i, (g, part, kind, tokens, counts, more, n) in enumerate(zip(*cols)):
                if (g, part) != key:
                    key, held, token = (g, part), [], None
                if kind == 0:
                    held.append((tokens, counts, n))
                    continue
                if token is None:  # every count of a token of a group comes from one row of the count table
                    token, df = (np.frombuffer(b"".join(h[k] for h in held), "<i8") for k in (0, 1))
                    order = np.argsort(token)
                    idf = np.log((1 + sum(h[2] or 0 for h in held)) / (1 + df[order])) + 1
                    token, held = token[order], []
                w = idf[np.searchsorted(token, np.frombuffer(tokens, "<i8"))]
                x, y = np.frombuffer(counts, "<u4") * w, np.frombuffer(more, "<u4") * w
                out.append((g, float(x @ y), float(x @ x), float(y @ y)))
                at.append(i)
            if out:
                g_, xy, xx, yy = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(g_, pa.int64()), b.column(3).take(pa.array(at)), pa.array(xy), pa.array(xx), pa.array(yy)],
                                                 names=["_g", id_name, "xy", "xx", "yy"])
    return run


def tfidf_scores(df: DataFrame, group: Sequence[str], id_col: str,
                 parts: Sequence[tuple[str, str, bool]], left: str, right: str, out: str = "sim",
                 stop_words: Sequence[str] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(``_g``, id, ``out``) of the rows with tokens in both texts; see ``tfidf_similarity``. ``_g`` is the group's hash."""
    stop = tuple(stop_words if stop_words is not None else english_stop_words())
    column = {tag: col for tag, col, _ in parts}
    base = df.withColumn("_g", F.xxhash64(*group)).filter(" AND ".join(f"`{c}` IS NOT NULL" for c in group))
    each = [F.col(col) for _, col, distinct in parts if not distinct]
    docs = [base.select("_g", F.explode(F.array(*each)).alias("text"))] if each else []
    for _, col, distinct in parts:
        if distinct:
            docs.append(base.groupBy("_g", F.md5(col).alias("_md5")).agg(F.any_value(col).alias("text")).select("_g", "text"))
    corpus = docs[0]
    for d in docs[1:]:
        corpus = corpus.unionByName(d)
    counts = written(corpus.mapInArrow(_count_documents(stop), "_g long, token long, n long").groupBy("_g", "token").agg(F.sum("n").alias("n")), "term-counts")
    sizes = base.groupBy("_g").agg(F.count(F.lit(1)).alias("rows"))
    total = base.select(F.count(F.lit(1))).first()[0]
    most = max(block_rows, -(-total // HEAVY))
    plan = {}
    for g, n in sizes.filter(F.col("rows") > most).collect():  # fewer than HEAVY groups
        blocks = -(-n // most)
        by_token = min(blocks, TOKEN_PARTS)
        plan[g] = (by_token, -(-blocks // by_token))
    id_type = df.schema[id_col].dataType.simpleString()
    schema = _STREAM.format(id=f"`{id_col}`", type=id_type)
    arrow_id = to_arrow_type(df.schema[id_col].dataType)
    stream = (counts.mapInArrow(_frequencies(plan, id_col, arrow_id), schema)
              .unionByName(base.select("_g", id_col, column[left], F.col(column[right]).alias("_right"), F.xxhash64(id_col)).mapInArrow(_vectors(plan, stop, id_col), schema)))
    products = (stream.repartition("_g", "part").sortWithinPartitions("_g", "part", "kind")
                .mapInArrow(_products(id_col), f"_g long, `{id_col}` {id_type}, xy double, xx double, yy double"))
    return products.groupBy("_g", id_col).agg(F.round(F.sum("xy") / F.sqrt(F.sum("xx") * F.sum("yy")), 6).alias(out))


def tfidf_similarity(df: DataFrame, group: Sequence[str], id_col: str,
                     parts: Sequence[tuple[str, str, bool]], left: str, right: str, out: str = "sim",
                     stop_words: Sequence[str] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``out`` = cosine of the TF-IDF vectors of two texts of each row, with the
    vectorizer fitted per group on a corpus built from the rows.

    ``parts``: (tag, text column, distinct) -- the corpus takes every row's text of
    that column (``distinct=False``) or each distinct text once per group
    (``distinct=True``). ``left`` / ``right`` are tags of two parts. ``id_col`` names a row of its group.
    Rows with a null in the group, and rows with a text without a token, get 0.
    """
    sims = tfidf_scores(df, group, id_col, parts, left, right, out, stop_words, block_rows)
    return _with_scores(df, group, id_col, sims, out)


def _with_scores(df: DataFrame, group: Sequence[str], id_col: str, sims: DataFrame, out: str) -> DataFrame:
    keyed = df.withColumn("_g", F.xxhash64(*group))
    return keyed.join(sims, ["_g", id_col], "left").select(*df.columns, out).fillna(0.0, [out])


# The corpus of the test-docstring similarity feature.
FEATURE_CORPUS = [("f", "focal_method", True), ("d", "docstring", True), ("p", "test_prefix", False),
                  ("t", "generated_test", False)]


def test_doc_similarity(df: DataFrame, group: Sequence[str], id_col: str, out: str = "test_doc_sim", onto: DataFrame | None = None) -> DataFrame:
    """The ``test_doc_sim`` ranking feature: generated test vs docstring, added to the rows or to ``onto`` (same groups and ids)."""
    sims = tfidf_scores(df, group, id_col, FEATURE_CORPUS, "t", "d", out)
    return _with_scores(df if onto is None else onto, group, id_col, sims, out)
