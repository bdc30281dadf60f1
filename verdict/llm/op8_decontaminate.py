"""Benchmark decontamination: pigeonhole edit matching.

Texts and items are compared in normal form (A-Z lower-cased, each run of white characters
one blank, trimmed). An item of m characters may differ by ``budget(m)`` edits (insert, delete,
replace). Cut into budget + 1 pieces, at least one piece of any such occurrence is unchanged,
so an Aho-Corasick automaton of all pieces finds every place to look at; Myers' bit-parallel
distance then decides, over the stretch of text that could hold the item.

Every document is scanned whole, on its own: no shuffle, one Arrow batch in memory. The item
table is the stated query set: it is read in blocks of ``BLOCK_CHARS`` characters, each block
one automaton per task and one pass over the documents.

Items shorter than ``SHORT_CHARS`` in normal form have no budget and match as whole words only: no
letter or digit stands beside them, and no edit is allowed. An item of one ordinary word so matches
every document with that word; ``least_chars`` leaves shorter items out where that is not wanted.

Defined results: null or empty texts match nothing; null items and items without a character in
normal form are left out; equal items
match on their own; repeated documents give rows of their own; an empty item table gives no row.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_RATE = 0.05
PIECE_CHARS = 16
SHORT_CHARS = 32
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return b" ".join((text or "").encode("utf-8", "replace").lower().split()).decode("utf-8")


def budget(m: int, rate: float = ERROR_RATE, piece: int = PIECE_CHARS) -> int:
    """Edits allowed in m characters: a share of m, and few enough for pieces of ``piece`` characters; none in a short item."""
    return 0 if m < SHORT_CHARS else max(0, min(int(m * rate), m // piece - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece): k + 1 contiguous pieces whose lengths differ by one at most."""
    m = len(item)
    cuts = [m * i // (k + 1) for i in range(k + 2)]
    return [(cuts[i], item[cuts[i]:cuts[i + 1]]) for i in range(k + 1)]


def whole_words(text: str, start: int, item: str) -> bool:
    """Whether no letter or digit goes on beyond either end of ``item`` at ``start``."""
    end = start + len(item)
    return not (start and item[0].isalnum() and text[start - 1].isalnum()) and not (
        end < len(text) and item[-1].isalnum() and text[end].isalnum())


class Pattern:
    """Myers' bit vectors of one item (Python integers of any width)."""

    def __init__(self, item: str):
        self.m, self.eq = len(item), {}
        for i, c in enumerate(item):
            self.eq[c] = self.eq.get(c, 0) | 1 << i
        self.ones, self.top = (1 << self.m) - 1, 1 << (self.m - 1)

    def best(self, text: str) -> tuple[int, int]:
        """(least distance of the item to any substring, end of the first such substring)."""
        ones, top, eq = self.ones, self.top, self.eq
        pv, mv, score = ones, 0, self.m
        least, end = score, 0
        for j, c in enumerate(text):
            e = eq.get(c, 0)
            xv = e | mv
            xh = (((e & pv) + pv) ^ pv) | e
            ph = mv | (~(xh | pv) & ones)
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = (ph << 1) & ones  # a free start: nothing enters at the bottom
            mh = (mh << 1) & ones
            pv = mh | (~(xv | ph) & ones)
            mv = ph & xv
            if score < least:
                least, end = score, j + 1
        return least, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        import ahocorasick

        self.items = [(i, t, budget(len(t), rate)) for i, t in items]
        self.patterns: dict[int, Pattern] = {}
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            for offset, piece in pieces(t, k):
                at.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()
        self.any = bool(at)

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, least distance, end in the normal text) of each item within its budget."""
        if not self.any:
            return []
        found: dict[int, tuple[int, int]] = {}
        looked: dict[int, set[int]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for n, offset in places:
                _, item, k = self.items[n]
                start, m = last + 1 - size - offset, len(self.items[n][1])
                if found.get(n, (1, 0))[0] == 0 or start in (seen := looked.setdefault(n, set())):
                    continue
                seen.add(start)
                if start >= 0 and text.startswith(item, start):
                    if m >= SHORT_CHARS or whole_words(text, start, item):
                        found[n] = (0, start + m)
                    continue
                if not k:
                    continue
                if n not in self.patterns:
                    self.patterns[n] = Pattern(item)
                lo = max(0, start - k)
                d, end = self.patterns[n].best(text[lo:start + m + k])
                if d <= k and d < found.get(n, (k + 1, 0))[0]:
                    found[n] = (d, lo + end)
        return [(self.items[n][0], d, end) for n, (d, end) in sorted(found.items())]


def _blocks(items: DataFrame, item_id: str, item_text: str, size: int, least_chars: int) -> Iterator[list[tuple[int, str]]]:
    block, chars = [], 0
    for row in items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).toLocalIterator():
        t = normal(row["t"])
        if len(t) < max(least_chars, 1):
            continue
        block.append((row["i"], t))
        chars += len(t)
        if chars >= size:
            yield block
            block, chars = [], 0
    if block:
        yield block


def find_leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
               item_text: str = "text", rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS, least_chars: int = 1) -> DataFrame:
    """doc_id, item_id, distance, end_pos (in the normal text): one row per document and item it holds."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in _blocks(items, item_id, item_text, block_chars, least_chars):
        shared = df.sparkSession.sparkContext.broadcast(block)  # block_chars characters at most, and one item

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for b in batches:
                rows = [(d, i, dist, end) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                        for i, dist, end in matcher.find(normal(t))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)],
                                                     names=["doc_id", "item_id", "distance", "end_pos"])

        part = docs.mapInArrow(run, "doc_id long, item_id long, distance long, end_pos long")
        out = part if out is None else out.unionByName(part)
    return docs.limit(0).selectExpr("doc_id", "doc_id as item_id", "doc_id as distance", "doc_id as end_pos") if out is None else out


def drop_leaks(df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
               rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS, least_chars: int = 1) -> DataFrame:
    """The input rows, all columns unchanged, without those that hold an item."""
    for block in _blocks(items, item_id, item_text, block_chars, least_chars):
        shared = df.sparkSession.sparkContext.broadcast(block)
        at = df.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for b in batches:
                yield b.filter(pa.array([not matcher.find(normal(t)) for t in b.column(at).to_pylist()], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df
