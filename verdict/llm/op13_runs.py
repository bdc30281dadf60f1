"""Periodic runs of words by a suffix automaton with link-cut access.

For a text of word codes the automaton is built once, then its prefixes are accessed in order:
the access of the prefix that ends at word i walks the suffix links to the root and recolours
the path with i. Each piece of the path that had one colour e is a class of suffixes whose last
occurrence ended at e; with L its longest one and d = i - e, the last L + d words have period d.
So L >= d is a square, and enough squares are a run, which is then extended word by word. The
tree doesn't change after the automaton is built, so the preferred paths of the link-cut tree
are kept as stacks of coloured pieces on heavy paths: an access meets O(log n) stacks, and the
pieces recoloured are O(log n) an access, amortised.

Only stretches that can hold a run are given to the automaton (``stretches``): in a run of
period q and length n >= max(6, 4q) the n - q - 3 four-word strings after the first q words all
stand again at most q words earlier, so the other words can't be in a run. This is exact; texts
where nothing comes back soon, nearly all, cost one vectorised pass.

Work is per document, in Arrow batches cut to about 1 MB of text; nothing is shuffled, and a
document's arrays need some 200 bytes a word of the stretches.

Defined results: null, empty and blank texts have no words, no runs and the digests of the empty
string; repeated rows are judged each; other columns are not read. With ``plant`` a null id
leaves the text as it is.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of the strings that must come back. A run of six words of period one still holds two of them.
GRAM = 4


class Automaton:
    """Suffix automaton of a code sequence: suffix links, longest lengths, and the state of each prefix."""

    def __init__(self, codes: list[int]):
        self.link, self.length, steps = [-1], [0], [{}]
        self.prefix_state, last = [], 0
        link, length = self.link, self.length
        for c in codes:
            cur, p = len(link), last
            link.append(0)
            length.append(length[last] + 1)
            steps.append({})
            while p >= 0 and c not in steps[p]:
                steps[p][c] = cur
                p = link[p]
            if p >= 0:
                q = steps[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(link)
                    link.append(link[q])
                    length.append(length[p] + 1)
                    steps.append(steps[q].copy())
                    while p >= 0 and steps[p].get(c) == q:
                        steps[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
            self.prefix_state.append(cur)

    def heavy_paths(self) -> tuple[list[int], list[int]]:
        """Top of each state's heavy path, and the state's place on it (from 0)."""
        link, n = self.link, len(self.link)
        order = sorted(range(n), key=self.length.__getitem__)
        size, heavy = [1] * n, [-1] * n
        for v in reversed(order[1:]):
            p = link[v]
            size[p] += size[v]
            if heavy[p] < 0 or size[v] > size[heavy[p]]:
                heavy[p] = v
        top, place = list(range(n)), [0] * n
        for v in order[1:]:
            p = link[v]
            if heavy[p] == v:
                top[v], place[v] = top[p], place[p] + 1
        return top, place


def last_occurrences(codes: list[int]) -> Iterator[tuple[int, int, int]]:
    """(i, e, longest): for each word i and each class of suffixes of the words up to i that ended before at e
    (their last such end), the length of its longest member. A class that spans heavy paths comes in parts, the longest first."""
    auto = Automaton(codes)
    link, length = auto.link, auto.length
    top, place = auto.heavy_paths()
    pieces: dict[int, list[tuple[int, int, int]]] = {}  # path -> (last place, length there, colour), the deepest piece first
    for i, v in enumerate(auto.prefix_state):
        while v > 0:
            head = top[v]
            stack = pieces.setdefault(head, [])
            while stack:
                end, longest, e = stack[-1]
                if end <= place[v]:
                    stack.pop()
                    yield i, e, longest
                    if end == place[v]:
                        break
                else:
                    yield i, e, length[v]
                    break
            stack.append((place[v], length[v], i))
            v = link[head]


def runs_of(codes, lo: int = 0, hi: int | None = None, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs that lie in words lo to hi - 1, extended over all words."""
    hi, found, reach = len(codes) if hi is None else hi, set(), {}
    for i, e, longest in last_occurrences(codes[lo:hi]):
        d = i - e
        if longest + d >= max(least, periods * d) and reach.get(d, -1) < lo + i:
            start, end = lo + i - longest - d + 1, lo + i
            while start > 0 and codes[start - 1] == codes[start - 1 + d]:
                start -= 1
            while end + 1 < len(codes) and codes[end + 1] == codes[end + 1 - d]:
                end += 1
            reach[d] = end
            found.add((start, end - start + 1, d))
    return found


def stretches(codes: np.ndarray, doc: np.ndarray, periods: int = LEAST_PERIODS) -> list[tuple[int, int]]:
    """Ranges [lo, hi) of a batch's words that hold every run; each lies in one document. ``doc``: row of each word, ascending.

    m positions in a row whose GRAM-word string also stands earlier can belong to a period of at most
    (m + 3) / (periods - 1), so strings that come back from farther away are dropped, until nothing changes.
    """
    n = len(codes) - GRAM + 1
    if n <= 1:
        return []
    gram = codes.astype(np.int64)
    width = int(gram.max()) + 1
    for k in (1, 2):  # pairs, then pairs of pairs
        gram = gram[:-k] * width + gram[k:]
        _, gram = np.unique(gram, return_inverse=True)
        width = int(gram.max()) + 1
    order = np.argsort(gram, kind="stable")
    back = np.full(n, np.iinfo(np.int64).max)
    same = (gram[order[1:]] == gram[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    at = np.nonzero((back < n) & (doc[:n] == doc[GRAM - 1:]))[0]
    while len(at):
        cut = np.nonzero((np.diff(at) != 1) | (doc[at[1:]] != doc[at[:-1]]))[0] + 1
        first = np.concatenate([[0], cut])
        sizes = np.diff(np.concatenate([first, [len(at)]]))
        period = (sizes + GRAM - 1) // (periods - 1)
        keep = (back[at] <= np.repeat(period, sizes)) & np.repeat(sizes > 1, sizes)
        if keep.all():
            left = np.searchsorted(doc, doc[at[first]])
            return [(max(int(a), int(b)), int(c)) for a, b, c in zip(at[first] - period, left, at[first] + sizes + GRAM - 1)]
        at = at[keep]
    return []


def planted(doc_id, words: list[bytes]) -> list[bytes]:
    """The words, of every tenth id (by its CRC-32) with a tail that repeats one part of them."""
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _digest(parts) -> str:
    return hashlib.sha256(b"".join(parts)).hexdigest()


def _result(words: list[bytes], runs: set[tuple[int, int, int]]) -> tuple:
    """n_runs, the longest run (start, length, period, exponent in thousandths), and the digests of runs and of the words kept."""
    if not runs:
        return 0, None, None, None, None, _digest(()), _digest((b" ".join(words),))
    ordered = sorted(runs, key=lambda r: (r[0], r[2]))
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]))
    kept = bytearray(b"\x01") * len(words)
    for s, n, q in ordered:
        kept[s + q:s + n] = bytes(n - q)
    return (len(runs), start, length, period, 1000 * length // period,
            _digest(f"{s},{n},{q}\n".encode() for s, n, q in ordered), _digest((b" ".join(w for w, k in zip(words, kept) if k),)))


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: Callable | None = None) -> DataFrame:
    """Per input row: id, n_runs, start, length, period, exponent_milli of the longest run, runs_sha256, collapsed_sha256.

    ``plant``: (id, words) -> words, applied before the search (the registered query repeats the tails of some documents).
    """
    id_type = df.schema[id_col].dataType.simpleString()
    longs = ("n_runs", "start", "length", "period", "exponent_milli")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1, 1 << 20):
            rows = [(t or "").encode().split() for t in b.column(1).to_pylist()]  # bytes split at the six blanks of ASCII only
            if plant:
                rows = [plant(i, words) for i, words in zip(b.column(0).to_pylist(), rows)]
            sizes, number = [len(words) for words in rows], {}
            codes = np.fromiter((number.setdefault(w, len(number)) for words in rows for w in words), np.int64, sum(sizes))
            first = np.cumsum([0, *sizes])
            doc = np.repeat(np.arange(len(rows)), sizes)
            runs = [set() for _ in rows]
            for lo, hi in stretches(codes, doc):
                d = int(doc[lo])
                at = int(first[d])
                runs[d] |= runs_of(codes[at:at + sizes[d]].tolist(), lo - at, hi - at)
            results = list(zip(*map(_result, rows, runs))) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in results[:5]), *(pa.array(x, pa.string()) for x in results[5:])],
                                             names=[id_col, *longs, "runs_sha256", "collapsed_sha256"])

    return df.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {id_type}, " + ", ".join(f"{c} long" for c in longs) + ", runs_sha256 string, collapsed_sha256 string")
