"""Token counts by the whole-token shortcut.

Offline (``prove``): each vocabulary string that is valid UTF-8, that the pre-tokenizer leaves
in one piece and that the merges build up to exactly one token is a proven whole token. While
counting, a pre-token in that set costs 1 by one set lookup; only the others are merged, and
merged pre-tokens are remembered in a bounded table per task.

The vocabulary file is read on the driver and its merges (bounded by the vocabulary, about
1 MB) go to the tasks with the function. One pass over the text, no shuffle, one Arrow batch
in memory.

Defined results: null or empty text has 0 bytes and 0 tokens; strings of added tokens inside a
text are that token; repeated rows are counted one by one; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

LIMIT = 512
#: Fixed value: the split pattern of byte-level pre-tokenizers (the file says ByteLevel with use_regex).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Remembered merged pre-tokens per task, and the longest one that is remembered.
CACHE_SIZE, CACHE_CHARS = 200_000, 64


def byte_letters() -> list[str]:
    """Letter of each byte: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, n = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], n = chr(n), n + 1
    return [letters[b] for b in range(256)]


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Number of tokens after all merges: lowest rank first, leftmost first (heap and links, n log n)."""
    n = len(symbols)
    if n < 2:
        return n
    right, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), n
    sym: list[str | None] = list(symbols)
    heap = [(ranks[p], i, p) for i in range(n - 1) if (p := (symbols[i], symbols[i + 1])) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, p = heapq.heappop(heap)
        j = right[i]
        if sym[i] != p[0] or j >= n or sym[j] != p[1]:
            continue  # stale
        sym[i], sym[j] = p[0] + p[1], None
        alive -= 1
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            if (q := (sym[i], sym[k])) in ranks:
                heapq.heappush(heap, (ranks[q], i, q))
        if (h := left[i]) >= 0 and (q := (sym[h], sym[i])) in ranks:
            heapq.heappush(heap, (ranks[q], h, q))
    return alive


class Vocabulary:
    """What counting needs of a byte-level BPE file: merges, proven whole tokens, added strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec.get("normalizer") or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["type"] != "BPE":
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.letters = byte_letters()
        self.whole = self.prove(model["vocab"])

    def parts(self) -> dict:
        return {"ranks": self.ranks, "whole": self.whole, "added": self.added}

    def prove(self, vocab) -> frozenset[str]:
        import regex

        split, to_byte, out = regex.compile(PATTERN), {c: b for b, c in enumerate(self.letters)}, set()
        for token in vocab:
            try:
                text = bytes(to_byte[c] for c in token).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if split.findall(text) == [text] and merged_length(list(token), self.ranks) == 1:
                out.add(text)
        return frozenset(out)


def counter(vocab: dict):
    """text -> number of tokens, from the parts of a ``Vocabulary``."""
    import regex

    split = regex.compile(PATTERN).findall
    special = regex.compile("|".join(map(regex.escape, vocab["added"]))) if vocab["added"] else None
    whole, letters, ranks, cache = vocab["whole"], byte_letters(), vocab["ranks"], {}

    def merge(piece: str) -> int:
        n = cache.get(piece)
        if n is None:
            n = merged_length([letters[b] for b in piece.encode("utf-8")], ranks)
            if len(piece) <= CACHE_CHARS:
                if len(cache) >= CACHE_SIZE:
                    cache.clear()
                cache[piece] = n
        return n

    def count(text: str) -> int:
        parts = split(text)
        rest = [p for p in parts if p not in whole]
        return len(parts) - len(rest) + sum(map(merge, rest))

    def count_all(text: str) -> int:
        if special is None:
            return count(text)
        n, at = 0, 0
        for m in special.finditer(text):
            n, at = n + 1 + count(text[at:m.start()]), m.end()
        return n + count(text[at:] if at else text)

    return count_all


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit per input row. ``path``: the vocabulary file, read here on the driver."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(path).parts())  # bounded by the vocabulary
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(shared.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            tokens = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array([n > limit for n in tokens], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return df.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
