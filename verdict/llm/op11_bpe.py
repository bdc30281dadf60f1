"""BPE encoding and decoding through a table of distinct words.

``encode``: the texts are split into words by Spark tasks and counted; each distinct word is
merged once, which gives a table (word, n, ids). Its most frequent words go to the tasks as
numbers: at most ``FREQUENT`` words of ``WORD_BYTES`` bytes, and longer ones whose bytes their
counts bound, so the table sent has a fixed bound. Every text becomes the numbers of its words;
the words that are not frequent, each of them at most 1 / ``FREQUENT`` of all words, are
joined with the table by word and come back to their text by position. A text is named by its
MD5, so copies of a text share what comes back, and ids may repeat or be null. The words of a text
that very many rows repeat are frequent; texts without other words wait for nothing and are dealt by
their id, so no key of the join has more rows than a word that is not frequent.

``decode``: the ids of all rows of a batch meet the table (id, piece) by one indexed take, as
a broadcast join with a table that the vocabulary bounds.

The split is that of the file: special strings first, then NFC, lower case and one pattern.
Texts with characters beyond Cyrillic are split by the library's own normaliser and
pre-tokeniser, since the Unicode versions of the regular expressions differ there.

Defined results: null or empty text has no ids and decodes to the empty text; strings of added
tokens inside a text are that token; repeated rows are encoded each; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .op4_tokens import byte_letters

#: Words sent to every task at most, and their bytes.
FREQUENT, WORD_BYTES = 1 << 19, 64
#: The contractions that the pattern names first, in its order.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Beyond this code point texts are split by the library.
PLAIN_UP_TO = 0x4FF


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The symbols after all merges: lowest rank first, leftmost first (a heap over linked symbols, n log n)."""
    n = len(symbols)
    right, left, sym = list(range(1, n + 1)), list(range(-1, n - 1)), list(symbols)
    heap = [(r, i, a + b) for i, (a, b) in enumerate(zip(sym, sym[1:])) if (r := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, whole = heapq.heappop(heap)
        j = right[i]
        if sym[i] is None or j >= n or sym[i] + sym[j] != whole:
            continue  # one of the two has been merged since
        sym[i], sym[j] = whole, None
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            if (r := ranks.get((whole, sym[k]))) is not None:
                heapq.heappush(heap, (r, i, whole + sym[k]))
        if (h := left[i]) >= 0 and (r := ranks.get((sym[h], whole))) is not None:
            heapq.heappush(heap, (r, h, sym[h] + whole))
    return [s for s in sym if s is not None]


class Vocabulary:
    """What a word-level BPE file says: ids, merges, the split pattern and its added strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, norm = spec["model"], spec["pre_tokenizer"], spec["normalizer"]
        split, level = (pre.get("pretokenizers") or [{}, {}])[:2]
        if (model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or spec.get("decoder")
                or [n["type"] for n in norm.get("normalizers", [])] != ["NFC", "Replace", "Lowercase"]
                or split.get("behavior") != "Removed" or not split.get("invert") or level.get("type") != "ByteLevel" or level.get("use_regex")):
            raise ValueError(f"{path} is not a word-level BPE file of the form that is read here")
        self.ids, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.pattern = split["pattern"]["Regex"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.library_parts = json.dumps({**spec, "model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None})
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec.get("added_tokens", [])):
            raise ValueError(f"{path} has added tokens that match more than their string")

    def pieces(self) -> list[str]:
        """Piece of each id."""
        by_id = {i: p for p, i in self.ids.items()} | {i: p for p, i in self.added.items()}
        return [by_id.get(i, "") for i in range(max(by_id, default=-1) + 1)]


def splitter(pattern: str, added: dict[str, int], library_parts: str) -> Callable[[str], list[str]]:
    """text -> its words in order, added strings among them."""
    import regex

    find, special = regex.compile(pattern).findall, None
    if added:
        special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")")
    beyond = regex.compile(f"[^\\x00-\\u{PLAIN_UP_TO:04x}]").search
    to_byte, library = {c: b for b, c in enumerate(byte_letters())}, []

    def by_library(text: str) -> list[str]:
        if not library:
            from tokenizers import Tokenizer
            library.append(Tokenizer.from_str(library_parts))
        norm, pre = library[0].normalizer, library[0].pre_tokenizer
        return [bytes(map(to_byte.__getitem__, w)).decode() for w, _ in pre.pre_tokenize_str(norm.normalize_str(text))]

    def plain(text: str) -> list[str]:
        if not text.isascii():
            if beyond(text):
                return by_library(text)
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # str.lower() looks at the end of the word for a sigma, the library does not
                return find("".join(map(str.lower, text)))
        return find(text.lower())

    def words(text: str) -> list[str]:
        if special is None or "<" not in text and not special.search(text):
            return plain(text)
        return [w for part in special.split(text) for w in ([part] if part in added else plain(part))]

    return words


# Classes of the code points below 0x300, where NFC changes nothing: 0 blank, 1 letter, 2 digit, 3 other.
_DIRECT = 0x300
_LETTER, _DIGIT, _OTHER = 1, 2, 3
_DOTTED_I = 0x130  # the one whose lower case is two characters


def _tables() -> tuple[np.ndarray, np.ndarray]:
    import regex

    kind, low = np.zeros(_DIRECT, np.uint8), np.arange(_DIRECT, dtype=np.uint32)
    for cp in range(_DIRECT):
        c = chr(cp)
        kind[cp] = _LETTER if regex.match(r"\p{L}", c) else _DIGIT if regex.match(r"\p{N}", c) else 0 if regex.match(r"\s", c) else _OTHER
        low[cp] = ord(c.lower()[0])
    return kind, low


class WordCodes:
    """texts -> distinct words, the code of every word, and the number of words of each text.

    Texts below ``_DIRECT`` without an added string are split all at once: a word starts where the class changes, at
    each digit, and around a contraction; the others one by one by ``splitter``."""

    def __init__(self, parts: tuple):
        self.split, self.added = splitter(*parts), parts[1]
        self.contractions = [[ord(c) for c in m] for m in CONTRACTIONS]
        if not parts[0].startswith("|".join("'" + m for m in CONTRACTIONS) + "|"):
            raise ValueError("the pattern has other contractions")
        self.kind, self.low = _tables()

    def __call__(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        cps = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(ends, np.nonzero((cps >= _DIRECT) | (cps == _DOTTED_I))[0], "right")] = True
        for i, t in enumerate(texts):
            if not odd[i] and any(s in t for s in self.added):
                odd[i] = True
        if odd.any():
            cps = cps[np.repeat(~odd, np.diff(ends, prepend=0))]
        plain = np.nonzero(~odd)[0]
        words, at = self._direct(cps)
        ends = np.cumsum(np.diff(ends, prepend=0)[plain])
        doc = plain[np.searchsorted(ends, at, "right")] if len(plain) else at
        if odd.any():
            slow = [self.split(texts[i]) for i in np.nonzero(odd)[0]]
            words = pa.concat_arrays([words, pa.array([w for ws in slow for w in ws], pa.string())])
            doc = np.concatenate([doc, np.repeat(np.nonzero(odd)[0], [len(ws) for ws in slow])])
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        if odd.any():
            codes = codes[np.argsort(doc, kind="stable")]
        return coded.dictionary, codes, np.bincount(doc, minlength=len(texts))

    def _direct(self, cps: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Words, and the place where each starts."""
        kind, low = self.kind[cps], self.low[cps]
        first = np.ones(len(kind), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        marks = np.nonzero(first & (kind == _OTHER) & (cps == ord("'")))[0]
        free = np.ones(len(marks), bool)
        for m in self.contractions:  # in the order of the pattern, the first that fits
            fits = free & (marks + len(m) < len(cps))
            for k, c in enumerate(m, 1):
                fits[fits] = low[marks[fits] + k] == c
            first[marks[fits] + 1] = False
            after = marks[fits] + len(m) + 1
            first[after[after < len(cps)]] = True
            free &= ~fits
        inside = kind > 0
        at = np.nonzero(first & inside)[0]
        wide = 1 + (low >= 0x80)
        offsets = np.concatenate([np.concatenate([[0], np.cumsum(wide * inside, dtype=np.int32)])[at], [(wide * inside).sum()]]).astype(np.int32)
        text = low[inside].tobytes().decode("utf-32-le").encode()
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(text)]), at


def _count_words(parts: tuple) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordCodes(parts)
        added = pa.array(list(coder.added), pa.string())
        for b in small_batches(batches, 0):
            words, codes, _ = coder(b.column(0).to_pylist())
            counted = pa.RecordBatch.from_arrays([words, pa.array(np.bincount(codes, minlength=len(words)), pa.int64())], names=["word", "n"])
            yield counted.filter(pc.invert(pc.is_in(words, added)))
    return run


def _encode_words(ids: dict, ranks: dict, end: str) -> Callable:
    letters = byte_letters()

    def encode(word: str) -> list[int]:
        symbols = [letters[b] for b in word.encode()]
        symbols[-1] += end
        return [ids[s] for s in merge(symbols, ranks)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(encode, b.column(0).to_pylist()), pa.list_(pa.int32()))],
                                             names=["word", "n", "ids"])
    return run


def word_table(texts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(word, n, ids): every distinct word of column ``text``, merged once; written to the shared folder."""
    parts = vocab.pattern, vocab.added, vocab.library_parts
    counted = texts.mapInArrow(_count_words(parts), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return written(counted.mapInArrow(_encode_words(vocab.ids, vocab.ranks, vocab.end), "word string, n long, ids array<int>"), "bpe-words")


def _numbered(parts: tuple, shared) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """texts -> number of each word, words of each text, and the words that are not frequent: their number in the
    order in which a text has them first, after all frequent and added ones, a row of (text, word) each."""
    coder = WordCodes(parts)
    number = {w: i for i, w in enumerate(shared.value.split("\n"))} if shared.value else {}
    for s in coder.added:
        number[s] = len(number)
    base = len(number)

    def run(texts):
        words, codes, sizes = coder([t or "" for t in texts])
        named = words.to_pylist()
        known = np.fromiter((number.get(w, -1) for w in named), np.int64, len(named))
        numbers = known[codes] if len(codes) else np.empty(0, np.int64)
        at = np.nonzero(numbers < 0)[0]
        text = np.repeat(np.arange(len(texts)), sizes)[at]
        _, first, group = np.unique(text * len(named) + codes[at], return_index=True, return_inverse=True)
        order = np.argsort(first, kind="stable")  # texts ascend, and so do the places in each
        texts_of = text[first[order]]
        j = np.arange(len(order)) - np.searchsorted(texts_of, texts_of)
        place = np.empty(len(order), np.int64)
        place[order] = j
        numbers[at] = base + place[group]
        return numbers, sizes, texts_of, j, words.take(pa.array(codes[at][first[order]], pa.int64()))

    return run


def _rare_words(parts: tuple, shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered = _numbered(parts, shared)
        for b in small_batches(batches, 1):
            _, _, text, j, words = numbered(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text, pa.int64())), pa.array(j, pa.int32()), words], names=["text_key", "j", "word"])
    return run


def _pack(numbers: np.ndarray) -> bytes:
    """Four planes of bytes, the low one first: the high ones are nearly empty, which the shuffle compresses."""
    import zstandard

    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(planes.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4").astype(np.int64)


def _number_texts(parts: tuple, shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered = _numbered(parts, shared)
        for b in small_batches(batches, 2):
            numbers, sizes, text, *_ = numbered(b.column(2).to_pylist())
            packed = [_pack(x) for x in np.split(numbers, np.cumsum(sizes)[:-1])] if len(sizes) else []
            waits = pa.array(np.isin(np.arange(len(sizes)), text))
            keys = pc.if_else(waits, b.column(1), b.column(3))
            yield pa.RecordBatch.from_arrays([b.column(0), keys, pa.array(packed, pa.binary())], names=["id", "text_key", "numbers"])
    return run


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((i for x in lists for i in x), np.int32, int(sizes.sum())), sizes


def _ids_of(known: np.ndarray, known_sizes: np.ndarray, numbers: pa.Array, rare: pa.Array) -> pa.ListArray:
    """Numbers and the ids of the rare words of each text -> ids of each text."""
    numbers, rare = [_unpack(x) for x in numbers.to_pylist()], [r or [] for r in rare.to_pylist()]
    own, own_sizes = _flat([ids for r in rare for ids in r])
    flat, sizes = np.concatenate([known, own]), np.concatenate([known_sizes, own_sizes])
    starts = np.cumsum(sizes) - sizes
    for ks, at in zip(numbers, np.cumsum([0, *map(len, rare)])):
        ks[ks >= len(known_sizes)] += at
    ks = np.concatenate([*numbers, np.empty(0, np.int64)])
    k_sizes = sizes[ks]
    ends = np.concatenate([[0], np.cumsum(k_sizes)])
    ids = flat[np.repeat(starts[ks] - ends[:-1], k_sizes) + np.arange(ends[-1])]
    offsets = ends[np.cumsum([0, *map(len, numbers)])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))


def _decoded(ids: pa.ListArray, pieces: pa.StringArray) -> pa.Array:
    return pc.fill_null(pc.binary_join(pa.ListArray.from_arrays(*_parts(ids, pieces)), " "), "")


def _digests(ids: pa.ListArray, pieces: pa.StringArray) -> list[pa.Array]:
    """Number of ids, and the SHA-256 of the ids (little-endian unsigned 32-bit integers) and of the text decoded from them."""
    sizes, flat = ids.value_lengths().to_numpy(zero_copy_only=False), ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
    ends = np.cumsum(sizes)
    return [pa.array(sizes, pa.int64()), pa.array([hashlib.sha256(flat[e - n:e]).hexdigest() for e, n in zip(ends, sizes)], pa.string()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in _decoded(ids, pieces).to_pylist()], pa.string())]


def _join_ids(shared_ids, pieces=None) -> Callable:
    """The join back by position; with ``pieces`` the digests of the ids and of what they decode to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_sizes = shared_ids.value
        strings = pieces and pa.array(pieces.value, pa.string())
        for b in small_batches(batches, 1, 1 << 18):
            ids = _ids_of(known, known_sizes, b.column(1), b.column(2))
            out = _digests(ids, strings) if pieces else [ids]
            yield pa.RecordBatch.from_arrays([b.column(0), *out], names=["id", *(("n_tokens", "ids_sha256", "decoded_sha256") if pieces else ("ids",))])
    return run


def _often(table: DataFrame, total: int, frequent: int) -> Column:
    """Whether a word goes to every task: at most ``frequent`` short words, from a count on, and long ones of
    ``frequent * WORD_BYTES`` bytes together (n * frequent * WORD_BYTES >= total * bytes for each, and all n add up to total)."""
    short = F.octet_length("word") <= WORD_BYTES
    step = F.floor(F.log2("n") * 16).cast("int")  # some hundred steps of counts
    left, least = frequent, None
    for r in sorted(table.filter(short).groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True):
        left -= r["words"]
        if left < 0:
            break
        least = r["step"]
    enough = F.lit(False) if least is None else step >= least
    return (short & enough) | (~short & (F.col("n").cast("double") * float(frequent * WORD_BYTES) >= F.octet_length("word") * float(total)))


def _numbered_texts(df: DataFrame, vocab: Vocabulary, id_col: str, text_col: str, frequent: int):
    """Rows of id, numbers and the ids of the rare words by their place, and the ids of the frequent words, broadcast."""
    spark = df.sparkSession
    parts = vocab.pattern, vocab.added, vocab.library_parts
    docs = df.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("text_key"), F.col(text_col).alias("text"))
    table = word_table(docs.select("text").filter("text <> ''"), vocab)
    total = table.agg(F.sum("n")).first()[0] or 0
    often = _often(table, total, frequent)
    chosen = table.filter(often).toArrow().sort_by([("n", "descending"), ("word", "ascending")])  # bounded, see above
    shared = spark.sparkContext.broadcast("\n".join(chosen.column("word").to_pylist()))
    shared_ids = spark.sparkContext.broadcast(_flat(chosen.column("ids").to_pylist() + [[i] for i in vocab.added.values()]))
    rare = (docs.select("text_key", "text").filter("text <> ''").mapInArrow(_rare_words(parts, shared), "text_key binary, j int, word string")
            .join(table.filter(~often).select("word", "ids"), "word")
            .groupBy("text_key").agg(F.sort_array(F.collect_set(F.struct("j", "ids"))).alias("rare"))
            .select("text_key", F.col("rare.ids").alias("rare")))
    id_type = df.schema[id_col].dataType.simpleString()
    by_id = F.unhex(F.hex(F.xxhash64("id")))  # eight bytes at most: no MD5
    numbered = docs.withColumn("id_key", by_id).mapInArrow(_number_texts(parts, shared), f"id {id_type}, text_key binary, numbers binary")
    return numbered.join(rare, "text_key", "left").select("id", "numbers", "rare"), id_type, shared_ids


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """id, ids (array of int) per input row. ``path``: the vocabulary file, read here on the driver."""
    rows, id_type, shared_ids = _numbered_texts(df, Vocabulary(path), id_col, text_col, frequent)
    return rows.mapInArrow(_join_ids(shared_ids), f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The rows with the text that the ids give: their pieces, special ones too, with blanks between (null ids: the empty text)."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(path).pieces())  # bounded by the vocabulary
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(shared.value, pa.string())
        for b in batches:
            ids = b.column(at)
            texts = [_decoded(ids.slice(i, 256), pieces) for i in range(0, b.num_rows, 256)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.concat_arrays(texts) if texts else pa.array([], pa.string())], names=[*b.schema.names, text_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, `{text_col}` string")


def _parts(ids: pa.ListArray, pieces: pa.StringArray) -> tuple[pa.Array, pa.Array]:
    """Offsets from zero and the piece of each id."""
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pieces.take(ids.flatten())


def report(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """id, n_tokens and the digests of the ids and of the text decoded from them, all in the task that joins the ids back."""
    vocab = Vocabulary(path)
    rows, id_type, shared_ids = _numbered_texts(df, vocab, id_col, text_col, frequent)
    pieces = df.sparkSession.sparkContext.broadcast(vocab.pieces())
    return (rows.mapInArrow(_join_ids(shared_ids, pieces), f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
            .withColumnRenamed("id", id_col))
