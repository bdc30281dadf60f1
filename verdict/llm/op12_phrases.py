"""Phrase collocations mined with stripes.

Each pair of words that opens a window of up to four words keys an associative counter of what
comes next (the third and fourth word, or the end of the piece). ``_map_stripes`` builds the
counters of a slice of text, ``_merge_stripes`` adds them up, element by element, and reads from
the one merged structure the totals of its prefix (the pair), of the prefix with one more word,
and the extensions by two. Subsumption needs the largest total that extends a phrase by one word
to either side.

How the stripes travel: a stripe of its own row would cost more than its text, so the stripes of
a slice are dealt to buckets by prefix and packed, a row per (lang, bucket) of the slice. The
number of buckets follows the number of words, ``BUCKET_WORDS`` words a bucket; where that is
more than ``FAN_OUT``, stripes are dealt and merged in rounds of ``FAN_OUT``, so that rows stay
packed. A prefix that may stand more than ``BUCKET_WORDS`` times (bounded by its words' counts;
the heavy words that say so are at most ``HEAVY``) is spread over buckets by its continuation,
and its totals are added up after the merge. Merging streams over the rows of a bucket and
compacts what it holds, so its memory follows the distinct windows of a bucket.

Defined results: null lang is ``und``; null, empty and blank texts hold no phrase; repeated rows
count each; other columns are not read; an empty table gives no rows. Counts are 64-bit and every
product that could pass that is a 38-digit decimal, so all comparisons are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.positions import topk_per_group
from .common import small_batches, written
from .rolling import combined

LEAST, LONGEST, SHARE, TOP, NO_LANG = 30, 4, 80, 2000, "und"
BUCKET_WORDS, FAN_OUT, HEAVY = 1 << 19, 1 << 12, 1 << 17
#: Text of a slice, and windows held before they are compacted.
SLICE_BYTES, HELD = 4 << 20, 1 << 19

# Byte classes: 0 in a word, 1 blank, 2 between pieces.
_CLASS, _LOWER = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER[ord("A"):ord("Z") + 1] += 32


def tokens(text: bytes, classes: np.ndarray = _CLASS) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, code of each word, and its piece (ascending)."""
    b = _LOWER[np.frombuffer(text, np.uint8)]
    kind = classes[b]
    inside = kind == 0
    edges = np.nonzero(np.diff(np.concatenate([[False], inside, [False]])))[0]
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(b[inside])]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(kind == 2, dtype=np.int32)[starts]


def _hashes(words: pa.Array) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def _unique(*cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and group number of each distinct row of small integers (from -1 on)."""
    first, group = np.zeros(1, np.int64), np.zeros(len(cols[0]), np.int64)
    for c in cols:
        _, first, group = np.unique(group * (int(c.max(initial=0)) + 2) + c + 1, return_index=True, return_inverse=True)
    return first, group


def _windows(codes: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """The window of up to four words of one piece at each word that has a next one (-1: past its end)."""
    n = len(codes)
    out = np.full((n, LONGEST), -1, np.int64)
    out[:, 0] = codes
    for k in range(1, LONGEST):
        same = piece[k:] == piece[:-k] if n > k else np.zeros(0, bool)
        out[:len(same), k][same] = codes[k:][same]
    return out[out[:, 1] >= 0]


def _joined(words: pa.Array, rows: np.ndarray) -> pa.Array:
    """The words of each row of codes with blanks between; -1 is left out."""
    parts = [words.take(pa.array(c, pa.int64(), mask=c < 0)) for c in rows.T]
    return pc.binary_join_element_wise(*parts, " ", null_handling="skip")


class Deal:
    """Where a window's stripe goes; the same on every task."""

    def __init__(self, words: int, heavy: dict[tuple[str, str], int], bucket_words: int):
        self.bucket_words, self.heavy = bucket_words, heavy
        self.buckets, self.others = max(1, -(-words // bucket_words)), words // HEAVY

    def segments(self, lang: str, words: pa.Array, rows: np.ndarray) -> np.ndarray:
        """Number of parts of each row's prefix, from the counts of its two words."""
        most = np.fromiter((self.heavy.get((lang, w), self.others) for w in words.to_pylist()) if self.heavy else
                           (self.others for _ in range(len(words))), np.int64, len(words))
        return 1 + np.minimum(most[rows[:, 0]], most[rows[:, 1]]) // self.bucket_words

    def bucket(self, words: pa.Array, rows: np.ndarray, segments: np.ndarray) -> np.ndarray:
        h = np.concatenate([_hashes(words), np.zeros(1, np.uint64)])  # -1 finds the last
        after = combined(h[rows[:, 2]], h[rows[:, 3]]) % segments.astype(np.uint64)
        return (combined(h[rows[:, 0]], h[rows[:, 1]], after) % np.uint64(self.buckets)).astype(np.int64)


def _packed(lang: str, words: pa.Array, rows: np.ndarray, n: np.ndarray, bucket: np.ndarray) -> Iterator[tuple]:
    """(lang, bucket, windows, counts): the rows of each bucket, one window a line."""
    import zstandard

    order = np.lexsort((*rows.T[::-1], bucket))
    rows, n, bucket = rows[order], n[order].astype("<i8"), bucket[order]
    cuts = np.concatenate([[0], np.nonzero(np.diff(bucket))[0] + 1, [len(bucket)]])
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), _joined(words, rows)), "\n")
    press = zstandard.ZstdCompressor(level=3).compress
    for i, text in enumerate(lines.to_pylist()):
        lo, hi = cuts[i], cuts[i + 1]
        yield lang, int(bucket[lo]), press(text.encode()), press(n[lo:hi].tobytes())


_STRIPES = "lang string, bucket long, windows binary, counts binary"


def _stripe_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.binary(), pa.binary()))],
                                      names=["lang", "bucket", "windows", "counts"])


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, its texts, one a line) of each slice; a line end parts pieces."""
    for b in small_batches(batches, 1, SLICE_BYTES):
        texts: dict[str, list[str]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if text:
                texts.setdefault(lang, []).append(text)
        for lang, some in texts.items():
            yield lang, "\n".join(some).encode()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, text in _by_lang(batches):
        words, codes, _ = tokens(text)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words.cast(pa.string()),
                                          pa.array(np.bincount(codes, minlength=len(words)), pa.int64())], names=["lang", "phrase", "n"])


def _map_stripes(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = shared.value
        for lang, text in _by_lang(batches):
            words, codes, piece = tokens(text)
            rows = _windows(codes, piece)
            if len(rows):
                first, group = _unique(*rows.T)
                rows, n = rows[first], np.bincount(group)
                bucket = deal.bucket(words, rows, deal.segments(lang, words, rows))
                if deal.buckets > FAN_OUT:  # dealt again once merged
                    bucket %= FAN_OUT
                yield _stripe_batch(list(_packed(lang, words, rows, n, bucket)))
    return run


class Stripes:
    """Merged counters of one (lang, bucket)."""

    def __init__(self):
        self.texts, self.counts, self.held = [], [], 0

    def add(self, windows: bytes, counts: bytes) -> None:
        import zstandard

        self.texts.append(zstandard.decompress(windows))
        self.counts.append(np.frombuffer(zstandard.decompress(counts), "<i8"))
        self.held += len(self.counts[-1])
        if self.held > HELD and len(self.texts) > 1:
            words, rows, n = self.merged()
            self.texts, self.counts = ["\n".join(_joined(words, rows).to_pylist()).encode()], [n]
            self.held = len(n) // 2  # compacted again only when as much has come

    def merged(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Words, distinct windows and their counts: equal elements of all stripes added up."""
        words, codes, line = tokens(b"\n".join(self.texts), _LINES)
        starts = np.concatenate([[True], np.diff(line) != 0])
        at = np.arange(len(codes)) - np.nonzero(starts)[0][np.cumsum(starts) - 1]
        rows = np.full((int(starts.sum()), LONGEST), -1, np.int64)
        rows[np.cumsum(starts) - 1, at] = codes
        first, group = _unique(*rows.T)
        n = np.zeros(len(first), np.int64)
        np.add.at(n, group, np.concatenate(self.counts))
        return words, rows[first], n


# Windows are written one a line with blanks between: only these two bytes part them.
_LINES = np.zeros(256, np.uint8)
_LINES[0x20], _LINES[0x0A] = 1, 2


def _each_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Stripes]]:
    """Rows sorted by (lang, bucket) -> their merged stripes."""
    key, stripes = None, None
    for b in batches:
        for lang, bucket, windows, counts in zip(*(c.to_pylist() for c in b.columns)):
            if key != (lang, bucket):
                if key is not None:
                    yield *key, stripes
                key, stripes = (lang, bucket), Stripes()
            stripes.add(windows, counts)
    if key is not None:
        yield *key, stripes


def _deal_again(shared) -> Callable:
    """Merged stripes of the first round, packed anew by their own buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = shared.value
        for lang, _, stripes in _each_bucket(batches):
            words, rows, n = stripes.merged()
            yield _stripe_batch(list(_packed(lang, words, rows, n, deal.bucket(words, rows, deal.segments(lang, words, rows)))))
    return run


def _merge_stripes(shared, least: int) -> Callable:
    """Totals of every prefix and extension that reach ``least``; of a spread prefix, the part of this bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = shared.value
        for lang, _, stripes in _each_bucket(batches):
            words, rows, n = stripes.merged()
            spread = deal.segments(lang, words, rows) > 1
            for k in range(2, LONGEST + 1):
                whole = rows[:, k - 1] >= 0
                first, group = _unique(*rows[whole, :k].T)
                total = np.zeros(len(first), np.int64)
                np.add.at(total, group, n[whole])
                keep = (total >= least) | (spread[whole][first] if k < LONGEST else False)
                phrases = _joined(words, rows[whole][first[keep], :k])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), phrases, pa.array([k] * len(phrases), pa.int32()),
                                                  pa.array(total[keep], pa.int64())], names=["lang", "phrase", "words", "n"])
    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, bucket_words: int = BUCKET_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of all single words, and (lang, phrase, words, n) of all phrases of 2 to 4 words with n >= least.
    ``docs``: columns lang and text. Both are written to the shared folder."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
    single = written(docs.mapInArrow(_count_words, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "words")
    total = single.agg(F.sum("n")).first()[0] or 0
    heavy = (single.filter((F.col("n") >= bucket_words) & (F.col("n") * HEAVY >= total) & (F.octet_length("phrase") <= 256))
             .select("lang", "phrase", "n").collect())  # at most HEAVY rows
    deal = Deal(total, {(r.lang, r.phrase): r.n for r in heavy}, bucket_words)
    shared = spark.sparkContext.broadcast(deal)
    stripes = docs.mapInArrow(_map_stripes(shared), _STRIPES)
    if deal.buckets > FAN_OUT:
        stripes = _sorted_buckets(stripes).mapInArrow(_deal_again(shared), _STRIPES)
    merged = _sorted_buckets(stripes).mapInArrow(_merge_stripes(shared, least), "lang string, phrase string, words int, n long")
    phrases = merged.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return single, written(phrases, "phrases")


def _sorted_buckets(stripes: DataFrame) -> DataFrame:
    return stripes.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, share: int = SHARE, top: int = TOP,
                 bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each lang that no longer phrase subsumes.

    A phrase of 2 to 4 words that stands a >= least times scores floor(2000000 a / (l + r)) at its worst cut into a
    first part that stands l times and a rest that stands r times. It goes if a longer phrase that holds it has
    ``share`` percent of a or more; since a phrase stands no more often than its parts, one more word is enough to look at.
    """
    single, phrases = phrase_counts(df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), least, bucket_words)
    first_words, last_words = F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)")
    longer = (phrases.filter("words > 2").select("lang", F.explode(F.array(first_words, last_words)).alias("phrase"), F.col("n").alias("m"))
              .groupBy("lang", "phrase").agg(F.max("m").alias("m")))
    alive = (phrases.withColumnRenamed("n", "a").join(longer, ["lang", "phrase"], "left")
             .filter(F.expr(f"m IS NULL OR CAST(100 AS DECIMAL(18, 0)) * m < CAST({share} AS DECIMAL(18, 0)) * a")).drop("m"))
    parts = single.filter(F.col("n") >= least).union(phrases.filter(f"words < {LONGEST}").select("lang", "phrase", "n"))
    cuts = (alive.select("lang", "phrase", "a", F.explode(F.expr("sequence(1, words - 1)")).alias("k"), "words")
            .select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("p"), F.expr("substring_index(phrase, ' ', k - words)").alias("q"))
            .join(parts.select("lang", F.col("phrase").alias("p"), F.col("n").alias("l")), ["lang", "p"])
            .join(parts.select("lang", F.col("phrase").alias("q"), F.col("n").alias("r")), ["lang", "q"]))
    score = F.expr("(CAST(2000000 AS DECIMAL(18, 0)) * a) DIV (CAST(l AS DECIMAL(20, 0)) + r)")
    worst = (cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
             .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    ranked = topk_per_group(worst, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, salt_of="phrase")
    words = single.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT lang, unnest(pieces) AS piece FROM (
    SELECT coalesce(lang, 'und') AS lang,
           string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
    FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
counted AS (
  SELECT lang, array_to_string(phrase, ' ') AS phrase, len(phrase) AS words, count(*) AS n FROM (
    SELECT lang, w[i:i + k - 1] AS phrase FROM (
      SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (VALUES (1), (2), (3), (4)) t(k) WHERE len(w) >= k))
  GROUP BY ALL),
cand AS (SELECT lang, phrase, words, string_split(phrase, ' ') AS w, n AS a FROM counted WHERE words > 1 AND n >= 30),
longer AS (
  SELECT lang, part AS phrase, max(a) AS m FROM (
    SELECT lang, a, array_to_string(w[i:i + k - 1], ' ') AS part FROM (
      SELECT lang, a, w, words, k, unnest(generate_series(1, words - k + 1)) AS i FROM cand, (VALUES (2), (3)) t(k) WHERE k < words))
  GROUP BY ALL),
alive AS (
  SELECT c.* FROM cand c LEFT JOIN longer g ON c.lang = g.lang AND c.phrase = g.phrase
  WHERE g.m IS NULL OR 100::HUGEINT * g.m < 80::HUGEINT * c.a),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1:], ' ') AS q
  FROM (SELECT lang, phrase, a, w, unnest(generate_series(1, words - 1)) AS k FROM alive)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.n AS l, y.n AS r, ((2000000::HUGEINT * c.a) // (x.n::HUGEINT + y.n))::BIGINT AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.p JOIN counted y ON y.lang = c.lang AND y.phrase = c.q),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM worst)
SELECT ranked.lang, ranked.rank, phrase, a, l, r, t.n, score
FROM ranked JOIN (SELECT lang, sum(n)::BIGINT AS n FROM counted WHERE words = 1 GROUP BY lang) t ON t.lang = ranked.lang
WHERE rank <= 2000
"""
