"""Suffix-array dedup of byte strings of ``LENGTH`` bytes across a corpus.

A byte goes if a 100-byte string that covers it also starts earlier (smaller id, or same
document and earlier start). The suffix array is sparse: of each 100-byte string, only the
suffix that starts at its minimal 32-byte gram (its *anchor*) is kept, about 3 % of all
suffixes. Equal strings have their anchor at the same offset, so no match is lost.

1. ``anchors`` (per document): leading token (hash of the 32 bytes), hash of the anchor's
   whole surroundings (68 bytes before, 100 from it on), place. Within a batch of documents,
   later places with the same surroundings are settled at once, so a passage in a third of
   all documents sends one row per batch on.
2. Sampled splitters range-partition the suffixes by (leading token, surroundings); each task
   sorts its bucket. Suffixes with the same surroundings as an earlier one are settled.
   Leading tokens seen with one surrounding only are settled as well. What is left (edges of
   passages) goes on: runs inside a bucket as a group, runs that touch a bucket's end as
   single strings, so that parts of a run in several buckets are compared across the ends.
3. For these, the document rows give the bytes. A group is sorted by multikey sort on 8-byte
   words, right part and (reversed) left part; neighbours' common lengths give classes, and
   for each of the 69 offsets the first place of a class keeps its string.
   Strings across bucket ends are compared by their 100-byte value, one row per value and batch.
4. Covered spans meet the texts again, by document.

Hashes of 64 bits stand for byte strings in 1, 2 and across ends; groups compare bytes.

Defined results: null text is empty (0 bytes, hash of nothing); a null id sorts last. Rows that
share an id are one document in order: of equal strings at the same start none goes. Other
columns are not read. Texts of any length are cut into overlapping segments, with the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_copy, small_batches
from .rolling import combined, levels, mixed, sliding

LENGTH, GRAM = 100, 32
LEFT = LENGTH - GRAM  # an anchor lies 0..68 bytes after the start of its string
PAD = 256
SEGMENT = 1 << 20
SETTLED, GROUP, SINGLE = 0, 1, 2
LAST = (1 << 63) - 1


# ---------------------------------------------------------------- 1: anchors of texts

def _segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about SEGMENT codes with the row and the position in it of each code that counts (else -1)."""
    codes, row, pos, size = [np.full(LENGTH, PAD, np.int16)], [np.full(LENGTH, -1)], [np.zeros(LENGTH, np.int64)], 0
    for i, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        for start in range(0, len(text), SEGMENT):
            lo, hi = max(0, start - LEFT), min(len(text), start + SEGMENT + LENGTH)
            at = np.arange(lo, hi)
            codes += [np.frombuffer(text, np.uint8, hi - lo, lo).astype(np.int16), np.full(LENGTH, PAD, np.int16)]
            row += [np.where((at >= start) & (at < start + SEGMENT), i, -1), np.full(LENGTH, -1)]
            pos += [at, np.zeros(LENGTH, np.int64)]
            size += hi - lo
            if size >= SEGMENT // 4:
                yield np.concatenate(codes), np.concatenate(row), np.concatenate(pos)
                codes, row, pos, size = codes[:1], row[:1], pos[:1], 0
                codes, row, pos = [np.full(LENGTH, PAD, np.int16)], [np.full(LENGTH, -1)], [np.zeros(LENGTH, np.int64)]
    if size:
        yield np.concatenate(codes), np.concatenate(row), np.concatenate(pos)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(row, pos, lead, around) of all anchors; pads take part in ``around``, so text ends count."""
    found = []
    for codes, row, pos in _segments(texts):
        lev = levels(codes, 128)
        lead = mixed(lev[GRAM])
        lead |= np.uint64(1)  # 0 marks strings that hold a pad
        least = sliding(lead, LENGTH - GRAM + 1, np.minimum)
        pads = np.concatenate([[0], np.cumsum(codes == PAD)])
        least[pads[LENGTH:] != pads[:-LENGTH]] = 0
        edge = np.zeros(LEFT, np.uint64)
        most = sliding(np.concatenate([edge, least, edge]), LEFT + 1, np.maximum)
        p = np.nonzero((lead == most) & (row[:len(lead)] >= 0))[0]
        # 68 + 100 = 128 + 32 + 8 codes around the anchor
        around = combined(lev[128][p - LEFT], lev[32][p - LEFT + 128], lev[8][p - LEFT + 160])
        found.append((row[p], pos[p], lead[p], around))
    if not found:
        e = np.zeros(0, np.int64)
        return e, e, e.astype(np.uint64), e.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _later(keys: list[np.ndarray], doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """True where an equal key stands at a smaller (doc, pos)."""
    order = np.lexsort([pos, doc, *reversed(keys)])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    d, p = doc[order], pos[order]
    out = np.zeros(len(order), bool)
    out[order] = (d != d[first]) | (p != p[first])
    return out


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


ANCHORS = "lead long, around long, d long, t long, pos int, done boolean"


def emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        d, t = b.column(0).to_numpy(), b.column(1).to_numpy()
        parts, at = [], 0
        for s in small_batches(iter([b]), 2):
            row, *rest = anchors(s.column(2).cast(pa.binary()).to_pylist())
            parts.append((row + at, *rest))
            at += s.num_rows
        if not parts:
            continue
        row, pos, lead, around = (np.concatenate(x) for x in zip(*parts))
        doc = d[row]
        done = _later([lead, around], doc, pos)
        lead = np.where(done, mixed(doc.astype(np.uint64) * np.uint64(31) + pos.astype(np.uint64)), lead)  # anywhere
        for s in range(0, len(row), 100_000):
            x = slice(s, s + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v) for v in (_signed(lead[x]), _signed(around[x]), doc[x], t[row[x]], pos[x].astype(np.int32), done[x])],
                names=["lead", "around", "d", "t", "pos", "done"])


# ---------------------------------------------------------------- 2: runs of leading tokens in sorted buckets

PLACES = "d long, t long, pos int, lead long, route int"


def settle_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a bucket -> places with a route; lonely anchors disappear."""
    held, first = None, True

    def out(lead, around, d, t, pos, done, edge_lo: bool, edge_hi: bool):
        route = np.full(len(lead), -1)
        route[done] = SETTLED
        live = np.nonzero(~done)[0]
        if len(live):
            k, a = lead[live], around[live]
            new = np.concatenate([[True], k[1:] != k[:-1]])
            run = np.cumsum(new) - 1
            new_class = new | np.concatenate([[True], a[1:] != a[:-1]])
            head = np.maximum.accumulate(np.where(new_class, np.arange(len(live)), 0))
            same = (d[live] == d[live][head]) & (pos[live] == pos[live][head])
            r = np.where(same, np.where(np.bincount(run, new_class)[run] > 1, GROUP, -1), SETTLED)
            edge = ((run == 0) & edge_lo) | ((run == run[-1]) & edge_hi)
            r[edge & same] = SINGLE
            route[live] = r
        x = np.nonzero(route >= 0)[0]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (d[x], t[x], pos[x], lead[x], route[x].astype(np.int32))],
                                          names=["d", "t", "pos", "lead", "route"])

    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        # the run of the last live row may go on in the next batch
        live = np.nonzero(~cols[5])[0]
        cut = int(np.searchsorted(cols[0], cols[0][live[-1]])) if len(live) else len(cols[0])
        held = [c[cut:] for c in cols]
        part = [c[:cut] for c in cols]
        if (~part[5]).any():
            yield out(*part, first, False)
            first = False
        elif cut:
            yield out(*part, False, False)
    if held is not None and len(held[0]):
        yield out(*held, first, True)


# ---------------------------------------------------------------- places by document

MARKS = "d long, t long, spans binary, pos binary, lead binary, route binary"


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals, sorted."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return s[new], e[np.concatenate([np.nonzero(new)[0][1:] - 1, [len(s) - 1]])]


def _pack(s: np.ndarray, e: np.ndarray) -> bytes:
    return np.stack([s, e], 1).astype("<i8").tobytes()


def mark_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (d, t, places) -> merged settled spans and the places that are open."""
    for b in batches:
        places = b.column(2)
        off, flat = places.offsets.to_numpy(), places.values
        pos, lead, route = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        out = []
        for i in range(b.num_rows):
            p, k, r = (x[off[i]:off[i + 1]] for x in (pos, lead, route))
            at = p[r == SETTLED].astype(np.int64)
            o = r != SETTLED
            out.append((_pack(*_merge(np.maximum(at - LEFT, 0), at + LENGTH)), p[o].astype("<i4").tobytes(),
                        k[o].astype("<i8").tobytes(), r[o].astype("<i1").tobytes()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(list(c), pa.binary()) for c in zip(*out)]],
                                         names=["d", "t", "spans", "pos", "lead", "route"])


# ---------------------------------------------------------------- 3: compare surroundings

SURROUNDINGS = "key long, route int, d long, t long, pos int, n_left int, n_right int, around binary"


def emit_surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, t, pos, lead, route, text) -> bytes around GROUP anchors; strings of SINGLE anchors by their hash."""
    names = [c.split(" ")[0] for c in SURROUNDINGS.split(", ")]
    for b in batches:
        d, t = b.column(0).to_numpy(), b.column(1).to_numpy()
        rows, singles = [], []
        for i in range(b.num_rows):
            text = b.column(5)[i].as_buffer().to_pybytes()
            pos, lead, route = (np.frombuffer(b.column(k)[i].as_py(), x) for k, x in ((2, "<i4"), (3, "<i8"), (4, "<i1")))
            for p, k, r in zip(pos.tolist(), lead.tolist(), route.tolist()):
                lo, hi = max(0, p - LEFT), min(len(text), p + LENGTH)
                if r == GROUP:
                    rows.append((k, r, int(d[i]), int(t[i]), p, p - lo, hi - p, text[lo:hi]))
                else:
                    starts = np.arange(lo, min(p, len(text) - LENGTH) + 1)
                    lev = levels(np.frombuffer(text, np.uint8, hi - lo, lo).astype(np.int16), 64)
                    x = starts - lo
                    singles.append((_signed(combined(lev[64][x], lev[32][x + 64], lev[4][x + 96])), starts,
                                    np.full(len(x), d[i]), np.full(len(x), t[i])))
        if singles:
            key, start, doc, tag = (np.concatenate(x) for x in zip(*singles))
            done = _later([key], doc, start)
            key = np.where(done, _signed(mixed(doc.astype(np.uint64) + start.astype(np.uint64))), key)
            rows += [(k, SETTLED if f else SINGLE, dd, tt, s, 0, LENGTH, None) for k, f, dd, tt, s in
                     zip(key.tolist(), done.tolist(), doc.tolist(), tag.tolist(), start.tolist())]
        for s in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*rows[s:s + 20_000]), (
                    pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=names)


def _classes(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey sort of fixed-width byte rows inside groups, by 8-byte words: (order, common length with the row before)."""
    n, width = words.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = words
    keys = padded.view(">u8")
    order = np.lexsort([*(keys[:, i] for i in range(keys.shape[1] - 1, -1, -1)), group])
    common = np.zeros(n, np.int64)
    if n > 1:
        s, g = words[order], group[order]
        differ = s[1:] != s[:-1]
        common[1:] = np.where(differ.any(1), differ.argmax(1), width)
        common[1:][g[1:] != g[:-1]] = -1
    common[0] = -1
    return order, common


def covered_offsets(group: np.ndarray, around: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, doc: np.ndarray,
                    pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest offset o (start = anchor - o) at which an earlier row of the group has the same 100 bytes
    (least > greatest: none). ``around``: 68 + 100 bytes a row, zero outside the text."""
    n = len(group)
    place = np.lexsort([pos, doc])  # rows by place: the first of a class is the earliest
    group, around, n_left, n_right, doc, pos = (x[place] for x in (group, around, n_left, n_right, doc, pos))
    r_order, r_common = _classes(around[:, LEFT:], group)
    l_order, l_common = _classes(around[:, LEFT - 1::-1], group)
    least, most = np.full(n, LENGTH, np.int64), np.full(n, -1, np.int64)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(LEFT + 1):
        r_class[r_order] = np.cumsum(r_common < LENGTH - o)
        l_class[l_order] = np.cumsum(l_common < o)
        valid = np.nonzero((n_left >= o) & (n_right >= LENGTH - o))[0]
        if len(valid) < 2:
            continue
        key = r_class[valid] * (n + 1) + l_class[valid]
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        head = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
        at = valid[order]
        first = at[head]
        hit = at[(doc[at] != doc[first]) | (pos[at] != pos[first])]
        least[hit] = np.minimum(least[hit], o)
        most[hit] = o
    back = np.empty(n, np.int64)
    back[place] = np.arange(n)
    return least[back], most[back]


SPANS = "d long, t long, lo long, hi long"
GROUP_ROWS = 20_000


def compare_surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (route, key) -> covered spans. Runs of a key stay together; memory: a run or GROUP_ROWS rows."""

    def spans(b: pa.RecordBatch) -> pa.RecordBatch:
        key, route, d, t, pos, n_left, n_right = (b.column(i).to_numpy(zero_copy_only=False) for i in range(7))
        pos = pos.astype(np.int64)
        lo, hi = pos.copy(), pos + LENGTH  # a string that stands for itself
        hit = route == SETTLED
        one = np.nonzero(route == SINGLE)[0]
        if len(one):
            hit[one] = _later([key[one]], d[one], pos[one])
        many = np.nonzero(route == GROUP)[0]
        if len(many):
            binary = b.column(7)
            around = np.zeros((len(many), LEFT + LENGTH), np.uint8)
            for j, i in enumerate(many.tolist()):
                x = np.frombuffer(binary[i].as_buffer(), np.uint8)
                around[j, LEFT - n_left[i]:LEFT - n_left[i] + len(x)] = x
            least, most = covered_offsets(key[many], around, n_left[many], n_right[many], d[many], pos[many])
            hit[many] = least <= most
            lo[many], hi[many] = pos[many] - most, pos[many] - least + LENGTH
        x = np.nonzero(hit)[0]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (d[x], t[x], lo[x], hi[x])], names=["d", "t", "lo", "hi"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) < GROUP_ROWS:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key = whole.column(0).to_numpy()
        cut = len(key)
        change = np.nonzero(key[1:] != key[:-1])[0]
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield spans(whole.slice(0, cut))
        held = [whole.slice(cut)]
    if held:
        rest = pa.Table.from_batches(held).combine_chunks().to_batches()
        if rest:
            yield spans(rest[0])


# ---------------------------------------------------------------- 4: what stays of each text

def _spans_of(*packed: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(x, "<i8").reshape(-1, 2) for x in packed if x]
    both = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
    return _merge(both[:, 0], both[:, 1])


def cut_text(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int, int]:
    """(rest, bytes removed, runs removed)"""
    ends = np.minimum(ends, len(text))
    kept, at = [], 0
    for s, e in zip(starts.tolist(), ends.tolist()):
        kept.append(text[at:s])
        at = e
    kept.append(text[at:])
    return b"".join(kept), int((ends - starts).sum()), len(starts)


def _row_keys(df: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """d: id for order (null last); t: tells rows of one id apart, 0 where all ids differ."""
    ids = df.select(F.col(id_col).cast("long").alias("i"))
    unique = ids.groupBy("i").count().filter((F.col("count") > 1) | F.col("i").isNull()).isEmpty()
    tag = F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), tag


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d, t = _row_keys(df, id_col, text_col)
    return df.select(d.alias("d"), t.alias("t"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def covered_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, t, spans): covered spans of the documents that have some; spans are packed pairs of 8-byte integers."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = _documents(df, id_col, text_col)
    found = docs.mapInArrow(emit_anchors, ANCHORS)
    sorted_ = found.repartitionByRange(n, "lead", "around").sortWithinPartitions("lead", "around", "d", "pos")
    places = sorted_.mapInArrow(settle_runs, PLACES)
    marks = places.groupBy("d", "t").agg(F.collect_list(F.struct("pos", "lead", "route")).alias("places"))
    marks = keep_copy(marks.mapInArrow(mark_documents, MARKS))
    todo = marks.filter(F.length("pos") > 0).select("d", "t", "pos", "lead", "route")
    surroundings = todo.join(docs, ["d", "t"]).select("d", "t", "pos", "lead", "route", F.col("text").cast("binary").alias("text"))
    rows = surroundings.mapInArrow(emit_surroundings, SURROUNDINGS)
    spans = rows.repartition(n, "key").sortWithinPartitions("route", "key").mapInArrow(compare_surroundings, SPANS)
    packed = spans.groupBy("d", "t").agg(F.collect_list(F.struct("lo", "hi")).alias("more"))
    return marks.select("d", "t", "spans").join(packed, ["d", "t"], "full")


def _joined(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spans = covered_spans(df, id_col, text_col)
    docs = _documents(df, id_col, text_col)
    return docs.join(spans, ["d", "t"], "left")


def _rows(b: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    text, spans, more = (b.column(b.schema.names.index(c)) for c in ("text", "spans", "more"))
    for i in range(b.num_rows):
        extra = more[i].as_py()
        extra = np.array([(x["lo"], x["hi"]) for x in extra], "<i8").tobytes() if extra else None
        yield text[i].as_buffer().to_pybytes(), *_spans_of(spans[i].as_py(), extra)


def dedup_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, s, e in _rows(b):
                rest, gone, runs = cut_text(text, s, e)
                out.append((len(text), gone, runs, hashlib.sha256(rest).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *[pa.array(list(c), k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = _joined(df, id_col, text_col)
    doc_id = F.when(F.col("d") != LAST, F.col("d"))
    return joined.select(doc_id.alias("doc_id"), "text", "spans", "more").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _whole_characters(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans shrunk to whole UTF-8 characters, so that the rest is text."""
    s, e = starts.copy(), np.minimum(ends, len(text))
    code = np.frombuffer(text, np.uint8)
    for i in range(len(s)):
        while s[i] < e[i] and code[s[i]] & 0xC0 == 0x80:
            s[i] += 1
        while s[i] < e[i] < len(text) and code[e[i]] & 0xC0 == 0x80:
            e[i] -= 1
    ok = s < e
    return s[ok], e[ok]


def cut_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The input rows with all columns; ``text_col`` without the covered spans (whole characters only), and
    ``length_col``, if given, the new number of characters of the rows that lost some. Null texts stay null."""
    names, schema = df.columns, df.schema
    at = names.index(text_col)
    n_at = names.index(length_col) if length_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = b.column(0).flatten()
            texts, lengths = cols[at].to_pylist(), cols[n_at].to_pylist() if length_col else None
            for i, (text, spans, more) in enumerate(zip(texts, b.column(1).to_pylist(), b.column(2).to_pylist())):
                if not text or not (spans or more):
                    continue
                raw = text.encode("utf-8")
                extra = np.array([(x["lo"], x["hi"]) for x in more], "<i8").tobytes() if more else None
                texts[i] = cut_text(raw, *_whole_characters(raw, *_spans_of(spans, extra)))[0].decode("utf-8")
                if lengths:
                    lengths[i] = len(texts[i])
            cols[at] = pa.array(texts, cols[at].type)
            if length_col:
                cols[n_at] = pa.array(lengths, cols[n_at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    spans = covered_spans(df, id_col, text_col)
    d, t = _row_keys(df, id_col, text_col)
    joined = df.select(d.alias("d"), t.alias("t"), F.struct(*[df[c] for c in names]).alias("row")).join(spans, ["d", "t"], "left")
    return joined.select("row", "spans", "more").mapInArrow(run, schema)
