"""N-gram Jaccard join: all links of 5-word shingle sets with 100 * common >= 80 * union, as classes.

1. ``features`` (one pass): per document the size of its set, a 128-bit key of the set, a
   bitmap signature (4 to 8 bits per shingle) and counts of shingle cells. Documents with the
   same set form one class at once; only its smallest member goes on.
2. Prefix filter: of a set of n, the n // 5 + 1 shingles that come first in one global order
   (rare cells first, then hash) meet those of every linked set. Rows (shingle, size, document)
   are grouped by shingle; a shingle of one document is dropped.
3. First links: in each shingle group every document is paired with its predecessor and with
   the first one (a number of pairs linear in the group); verified links give components.
4. Rest: each group is cut into size-banded tiles (a document of band b meets bands b and b + 1
   only), large tiles into salted blocks, and pairs of *different components* are compared
   whose positions in the order leave enough shingles to share. Documents already linked are
   never paired again, so a group of copies costs its size, not its square; near copies that
   just miss the threshold have their own, rare shingles first and fail the position test.
5. A pair is verified by bitmaps first: a bit of A's signature missing in B's is a shingle of A
   outside B, so |A| - popcount(A & ~B) bounds the overlap from above. What passes gets the
   exact intersection of both sorted arrays, made from the texts.

Defined results: null text, or one without words, has an empty set, links to nothing and is a
component of its own; with fewer than 5 words the whole sequence is the one shingle. Repeated
rows are linked to each other; rows that share an id but not a text are nodes of their own. A
null id is never the smallest (a component of null ids has a null id). Other columns are not read.
Shingles are compared by 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, keep_copy, small_batches
from .components import components
from .rolling import combined
from .shingles import shingle_sets

CELLS = 1 << 14
BAND = 1.25  # sizes of linked sets differ by this factor at most
TILE = 4096
SEEN_SETS = 200_000
#: Up to this many documents, the rows to verify are found by a broadcast of their ids (16 bytes each), else by a shuffle.
BROADCAST_IDS = 300_000

FEATURES = "id long, v long, n long, s1 long, s2 long, sig binary"


def signature(h: np.ndarray) -> bytes:
    """Bitmap of 4 to 8 bits per hash (a power of two, 64 at least)."""
    bits = max(64, 1 << (4 * len(h) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(h >> np.uint64(20)) & np.uint64(bits - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def overlap_bound(a: bytes, b: bytes, n_a: int, n_b: int) -> int:
    """Upper bound of the common shingles from both bitmaps (the longer one is folded)."""
    x, y = (np.frombuffer(s, np.uint64) for s in (a, b))
    while len(x) > len(y):
        x = x[:len(x) // 2] | x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] | y[len(y) // 2:]
    return min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))


def linked(common: int, n_a: int, n_b: int) -> bool:
    return 100 * common >= 80 * (n_a + n_b - common)


def _bounds(row: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(row, np.arange(n + 1))


def _texts(c: pa.Array) -> list[bytes]:
    return [x or b"" for x in c.cast(pa.binary()).to_pylist()]


def emit_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, v, text) -> FEATURES; at the task's end, one row per used cell: v = cell, n = shingles, sig = null."""
    names = [x.split(" ")[0] for x in FEATURES.split(", ")]
    cells = np.zeros(CELLS, np.int64)
    for b in small_batches(batches, 2):
        row, h = shingle_sets(_texts(b.column(2)))
        cells += np.bincount((h & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        at = _bounds(row, b.num_rows)
        n = np.diff(at)
        s1, s2, sig = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), []
        place = (np.arange(len(h)) - at[row]).astype(np.uint64)
        one, two = combined(h, place), combined(place, h)  # order-dependent sums over the sorted set
        for i in range(b.num_rows):
            x = slice(at[i], at[i + 1])
            if n[i]:
                s1[i], s2[i] = one[x].sum().view(np.int64), two[x].sum().view(np.int64)
            sig.append(signature(h[x]) if n[i] else b"")
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c) for c in (n, s1, s2)], pa.array(sig, pa.binary())],
                                         names=names)
    used = np.nonzero(cells)[0]
    zero, none = pa.array(np.zeros(len(used), np.int64)), pa.nulls(len(used), pa.int64())
    yield pa.RecordBatch.from_arrays([none, pa.array(used), pa.array(cells[used]), zero, zero, pa.nulls(len(used), pa.binary())],
                                     names=names)


def prefix_rows(cells: np.ndarray):
    """(v, text) -> (h, n, i, v): first n // 5 + 1 shingles in the order (cell count, hash), i = 0, 1 ...; a set that the task saw
    before is skipped (its class has that member's rows). The sets seen are forgotten at ``SEEN_SETS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in small_batches(batches, 1):
            row, h = shingle_sets(_texts(b.column(1)))
            at = _bounds(row, b.num_rows)
            n = np.diff(at)
            if len(seen) > SEEN_SETS:
                seen.clear()
            fresh = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                if n[i]:
                    key = int(combined(h[at[i]:at[i + 1]], np.arange(n[i]).astype(np.uint64)).sum())
                    fresh[i] = key not in seen
                    seen.add(key)
            order = np.lexsort([h, cells[(h & np.uint64(CELLS - 1)).astype(np.int64)], row])
            rank = np.arange(len(h)) - at[row]
            keep = (rank <= n[row] // 5) & fresh[row]
            h, row, rank = h[order][keep], row[keep], rank[keep]
            v = b.column(0).to_numpy()
            for s in range(0, len(h), 100_000):
                x = slice(s, s + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (h[x].view(np.int64), n[row[x]], rank[x].astype(np.int32), v[row[x]])], names=["h", "n", "i", "v"])

    return run


def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h: drops those whose h stands in one row only. Holds one batch and one row."""
    held, go = None, False  # the last row is out when the next one is known; go: it shares its h with the one before

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks().to_batches()[0]
        h = t.column(0).to_numpy()
        same = h[1:] == h[:-1]
        keep = np.concatenate([same, [False]]) | np.concatenate([[go], same])
        go = bool(keep[-1]) if len(same) and same[-1] else (go if not len(same) else False)
        held = t.slice(t.num_rows - 1)
        out = t.slice(0, t.num_rows - 1).filter(pa.array(keep[:-1]))
        if out.num_rows:
            yield out
    if held is not None and go:
        yield held


def first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, r, n) sorted by (h, r) -> pairs (a, b) of each row with the row before and the first of its h."""
    held = None  # (h, first r, first n, last r, last n)
    for b in batches:
        if not b.num_rows:
            continue
        h, r, n = (c.to_numpy() for c in b.columns)
        if held is not None:
            h, r, n = (np.concatenate([[x, x], c]) for x, c in ((held[0], h), (0, r), (0, n)))
            r[0], n[0], r[1], n[1] = held[1:]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        a = np.concatenate([r[:-1][~new[1:]], r[first]])
        c = np.concatenate([r[1:][~new[1:]], r])
        na, nc = np.concatenate([n[:-1][~new[1:]], n[first]]), np.concatenate([n[1:][~new[1:]], n])
        ok = (a != c) & (4 * np.maximum(na, nc) <= 5 * np.minimum(na, nc))
        a, c = a[ok], c[ok]
        held = (h[-1], r[first[-1]], n[first[-1]], r[-1], n[-1])
        pairs = np.unique(np.stack([np.minimum(a, c), np.maximum(a, c)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tile, side, r, n, i, c) sorted by tile -> pairs of different components whose sizes and positions fit.

    If this shingle is the first that two sets share, they share none of the i and j that come before it in the
    global order, so at most min(n - i, m - j). A linked pair passes that test at its first common shingle; a pair
    that fails it here is either no link or passes elsewhere.

    side 0: home band, 1: the band above; of a salted block: bit 1 is the block's side, so that only
    (0, 0), (0, 1) and the two block sides meet. Holds one tile.
    """

    def pairs(cols) -> Iterator[pa.RecordBatch]:
        tile, side, r, n, i, c = cols
        rest = n - i
        k = 1
        found_a, found_b, size = [], [], 0
        while k < len(tile):
            near = np.nonzero(tile[k:] == tile[:-k])[0]
            if not len(near):
                break
            far = near + k
            guest, block = side & 1, side >> 1
            ok = ((guest[near] & guest[far]) == 0) & ((block[near] == 0) | (block[near] != block[far]))
            ok &= (c[near] != c[far]) & (4 * np.maximum(n[near], n[far]) <= 5 * np.minimum(n[near], n[far]))
            ok &= 9 * np.minimum(rest[near], rest[far]) >= 4 * (n[near] + n[far])
            found_a.append(np.minimum(r[near], r[far])[ok])
            found_b.append(np.maximum(r[near], r[far])[ok])
            size += len(found_a[-1])
            if size > 200_000:
                yield _pairs(found_a, found_b)
                found_a, found_b, size = [], [], 0
            k += 1
        if size:
            yield _pairs(found_a, found_b)

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [x.to_numpy() for x in b.columns]
        if held is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(held, cols)]
        change = np.nonzero(cols[0][1:] != cols[0][:-1])[0]
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield from pairs([x[:cut] for x in cols])
        held = [x[cut:] for x in cols]
    if held is not None:
        yield from pairs(held)


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])


def pass_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n_a, n_b, sig_a, sig_b) -> pairs whose overlap bound still links them."""
    for b in batches:
        n_a, n_b = b.column(2).to_pylist(), b.column(3).to_pylist()
        s_a, s_b = b.column(4).to_pylist(), b.column(5).to_pylist()
        ok = [linked(overlap_bound(x, y, p, q), p, q) for x, y, p, q in zip(s_a, s_b, n_a, n_b)]
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def exact_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) -> linked pairs, by intersection of the sorted arrays."""
    for b in small_batches(batches, 2, 1 << 20):
        n = b.num_rows
        row, h = shingle_sets(_texts(b.column(2)) + _texts(b.column(3)))
        at = _bounds(row, 2 * n)
        ok = []
        for i in range(n):
            x, y = h[at[i]:at[i + 1]], h[at[n + i]:at[n + i + 1]]
            ok.append(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _verify(pairs: DataFrame, feats: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that are links."""
    sig = feats.select("v", "n", "sig")
    near = (pairs.join(sig.select(F.col("v").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a")), "a")
            .join(sig.select(F.col("v").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b")), "b"))
    near = keep_copy(near.select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(pass_bitmaps, "a long, b long"))
    ids = keep_copy(near.select(F.col("a").alias("w")).union(near.select("b")).distinct())
    few = ids.count() <= BROADCAST_IDS
    texts = nodes.join(F.broadcast(ids) if few else ids, nodes["v"] == ids["w"], "left_semi").select("v", "text")
    texts = texts.dropDuplicates(["v"])
    both = (near.join(texts.select(F.col("v").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("v").alias("b"), F.col("text").alias("text_b")), "b"))
    return both.select("a", "b", "text_a", "text_b").mapInArrow(exact_links, "a long, b long")


def _node(df: DataFrame, id_col: str, text_col: str) -> tuple[Column, bool]:
    """(node of a row, whether ids are unique): the id itself, or where ids repeat a hash of id and text."""
    i = F.col(id_col).cast("long")
    unique = df.select(i.alias("i")).groupBy("i").count().filter((F.col("count") > 1) | F.col("i").isNull()).isEmpty()
    return (i if unique else F.xxhash64(i, F.lit("|"), F.coalesce(F.col(text_col), F.lit("")))), unique


def _nodes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id; v: node; text."""
    v, _ = _node(df, id_col, text_col)
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def link_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(features per row: id, v, n, s1, s2; component c per class: s1, s2, c) of the documents with words."""
    spark = df.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = _nodes(df, id_col, text_col)
    made = keep_copy(nodes.mapInArrow(emit_features, FEATURES))
    feats = made.filter(F.col("sig").isNotNull())
    cells = np.zeros(CELLS, np.int64)
    for x in made.filter(F.col("sig").isNull()).groupBy("v").agg(F.sum("n").alias("n")).toLocalIterator():
        cells[x["v"]] = x["n"]  # CELLS numbers, whatever the input
    sets = feats.filter("n > 0")
    classes = sets.groupBy("s1", "s2").agg(F.min("v").alias("r"), F.max("n").alias("n"))
    node_class = sets.select("v", "s1", "s2").distinct().join(classes.select("s1", "s2", "r"), ["s1", "s2"]).select("v", "r")

    rows = nodes.select("v", "text").mapInArrow(prefix_rows(cells), "h long, n long, i int, v long")
    shared = rows.repartition(n_parts, "h").sortWithinPartitions("h").mapInArrow(shared_only, "h long, n long, i int, v long")
    groups = keep_copy(shared.join(node_class, "v").select("h", "r", "n", "i").distinct())

    pairs = groups.select("h", "r", "n").repartition(n_parts, "h").sortWithinPartitions("h", "r").mapInArrow(first_pairs, "a long, b long").distinct()
    links = keep_copy(_verify(pairs, feats, nodes))
    label = components(links)

    labelled = groups.join(label.withColumnRenamed("v", "r"), "r", "left").withColumn("c", F.coalesce("c", "r"))
    mixed_groups = labelled.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("h")
    left = labelled.join(mixed_groups, "h", "left_semi")
    rest = tiles(left).repartition(n_parts, "tile").sortWithinPartitions("tile").mapInArrow(tile_pairs, "a long, b long").distinct()
    more = keep_copy(_verify(rest, feats, nodes))
    label = components(links.union(more))
    out = classes.select("s1", "s2", F.col("r").alias("v")).join(label, "v", "left").select(
        "s1", "s2", F.coalesce("c", "v").alias("c"))
    return feats.select("id", "v", "n", "s1", "s2"), out


def tiles(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """(h, r, n, i, c) -> (tile, side, r, n, i, c): each row in its size band and, as a guest, in the band below; bands of
    more than ``tile`` rows of one h are cut into salted blocks, and each pair of blocks is a tile."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(BAND)))).cast("int")
    rows = rows.withColumn("band", band)
    both = rows.withColumn("guest", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", F.col("band") - F.col("guest"))
    counts = both.groupBy("h", "band").agg(F.count(F.lit(1)).alias("m"), F.min("guest").alias("g")).filter(
        (F.col("m") > 1) & (F.col("g") == 0)).select("h", "band", F.ceil(F.col("m") / tile).cast("int").alias("k"))
    both = both.join(counts, ["h", "band"])
    mine = F.pmod(F.xxhash64("r"), F.col("k")).cast("int")
    other = F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("k") - 1))
    both = both.withColumn("mine", mine).withColumn("other", F.explode(other))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    # the two blocks of a tile are sides 1 and 2; a block with itself is side 0
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    return both.select(F.xxhash64("h", "band", lo, hi).alias("tile"), (side * 2 + F.col("guest")).alias("side"), "r", "n", "i", "c")


def join_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id per input row."""
    feats, comp = link_components(df, id_col, text_col)
    least = (feats.filter("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("m")).join(comp, ["s1", "s2"])
             .groupBy("c").agg(F.min("m").alias("component_id")))
    named = keep_copy(comp.join(least, "c").select("s1", "s2", "component_id"))
    full = feats.filter("n > 0").join(named, ["s1", "s2"]).select("id", "n", "component_id")
    empty = feats.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return full.union(empty).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, all columns unchanged, with one row of each component: the one with the smallest id (null last)."""
    feats, comp = link_components(df, id_col, text_col)
    members = feats.filter("n > 0").join(comp, ["s1", "s2"]).select("c", "v", F.struct(F.col("id").isNull(), "id", "v").alias("k"))
    first = members.groupBy("c").agg(F.min_by("v", "k").alias("f"))
    gone = keep_copy(members.join(first, "c").filter("v <> f").select(F.col("v").alias("_gone")).distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    v, unique = _node(df, id_col, text_col)
    kept = df.withColumn("_node", v).join(gone, F.col("_node") == F.col("_gone"), "left_anti")
    if not unique:  # repeated rows share a node
        words = F.length(F.translate(F.coalesce(F.col(text_col), F.lit("")), WHITE, "")) > 0
        kept = kept.filter(words).dropDuplicates(["_node"]).unionByName(kept.filter(~words))
    return kept.drop("_node")
