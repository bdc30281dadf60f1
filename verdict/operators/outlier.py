"""Isolation-forest ranking of failed tests inside each bug, for many seeds.

MLlib has no isolation forest, so it is built from Spark stages, one path for all sizes:

1. draw: each tree of each seed draws its at most 256 rows without replacement over all rows of
   the group, as in the library: the 256 rows of smallest priority, a hash of (row, seed, tree). Bottom-k
   samples merge, so a task keeps only rows that some tree may draw (priority below a limit that the
   group's size gives), and no row has to know its position. Each goes on once per (group, seed), without its priorities,
   which follow from its hash.
2. grow: one grouped call per (group, seed) sees its candidates (some trees x 400), cuts them to the
   256 smallest of each tree and returns the node table of all trees, packed (about 5 bytes a node): random feature, uniform
   split, depth limit ceil(log2 psi), level by level with NumPy.
3. score: rows are dealt into blocks of ``BLOCK_ROWS``; a block meets its group's forests and
   walks them in small chunks. Score = 2 ** (-E[h] / c(psi)).
4. rank: ascending mean path length (most isolated first), ties by id, by skew-safe positions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.positions import group_positions
from ..session import cut_lineage

# Library defaults of the isolation forest.
N_TREES = 100
MAX_SAMPLES = 256
EULER = 0.5772156649015329
BLOCK_ROWS = 100_000
CHUNK_ROWS = 2_000


def avg_path_length(n: np.ndarray | float) -> np.ndarray:
    """c(n): average path length of an unsuccessful search in a binary search tree."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def grow_forest(x: np.ndarray, tree: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """Grow every tree of one (group, seed) at once, level by level (no per-node Python).

    ``x``: the sample rows of all trees, ``tree``: tree id per row, sorted. At each
    level the rows of the open nodes lie contiguously; segment min/max come from
    ``reduceat``, each node draws a random non-constant feature and a uniform split
    in its range, and one stable sort partitions all rows into the children.
    Node ids are breadth-first over the whole forest.
    """
    rng = np.random.default_rng(seed & 0xFFFFFFFFFFFFFFFF)
    m = len(x)
    rows = np.arange(m)
    seg_start = np.concatenate([[0], np.flatnonzero(np.diff(tree)) + 1]).astype(np.int64)
    seg_size = np.diff(np.concatenate([seg_start, [m]])).astype(np.int64)
    node = np.arange(len(seg_start), dtype=np.int64)
    depth = np.zeros(len(node), np.int64)
    limit = np.maximum(1, np.ceil(np.log2(np.maximum(seg_size, 2)))).astype(np.int64)
    tr = tree[seg_start].astype(np.int64)
    psi = seg_size.copy()
    next_id = len(node)
    out: dict[str, list] = {k: [] for k in ("node", "feature", "split", "left", "right", "size", "depth",
                                            "tree", "psi")}

    def emit(nd, ft, sp, lf, rt, sz, dp, t, ps):
        for k, v in zip(out, (nd, ft, sp, lf, rt, sz, dp, t, ps)):
            out[k].append(np.asarray(v))

    while len(node):
        n = len(node)
        xr = x[rows]
        lo = np.minimum.reduceat(xr, seg_start, axis=0)
        hi = np.maximum.reduceat(xr, seg_start, axis=0)
        can = (depth < limit) & (seg_size > 1)
        cand = (hi > lo) & can[:, None]
        n_c = cand.sum(axis=1)
        inner = n_c > 0
        u1, u2 = rng.random(n), rng.random(n)
        pick = np.minimum((u1 * n_c).astype(np.int64), np.maximum(n_c - 1, 0))
        q = np.argmax(np.cumsum(cand, axis=1) > pick[:, None], axis=1)
        ar = np.arange(n)
        split = np.where(inner, lo[ar, q] + u2 * (hi[ar, q] - lo[ar, q]), 0.0)
        feat = np.where(inner, q, -1).astype(np.int64)
        k = np.cumsum(inner) - 1
        left = np.where(inner, next_id + 2 * k, -1)
        right = np.where(inner, next_id + 2 * k + 1, -1)
        emit(node, feat, split, left, right, seg_size, depth, tr, psi)
        n_inner = int(inner.sum())
        if not n_inner:
            break
        seg_of_row = np.repeat(ar, seg_size)
        keep = inner[seg_of_row]
        r, sg = rows[keep], seg_of_row[keep]
        go_right = ~(x[r, feat[sg]] < split[sg])
        child = 2 * k[sg] + go_right
        order = np.argsort(child, kind="stable")
        rows = r[order]
        c_size = np.bincount(child, minlength=2 * n_inner).astype(np.int64)
        parent = np.repeat(np.flatnonzero(inner), 2)
        c_id = next_id + np.arange(2 * n_inner, dtype=np.int64)
        next_id += 2 * n_inner
        empty = c_size == 0
        if empty.any():  # an empty side is a leaf of size 0
            emit(c_id[empty], np.full(empty.sum(), -1), np.zeros(empty.sum()), np.full(empty.sum(), -1),
                 np.full(empty.sum(), -1), np.zeros(empty.sum(), np.int64), depth[parent][empty] + 1,
                 tr[parent][empty], psi[parent][empty])
        live = ~empty
        node, seg_size = c_id[live], c_size[live]
        seg_start = np.concatenate([[0], np.cumsum(seg_size)[:-1]]).astype(np.int64)
        depth, limit = depth[parent][live] + 1, limit[parent][live]
        tr, psi = tr[parent][live], psi[parent][live]
    return {k: np.concatenate(v) for k, v in out.items()}


def pack_forest(nodes: dict[str, np.ndarray]) -> bytes:
    """Nodes in id order, compressed: their number, features (-1 leaf), splits of the inner nodes, path lengths of the leaves.
    The children aren't stored: inner nodes in id order have the pairs of ids that follow the roots."""
    order = np.argsort(nodes["node"])
    feature = nodes["feature"][order]
    leaf = feature < 0
    path = (nodes["depth"] + avg_path_length(nodes["size"]))[order]
    parts = (np.array([len(order)], "<i4"), feature.astype("i1"), nodes["split"][order][~leaf].astype("<f8"), path[leaf].astype("<f4"))
    return zlib.compress(b"".join(p.tobytes() for p in parts), 1)


def unpack_forest(packed: bytes, n_trees: int) -> tuple[np.ndarray, ...]:
    """(feature, split, left child, path length) of every node; the right child follows the left one, the roots are the first nodes."""
    raw = zlib.decompress(packed)
    n = int(np.frombuffer(raw, "<i4", 1)[0])
    feature = np.frombuffer(raw, "i1", n, 4)
    inner = feature >= 0
    m = int(inner.sum())
    split, left, path = np.zeros(n), np.full(n, -1, np.int64), np.zeros(n, np.float32)
    split[inner] = np.frombuffer(raw, "<f8", m, 4 + n)
    path[~inner] = np.frombuffer(raw, "<f4", n - m, 4 + n + 8 * m)
    left[inner] = n_trees + 2 * np.arange(m)
    return feature, split, left, path


def mean_path(x: np.ndarray, packed: bytes, n_trees: int) -> np.ndarray:
    """Mean path length of every row over all trees."""
    feature, split, left, path = unpack_forest(packed, n_trees)
    out = np.empty(len(x))
    for s in range(0, len(x), CHUNK_ROWS):
        part = x[s:s + CHUNK_ROWS]
        at = np.repeat(np.arange(n_trees), len(part))
        row = np.tile(np.arange(len(part)), n_trees)
        open_ = np.flatnonzero(feature[at] >= 0)
        while len(open_):
            cur = at[open_]
            at[open_] = left[cur] + (part[row[open_], feature[cur]] >= split[cur])
            open_ = open_[feature[at[open_]] >= 0]
        out[s:s + CHUNK_ROWS] = path[at].astype(float).reshape(n_trees, len(part)).mean(axis=0)
    return out


def priorities(h: np.ndarray, seed: int, tree: np.ndarray) -> np.ndarray:
    """A uniform 64-bit number of each (row, tree) from the hash of the row's id, a line a row."""
    with np.errstate(over="ignore"):
        x = h.astype(np.uint64)[:, None] + np.uint64(0x9E3779B97F4A7C15) * (np.uint64(seed * 1_000_003 + 1) + tree.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # Fixed values: a 64-bit finaliser
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
        return x ^ (x >> np.uint64(31))


def sample_limit(n: np.ndarray, k: int) -> np.ndarray:
    """Priorities below this may be among the k smallest of n rows: k and eight deviations more are expected below it."""
    share = np.minimum(1.0, (k + 8.0 * np.sqrt(k) + 16.0) / np.maximum(n, 1))
    return np.where(n <= k, 2.0 ** 64, share * 2.0 ** 64)


def _candidates(seeds: Sequence[int], n_trees: int, k: int):
    """Rows that some tree of a seed may draw, once per (row, seed); in a group of at most k rows every tree takes every row.
    The priorities aren't sent: they follow from the row's hash."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = np.arange(n_trees)
        for part in parts:
            for lo in range(0, len(part), CHUNK_ROWS):
                rows = part.iloc[lo:lo + CHUNK_ROWS]
                n, h = rows["_n"].to_numpy(), rows["_h"].to_numpy()
                limit = sample_limit(n, k)[:, None]
                for seed in seeds:
                    taken = np.flatnonzero((priorities(h, seed, trees) < limit).any(axis=1) | (n <= k))
                    if len(taken):
                        out = rows.iloc[taken].copy()
                        out.insert(0, "seed", seed)
                        yield out
    return run


def draw(h: np.ndarray, seed: int, n_trees: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, tree) of the k rows of smallest priority of each tree, sorted by tree; every row where there are at most k."""
    if len(h) <= k:
        order = np.argsort(h, kind="stable")
        return np.tile(order, n_trees), np.repeat(np.arange(n_trees), len(order))
    picks = []
    for t in range(n_trees):
        u = priorities(h, seed, np.array([t]))[:, 0]
        near = np.flatnonzero(u <= np.partition(u, k - 1)[k - 1])
        picks.append(near[np.lexsort((h[near], u[near]))][:k])
    return np.concatenate(picks), np.repeat(np.arange(n_trees), k)


def _grow(features: Sequence[str], n_trees: int, max_samples: int, block_rows: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        g, seed, h = rows["_g"].iloc[0], int(rows["seed"].iloc[0]), rows["_h"].to_numpy()
        row, tree = draw(h, seed, n_trees, max_samples)
        growth = int(np.random.default_rng([seed, zlib.crc32(g.encode())]).integers(2 ** 62))
        nodes = grow_forest(rows[list(features)].to_numpy(dtype=float)[row], tree, growth)
        k = -(-int(rows["_n"].iloc[0]) // block_rows)
        return pd.DataFrame([(g, seed, int(np.bincount(tree).max()), k, pack_forest(nodes))], columns=["_g", "seed", "_psi", "_k", "forest"])
    return run


def _score(features: Sequence[str], n_trees: int):
    def run(rows: pd.DataFrame, forests: pd.DataFrame) -> pd.DataFrame:
        x = rows[list(features)].to_numpy(dtype=float)
        parts = [pd.DataFrame({"_id": rows["_id"], "_g": rows["_g"], "seed": seed, "_psi": psi, "mean_path": mean_path(x, forest, n_trees)})
                 for seed, psi, forest in zip(forests["seed"], forests["_psi"], forests["forest"])] if len(rows) else []
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(
            {"_id": rows["_id"][:0], "_g": [], "seed": [], "_psi": [], "mean_path": []})
    return run


def isolation_scores(df: DataFrame, group: Sequence[str], id_col: str, features: Sequence[str],
                     seeds: Sequence[int] = tuple(range(10)), n_trees: int = N_TREES,
                     max_samples: int = MAX_SAMPLES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(group..., id, seed, mean_path, score) for every row and seed; the id keeps its type."""
    base = df.select(F.to_json(F.struct(*group)).alias("_g"), F.col(id_col).alias("_id"), *group,
                     *[F.col(f).cast("double").alias(f) for f in features])
    base = cut_lineage(base.withColumn("_h", F.xxhash64("_id")))  # narrow; read for sizes, draws and scores
    groups = base.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), *[F.any_value(c).alias(c) for c in group])
    sized = base.drop(*group).join(groups.select("_g", "_n"), "_g")
    n_part = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ", ".join(f"`{f}` double" for f in features)
    sample = sized.select("_g", "_h", "_n", *features).mapInPandas(
        _candidates([int(x) for x in seeds], n_trees, max_samples), f"seed int, _g string, _h long, _n long, {columns}")
    forests = sample.repartition(n_part, "_g", "seed").groupBy("_g", "seed").applyInPandas(
        _grow(list(features), n_trees, max_samples, block_rows), "_g string, seed int, _psi int, _k int, forest binary")
    rows = sized.withColumn("_b", F.pmod("_h", F.ceil(F.col("_n") / block_rows)).cast("int"))
    copies = forests.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    # CPU-heavy on few bytes: an explicit repartition keeps one task per shuffle partition
    left = rows.select("_g", "_b", "_id", *features).repartition(n_part, "_g", "_b").groupBy("_g", "_b")
    right = copies.select("_g", "_b", "seed", "_psi", "forest").repartition(n_part, "_g", "_b").groupBy("_g", "_b")
    id_type = df.schema[id_col].dataType.simpleString()
    scored = left.cogroup(right).applyInPandas(_score(list(features), n_trees), f"_id {id_type}, _g string, seed int, _psi int, mean_path double")
    out = scored.join(groups.drop("_n"), "_g")
    psi = F.col("_psi").cast("double")
    c_psi = F.when(psi > 2, 2.0 * (F.log(psi - 1.0) + EULER) - 2.0 * (psi - 1.0) / psi).otherwise(1.0)
    return out.select(*group, F.col("_id").alias(id_col), "seed", "mean_path", F.pow(F.lit(2.0), -F.col("mean_path") / c_psi).alias("score"))


def isolation_rank(df: DataFrame, group: Sequence[str], id_col: str, features: Sequence[str],
                   seeds: Sequence[int] = tuple(range(10)), n_trees: int = N_TREES) -> DataFrame:
    """1-based rank per (group, seed): most isolated (shortest mean path) first."""
    s = isolation_scores(df, group, id_col, features, seeds, n_trees)
    r = group_positions(s, [*group, "seed"], ["mean_path", id_col], pos_col="rank")
    return r.withColumn("rank", F.col("rank") + 1)
