"""Model-input shaping: pair / triple truncation, sequence packing, statistics.

Token lists are array columns; every step is a closed form or an array
higher-order function, so no row leaves the JVM. The exact median is found by
selection in rounds of partial counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from ..session import cut_lineage

# First segment cap, sequence length and special tokens.
FIRST_SEGMENT_CAP = 50
MAX_SEQ_LENGTH = 200
CLS, SEP, PAD = "[CLS]", "[SEP]", "[PAD]"


def word_tokens(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(c, F.lit(r"\S+"), 0)


def pair_cuts(len_a: Column, len_b: Column, limit: int) -> tuple[Column, Column]:
    """Tokens removed from a and b so that a + b <= limit, popping one token at a
    time from the longer side (the second side on ties)."""
    excess = F.greatest(len_a + len_b - limit, F.lit(0))
    gap = F.least(excess, F.abs(len_a - len_b))
    rest = excess - gap
    cut_a = F.when(len_a > len_b, gap).otherwise(0) + F.floor(rest / 2)
    cut_b = F.when(len_b > len_a, gap).otherwise(0) + F.ceil(rest / 2)
    return cut_a.cast("int"), cut_b.cast("int")


def truncate_pair(df: DataFrame, a: str, b: str, max_len: int = MAX_SEQ_LENGTH) -> DataFrame:
    """Cap a at 50 tokens, then fit a + b into max_len - 3 (room for CLS, SEP, SEP)."""
    ta = F.slice(word_tokens(a), 1, FIRST_SEGMENT_CAP)
    tb = word_tokens(b)
    out = df.withColumns({"_ta": ta, "_tb": tb, "len_a": F.size(word_tokens(a)), "len_b": F.size(tb)})
    la, lb = F.size("_ta"), F.size("_tb")
    ca, cb = pair_cuts(la, lb, max_len - 3)
    out = out.withColumns({"trunc_a": F.col("len_a") - la + ca, "trunc_b": cb})
    return out.withColumns({
        "tokens_a": F.slice("_ta", 1, la - ca),
        "tokens_b": F.slice("_tb", 1, lb - cb),
    }).drop("_ta", "_tb")


def triple_cuts(len_a: Column, len_b: Column, len_c: Column, limit: int) -> Column:
    """Kept lengths struct(a, b, c) when one token at a time is popped until a + b + c <= limit:
    from a if it is strictly the longest, else from b if it is strictly the longest, else from c.

    In closed form: the longest side falls to the second longest; if c is one of two equal
    longest sides, c and the other fall in turn (c first) to the third; everything else comes off
    c, which stops at zero.
    """
    def to_second(s: Column) -> Column:
        a, b, c, e = s["a"], s["b"], s["c"], s["e"]
        x = F.when((a > b) & (a > c), F.least(e, a - F.greatest(b, c))).otherwise(F.lit(0))
        y = F.when((b > a) & (b > c), F.least(e, b - F.greatest(a, c))).otherwise(F.lit(0))
        z = F.when((c > a) & (c > b), F.least(e, c - F.greatest(a, b))).otherwise(F.lit(0))
        return let(F.struct((a - x).alias("a"), (b - y).alias("b"), (c - z).alias("c"), (e - x - y - z).alias("e")), in_turn)

    def in_turn(s: Column) -> Column:
        a, b, c, e = s["a"], s["b"], s["c"], s["e"]
        with_a = F.when((a == c) & (a > b), F.least(e, 2 * (a - b))).otherwise(F.lit(0))
        with_b = F.when((b == c) & (b > a), F.least(e, 2 * (b - a))).otherwise(F.lit(0))
        half = lambda x: F.floor(x / 2).cast("int")
        off_c = with_a + with_b - half(with_a) - half(with_b)
        return let(F.struct((a - half(with_a)).alias("a"), (b - half(with_b)).alias("b"), (c - off_c).alias("c"),
                            (e - with_a - with_b).alias("e")),
                   lambda r: F.struct(r["a"].alias("a"), r["b"].alias("b"), F.greatest(r["c"] - r["e"], F.lit(0)).alias("c")))

    excess = F.greatest(len_a + len_b + len_c - limit, F.lit(0))
    return let(F.struct(len_a.alias("a"), len_b.alias("b"), len_c.alias("c"), excess.alias("e")), to_second)


def truncate_triple(df: DataFrame, a: str, b: str, c: str, max_len: int = MAX_SEQ_LENGTH) -> DataFrame:
    """Cap a at 50 tokens, then fit a + b + c into max_len - 4; ``truncation`` = tokens cut from b."""
    out = df.withColumns({"_ta": F.slice(word_tokens(a), 1, FIRST_SEGMENT_CAP), "_tb": word_tokens(b),
                          "_tc": word_tokens(c)})
    kept = triple_cuts(F.size("_ta"), F.size("_tb"), F.size("_tc"), max_len - 4)
    out = out.withColumn("_k", kept)
    return out.withColumns({
        "tokens_a": F.slice("_ta", 1, F.col("_k.a")),
        "tokens_b": F.slice("_tb", 1, F.col("_k.b")),
        "tokens_c": F.slice("_tc", 1, F.col("_k.c")),
        "truncation": F.size("_tb") - F.col("_k.b"),
    }).drop("_ta", "_tb", "_tc", "_k")


def pack(df: DataFrame, segments: list[str], segment_ids: list[int], max_len: int = MAX_SEQ_LENGTH,
         cls_at_end: bool = False, pad_on_left: bool = False, cls_segment: int = 0, pad_segment: int = 0) -> DataFrame:
    """[CLS] s1 [SEP] s2 [SEP] ... padded to ``max_len``: tokens, input mask, segment ids."""
    toks = F.concat(*[F.concat(F.col(s), F.array(F.lit(SEP))) for s in segments])
    segs = F.concat(*[F.array_repeat(F.lit(i), F.size(s) + 1) for s, i in zip(segments, segment_ids)])
    if cls_at_end:
        toks, segs = F.concat(toks, F.array(F.lit(CLS))), F.concat(segs, F.array(F.lit(cls_segment)))
    else:
        toks, segs = F.concat(F.array(F.lit(CLS)), toks), F.concat(F.array(F.lit(cls_segment)), segs)
    n = F.size(toks)
    pad_n = F.greatest(F.lit(max_len) - n, F.lit(0))
    mask = F.array_repeat(F.lit(1), n)
    pads = (F.array_repeat(F.lit(PAD), pad_n), F.array_repeat(F.lit(0), pad_n), F.array_repeat(F.lit(pad_segment), pad_n))
    if pad_on_left:
        cols = (F.concat(pads[0], toks), F.concat(pads[1], mask), F.concat(pads[2], segs))
    else:
        cols = (F.concat(toks, pads[0]), F.concat(mask, pads[1]), F.concat(segs, pads[2]))
    return df.withColumns({"input_tokens": cols[0], "input_mask": cols[1], "segment_ids": cols[2]})


#: Bins of a narrowing round, and the rows that are sorted at the end.
BINS, FEW = 1024, 10_000


def exact_percentile(df: DataFrame, value: str, p: float = 0.5) -> float | None:
    """The p-quantile of a column of finite numbers, interpolated between the two middle ranks; nulls are skipped (none left: None).

    Selection by rounds: each counts the rows of ``BINS`` equal bins between the bounds left (a partial sum, ``BINS`` rows to
    the driver) and narrows to the bins that hold the two ranks, until the bounds meet or few rows are left between them.
    No task sees more than its input and no buffer holds the values.
    """
    rows = df.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    lo, hi, n = rows.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not n:
        return None
    at = p * (n - 1)
    ranks = [int(at), min(int(at) + 1, n - 1)]  # the two ranks, among the rows from ``lo`` on
    below, inside = 0, n
    while lo < hi and inside > FEW:
        width = max((hi - lo) / BINS, 5e-324)
        slot = F.least(F.floor((F.col("v") - lo) / width), F.lit(BINS - 1))
        found = (rows.filter(F.col("v").between(lo, hi)).groupBy(slot.alias("slot"))
                 .agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n")).orderBy("slot").collect())
        bounds = []
        for r in found:
            if below + r["n"] > ranks[0] and below <= ranks[1]:
                bounds.append((r["lo"], r["hi"], below, r["n"]))
            below += r["n"]
        if len(bounds) == 2:  # the ranks are the last row of one bin and the first of the next
            return bounds[0][1] + (at - ranks[0]) * (bounds[1][0] - bounds[0][1])
        lo, hi, below, inside = bounds[0]
    if lo == hi:
        return lo
    few = [r["v"] for r in rows.filter(F.col("v").between(lo, hi)).orderBy("v").collect()]
    a, b = few[ranks[0] - below], few[ranks[1] - below]
    return a + (at - ranks[0]) * (b - a)


def truncation_stats(df: DataFrame, total: Column | str) -> DataFrame:
    """Rows, rows truncated, mean / median / max of the tokens cut; the median by selection."""
    cuts = cut_lineage(df.select((F.col(total) if isinstance(total, str) else total).alias("t")))  # one number a row, read in each round
    median = exact_percentile(cuts, "t")
    return cuts.agg(F.count(F.lit(1)).alias("total_samples"), F.count_if(F.col("t") > 0).alias("total_truncations"),
                    F.round(F.avg("t"), 6).alias("mean_trunc"), F.round(F.lit(median).cast("double"), 6).alias("median_trunc"),
                    F.max("t").cast("long").alias("max_trunc"))
