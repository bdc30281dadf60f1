"""Mixing sources to target weights: Efraimidis-Spirakis sampling to token budgets.

1. Sources get budgets: weights share ``share`` of all sizes; a target stops at
   ``max_epochs`` times its source's size and the excess goes to the others by weight
   (water filling: target = least(cap, level * weight)).
2. A source takes complete epochs first: every document floor(target / size) times.
3. The rest is a weighted sample without replacement: documents are ordered by the
   exponential key -ln(1 - u) / quality and taken while the running sum of sizes is nearer
   to the rest than the sum before it.

A source may hold any share of the rows and its keys may crowd anywhere: the keys are cut into ``BUCKETS``
ranges, range sums are partial aggregates, and the one range of a source in which the budget ends is cut again
between its smallest and largest key until it has at most ``SPLIT_ROWS`` rows (or one key only). Only that is
sorted. u is a hash of seed and id, so reruns and other engines agree.

Defined results: null text has size 0; a null source is a source of its own, last in order;
repeated rows are drawn as rows of their own, ties of the key ordered by id and size; an
empty table gives an empty result; size 0 takes 0 words. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_chars, keep_copy, words_of
from .op2_quality import SYMBOLS

SOURCE_WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
BUCKETS = 4096
#: Rows of a source that one task sorts at most.
SPLIT_ROWS = 100_000
SEED = "mix-1"
#: Source tables up to this many rows are broadcast (about 100 bytes a row); larger ones are joined by shuffle.
BROADCAST_ROWS = 20_000


def uniform(id_col: Column, seed: str) -> Column:
    """52-bit uniform in [0, 1) from md5 of seed and id."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + "-"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2 ** 52))


def quality(text: Column, size: Column) -> Column:
    """Document weight in (0, 1]: falls with symbols per word."""
    n = count_chars(F.coalesce(text, F.lit("")), SYMBOLS).cast("double")
    return F.lit(1.0) / (F.lit(1.0) + n / F.greatest(size, F.lit(1)).cast("double"))


def source_targets(sizes: DataFrame, weights=SOURCE_WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> + target, epochs, rest. One row per source: ordered as one small table."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    k = len(weights)
    t = (sizes.withColumn("rk", F.row_number().over(by_name))
         .withColumn("w", F.get(F.array(*[F.lit(x) for x in weights]), (F.col("rk") - 1) % k).cast("long"))
         .withColumn("cap", F.col("source_size") * max_epochs)
         .withColumn("r", F.col("cap").cast("double") / F.col("w").cast("double")))
    before = Window.orderBy("r", "rk").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(everything).cast("double") - F.coalesce(
        F.sum("cap").over(before), F.lit(0)).cast("double")
    room = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    # The level when all sources before this one are full; it rises while they really are, then falls.
    t = t.withColumn("level", left / room.cast("double")).withColumn("level", F.max("level").over(everything))
    t = t.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w").cast("double")))
    size = F.col("source_size")
    t = t.withColumn("epochs", F.when(size > 0, F.floor(F.col("target") / size.cast("double"))).otherwise(F.lit(0)).cast("long"))
    return t.select("source", "source_size", "target", "epochs",
                    (F.col("target") - (F.col("epochs") * size).cast("double")).alias("rest"))


def _range_ends(sums: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source (``_s``), the first range whose running sum reaches the rest: its smallest and largest key, its
    rows, the sum before it. ``base`` is what the source takes before all ranges."""
    running = Window.partitionBy("source").orderBy("bucket")  # at most BUCKETS + 1 rows
    joined = sums.withColumn("upto", F.sum("in_bucket").over(running)).join(
        plan.select("_s", "rest", "base"), F.col("source").eqNullSafe(F.col("_s")))
    first = F.struct("bucket", "lo", "hi", "n", (F.col("base") + F.col("upto") - F.col("in_bucket")).alias("before"))
    return (joined.filter((F.col("base") + F.col("upto")).cast("double") >= F.col("rest"))
            .groupBy("_s").agg(F.min_by(first, "bucket").alias("e")).select("_s", "e.lo", "e.hi", "e.n", "e.before"))


def _range_sums(rows: DataFrame, bucket: Column) -> DataFrame:
    return rows.groupBy("source", bucket.cast("int").alias("bucket")).agg(
        F.sum("size").alias("in_bucket"), F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))


def _beside(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """The rows with the columns of their source's row of ``per_source`` (key ``_s``)."""
    small = F.broadcast(per_source) if per_source.count() <= BROADCAST_ROWS else per_source
    return rows.join(small, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def end_ranges(rows: DataFrame, sums: DataFrame, plan: DataFrame, split_rows: int = SPLIT_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """(_s, lo, hi, n, before): the keys of a source among which its rest ends, at most ``split_rows`` rows unless they share a key."""
    ends = keep_copy(_range_ends(sums, plan.withColumn("base", F.lit(0).cast("long"))))
    is_wide = (F.col("n") > split_rows) & (F.col("lo") < F.col("hi"))
    while True:
        wide = ends.filter(is_wide)
        if wide.isEmpty():
            return ends
        inside = _beside(rows, wide.select("_s", "lo", "hi")).filter(F.col("key").between(F.col("lo"), F.col("hi")))
        part = F.least(F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets), F.lit(buckets - 1))
        closer = wide.select(F.col("_s").alias("_w"), F.col("before").alias("base")).join(plan, F.col("_w").eqNullSafe(F.col("_s"))).drop("_w")
        cut = inside.select("source", "size", "key", part.alias("part"))
        narrow = _range_ends(_range_sums(cut, F.col("part")), closer)
        ends = keep_copy(ends.filter(~is_wide).unionByName(narrow))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights=SOURCE_WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS, seed: str = SEED, split_rows: int = SPLIT_ROWS,
        buckets: int = BUCKETS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row per input row."""
    text = F.col(text_col)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                     F.size(words_of(text)).cast("long").alias("size"), text.alias("text"))
    rows = rows.select("doc_id", "source", "size", (
        -F.log(F.lit(1.0) - uniform(F.col("doc_id"), seed)) / quality(F.col("text"), F.col("size"))).alias("key"))
    rows = keep_copy(rows)  # without the texts

    sums = keep_copy(_range_sums(rows, F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * buckets)))
    sizes = sums.groupBy("source").agg(F.sum("in_bucket").alias("source_size"))
    plan = keep_copy(source_targets(sizes, weights, share, max_epochs).withColumnRenamed("source", "_s"))
    ends = end_ranges(rows, sums, plan, split_rows, buckets)
    plan = plan.join(ends.withColumnRenamed("_s", "_e"), F.col("_s").eqNullSafe(F.col("_e")), "left").drop("_e", "n")
    rows = _beside(rows, keep_copy(plan))
    inside = F.coalesce(F.col("key").between(F.col("lo"), F.col("hi")), F.lit(False))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    edge = rows.filter(inside).withColumn("once", (2 * ahead + F.col("size")).cast("double") < 2 * F.col("rest"))
    clear = rows.filter(~inside).withColumn("once", F.coalesce(F.col("key") < F.col("lo"), F.lit(False)))
    out = clear.unionByName(edge)
    taken = F.col("size") * (F.col("epochs") + F.col("once").cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


SQL = rf"""
WITH t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::DOUBLE AS sym FROM documents),
k AS (SELECT doc_id, source, size,
             -ln(1.0::DOUBLE - ('0x' || substr(md5('{SEED}-' || coalesce(doc_id::VARCHAR, '')), 1, 13))::UBIGINT::DOUBLE
                 / {2 ** 52}::DOUBLE) / (1.0::DOUBLE / (1.0::DOUBLE + sym / greatest(size, 1)::DOUBLE)) AS key FROM t),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk, source_size * {MAX_EPOCHS} AS cap FROM s),
v AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM w),
l AS (SELECT *, cap::DOUBLE / w::DOUBLE AS r FROM v),
p AS (SELECT *, ({SHARE}::DOUBLE * (sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY r, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
             / ((sum(w) OVER ()) - coalesce(sum(w) OVER (ORDER BY r, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             AS lv FROM l),
g AS (SELECT source, source_size, least(cap::DOUBLE, (max(lv) OVER ()) * w::DOUBLE) AS target FROM p),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE) ELSE 0 END::BIGINT AS epochs FROM g),
a AS (SELECT k.*, source_size, target, epochs, target - (epochs * source_size)::DOUBLE AS rest,
             coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target,
       (size * (epochs + CASE WHEN (2 * ahead + size)::DOUBLE < 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM a
"""
