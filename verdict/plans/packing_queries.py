"""Model-input truncation and packing over (user, assistant) text pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import packing as P
from ..sources import views as V
from ..sources.views import with_views
from .registry import register

_TRUNC_SQL = r"""
tok AS (SELECT conv_id, turn, len(regexp_extract_all(text_a, '\S+')) AS len_a,
               len(regexp_extract_all(text_b, '\S+')) AS len_b FROM pairs),
cap AS (SELECT *, least(len_a, 50) AS la, len_b AS lb FROM tok),
ex AS (SELECT *, greatest(la + lb - 197, 0) AS e FROM cap),
g AS (SELECT *, least(e, abs(la - lb)) AS gap FROM ex),
cuts AS (SELECT conv_id, turn, len_a, len_b,
                CAST(len_a - la + CASE WHEN la > lb THEN gap ELSE 0 END + floor((e - gap) / 2) AS INTEGER) AS trunc_a,
                CAST(CASE WHEN lb > la THEN gap ELSE 0 END + ceil((e - gap) / 2) AS INTEGER) AS trunc_b
         FROM g)"""


@register("truncate_pair", with_views("""
SELECT conv_id, turn, CAST(len_a AS INTEGER) AS len_a, CAST(len_b AS INTEGER) AS len_b, trunc_a, trunc_b,
       CAST(least(len_a, 50) - (trunc_a - (len_a - least(len_a, 50))) + len_b - trunc_b AS INTEGER) AS kept
FROM cuts""", "pairs", ctes=_TRUNC_SQL))
def truncate_pair(spark, sf_dir):
    """M5: first side capped at 50 tokens, then the longer side popped to fit 200 - 3."""
    t = P.truncate_pair(V.pairs(spark, sf_dir), "text_a", "text_b")
    return t.select("conv_id", "turn", "len_a", "len_b", "trunc_a", "trunc_b",
                    (F.size("tokens_a") + F.size("tokens_b")).alias("kept"))


@register("truncation_stats", with_views("""
SELECT count(*) AS total_samples, CAST(count_if(trunc_a + trunc_b > 0) AS BIGINT) AS total_truncations,
       round(avg(trunc_a + trunc_b), 6) AS mean_trunc, round(median(trunc_a + trunc_b), 6) AS median_trunc,
       CAST(max(trunc_a + trunc_b) AS BIGINT) AS max_trunc FROM cuts""", "pairs", ctes=_TRUNC_SQL))
def truncation_stats(spark, sf_dir):
    """Rows, rows truncated, mean / median / max tokens cut (exact median)."""
    t = P.truncate_pair(V.pairs(spark, sf_dir), "text_a", "text_b")
    return P.truncation_stats(t, F.col("trunc_a") + F.col("trunc_b"))


_TRIPLE_SQL = r"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, least(len(regexp_extract_all(text_a, '\S+')), 50) AS a,
         len(regexp_extract_all(text_b, '\S+')) AS b, len(regexp_extract_all(split_part(text_b, '.', 1), '\S+')) AS c
  FROM pairs),
t(conv_id, turn, a, b, c, b0, step, excess) AS (
  SELECT conv_id, turn, a, b, c, b, 0, greatest(a + b + c - 196, 0) FROM base
  UNION ALL
  SELECT conv_id, turn,
         CASE WHEN a > b AND a > c THEN a - 1 ELSE a END,
         CASE WHEN NOT (a > b AND a > c) AND b > a AND b > c THEN b - 1 ELSE b END,
         CASE WHEN NOT (a > b AND a > c) AND NOT (b > a AND b > c) THEN greatest(c - 1, 0) ELSE c END,
         b0, step + 1, excess
  FROM t WHERE step < excess)
SELECT conv_id, turn, CAST(a AS INTEGER) AS kept_a, CAST(b AS INTEGER) AS kept_b, CAST(c AS INTEGER) AS kept_c,
       CAST(b0 - b AS INTEGER) AS truncation
FROM t WHERE step = excess"""


@register("truncate_triple", _TRIPLE_SQL.replace(
    "WITH RECURSIVE base AS", "WITH RECURSIVE pairs AS (" + V.VIEW_SQL["pairs"] + "\n), base AS", 1))
def truncate_triple(spark, sf_dir):
    """M6 / M8: (user turn, assistant turn, first assistant sentence) fitted into 200 - 4,
    popping from the strictly longest of a, b, else c; ``truncation`` = tokens cut from b."""
    p = V.pairs(spark, sf_dir).withColumn("text_c", F.substring_index("text_b", ".", 1))
    t = P.truncate_triple(p, "text_a", "text_b", "text_c")
    return t.select("conv_id", "turn", F.size("tokens_a").alias("kept_a"), F.size("tokens_b").alias("kept_b"),
                    F.size("tokens_c").alias("kept_c"), F.col("truncation").cast("int").alias("truncation"))


@register("pack_sequence", with_views(r"""
SELECT conv_id, turn, CAST(len(toks) AS INTEGER) AS n_tokens, CAST(n_real AS INTEGER) AS n_real,
       md5(array_to_string(toks, ' ')) AS tokens_md5, segs AS segments
FROM (
  SELECT conv_id, turn,
         list_concat(['[CLS]'], ta, ['[SEP]'], tb, ['[SEP]'],
                     list_transform(range(greatest(200 - (len(ta) + len(tb) + 3), 0)), lambda i: '[PAD]')) AS toks,
         len(ta) + len(tb) + 3 AS n_real,
         concat('0', repeat('0', len(ta) + 1), repeat('1', len(tb) + 1),
                repeat('0', greatest(200 - (len(ta) + len(tb) + 3), 0))) AS segs
  FROM (
    SELECT c.conv_id, c.turn,
           regexp_extract_all(p.text_a, '\S+')[1:least(c.len_a, 50) - (c.trunc_a - (c.len_a - least(c.len_a, 50)))] AS ta,
           regexp_extract_all(p.text_b, '\S+')[1:c.len_b - c.trunc_b] AS tb
    FROM cuts c JOIN pairs p ON c.conv_id = p.conv_id AND c.turn = p.turn))""", "pairs", ctes=_TRUNC_SQL))
def pack_sequence(spark, sf_dir):
    """M7 / M9: [CLS] a [SEP] b [SEP] packed and padded to 200 with mask and segment ids."""
    t = P.truncate_pair(V.pairs(spark, sf_dir), "text_a", "text_b")
    packed = P.pack(t, ["tokens_a", "tokens_b"], [0, 1])
    return packed.select("conv_id", "turn", F.size("input_tokens").alias("n_tokens"),
                         F.aggregate("input_mask", F.lit(0), lambda acc, x: acc + x).alias("n_real"),
                         F.md5(F.array_join("input_tokens", " ")).alias("tokens_md5"),
                         F.array_join(F.transform("segment_ids", lambda x: x.cast("string")), "").alias("segments"))
