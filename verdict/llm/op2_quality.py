"""Quality rules: a ledger of rule bits.

``ledger`` evaluates every rule once per document and stores one failure bit per rule next
to the measurements. ``apply_policy`` is a bit mask over the stored bits, so a new policy
version (or a rule switched off) needs no second look at the text. ``ablation`` gets, in one
aggregation, how many documents each rule rejects and how many it alone rejects.

Everything is a column expression of one row: no shuffle, no Python, one pass over the text.

Defined results: a null or empty text has no words and fails ``few_words``; repeated rows are
judged one by one; a null id stays null; other columns of the input, whatever their names,
are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, WORD, count_chars, with_value, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5

# rule -> condition over the measurements (SQL that Spark and DuckDB both read). The order
# fixes the bits: append only.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "symbols": "10 * n_symbols > n_words",
    "capitals": "100 * n_capitals > 40 * word_chars",
    "stutter": "100 * n_stutter > 30 * n_words",
    "long_words": "word_chars > 25 * n_words",
}
BASE = ("few_words", "repeated_windows")
#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": tuple(RULES),
}
CURRENT = "v2"


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(rules) -> int:
    return sum(bit(r) for r in rules)


def _covered(hashes: Column) -> Column:
    """Word positions inside windows that occur twice or more, from the windows' hashes."""

    def from_starts(starts: Column) -> Column:
        last = F.size(starts) - 1
        run = F.transform(starts, lambda x, j: F.when(j < last, F.least(F.lit(WINDOW), F.get(starts, j + 1) - x))
                          .otherwise(F.lit(WINDOW)))
        return F.aggregate(run, F.lit(0).cast("long"), lambda a, x: a + x)

    def from_sorted(s: Column) -> Column:
        twin = F.transform(s, lambda x, j: F.when(
            (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]), x["i"]))
        return with_value(F.sort_array(F.filter(twin, lambda x: x.isNotNull())), from_starts)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
        with_value(pairs, from_sorted))


def _repeat_words(words: Column) -> Column:
    starts = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)).otherwise(
        F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return with_value(hashes, _covered)


def measurements(text: Column) -> Column:
    """Struct of all counts. Windows are compared by 64-bit hash within one document."""
    text = F.coalesce(text, F.lit(""))
    from_words = with_value(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        _repeat_words(w).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).cast("long").alias("n_stutter")))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    from_lines = with_value(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(
        from_words.alias("w"), from_lines.alias("l"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        count_chars(text, SYMBOLS).cast("long").alias("n_symbols"),
        count_chars(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"))


#: Where each measurement stands in the struct of ``measurements``.
PATHS = {"n_words": "w.n_words", "n_repeat_words": "w.n_repeat_words", "n_stutter": "w.n_stutter", "n_lines": "l.n_lines",
         "n_dup_lines": "l.n_dup_lines", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_capitals": "n_capitals"}


def fail_bits(struct: str) -> str:
    """SQL of the failure bits of all rules over a struct column of measurements."""
    name = re.compile(rf"\b({'|'.join(PATHS)})\b")  # whole names: one may be part of another
    rules = ((bit(rule), name.sub(lambda m: f"{struct}.{PATHS[m[1]]}", cond)) for rule, cond in RULES.items())
    return "cast(" + " + ".join(f"case when {cond} then {b} else 0 end" for b, cond in rules) + " as bigint)"


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, measurements, ``fail_bits`` (bit i: rule i fails)."""
    measured = df.select(F.col(id_col), with_value(F.col(text_col), measurements).alias("_m"))
    return measured.select(
        F.col(id_col), "_m.w.n_words", "_m.word_chars", "_m.n_symbols", "_m.l.n_dup_lines", "_m.w.n_repeat_words",
        "_m.l.n_lines", "_m.n_capitals", "_m.w.n_stutter", F.expr(fail_bits("_m")).alias("fail_bits"))


def apply_policy(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds ``base_failed``, ``kept`` and ``sole_bit`` (the bit of the only rule that rejects, else 0)."""
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy])))
    return (led.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(mask(BASE))) != 0)
            .withColumn("kept", ~F.col("base_failed") & (failed == 0))
            .withColumn("sole_bit", F.when(failed.bitwiseAND(failed - 1) == 0, failed).otherwise(F.lit(0).cast("long"))))


def ablation(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of the policy: rule, n_failed, n_sole (documents that come back without it).

    One partial aggregation over the stored bits; the text is not read again.
    """
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy])))
    names = POLICIES[policy]
    sums = [F.count_if(failed.bitwiseAND(F.lit(bit(r))) != 0).alias(f"f_{r}") for r in names]
    sums += [F.count_if(failed == bit(r)).alias(f"s_{r}") for r in names]
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"),
                                        F.col(f"s_{r}").alias("n_sole")) for r in names]))
    return led.agg(*sums).select(rows.alias("r")).select("r.*")


def keep_good(df: DataFrame, policy: str = CURRENT, text_col: str = "text") -> DataFrame:
    """The input rows, all columns unchanged, that the policy keeps."""
    mark = "_verdict_mark"
    rejected = f"({fail_bits(mark)} & {mask(dict.fromkeys(BASE + POLICIES[policy]))}) <> 0"
    # explode of a 0/1-element array: a filter would be pushed below and compute the struct twice
    kept = df.withColumn(mark, with_value(F.col(text_col), measurements))
    return kept.withColumn(mark, F.expr(f"explode(if({rejected}, array(), array(true)))")).drop(mark)


SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '{WORD}') AS w,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ln
      FROM t),
g AS (SELECT rid, unnest(range(1, len(w) - 3)) AS i,
             unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS g
      FROM w WHERE len(w) >= 5),
d AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c >= 2),
r AS (SELECT rid, sum(least(5, nxt - i))::BIGINT AS n
      FROM (SELECT rid, i, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i), i + 5) AS nxt FROM d) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ln)::BIGINT AS n_lines,
             length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
             len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_stutter
      FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, ({" + ".join(f"case when {c} then {1 << i} else 0 end" for i, c in enumerate(RULES.values()))})::BIGINT
             AS fail_bits FROM m)
SELECT *, fail_bits & {mask(BASE)} <> 0 AS base_failed,
       fail_bits & {mask(dict.fromkeys(BASE + POLICIES[CURRENT]))} = 0 AS kept,
       (case when (fail_bits & {mask(POLICIES[CURRENT])}) & ((fail_bits & {mask(POLICIES[CURRENT])}) - 1) = 0
             then fail_bits & {mask(POLICIES[CURRENT])} else 0 end)::BIGINT AS sole_bit
FROM b
"""
