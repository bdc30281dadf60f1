"""URL filters: host and path rules, then a weighted vocabulary counted by Aho-Corasick.

The automaton of all terms runs over the lower-cased (A-Z) url; a hit counts if no letter or
digit stands directly before or after it. One strict term, or ``SOFT_LIMIT`` distinct soft
terms, block the url. Host and path rules go first: the longest rule that fits decides.

Row by row in Arrow batches: no shuffle; the automaton (a few kB, built from parameters) is
made once per task.

Defined results: a null url, or one without ``://``, has empty host and path and fits no rule;
the vocabulary still judges its text (null: allowed). Repeated rows are judged one by one; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import A_Z, A_Z_LOWER

# (host, path) -> verdict
RULES: dict[tuple[str, str], str] = {
    ("org", "/"): "allow",
    ("example.org", "/es/"): "block",
    ("example.org", "/en/1"): "block",
    ("com", "/fr/"): "allow",
    ("com", "/de/"): "block",
}
STRICT = ("porn", "xxx", "casino", "viagra", "cheap-pills", "free-bets", "spam-farm", "warez", "escort")
SOFT = ("ads", "track", "bet", "bets", "win", "free", "cheap", "pills", "spam", "farm", "adult", "sex", "loan", "loans",
        "poker", "slots", "jackpot", "prize", "click", "banner")
SOFT_LIMIT = 2
STRICT_WEIGHT, SOFT_WEIGHT = SOFT_LIMIT, 1


def automaton(strict=STRICT, soft=SOFT):
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, (term, weight) in enumerate([(t, STRICT_WEIGHT) for t in strict] + [(t, SOFT_WEIGHT) for t in soft]):
        a.add_word(term, (i, len(term), weight))
    a.make_automaton()
    return a


def vocabulary_weight(a, url: str) -> int:
    """Sum of the weights of the distinct terms that stand in the url between boundaries."""
    seen = {}
    for end, (i, n, weight) in a.iter(url):
        before, after = url[end - n:end - n + 1] if end >= n else "", url[end + 1:end + 2]
        if not _inner(before) and not _inner(after):
            seen[i] = weight
    return sum(seen.values())


def _inner(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def ordered_rules(rules=RULES) -> list[tuple[str, str, str]]:
    """Longest first (host and path together, then host)."""
    return [(h, p, v) for (h, p), v in sorted(rules.items(), key=lambda x: (-len(x[0][0]) - len(x[0][1]), -len(x[0][0]), x[0]))]


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=None, strict=STRICT, soft=SOFT,
          limit: int = SOFT_LIMIT) -> DataFrame:
    """id, host, path, rule, verdict, weight (of the vocabulary) per input row."""
    ordered = ordered_rules(RULES if rules is None else rules)
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    rows = df.select(F.col(id_col), F.translate(url, A_Z, A_Z_LOWER).alias("low"),
                     F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), A_Z, A_Z_LOWER).alias("host"),
                     F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"))
    id_type = rows.schema[id_col].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(strict, soft)
        for b in batches:
            weights = pa.array([vocabulary_weight(a, u) for u in b.column("low").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column("host"), b.column("path"), weights],
                                             names=[id_col, "host", "path", "weight"])

    out = rows.mapInArrow(weigh, f"`{id_col}` {id_type}, host string, path string, weight int")
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("weight") >= limit, F.lit("block")).otherwise(F.lit("allow"))
    for h, p, v in reversed(ordered):  # the longest is tested first
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return out.select(F.col(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"), "weight")


def _sql() -> str:
    term = lambda t: f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS INTEGER)"
    weight = " + ".join([f"{STRICT_WEIGHT} * {term(t)}" for t in STRICT] + [f"{SOFT_WEIGHT} * {term(t)}" for t in SOFT])
    fits = [(f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))", h + p, v)
            for h, p, v in ordered_rules()]
    rule = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits)
    low = lambda x: f"translate({x}, '{A_Z}', '{A_Z_LOWER}')"
    return rf"""
WITH u AS (SELECT page_id, {low("coalesce(url, '')")} AS low, coalesce(url, '') AS url FROM pages),
r AS (SELECT *, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, low, {low("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
w AS (SELECT *, ({weight})::INTEGER AS weight FROM h)
SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule,
       CASE {verdict} WHEN weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict, weight FROM w
"""


SQL = _sql()
