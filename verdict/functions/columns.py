"""Column helpers shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str, digits: int | None = 6) -> Column:
    """num / den as double; 0/0 (and x/0) gives null instead of raising (ANSI)."""
    r = F.try_divide(col_(num).cast("double"), col_(den).cast("double"))
    return F.round(r, digits) if digits is not None else r


def guarded_ratio(num: Column | str, den: Column | str, default: float = 1.0, digits: int | None = 6) -> Column:
    """Ratio with a fixed value when the denominator is zero."""
    return F.coalesce(ratio(num, den, digits), F.lit(float(default)))


def f1(p: Column | str, r: Column | str, digits: int | None = 6) -> Column:
    p, r = col_(p), col_(r)
    return ratio(2 * p * r, p + r, digits)


def count_true(c: Column | str) -> Column:
    """Number of true values (nulls skipped, like a pandas boolean sum)."""
    return F.sum(col_(c).cast("long")).cast("long")


def md5_uniform(*parts: Column | str) -> Column:
    """Deterministic uniform double in [0, 1) from md5 of the parts joined by '-'.

    Same value on any engine that has md5: first 8 hex digits / 2**32.
    """
    key = F.concat_ws("-", *[col_(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


# The characters of Unicode's White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def py_strip(c: Column | str) -> Column:
    """Python ``str.strip()``: Unicode whitespace on both ends (plain F.trim only strips blanks)."""
    return F.trim(col_(c), F.lit(WHITE_SPACE))


def clean_ws(c: Column | str) -> Column:
    """Every whitespace run -> one space, then strip (Unicode aware)."""
    return F.trim(F.regexp_replace(col_(c), r"(?U)\s+", " "))


def rfind(c: Column | str, needle: str) -> Column:
    """1-based position of the last occurrence of ``needle`` (0 if absent)."""
    c = col_(c)
    return let(F.locate(needle[::-1], F.reverse(c)),
               lambda pos: F.when(pos == 0, F.lit(0)).otherwise(F.length(c) - pos - F.lit(len(needle)) + 2))


def last_of(c: Column, chars: str) -> Column:
    """1-based position of the last character of ``chars`` (0 if there is none)."""
    return F.length(c) - F.length(F.regexp_extract(F.reverse(c), f"^[^{chars}]*", 0))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row (a one-element ``transform``).

    Catalyst inlines a projected expression into every place that uses it; a lambda variable
    is bound once, so chained text steps stay linear in the number of patterns.
    """
    return F.transform(F.array(value), body)[0]


def keep_non_null(df, column: str):
    """Drop rows whose ``column`` is null without a Filter node.

    A filter on a deeply computed column is pushed below the projections that
    define it, and Catalyst inlines every intermediate into the predicate (each
    reference duplicates the whole chain). Exploding a 0/1-element array keeps the
    computation in its projection and drops the rows after it.
    """
    dtype = dict(df.dtypes)[column]
    one = F.when(F.col(column).isNotNull(), F.array(F.col(column))).otherwise(F.array().cast(f"array<{dtype}>"))
    return df.withColumn(column, F.explode(one))
