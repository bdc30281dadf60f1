"""Line-level operators over code texts.

* ``distinct_line_counts``, ``lone_lines`` (W7): lines of a test that no other test of the bug has.
* ``marker_split`` (W3): one split test per marker line (earlier plain lines + it + '}').
* ``method_spans`` (W6) and ``repair_files`` (J12): drop every method whose line
  span holds a failing line, a range anti-join on (file, line in [start, end)) by a sweep.
* ``compile_error_lines`` (P29): (file, line) of compiler error lines.

Steps inside one text work on its line array; only what meets other texts is
exploded. Texts go to Python for the splits alone, which are streamed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let, py_strip


def text_lines(df: DataFrame, id_cols: Sequence[str], text: str, keep_blank: bool = True) -> DataFrame:
    """(ids..., line_idx (0-based), line) for every line of ``text``."""
    out = df.select(*id_cols, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_idx", "line"))
    out = out.withColumn("line_idx", F.col("line_idx").cast("long"))
    if not keep_blank:
        out = out.filter(py_strip("line") != "")
    return out


def test_line_set(text: Column | str) -> Column:
    """Stripped non-blank lines without the first two and the last one, as a set."""
    lines = F.filter(F.transform(F.split(py_strip(text), "\n", -1), lambda x: py_strip(x)), lambda x: x != "")
    return F.array_distinct(let(lines, lambda ls: F.when(F.size(ls) > 3, F.slice(ls, F.lit(3), F.size(ls) - 3)).otherwise(F.array().cast("array<string>"))))


def lone_lines(df: DataFrame, group: Sequence[str], id_col: str, text: str, out: str) -> DataFrame:
    """(group..., id, ``out``) of the tests with lines found in no other test of their group; lines meet by their MD5 digest."""
    exploded = df.select(*group, id_col, F.explode(F.transform(test_line_set(text), lambda x: F.unhex(F.md5(x)))).alias("_line"))
    per_line = exploded.groupBy(*group, "_line").agg(F.count(F.lit(1)).alias("_n"), F.min(id_col).alias(id_col))
    return per_line.filter(F.col("_n") == 1).groupBy(*group, id_col).agg(F.count(F.lit(1)).cast("int").alias(out))


def distinct_line_counts(df: DataFrame, group: Sequence[str], id_col: str, text: str, out: str) -> DataFrame:
    """Add ``out`` = number of lines of the test found in no other test of its group."""
    return df.join(lone_lines(df, group, id_col, text, out), [*group, id_col], "left").fillna(0, [out])


#: Text of the splits sent on at once.
SPLIT_BYTES = 1 << 20


def _splits_of(text: str | None, marker: str) -> Iterator[tuple[str, bool]]:
    """(split, has_marker) of one text, one at a time; the lines before a marker are kept once."""
    if text is None:
        return
    plain: list[str] = []
    for line in text.split("\n"):
        if not line.strip():
            continue
        if marker in line:
            yield "\n".join([*plain, line, "}"]), True
        else:
            plain.append(line)
    yield "\n".join(plain), False


def marker_split(df: DataFrame, id_col: str, text: str, marker: str) -> DataFrame:
    """Split tests: for every non-blank line containing ``marker`` (in order), the
    earlier non-blank non-marker lines + that line + '}'; then one row with all
    non-blank non-marker lines. ``split_no`` orders them; the last is the full one.

    A text's splits together grow with the square of its length, so they are made one after the other and sent on
    ``SPLIT_BYTES`` at a time: a task holds the lines of one text and one batch, however many markers there are.
    A null text has no split.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out, size = [], [], 0

            def batch() -> pa.RecordBatch:
                split, has, no = zip(*out)
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(split, pa.string()), pa.array(has, pa.bool_()),
                                                   pa.array(no, pa.int64())], names=["id", "split_test", "has_marker", "split_no"])

            for i, value in enumerate(b.column(1).to_pylist()):
                for no, (split, has) in enumerate(_splits_of(value, marker)):
                    at.append(i)
                    out.append((split, has, no))
                    size += len(split)
                    if size > SPLIT_BYTES:
                        yield batch()
                        at, out, size = [], [], 0
            if out:
                yield batch()

    return df.select(id_col, text).mapInArrow(run, f"id {id_type}, split_test string, has_marker boolean, split_no long").withColumnRenamed("id", id_col)


def _spans(lines: Column, signature: str) -> Column:
    """struct(spans: array of (start, end), last_brace) of a file's lines: a span starts one line before a signature
    and ends where the next one starts, the last one at the last lone '}' line (else at the line count)."""
    at = lambda keep: F.filter(F.transform(lines, lambda x, i: F.when(keep(x), i)), lambda i: i.isNotNull())
    last = F.coalesce(F.array_max(at(lambda x: py_strip(x) == "}")), F.size(lines)).cast("long")
    starts = F.transform(at(lambda x: x.rlike(signature)), lambda i: (i - 1).cast("long"))
    return let(F.struct(starts.alias("s"), last.alias("last")), lambda v: F.struct(
        F.transform(v["s"], lambda x, i: F.struct(x.alias("start"), F.coalesce(F.get(v["s"], i + 1), v["last"]).alias("end"))).alias("spans"),
        v["last"].alias("last_brace")))


def method_spans(files: DataFrame, file_col: str, text: str, signature: str) -> DataFrame:
    """(file, start, end) of the methods of each file, inside its line array."""
    spans = let(F.split(F.col(text), "\n", -1), lambda ls: _spans(ls, signature)["spans"])
    return files.select(file_col, F.explode(spans).alias("_s")).select(file_col, "_s.*")


def failing_spans(spans: DataFrame, errors: DataFrame, file_col: str) -> tuple[DataFrame, DataFrame]:
    """((file, start, end) of the spans with a failing line, (file, err_idx) of the failing lines before a file's first span).

    A sweep over each file's span starts and failing lines in line order: spans don't overlap, so a line can only lie in the
    span that opened last. A failing line counts once, so a file's sweep is as long as the file, whatever the errors.
    """
    points = errors.select(file_col, F.col("err_idx").cast("long").alias("pos")).filter("pos >= 0").distinct()
    events = (spans.select(file_col, F.col("start").alias("pos"), F.lit(0).alias("kind"), "start", "end")
              .unionByName(points.withColumn("kind", F.lit(1)), allowMissingColumns=True))
    w = Window.partitionBy(file_col).orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    open_span = F.last(F.when(F.col("kind") == 0, F.struct("start", "end")), ignorenulls=True).over(w)
    swept = events.withColumn("_span", open_span).filter(F.col("kind") == 1)
    bad = swept.filter(F.col("pos") < F.col("_span.end")).select(file_col, "_span.start", "_span.end").distinct()
    return bad, swept.filter(F.col("_span").isNull()).select(file_col, F.col("pos").alias("err_idx"))


def repair_files(files: DataFrame, errors: DataFrame, file_col: str, text: str, signature: str) -> DataFrame:
    """(file, kept): the lines (line_idx, line) that are left when every method span with a failing line, and failing
    ``import`` lines of the header, are removed. ``errors`` has (file, err_idx) 0-based.

    A range anti-join on (file, line in [start, end)): ``failing_spans`` finds the spans to go; a file gets back
    at most its own methods and header lines, and the lines that stay are a difference of index sets.
    """
    bad, early = failing_spans(method_spans(files, file_col, text, signature), errors, file_col)
    spans_out = bad.groupBy(file_col).agg(F.array_agg(F.struct("start", "end")).alias("_bad"))
    early_out = early.groupBy(file_col).agg(F.array_agg("err_idx").alias("_early"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    joined = (files.select(file_col, text).join(spans_out, file_col, "left").join(early_out, file_col, "left")
              .withColumns({"_bad": none("_bad", "array<struct<start:bigint,end:bigint>>"), "_early": none("_early", "array<bigint>")}))

    def kept(ls: Column) -> Column:
        def left(v: Column) -> Column:
            header = F.coalesce(F.get(v["spans"], 0)["start"], v["last_brace"])
            imports = F.filter(F.transform(ls, lambda x, i: F.when(x.startswith("import") & (i < header), i.cast("long"))), lambda i: i.isNotNull())
            gone = F.concat(F.flatten(F.transform("_bad", lambda s: F.sequence(s["start"], s["end"] - 1))), F.array_intersect(imports, F.col("_early")))
            stay = F.array_except(F.sequence(F.lit(0).cast("long"), F.size(ls).cast("long") - 1), gone)
            return F.transform(stay, lambda i: F.struct(i.alias("line_idx"), F.get(ls, i.cast("int")).alias("line")))
        return let(_spans(ls, signature), left)

    return joined.select(file_col, let(F.split(F.col(text), "\n", -1), kept).alias("kept"))


# The compiler's message lines.
_ERROR_RE = r"^.*?(\S*_ESTest\.java):(\d+):\s+error:.*"
_WARNING_RE = r"^.*?(\S*_ESTest\.java):(\d+):\s+warning:.*"


def compile_error_lines(df: DataFrame, keys: Sequence[str], msg: str) -> DataFrame:
    """(keys..., file, line_no, status) per message line that names a test file:
    status 'error' (parsed), 'warning' (ignored) or 'unparsed'. The file path
    drops its first four segments."""
    lines = df.select(*keys, F.explode(F.split(F.col(msg), "\n+")).alias("_l"))
    lines = lines.filter(F.contains(F.col("_l"), F.lit("_ESTest.java")))
    path = F.regexp_extract("_l", _ERROR_RE, 1)
    is_err = F.col("_l").rlike(_ERROR_RE)
    status = F.when(is_err, "error").when(F.col("_l").rlike(_WARNING_RE), "warning").otherwise("unparsed")
    segs = F.split(path, "/")
    return lines.select(
        *keys,
        F.when(is_err, F.array_join(F.slice(segs, 5, 1 << 20), "/")).alias("file"),
        F.when(is_err, F.regexp_extract("_l", _ERROR_RE, 2).cast("int")).alias("line_no"),
        status.alias("status"))

