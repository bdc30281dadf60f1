"""Methods of a source file by one lexical scan.

``scan`` walks the tokens that matter once: comments, string, character and text-block literals
(skipped whole) and ``{ } ;``. Every opening brace gets its closing one from the depth; the code
before an opening brace, back to the last ``{ } ;`` outside comments and literals, is its header. A
method is a brace whose header reads like a declaration; its text runs from the line of its return
type (or constructor name), or from the last ``{ } ;`` if that stands on the same line, to its closing brace. Time is linear in the length of the file, each
method is sliced once, and files are rows, so Spark deals them over tasks.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lexical rules of the language, in the order in which they are tried; literals end at their line.
COMMENT = r"//[^\n]*|/\*(?s:.*?)(?:\*/|{end})"
LITERAL = r'"""(?s:(?:[^\\]|\\.)*?)(?:"""|{end})|"[^"\\\n]*(?:\\.[^"\\\n]*)*"?|' + r"'(?:[^'\\\n]|\\(?:u+[0-9a-fA-F]{{4}}|[0-7]{{1,3}}|.))'"
# Modifiers, and what a header says after them.
MODIFIERS = "public|protected|private|static|final|synchronized|abstract|native|default|strictfp"
BEFORE_TYPE = r"^(?:\s+|@[\w.$]+(?:\s*\((?:[^()]|\([^()]*\))*\))?|(?:" + MODIFIERS + r")\b)*"
GENERIC = r"^(?:<[^()]*>\s*)?"
CONSTRUCTOR = GENERIC + r"([\w$]+)\s*\("
METHOD = GENERIC + r"[\w$][\w.$<>\[\],?&\s]*[\s>\]]([\w$]+)\s*\("
TYPE = r"(?:^|[^\w$.])(?:class|interface|enum|record)\s+([\w$]+)"

_TOKEN = re.compile(f"(?P<comment>{COMMENT})|(?P<literal>{LITERAL})|[{{{{}}}};]".format(end=r"\Z"))
_BEFORE, _CONSTRUCTOR, _METHOD, _TYPE = (re.compile(p, re.ASCII) for p in (BEFORE_TYPE, CONSTRUCTOR, METHOD, TYPE))


def _plain(what: str, token: str) -> str:
    """What a header keeps of a token: line ends, and a pair of quotes for a literal."""
    return ('""' if what == "literal" else "") + "\n" * token.count("\n")


def scan(text: str, in_type: bool = True) -> list[tuple[str, str | None, int, int, str, str]]:
    """(name, name of the type, start line, end line, text, documentation comment) of each method, in file order."""
    return [(name, kind, first, last, text[lo:hi], text[a:b]) for name, kind, first, last, lo, hi, a, b in spans(text, in_type)]


def spans(text: str, in_type: bool = True) -> list[tuple[str, str | None, int, int, int, int, int, int]]:
    """(name, name of the type, start line, end line, start and end of its text, start and end of its comment) of each method.

    ``in_type``: the direct members of the first type of a file; else the methods of a fragment that are in no braces.
    Lines count from 0. A method that never closes is left out; one without a body is no method here."""
    line_ends = [m.start() for m in re.finditer("\n", text)]
    levels = 2 if in_type else 1  # depths below it have headers that matter
    depth, start, parts, doc, out = 0, 0, [], (0, 0), []  # start: after the last { } ; and parts: the header up to ``at``
    at, open_at, kind, type_end = 0, {}, None, None
    for m in _TOKEN.finditer(text):
        lo, hi = m.span()
        what = m.lastgroup
        if depth < levels and depth >= 0:
            if at < lo:
                parts.append(text[at:lo])
            if what:
                token = m.group()
                parts.append(_plain(what, token))
                if token.startswith("/**"):
                    doc = (lo, hi)
        at = hi
        if what:
            continue
        brace = text[lo]
        if brace == "{":
            if in_type and depth == 0 and kind is None and (t := _TYPE.search("".join(parts))):
                kind = t.group(1)
                type_end = False
            elif (depth == 1 and type_end is False) if in_type else depth == 0:
                header = "".join(parts)
                skip = _BEFORE.match(header).end()
                rest = header[skip:]
                d = _METHOD.match(rest)
                c = None if d else _CONSTRUCTOR.match(rest)
                name = d.group(1) if d else c.group(1) if c and c.group(1) == kind else None
                if name:
                    first = bisect_left(line_ends, start) + header.count("\n", 0, skip)
                    open_at[depth] = (name, first, max(start, line_ends[first - 1] + 1 if first else 0), doc)
            depth += 1
        elif brace == "}":
            depth -= 1
            if depth == 0 and type_end is False:
                type_end = True
            if depth in open_at:
                name, first, begin, comment = open_at.pop(depth)
                out.append((name, kind, first, bisect_left(line_ends, lo), begin, hi, *comment))
        start, doc = hi, (0, 0)
        parts.clear()
    return out


def _rows(in_type: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column(1).to_pylist()):
                found = scan(text or "", in_type)
                if found:
                    name, kind, first, last, body, doc = zip(*found)
                    ids = b.column(0).take(pa.array([i] * len(found)))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([0 if n == k else 1 for n, k in zip(name, kind)], pa.int32()), pa.array(range(len(found)), pa.int32()),
                         pa.array(name), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(body), pa.array(doc)],
                        names=["id", "kind_order", "member", "name", "start_line", "end_line", "method_text", "docstring"])
    return run


def methods_of(df: DataFrame, id_col: str, text: str, in_type: bool = True) -> DataFrame:
    """(id, kind_order, member, name, start_line, end_line, method_text, docstring): constructors have kind 0, methods 1;
    ``member`` numbers them in file order. Null and empty texts have none."""
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, kind_order int, member int, name string, start_line long, end_line long, method_text string, docstring string"
    return df.select(F.col(id_col), F.col(text)).mapInArrow(_rows(in_type), schema).withColumnRenamed("id", id_col)


def file_methods(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """The members of each file that are kept: a method with more than one @Test is left out."""
    return methods_of(df, id_col, text).filter(F.size(F.split("method_text", "@Test", -1)) <= 2)


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "kind_order", "member", "name", "span", "doc_span", "name_span"]
    types = [None, pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    for b in batches:
        rows, size = [], 0
        types[0] = b.schema.types[0]
        for key, text in zip(b.column(0).to_pylist(), b.column(1)):
            text = text.as_py() or ""
            size += len(text)
            seen = set()
            for i, (name, kind, _, _, lo, hi, a, e) in enumerate(spans(text)):
                if name not in seen and text.count("@Test", lo, hi) <= 1:
                    seen.add(name)
                    at = text.find(name, lo, hi)
                    rows.append((key, 0 if name == kind else 1, i, name, lo << 32 | hi, a << 32 | e, at << 32 | at + len(name) if at >= 0 else None))
            if rows and size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def method_offsets(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, kind_order, member, name, span, doc_span, name_span) of the first member of each name that ``file_methods`` keeps, without
    their texts: a span is start * 2**32 + end in characters of the file; ``sliced`` reads it. name_span is null for a name that a comment splits."""
    schema = f"id {df.schema[id_col].dataType.simpleString()}, kind_order int, member int, name string, span long, doc_span long, name_span long"
    return df.select(F.col(id_col), F.col(text)).mapInArrow(_offsets, schema).withColumnRenamed("id", id_col)


def sliced(text: str, span: str) -> Column:
    """The part of ``text`` that a span names."""
    start = F.shiftright(span, 32).cast("int")
    return F.substring(text, start + 1, F.col(span).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int") - start)


def scan_sql(source: str, in_type: bool = True) -> str:
    """The same scan as DuckDB CTEs over ``source`` (id, body): ``found`` (id, name, cls, s, e, t, doc) of every method.

    Tokens are numbered, depth and lines are running sums, and the brace that closes another is the next one of its level."""
    token = f"{COMMENT}|{LITERAL}".format(end=r"\z").replace("'", "''")
    before, ctor, method, kind = (p.replace("'", "''") for p in (BEFORE_TYPE, CONSTRUCTOR, METHOD, TYPE))
    inside = "o.level = 1 AND o.g > ty.g AND o.i < ty.close_i" if in_type else "o.level = 0"
    types = ("(SELECT id, arg_min(g, i) AS g, arg_min(close_i, i) AS close_i, arg_min(cls, i) AS cls FROM (SELECT *, regexp_extract(header, "
             f"'{kind}', 1) AS cls FROM named WHERE level = 0) WHERE cls <> '' GROUP BY id)" if in_type
             else "(SELECT DISTINCT id, NULL AS g, NULL AS close_i, NULL AS cls FROM named)")
    return rf"""
tok AS (
  SELECT id, i, toks[i] AS t FROM (
    SELECT id, toks, unnest(generate_series(1, len(toks))) AS i FROM (
      SELECT id, regexp_extract_all(coalesce(body, ''), '(?:{token}|[{{}};]|[^"''/{{}};]+|(?s:.))') AS toks FROM {source}))),
placed AS (
  SELECT id, i, t, t IN ('{{', '}}', ';') AS stop, len(t) - len(replace(t, chr(10), '')) AS nl,
         coalesce(sum(len(t)) OVER before, 0) AS off, coalesce(sum(len(t) - len(replace(t, chr(10), ''))) OVER before, 0) AS line,
         coalesce(sum(CASE WHEN t IN ('{{', '}}', ';') THEN 1 ELSE 0 END) OVER before, 0) AS g,
         coalesce(sum(CASE t WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER before, 0) AS depth
  FROM tok WINDOW before AS (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
headers AS (
  SELECT id, g, min(line) AS line, min(off) AS off, arg_max(t, i) FILTER (WHERE starts_with(t, '/**')) AS doc, string_agg(CASE
           WHEN stop THEN '' WHEN starts_with(t, '//') OR starts_with(t, '/*') THEN repeat(chr(10), nl)
           WHEN starts_with(t, '"') OR (starts_with(t, '''') AND len(t) > 1) THEN '""' || repeat(chr(10), nl) ELSE t END, '' ORDER BY i) AS header
  FROM placed GROUP BY id, g),
braces AS (
  SELECT *, lead(i) OVER w AS close_i, lead(line) OVER w AS e, lead(off) OVER w AS close_off
  FROM (SELECT *, CASE t WHEN '{{' THEN depth ELSE depth - 1 END AS level FROM placed WHERE t IN ('{{', '}}'))
  WINDOW w AS (PARTITION BY id, level ORDER BY i)),
named AS (SELECT b.*, h.header, h.doc, h.line AS first, h.off AS first_off FROM braces b JOIN headers h ON h.id = b.id AND h.g = b.g WHERE b.t = '{{'),
decl AS (
  SELECT o.id, ty.cls, o.e, o.close_off, o.first_off, coalesce(o.doc, '') AS doc, first + len(pre) - len(replace(pre, chr(10), '')) AS s, o.i,
         CASE WHEN m <> '' THEN m WHEN c = ty.cls THEN c ELSE '' END AS name
  FROM (SELECT *, regexp_extract(rest, '{method}', 1) AS m, regexp_extract(rest, '{ctor}', 1) AS c FROM (
          SELECT *, substr(header, len(pre) + 1) AS rest FROM (SELECT *, regexp_extract(header, '{before}') AS pre FROM named))) o
  JOIN {types} ty ON ty.id = o.id
  WHERE {inside} AND o.close_i IS NOT NULL),
found AS (
  SELECT id, name, cls, s, e, doc, i, substr(body, lo + 1, CAST(close_off AS BIGINT) - lo + 1) AS t FROM (
    SELECT decl.*, body, greatest(CAST(first_off AS BIGINT), CASE WHEN s = 0 THEN 0 ELSE len(array_to_string(string_split(body, chr(10))[1:s], chr(10))) + 1 END) AS lo
    FROM decl JOIN {source} USING (id) WHERE name <> ''))"""
