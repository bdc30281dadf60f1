"""Test-code text operators: exception-oracle classification and normalisation,
assertion separation, header standardisation, literal types, test rendering.

All of them are Column expressions (regex, locate, higher-order functions over
arrays); Java regex is used with the same greedy semantics as the patterns
they mirror, on whitespace-cleaned single-line text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean_ws, col_, last_of, let, py_strip, rfind

# Patterns of the exception-oracle classifier.
ASSERT_THROWS_BODY_RE = r"^.*\(\s*\)\s*->\s*(.*)\s*\)"
EXPECTED_RE = r"^@Test.*(expected\s*=.*Exception.class)"
ASSERT_RE = r"assert[a-zA-z]*\(.*\);"
FAIL_CATCH_RE = r"fail\(.*\).*}\s*catch"
FAIL_CATCH_EXTRACT_RE = r"(?s)try\s*\{(.*;) fail\(.*\)\s*;\s*\}\s*catch"
EMPTY_TEST_RE = r"^@Test (public )?void \S*\(.*\)\s*\{\s*}"
METHOD_NAME_RE = r"(?s)^.*\s+([\w\d$]+)\(.*\)\s*(throws.*)?$"
UNDECLARED_MARK = "// Undeclared exception! "


def _after_first(s: Column, token: str) -> Column:
    """Python ``s.split(token)[1]``: text between the first and second occurrence."""
    return F.coalesce(F.get(F.split(s, _re_quote(token), -1), 1), F.lit(""))


def _before_first(s: Column, token: str) -> Column:
    return F.substring_index(s, token, 1)


def _re_quote(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\/" else ch for ch in s)


def balanced_block(test: Column, call: str) -> Column:
    """Text inside the balanced parentheses after the first ``call``; a lambda body
    (after '->') or ``obj::m`` -> ``obj.m()``."""
    return let(_after_first(test, call), lambda part: let(F.split(part, ""), lambda chars: let(_block(part, chars), _called)))


def _block(part: Column, chars: Column) -> Column:
    init = F.struct(F.lit(0).alias("d"), F.lit(0).alias("i"), F.lit(-1).alias("end"))

    def step(s, ch):
        d = F.when(ch == "(", s["d"] + 1).when(ch == ")", s["d"] - 1).otherwise(s["d"])
        hit = (s["end"] < 0) & (ch == ")") & (d == 0)
        return F.struct(F.when(s["end"] < 0, d).otherwise(s["d"]).alias("d"), (s["i"] + 1).alias("i"),
                        F.when(hit, s["i"]).otherwise(s["end"]).alias("end"))

    return let(F.aggregate(chars, init, step)["end"], lambda end: F.substring(
        part, F.lit(1), F.when(end >= 0, end).otherwise(F.greatest(F.size(chars) - 1, F.lit(0)))))


def _called(block: Column) -> Column:
    lam = F.coalesce(F.get(F.split(block, "->", -1), 1), F.lit(""))
    ref = F.regexp_extract(block, r"(\w+)::(\w+)", 0)
    ref_call = F.concat(F.regexp_extract(block, r"(\w+)::(\w+)", 1), F.lit("."),
                        F.regexp_extract(block, r"(\w+)::(\w+)", 2), F.lit("()"))
    return F.when(F.contains(block, F.lit("->")), lam).when(ref != "", ref_call).otherwise(block)


def exception_kind(test: Column | str) -> Column:
    """First matching rule on the cleaned test: assertThrows / expected / assertThatThrownBy /
    fail_catch / isThrownBy, else 'none' (negative example)."""
    return let(clean_ws(test), _kind)


def _kind(t: Column) -> Column:
    return (F.when(F.contains(t, F.lit("assertThrows")), "assertThrows")
            .when(t.rlike(EXPECTED_RE), "expected")
            .when(F.contains(t, F.lit("assertThatThrownBy")), "assertThatThrownBy")
            .when(t.rlike(FAIL_CATCH_RE), "fail_catch")
            .when(F.contains(t, F.lit("isThrownBy")), "isThrownBy")
            .otherwise("none"))


def remove_assignment_rhs(t: Column) -> Column:
    """Keep only the right side of a trailing assignment statement."""
    start = let(F.rtrim(py_strip(t), F.lit(";} ")), lambda s: last_of(s, ";{}"))  # 1-based, 0 = none

    def cut(start: Column, last: Column) -> Column:
        return let(F.instr(last, "="), lambda eq: F.when(eq == 0, t).otherwise(
            F.concat(F.substring(t, F.lit(1), start), F.substring(last, eq + 1, F.lit(1 << 30)))))

    return let(start, lambda i: let(F.substring(t, i + 1, F.lit(1 << 30)), lambda last: cut(i, last)))


def normalize_negative(t: Column) -> Column:
    """Cut the first assertion statement (from the last ';', '{' or '}' before it), then
    drop the left side of a trailing assignment. Each step is bound, so a text is searched once a pattern."""
    def cut(at: Column) -> Column:  # 1-based, 0 = no match
        rest = F.substring(t, at + F.length(F.regexp_extract(t, ASSERT_RE, 0)), F.lit(1 << 30))
        head = let(F.substring(t, F.lit(1), at - 1), lambda before: F.substring(before, F.lit(1), last_of(before, ";{}")))
        return F.when(at > 0, F.concat(head, rest)).otherwise(t)

    return let(let(F.regexp_instr(t, F.lit(ASSERT_RE)), cut), remove_assignment_rhs)


def normalize_exception_test(test: Column | str) -> Column:
    """Normalised test text per kind (before pruning and header standardisation); null when the
    kind's pattern does not fit (such a row is an error)."""
    return let(clean_ws(test), lambda t: let(_kind(t), lambda k: _normalize(t, k)))


def _normalize(t: Column, kind: Column) -> Column:
    # the pattern is tried from the start of the text; without a lambda body it does not match
    throws = let(_after_first(t, "assertThrows"), lambda call: F.when(call.rlike(ASSERT_THROWS_BODY_RE), F.concat(
        _before_first(t, "assertThrows"), F.regexp_extract(call, ASSERT_THROWS_BODY_RE, 1), F.lit("; }\n"))))
    expected = F.replace(t, F.regexp_extract(t, EXPECTED_RE, 1), F.lit(""))
    that = F.concat(_before_first(t, "assertThatThrownBy"), balanced_block(t, "assertThatThrownBy"), F.lit("; }\n"))
    fail = let(F.regexp_instr(t, F.lit(FAIL_CATCH_EXTRACT_RE)), lambda m_pos: F.when(m_pos > 0, F.concat(
        F.substring(t, F.lit(1), m_pos - 1), py_strip(F.regexp_extract(t, FAIL_CATCH_EXTRACT_RE, 1)), F.lit(" }\n"))))
    is_thrown = F.concat(_before_first(t, "isThrownBy"), balanced_block(t, "isThrownBy"), F.lit("; }\n"))
    return (F.when(kind == "assertThrows", throws).when(kind == "expected", expected)
            .when(kind == "assertThatThrownBy", that).when(kind == "fail_catch", fail)
            .when(kind == "isThrownBy", is_thrown).otherwise(normalize_negative(t)))


def prune_pieces(t: Column | str) -> Column:
    """Split on ';', drop empty pieces, join again (the assertion pattern can never
    match a ';'-free piece, so this is the whole observable effect)."""
    return F.array_join(F.filter(F.split(col_(t), ";", -1), lambda x: x != ""), ";")


def standardize_header(test: Column | str, focal: Column | str) -> Column:
    """'public void test' + focal name (first letter upper) + '() {' + body after the
    first '{'; null when the focal name or the '{' is missing (row dropped)."""
    t = col_(test)

    def header(name: Column) -> Column:
        cap = F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30))
        return let(F.instr(t, "{"), lambda brace: F.when((name != "") & (brace > 0), F.concat(
            F.lit("public void test"), cap, F.lit("() {"), F.substring(t, brace + 1, F.lit(1 << 30)))))

    return let(F.regexp_extract(_before_first(clean_ws(focal), "{"), METHOD_NAME_RE, 1), header)


def exception_inputs(df: DataFrame, test: str, focal: str) -> DataFrame:
    """Exception-model input rows: kind, label, normalised and standardised test, drop reason.

    Dropped (``reason``): negative tests that normalise to an empty test, negative tests that
    still hold ``verifyException``, tests whose pattern or header does not fit. ``missed`` marks
    negative tests that speak of an exception. Each step is bound once per row (``let``), so a
    pattern runs once per text.
    """
    def from_norm(t: Column, kind: Column, norm: Column) -> Column:
        none = kind == "none"
        pruned = clean_ws(prune_pieces(F.replace(norm, F.lit(UNDECLARED_MARK), F.lit(""))))
        return let(let(pruned, lambda p: standardize_header(p, focal)), lambda model: F.struct(
            kind.alias("kind"), F.when(none, 0).otherwise(1).alias("label"), model.alias("model_test"),
            F.when(none & norm.rlike(EMPTY_TEST_RE), "empty_test")
            .when(none & F.contains(t, F.lit("verifyException")), "error")
            .when(norm.isNull() | model.isNull(), "error").alias("reason"),
            (none & t.rlike("[eE]xception")).alias("missed")))

    steps = let(clean_ws(test), lambda t: let(_kind(t), lambda k: let(_normalize(t, k), lambda n: from_norm(t, k, n))))
    return df.withColumn("_x", steps).select(*df.columns, "_x.*")


# ---- assertions ------------------------------------------------------------

# The first assertion of a test and what stands in its place.
SEPARATE_ASSERT_RE = r"assert\w*\(.*\)"
PLACEHOLDER = '"<AssertPlaceHolder>" ; \n }'


def separate_assertion(test: Column | str) -> tuple[Column, Column]:
    """(prefix with placeholder, first assertion) — null when there is none."""
    t = col_(test)
    pos = F.regexp_instr(t, F.lit(SEPARATE_ASSERT_RE))
    assertion = F.regexp_extract(t, SEPARATE_ASSERT_RE, 0)
    prefix = F.concat(F.substring(t, 1, pos - 1), F.lit(PLACEHOLDER))
    return F.when(pos > 0, prefix), F.when(pos > 0, assertion)


def _unparen(s: Column) -> Column:
    return F.when(s.startswith("(") & s.endswith(")") & (F.length(s) >= 2),
                  F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s)


def literal_kind(lit: Column | str) -> Column:
    """Type of a literal argument: int, float, String, or null."""
    return let(col_(lit), lambda s: let(_unparen(s), lambda u: _literal_kind(s, u)))


def _literal_kind(s: Column, u: Column) -> Column:
    int_body = F.when(u.endswith("L"), F.substring(u, F.lit(1), F.length(u) - 1)).otherwise(u)
    flt_body = F.when(u.endswith("F") | u.endswith("D"), F.substring(u, F.lit(1), F.length(u) - 1)).otherwise(u)
    is_int = int_body.rlike(r"^\s*[-+]?\d+(_\d+)*\s*$")
    is_float = flt_body.rlike(r"^\s*[-+]?((\d+(_\d+)*)?\.?\d+(_\d+)*([eE][-+]?\d+)?|\d+\.|(?i:inf|infinity|nan))\s*$")
    st = py_strip(s)
    is_str = F.substring(st, 1, 1).isin('"', "'") & F.substring(st, -1, 1).isin('"', "'")
    return F.when(is_int, "int").when(is_float, "float").when(is_str, "String")


def normalize_assertion(a: Column | str) -> Column:
    """(-n) -> -n and nL -> n inside assertEquals; assertEquals(true/false, x) -> assertTrue/False(x)."""
    s = col_(a)
    s = F.regexp_replace(s, r"^assertEquals\(\((-\d+)\)(.*)", "assertEquals($1$2")
    s = F.regexp_replace(s, r"^assertEquals\(([-]?[0-9]+)L(,.*)", "assertEquals($1$2")
    return (F.when(s.rlike(r"^assertEquals\(true, (.*)\)"),
                   F.regexp_replace(s, r"^assertEquals\(true, (.*)\)", "assertTrue($1)"))
            .when(s.rlike(r"^assertEquals\(false, (.*)\)"),
                  F.regexp_replace(s, r"^assertEquals\(false, (.*)\)", "assertFalse($1)"))
            .otherwise(s))


# ---- rendering ---------------------------------------------------------------

# Where the prefix of a test ends.
RENDER_FAIL_CATCH_RE = r"(?s)try\s*\{(.*;).*fail\(.*\)\s*;\s*\}\s*catch"
RENDER_ASSERT_RE = r"assert\w*\s*\((.*)\)"


def test_prefix(test: Column | str) -> Column:
    """Prefix of a test: 'throws Exception' added when the header has no 'throws ',
    the undeclared marker removed, then cut at the try/catch (keeping its statements),
    else at the first assertion, else before the last '}'."""
    t0 = col_(test)
    brace = F.instr(t0, "{")
    head = F.substring(t0, 1, brace - 1)
    t = F.when(~F.contains(head, F.lit("throws ")),
               F.concat(head, F.lit(" throws Exception "), F.substring(t0, brace, 1 << 30))).otherwise(t0)
    t = F.replace(t, F.lit("// Undeclared exception!"), F.lit(""))
    tc_pos = F.regexp_instr(t, F.lit(RENDER_FAIL_CATCH_RE))
    tc_body = py_strip(F.regexp_extract(t, RENDER_FAIL_CATCH_RE, 1))
    as_pos = F.regexp_instr(t, F.lit(RENDER_ASSERT_RE))
    last = rfind(t, "}")
    return (F.when(tc_pos > 0, F.concat(F.substring(t, 1, tc_pos - 1), F.lit(" "), tc_body))
            .when(as_pos > 0, F.substring(t, 1, as_pos - 1))
            .otherwise(F.substring(t, 1, F.when(last > 0, last - 1).otherwise(F.length(t) - 1))))


def insert_try_catch(method: Column) -> Column:
    brace = F.instr(method, "{")
    return F.concat(F.substring(method, 1, brace - 1), F.lit("{\n\ttry "), F.substring(method, brace, 1 << 30),
                    F.lit('\n\t\tfail("Expecting exception"); } catch (Exception e) { }\n\t}'))


def bool_assert_to_equals(assertion: Column) -> Column:
    a = py_strip(assertion)
    b = F.when(F.contains(a, F.lit("assertTrue")), "true").otherwise("false")
    arg = F.substring(a, F.instr(a, "(") + 1, rfind(a, ")") - F.instr(a, "(") - 1)
    return F.concat(F.lit("assertEquals("), b, F.lit(", "), arg, F.lit(")"))


def insert_assertion(method: Column, assertion: Column) -> Column:
    return F.concat(py_strip(method), F.lit("\n      "), assertion, F.lit(";\n}"))


def render_test(test: Column | str, except_pred: Column | str, assert_pred: Column | str,
                generator: str = "learned") -> Column:
    """Rendered test of a generator: 'learned' inserts the predicted oracle,
    'naive' only closes the prefix. Unknown generator names are an error."""
    prefix = F.concat(F.lit("@Test\n"), test_prefix(test))
    if generator == "naive":
        return F.concat(prefix, F.lit("\n    }"))
    if generator != "learned":
        raise ValueError(f"unexpected generator {generator!r}")
    ap = col_(assert_pred)
    to_eq = F.contains(col_(test), F.lit("assertEquals")) & (
        F.contains(ap, F.lit("assertTrue")) | F.contains(ap, F.lit("assertFalse")))
    assertion = F.when(to_eq, bool_assert_to_equals(ap)).otherwise(ap)
    return (F.when(col_(except_pred).cast("boolean"), insert_try_catch(prefix))
            .when(F.coalesce(ap, F.lit("")) != "", insert_assertion(prefix, assertion))
            .otherwise(F.concat(prefix, F.lit("\n    }"))))


# Assertion kinds accepted by the expected-type rule.
ASSERT_TYPES = ("assertTrue", "assertFalse", "assertEquals", "assertNotNull", "assertNull")
_MODIFIERS = r"(?:(?:public|protected|private|static|final|synchronized|abstract|native)\s+)*"
_RETURN_RE = r"^(?:<[^>]*>\s+)?([\w.$<>\[\]]+)\s+[\w$]+\s*\("  # after the modifiers are cut
_CTOR_RE = r"^([\w$]+)\s*\("
_MODIFIERS_RE = r"^\s*" + _MODIFIERS


def assertion_args(assertion: Column | str) -> Column:
    """Arguments split on every comma between the first '(' and the last ')'; only
    the last argument is stripped."""
    a = col_(assertion)
    inner = F.substring(a, F.instr(a, "(") + 1, rfind(a, ")") - F.instr(a, "(") - 1)
    parts = F.split(inner, ",", -1)
    n = F.size(parts)
    return F.transform(parts, lambda x, i: F.when(i == n - 1, py_strip(x)).otherwise(x))


def with_expected_type(df: DataFrame, assertion: str, focal: str, out: str = "expected_type") -> DataFrame:
    """Add ``out`` = expected type of the checked value, first rule wins:
    assertTrue/False -> boolean; int / float / String literal as first argument;
    constructor name; declared return type. Null (row to drop) when the checked
    argument is not a variable or a no-argument call, or the assertion kind is not
    accepted.
    """
    a = F.col(assertion)

    def from_args(args: Column) -> Column:
        var = F.when(F.size(args) == 1, F.get(args, 0)).otherwise(F.get(args, 1))
        var_ok = let(var, lambda v: v.rlike(r"^\w+$") | v.rlike(r"^\w+\.\w+\(\)$"))
        kind_ok = F.substring_index(a, "(", 1).isin(*ASSERT_TYPES)
        literal = literal_kind(F.get(args, 0))
        t = (F.when(a.startswith("assertTrue") | a.startswith("assertFalse"), F.lit("boolean"))
             .otherwise(F.coalesce(literal, let(head, declared))))
        return F.when(var_ok & kind_ok, t)

    head = F.regexp_replace(F.substring_index(clean_ws(focal), "{", 1), _MODIFIERS_RE, "")
    named = lambda x: F.when(x != "", x)

    def declared(h: Column) -> Column:
        return F.coalesce(named(F.regexp_extract(h, _RETURN_RE, 1)), named(F.regexp_extract(h, _CTOR_RE, 1)))

    return df.withColumn(out, let(assertion_args(a), from_args))


# The assertion forms whose cast or parentheses are stripped.
CAST_RE = r"(assertEquals\()\(\w+\)(\S*, \w+\))"
PAREN_RE = r"(assertEquals\()\((\S+)\)(, \w+\))"


def strip_cast(assertion: Column | str, candidates: Column | str) -> Column:
    """An assertion that is not among its candidates loses the parentheses, else the cast, of its first argument."""
    s = col_(assertion)
    return (F.when(F.array_contains(col_(candidates), s), s)
            .when(F.regexp_like(s, F.lit(PAREN_RE)), F.concat(
                F.regexp_extract(s, PAREN_RE, 1), F.regexp_extract(s, PAREN_RE, 2), F.regexp_extract(s, PAREN_RE, 3)))
            .when(F.regexp_like(s, F.lit(CAST_RE)), F.concat(F.regexp_extract(s, CAST_RE, 1), F.regexp_extract(s, CAST_RE, 2)))
            .otherwise(s))
