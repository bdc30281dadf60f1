"""Candidate generation, first-match focal lookup and the superclass walk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import let
from ..operators import lookup as LK
from ..operators import methods as MT
from ..session import written
from ..sources import views as V
from ..sources.tables import table
from .registry import register

# The type of a name goes by its length over these (vocabulary types, bool, int, float).
_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "bool", "int", "float"]
_TYPE_SQL = f"CASE length({{w}}) % {len(_TYPES)} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPES)) + " END"

_CAND_SQL = f"""
WITH vc AS (SELECT p_type AS type, split_part(p_name, ' ', 1) AS value, count(*) AS n FROM part GROUP BY ALL),
vocab AS (SELECT type, row_number() OVER (PARTITION BY type ORDER BY n DESC, value) AS rank, value FROM vc),
t AS (SELECT doc_id, w, {_TYPE_SQL.format(w="w[1]")} AS _type, trim(w[1]) AS _arg
      FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents) WHERE length(w[1]) % {len(_TYPES)} <> 8),
vs AS (SELECT doc_id, _arg, list_filter(w[2:], lambda x: {_TYPE_SQL.format(w="x")} = _type) AS vars FROM t),
eq AS (
  SELECT t.doc_id, 0 AS src, v.rank AS rnk, concat('assertEquals(', v.value, ', ', t._arg, ')') AS candidate
  FROM t JOIN vocab v ON t._type = v.type WHERE v.value <> t._arg
  UNION ALL
  SELECT doc_id, 1, i - 1, concat('assertEquals(', vars[i], ', ', _arg, ')')
  FROM (SELECT doc_id, _arg, vars, generate_subscripts(vars, 1) AS i FROM vs) WHERE vars[i] <> _arg),
extras AS (
  SELECT doc_id, 2 AS src, 0 AS rnk, concat('assertTrue(', _arg, ')') AS candidate FROM t WHERE _type IN ('bool', 'boolean')
  UNION ALL SELECT doc_id, 2, 1, concat('assertFalse(', _arg, ')') FROM t WHERE _type IN ('bool', 'boolean')
  UNION ALL SELECT doc_id, 2, 0, concat('assertNotNull(', _arg, ')') FROM t
            WHERE _type NOT IN ('bool', 'boolean', 'int', 'float', 'double')),
allc AS (SELECT * FROM eq UNION ALL SELECT * FROM extras),
best AS (SELECT doc_id, candidate, min((src, rnk)) AS o FROM allc GROUP BY doc_id, candidate)
SELECT doc_id, candidate, row_number() OVER (PARTITION BY doc_id ORDER BY o, candidate) - 1 AS cand_order FROM best"""


def _type_of(w):
    return F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (F.length(w) % len(_TYPES) + 1).cast("int"))


@register("candidate_generation", _CAND_SQL)
def candidate_generation(spark, sf_dir):
    """Assertion candidates from the ranked vocabulary of the argument's type and the
    same-type variables among all names of the text, plus assertTrue/False or assertNotNull;
    assertions on floats are skipped."""
    part = table(spark, sf_dir, "part")
    vocab = LK.rank_vocabulary(part.select(F.col("p_type").alias("type"),
                                           F.substring_index("p_name", " ", 1).alias("value")))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))

    def shaped(w):
        declared = F.transform(F.slice(w, F.lit(2), F.size(w)), lambda x: F.struct(_type_of(x).alias("type"), x.alias("name")))
        wanted = _type_of(F.get(w, 0))
        return F.struct(wanted.alias("type"), F.get(w, 0).alias("arg"),
                        let(wanted, lambda t: LK.same_type(declared, t)).alias("vars"))

    tests = docs.select("doc_id", let(F.col("w"), shaped).alias("t")).select("doc_id", "t.*")
    return LK.generate_candidates(tests, vocab, "doc_id", "type", "arg", "vars").select(
        "doc_id", "candidate", F.col("cand_order").cast("long").alias("cand_order"))


_MATCH_SQL = """
WITH names AS (
  SELECT doc_id, w[i] AS name, len(w) - i AS name_pos
  FROM (SELECT doc_id, w, generate_subscripts(w, 1) AS i
        FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents))),
n1 AS (SELECT doc_id, name, min(name_pos) AS name_pos FROM names GROUP BY ALL),
classes AS (
  SELECT doc_id, source AS class, 0 AS depth FROM documents
  UNION ALL
  SELECT doc_id, concat('src', CAST((CAST(substr(source, 4) AS INTEGER) + 1) % 20 AS VARCHAR)), 1 FROM documents),
decls AS (
  SELECT concat('src', CAST(item_id % 20 AS VARCHAR)) AS class, lower(w[i]) AS name,
         CASE WHEN regexp_matches(w[i], '^[A-Z]') THEN 0 ELSE 1 END AS kind_order,
         item_id, i,
         concat('public void ', lower(w[i]), '() { }') AS text, concat('/** ', w[i], ' of item ', item_id, ' */') AS doc
  FROM (SELECT item_id, w, generate_subscripts(w, 1) AS i
        FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark))),
d1 AS (SELECT class, name, arg_min(text, (kind_order, item_id, i)) AS text, arg_min(doc, (kind_order, item_id, i)) AS doc,
              min((kind_order, item_id, i)) AS dkey FROM decls GROUP BY class, name),
cand AS (SELECT n1.doc_id, c.class, n1.name, n1.name_pos, c.depth, d1.text, d1.doc, d1.dkey
         FROM n1 JOIN classes c ON n1.doc_id = c.doc_id JOIN d1 ON d1.class = c.class AND d1.name = n1.name),
best AS (SELECT doc_id, arg_min(class, (name_pos, depth, dkey)) AS focal_class,
                arg_min(name, (name_pos, depth, dkey)) AS focal_name,
                arg_min(text, (name_pos, depth, dkey)) AS focal_text, arg_min(doc, (name_pos, depth, dkey)) AS docstring
         FROM cand GROUP BY doc_id)
SELECT d.doc_id, coalesce(b.focal_class, '') AS focal_class, coalesce(b.focal_name, '') AS focal_name,
       coalesce(b.focal_text, '') AS focal_text, coalesce(b.docstring, '') AS docstring
FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id"""


@register("first_match_lookup", _MATCH_SQL)
def first_match_lookup(spark, sf_dir):
    """Focal method of each test = first declaration named like an invoked name,
    by (last call first, own class before superclass, constructors before methods);
    no match -> ''."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # tokenise once into a column: an expression repeated after the explode would
    # re-run the regex over the whole text for every exploded word
    words = docs.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("_ws"))
    names = words.select("doc_id", F.posexplode("_ws").alias("_p", "name"), F.size("_ws").alias("_n")).select(
        "doc_id", "name", (F.col("_n") - 1 - F.col("_p")).alias("name_pos"))
    sup = F.concat(F.lit("src"), ((F.substring("source", 4, 10).cast("int") + 1) % 20).cast("string"))
    classes = docs.select("doc_id", F.col("source").alias("class"), F.lit(0).alias("depth")).unionByName(
        docs.select("doc_id", sup.alias("class"), F.lit(1).alias("depth")))
    bench = table(spark, sf_dir, "benchmark").select("item_id", "text")
    bw = bench.select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("_i", "_w"))
    decls = bw.select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("class"),
                      F.lower("_w").alias("name"), F.when(F.col("_w").rlike("^[A-Z]"), 0).otherwise(1).alias("kind_order"),
                      F.struct("item_id", "_i").alias("decl_pos"),
                      F.concat(F.lit("public void "), F.lower("_w"), F.lit("() { }")).alias("text"),
                      F.concat(F.lit("/** "), "_w", F.lit(" of item "), F.col("item_id").cast("string"), F.lit(" */")).alias("doc"))
    best = LK.first_match(names, classes, decls, "doc_id")
    out = docs.select("doc_id").join(best, "doc_id", "left")
    return out.select("doc_id", F.coalesce("class", F.lit("")).alias("focal_class"),
                      F.coalesce("name", F.lit("")).alias("focal_name"),
                      F.coalesce("text", F.lit("")).alias("focal_text"), F.coalesce("doc", F.lit("")).alias("docstring"))


_WALK_SQL = """
WITH RECURSIVE cls AS (
  SELECT concat('C', CAST(p_partkey AS VARCHAR)) AS class,
         CASE WHEN p_partkey > 0 THEN concat('C', CAST(p_partkey // 2 AS VARCHAR)) END AS extends,
         p_size % 5 <> 0 AS imported FROM part),
step AS (SELECT c.class, c.extends AS parent FROM cls c
         WHERE c.imported AND c.extends IS NOT NULL AND EXISTS (SELECT 1 FROM cls p WHERE p.class = c.extends)),
walk(class, ancestor, depth, path) AS (
  SELECT class, parent, 1, [parent] FROM step
  UNION ALL
  SELECT w.class, s.parent, w.depth + 1, list_append(w.path, s.parent) FROM walk w JOIN step s ON w.ancestor = s.class
  WHERE NOT list_contains(w.path, s.parent))
SELECT class, ancestor, depth FROM walk"""


@register("superclass_walk", _WALK_SQL)
def superclass_walk(spark, sf_dir):
    """Ancestors of each class along ``extends`` while the parent is imported and exists."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    classes = part.select(
        F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("class"),
        F.when(F.col("p_partkey") > 0, F.concat(F.lit("C"), F.floor(F.col("p_partkey") / 2).cast("string")))
        .alias("extends"),
        (F.col("p_size") % 5 != 0).alias("imported"))
    return LK.superclass_chain(classes)


_FOCAL_SQL = r"""
WITH RECURSIVE sentences AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '[.\n]+'),
                                            lambda x: array_to_string(regexp_extract_all(x, '[a-z]+'), '_')), lambda x: x <> '') AS names
  FROM documents),
files AS (
  SELECT doc_id AS id, concat('package pkg;', chr(10), CASE WHEN doc_id % 5 <> 0 THEN concat('import pkg.K', doc_id // 2, ';', chr(10)) ELSE '' END,
                              'public class K', doc_id, CASE WHEN doc_id > 0 THEN concat(' extends K', doc_id // 2) ELSE '' END, ' {', chr(10),
                              array_to_string(list_transform(names, lambda x: concat('  /** { ', x, ' */', chr(10), '  public int ', x, '(int n) {', chr(10),
                                                                                     '    return "}".length();', chr(10), '  }')), chr(10)), chr(10), '}') AS body
  FROM sentences),""" + MT.scan_sql("files") + """,
step AS (SELECT c.doc_id AS class, c.doc_id // 2 AS parent FROM documents c WHERE c.doc_id > 0 AND c.doc_id % 5 <> 0
                                                                       AND EXISTS (SELECT 1 FROM documents p WHERE p.doc_id = c.doc_id // 2)),
walk(class, ancestor, depth) AS (
  SELECT class, parent, 1 FROM step UNION ALL SELECT w.class, s.parent, w.depth + 1 FROM walk w JOIN step s ON w.ancestor = s.class),
tests AS (SELECT d.doc_id, CASE WHEN EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = 2 * d.doc_id) THEN 2 * d.doc_id ELSE d.doc_id END AS class FROM documents d),
places AS (SELECT doc_id, class, 0 AS depth FROM tests UNION ALL SELECT doc_id, ancestor, depth FROM tests JOIN walk USING (class)),
called AS (SELECT doc_id, name, min(pos) AS pos FROM (SELECT doc_id, unnest(names) AS name, len(names) - unnest(generate_series(1, len(names))) AS pos FROM sentences)
           GROUP BY doc_id, name),
hits AS (SELECT c.doc_id, f.id AS class, c.name, c.pos, p.depth, f.i, f.t, f.doc FROM called c JOIN places p ON p.doc_id = c.doc_id
         JOIN found f ON f.id = p.class AND f.name = c.name WHERE len(string_split(f.t, '@Test')) <= 2),
best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos, depth, i) = 1)
SELECT d.doc_id, coalesce('K' || b.class, '') AS focal_class, coalesce(b.depth, -1) AS depth, coalesce(b.name, '') AS focal_name,
       md5(coalesce(b.t, '')) AS method_md5, coalesce(b.doc, '') AS docstring
FROM documents d LEFT JOIN best b USING (doc_id)"""


@register("focal_method_lookup", _FOCAL_SQL)
def focal_method_lookup(spark, sf_dir):
    """P31 -> J16 -> J8: the methods of class files, looked up by each test's calls (last first) in its class and superclasses."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = lambda c: F.concat(F.lit("K"), c.cast("string"))
    up = F.floor(F.col("doc_id") / 2)
    s = written(d.select("doc_id", V.sentence_names(F.col("text")).alias("names")), "sentences")
    members = F.transform("names", lambda x: F.concat(F.lit("  /** { "), x, F.lit(" */\n  public int "), x, F.lit("(int n) {\n    return \"}\".length();\n  }")))
    body = F.concat(F.lit("package pkg;\n"), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("import pkg."), k(up), F.lit(";\n"))).otherwise(""),
                    F.lit("public class "), k(F.col("doc_id")), F.when(F.col("doc_id") > 0, F.concat(F.lit(" extends "), k(up))).otherwise(""),
                    F.lit(" {\n"), F.array_join(members, "\n"), F.lit("\n}"))
    files = s.select(body.alias("body"))
    names = s.select("doc_id", F.posexplode("names").alias("_p", "name"), F.size("names").alias("_n")).select(
        "doc_id", "name", (F.col("_n") - 1 - F.col("_p")).alias("name_pos"))
    twice = d.select((F.col("doc_id") / 2).alias("doc_id")).filter("doc_id = floor(doc_id)").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("_is"))
    tests = d.select("doc_id").join(twice, "doc_id", "left").select(
        "doc_id", k(F.when(F.col("_is"), 2 * F.col("doc_id")).otherwise(F.col("doc_id"))).alias("cls"))
    best = LK.focal_methods(tests, names, files, "doc_id", "cls", "body")
    return d.select("doc_id").join(best, "doc_id", "left").select(
        "doc_id", F.coalesce("class", F.lit("")).alias("focal_class"), F.coalesce("depth", F.lit(-1)).alias("depth"),
        F.coalesce("name", F.lit("")).alias("focal_name"), F.md5(F.coalesce("text", F.lit(""))).alias("method_md5"), F.coalesce("doc", F.lit("")).alias("docstring"))
