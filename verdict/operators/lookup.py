"""Lateral candidate generation, first-match lookup by priority, and the
superclass walk.

* ``generate_candidates`` (J11): vocabulary values of the argument's type and
  same-type variables -> ``assertEquals(v, arg)`` (the argument itself
  skipped), plus assertTrue/False for booleans or assertNotNull for non-numeric
  types; duplicates removed, order = (source, rank).
* ``first_match`` (J8): for every test, the first declaration whose name
  equals an invoked name, by (name position, class depth, declaration order);
  names and declarations are reduced to their best occurrence first, so the
  join is bounded by distinct names, not by text length squared.
* ``first_match_in_rounds`` (J8): the same where tests have many names and classes many
  ancestors: the names of highest priority are looked up first, and only tests without a
  match go on, so the names met by every ancestor are few.
* ``superclass_chain`` (J16): follow ``extends`` while the parent is imported
  and exists; joins double the depth, cycles end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.positions import group_positions
from ..session import cut_lineage, written
from .methods import method_offsets, sliced

BOOL_TYPES = ("bool", "boolean")
NUMERIC_TYPES = ("int", "float", "double")
FLOAT_TYPES = ("float", "double")  # an assertion on a float is skipped


def rank_vocabulary(values: DataFrame, type_col: str = "type", value_col: str = "value") -> DataFrame:
    """(type, rank, value): values ranked by frequency (then value) inside each type."""
    counts = values.groupBy(F.col(type_col).alias("type"), F.col(value_col).alias("value")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per distinct (type, value); positions by range, so one large type is many tasks
    ranked = group_positions(counts, ["type"], [F.col("_n").desc(), "value"], pos_col="rank")
    return ranked.select("type", (F.col("rank") + 1).cast("int").alias("rank"), "value")


def generate_candidates(tests: DataFrame, vocab: DataFrame, id_col: str, type_col: str, arg_col: str,
                        vars_col: str) -> DataFrame:
    """(id, candidate, cand_order) for every test that doesn't check a float; ``vars_col`` is an array of
    same-type variables (``same_type``)."""
    t = tests.filter(~F.col(type_col).isin(*FLOAT_TYPES)).select(id_col, F.col(type_col).alias("_type"), F.trim(F.col(arg_col)).alias("_arg"), vars_col)
    from_vocab = t.join(vocab, t["_type"] == vocab["type"]).select(
        id_col, "_arg", F.lit(0).alias("_src"), F.col("rank").alias("_rank"), F.col("value").alias("_v"))
    from_vars = t.select(id_col, "_arg", F.posexplode(vars_col).alias("_rank", "_v")).withColumn("_src", F.lit(1))
    eq = from_vocab.unionByName(from_vars).filter(F.col("_v") != F.col("_arg")).select(
        id_col, "_src", "_rank", F.concat(F.lit("assertEquals("), F.col("_v"), F.lit(", "), F.col("_arg"),
                                          F.lit(")")).alias("candidate"))
    is_bool = F.col("_type").isin(*BOOL_TYPES)
    extras = t.select(id_col, F.explode(
        F.when(is_bool, F.array(F.concat(F.lit("assertTrue("), F.col("_arg"), F.lit(")")),
                                F.concat(F.lit("assertFalse("), F.col("_arg"), F.lit(")"))))
        .when(~F.col("_type").isin(*NUMERIC_TYPES), F.array(F.concat(F.lit("assertNotNull("), F.col("_arg"),
                                                                     F.lit(")"))))
        .otherwise(F.array().cast("array<string>"))).alias("candidate"))
    extras = extras.withColumn("_src", F.lit(2)).withColumn(
        "_rank", F.when(F.col("candidate").startswith("assertFalse"), 1).otherwise(0))
    allc = eq.unionByName(extras.select(id_col, "_src", "_rank", "candidate"))
    best = allc.groupBy(id_col, "candidate").agg(F.min(F.struct("_src", "_rank")).alias("_o"))
    w = Window.partitionBy(id_col).orderBy("_o", "candidate")  # candidates of one test
    return best.select(id_col, "candidate", (F.row_number().over(w) - 1).alias("cand_order"))


def same_type(declared: Column, wanted: Column) -> Column:
    """Names of the variables and literals of a test whose type is ``wanted``; ``declared``: array of (type, name)."""
    return F.transform(F.filter(declared, lambda x: x["type"] == wanted), lambda x: x["name"])


def first_match(names: DataFrame, classes: DataFrame, decls: DataFrame, id_col: str) -> DataFrame:
    """Best declaration per test.

    names: (id, name, name_pos) — invoked names, 0 = highest priority;
    classes: (id, class, depth) — own class 0, superclasses 1, 2, ...;
    decls: (class, name, kind_order, decl_pos, text, doc) — constructors before methods.
    Returns (id, class, name, name_pos, depth, text, doc) for tests with a match.
    """
    # only names that some class declares can match: drop the others before their shuffle
    declared = decls.select("name").distinct()
    n1 = names.join(declared, "name", "left_semi").groupBy(id_col, "name").agg(F.min("name_pos").alias("name_pos"))
    d1 = decls.groupBy("class", "name").agg(
        F.min_by(F.struct("kind_order", "decl_pos", "text", "doc"), F.struct("kind_order", "decl_pos")).alias("_d"))
    # both sides grow with the data (and the planner underestimates exploded names):
    # keep this one a shuffle join; the declaration side is left to AQE
    cand = n1.join(classes.hint("merge"), id_col).join(d1, ["class", "name"])
    key = F.struct("name_pos", "depth", F.col("_d.kind_order"), F.col("_d.decl_pos"))
    best = cand.groupBy(id_col).agg(F.min_by(F.struct("class", "name", "name_pos", "depth", F.col("_d.text")
                                                      .alias("text"), F.col("_d.doc").alias("doc")), key).alias("_b"))
    return best.select(id_col, "_b.*")


#: First positions of the rounds of ``first_match_in_rounds``.
ROUNDS = (0, 1)


def first_match_in_rounds(names: DataFrame, classes: DataFrame, decls: DataFrame, id_col: str) -> DataFrame:
    """The declaration that ``first_match`` finds for each test, where a test stops at its first hit.

    names and classes as there; decls: (class, name, kind_order, decl_pos), each name once a class. Small columns of the
    caller's in classes and decls come back with id, class, name_pos and depth. A round takes a range of positions (``ROUNDS``) of the tests that no earlier one has
    settled, so few names meet all superclasses. Names meet declarations by a 64-bit hash of class and name. ``decls`` is read
    in each round: pass a written table.
    """
    begins = sum((F.when(F.col("name_pos") >= p, 1).otherwise(0) for p in ROUNDS[1:]), F.lit(0))
    rounds = written(names.filter("name IS NOT NULL").select(id_col, F.xxhash64("name").alias("_h"), "name_pos", begins.alias("_round")),
                     "invoked-names", by="_round")
    places = written(classes, "places")
    extra = [c for c in classes.columns if c not in (id_col, "class", "depth")]
    given = [c for c in decls.columns if c not in ("class", "name", "kind_order", "decl_pos")]
    keyed = decls.filter("name IS NOT NULL").select(F.xxhash64("class", F.xxhash64("name")).alias("_k"), "kind_order", "decl_pos", *given)
    key = F.struct("name_pos", "depth", "kind_order", "decl_pos", "class", *extra, *given)
    found = None
    for r in range(len(ROUNDS)):
        left = rounds.filter(F.col("_round") == r).drop("_round")
        if found is not None:
            left = left.join(found.select(id_col), id_col, "left_anti").groupBy(id_col, "_h").agg(F.min("name_pos").alias("name_pos"))
        hits = written(left.join(places, id_col).withColumn("_k", F.xxhash64("class", "_h")).drop("_h").join(keyed, "_k").groupBy(id_col).agg(F.min(key).alias("_k")), "found")
        found = hits if found is None else found.unionByName(hits)
    return found.select(id_col, "_k.*")


def superclass_chain(classes: DataFrame) -> DataFrame:
    """(class, ancestor, depth) for depth >= 1 along ``extends`` while the parent is
    imported by the child and exists. ``classes``: (class, extends, imported bool).

    Doubling: once all ancestors up to depth 2**k are known, those at depth exactly 2**k
    reach the ones up to 2**(k + 1), so a chain of n classes takes log2(n) joins. Each
    (class, ancestor) pair keeps its smallest depth, so a cycle ends when it closes.
    """
    exists = classes.select(F.col("class").alias("_parent")).distinct()
    reach = written(classes.filter(F.col("imported") & F.col("extends").isNotNull())
                        .join(exists, F.col("extends") == F.col("_parent"), "left_semi")
                        .select("class", F.col("extends").alias("ancestor"), F.lit(1).alias("depth")).distinct(), "superclasses")
    known = 1
    while not (far := reach.filter(F.col("depth") == known)).isEmpty():
        f, r = far.alias("f"), reach.alias("r")
        more = f.join(r, F.col("f.ancestor") == F.col("r.class")).select(
            F.col("f.class").alias("class"), F.col("r.ancestor").alias("ancestor"),
            (F.col("f.depth") + F.col("r.depth")).alias("depth"))
        reach = written(reach.unionByName(more).groupBy("class", "ancestor").agg(F.min("depth").alias("depth")), "superclasses")
        known *= 2
    return reach


# A type's header and an import line.
_EXTENDS_RE = r"(?m)^\s*(?:(?:public|abstract|final)\s+)*class\s+([\w$]+)(?:\s*<[^{]*?>)?\s+extends\s+([\w$]+)"
_CLASS_RE = r"(?m)^\s*(?:(?:public|abstract|final)\s+)*class\s+([\w$]+)"
_IMPORT_RE = r"(?m)^\s*import\s+(?:static\s+)?[\w.$]*?([\w$]+)\s*;"


def class_headers(files: DataFrame, text: str) -> DataFrame:
    """(class, extends, imported, file) of the first class of each file; files without a class are left out. file: hash of the text."""
    parent = F.regexp_extract(text, _EXTENDS_RE, 2)
    return files.select(F.regexp_extract(text, _CLASS_RE, 1).alias("class"), F.when(parent != "", parent).alias("extends"),
                        F.array_contains(F.regexp_extract_all(F.col(text), F.lit(_IMPORT_RE), 1), parent).alias("imported"), F.xxhash64(text).alias("file")).filter("class <> ''")


def focal_methods(tests: DataFrame, names: DataFrame, files: DataFrame, id_col: str, class_col: str, text: str) -> DataFrame:
    """The focal method of each test: P31, J16 and J8 in one plan.

    ``files`` (one class each) give the places of their methods and documentation (``methods.method_offsets``) and their
    headers; ``tests`` (id, class under test) look up their invoked ``names`` (id, name, name_pos) there and then in the
    superclasses, nearest first. A class that several files declare is the one of smallest hash. Texts stay in the files until a test has found its method. (id, class, name, name_pos, depth,
    text, doc) of the tests with a match.
    """
    every = cut_lineage(class_headers(files, text))
    rows, different = every.agg(F.count(F.lit(1)), F.countDistinct("file")).first()
    if rows > different:  # repeated rows: each text counts once
        files = files.withColumn("_file", F.xxhash64(text)).dropDuplicates(["_file"]).drop("_file")
    headers = every.groupBy("class").agg(F.min(F.struct("file", "extends", "imported")).alias("f")).select("class", "f.*")
    own = files.select(F.xxhash64(text).alias("file"), F.col(text).alias("_body"))
    decls = written(method_offsets(own, "file", "_body").select(
        F.col("file").alias("class"), "name", "kind_order", F.col("member").alias("decl_pos"), "span", "doc_span", "name_span",
        F.when(F.col("name_span").isNull(), F.col("name")).alias("split_name")), "methods")
    start = tests.select(id_col, F.col(class_col).alias("class"))
    above = start.join(superclass_chain(headers), "class").select(id_col, F.col("ancestor").alias("class"), "depth")
    places = start.withColumn("depth", F.lit(0)).unionByName(above).join(headers.select("class", "file"), "class")
    best = first_match_in_rounds(names, places.select(id_col, F.col("file").alias("class"), "depth", F.col("class").alias("_name")), decls, id_col)
    found = best.join(own.withColumnRenamed("file", "class"), "class")
    return found.select(id_col, F.col("_name").alias("class"), F.coalesce("split_name", sliced("_body", "name_span")).alias("name"),
                        "name_pos", "depth", sliced("_body", "span").alias("text"), sliced("_body", "doc_span").alias("doc"))
