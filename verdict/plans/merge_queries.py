"""Result-merging and lookup queries over the dimension tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outcomes as O
from ..sources.tables import table
from .registry import register

# The five market segments used as the second key of the patch table.
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_SEG_SQL = "CASE s_suppkey % 5 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SEGMENTS)) + " END"


def _base_patch(spark, sf_dir):
    cust = table(spark, sf_dir, "customer")
    base = cust.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"),
                       F.col("c_custkey").alias("pos"), F.col("c_name").alias("name"),
                       F.col("c_acctbal").alias("balance"))
    seg = F.element_at(F.array(*[F.lit(s) for s in _SEGMENTS]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    sup = table(spark, sf_dir, "supplier")
    patch = sup.select(F.col("s_nationkey").alias("nation"), seg.alias("segment"), F.col("s_suppkey").alias("pos"),
                       F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return base, patch


@register("update_only_upsert", f"""
WITH base AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, c_custkey AS pos, c_name AS name,
                     c_acctbal AS balance FROM customer),
patch AS (SELECT s_nationkey AS nation, {_SEG_SQL} AS segment, s_suppkey AS pos, s_name AS name,
                 s_acctbal AS balance FROM supplier),
b AS (SELECT nation, segment, min(pos) AS pos, arg_max(name, pos) AS name, arg_max(balance, pos) AS balance
      FROM base GROUP BY nation, segment),
p AS (SELECT nation, segment, arg_max(name, pos) AS name, arg_max(balance, pos) AS balance
      FROM patch GROUP BY nation, segment)
SELECT b.nation, b.segment, b.pos, CASE WHEN p.nation IS NOT NULL THEN p.name ELSE b.name END AS name,
       CASE WHEN p.nation IS NOT NULL THEN p.balance ELSE b.balance END AS balance
FROM b LEFT JOIN p ON b.nation = p.nation AND b.segment = p.segment""")
def update_only_upsert(spark, sf_dir):
    """Patch rows replace base rows with the same key; new keys are not inserted;
    duplicate keys keep the first position and the last values."""
    base, patch = _base_patch(spark, sf_dir)
    return O.update_only_upsert(base, patch, ["nation", "segment"], "pos")


@register("overlay_merge", """
WITH base AS (SELECT doc_id, CAST(quality AS BIGINT) AS value FROM labels),
patch AS (SELECT conv_id AS doc_id, count(*) AS value FROM conversations GROUP BY conv_id)
SELECT coalesce(p.doc_id, b.doc_id) AS doc_id, CASE WHEN p.doc_id IS NOT NULL THEN p.value ELSE b.value END AS value,
       p.doc_id IS NOT NULL AS from_patch
FROM base b FULL OUTER JOIN patch p ON b.doc_id = p.doc_id""")
def overlay_merge(spark, sf_dir):
    """Patch entries replace same-key entries and new keys are added."""
    base = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("value"))
    patch = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("value"))
    return O.overlay_merge(base, patch, ["doc_id"])


@register("opposite_tag", """
WITH entries AS (SELECT DISTINCT concat('proj', CAST(user_id % 10 AS VARCHAR)) AS project, user_id % 7 AS bug_num,
                        CASE WHEN event_id % 2 = 0 THEN 'b' ELSE 'f' END AS tag FROM events)
SELECT e.project, e.bug_num, e.tag FROM entries e
WHERE e.tag = 'f' AND EXISTS (SELECT 1 FROM entries o WHERE o.project = e.project AND o.bug_num = e.bug_num
                              AND o.tag = 'b')""")
def opposite_tag(spark, sf_dir):
    """Fixed-version entries whose buggy-version twin is also present."""
    ev = table(spark, sf_dir, "events")
    entries = ev.select(F.concat(F.lit("proj"), (F.col("user_id") % 10).cast("string")).alias("project"),
                        (F.col("user_id") % 7).alias("bug_num"),
                        F.when(F.col("event_id") % 2 == 0, "b").otherwise("f").alias("tag")).distinct()
    fixed = entries.filter(F.col("tag") == "f")
    buggy = entries.filter(F.col("tag") == "b").select("project", "bug_num")
    return fixed.join(buggy, ["project", "bug_num"], "left_semi")


@register("dim_lookup_chain", """
SELECT c.c_custkey, n.n_name, r.r_name FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""")
def dim_lookup_chain(spark, sf_dir):
    """Chained dimension lookups (bug -> revision -> layout); unresolved rows drop out.

    No hint: the dimensions stand for tables that may grow, and adaptive execution
    broadcasts them by their size."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select("c_custkey", "n_name", "r_name")


@register("lookup_rejects", """
SELECT 'no_region' AS reason, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE NOT EXISTS (SELECT 1 FROM region r WHERE r.r_regionkey = n.n_regionkey)
UNION ALL
SELECT 'no_nation', count(*) FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = c.c_nationkey)""")
def lookup_rejects(spark, sf_dir):
    """Rows dropped by the lookup chain, counted per reason (left anti joins)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    no_nation = c.join(n, c.c_nationkey == n.n_nationkey, "left_anti")
    with_n = c.join(n, c.c_nationkey == n.n_nationkey)
    no_region = with_n.join(r, with_n.n_regionkey == r.r_regionkey, "left_anti")
    a = no_region.agg(F.lit("no_region").alias("reason"), F.count(F.lit(1)).alias("n"))
    b = no_nation.agg(F.lit("no_nation").alias("reason"), F.count(F.lit(1)).alias("n"))
    return a.unionByName(b)


# Project sample list and skip list of the project filter.
_SAMPLE = ["BUILDING", "MACHINERY", "AUTOMOBILE"]
_SKIP_NATIONS = [3, 7]


@register("project_filter", f"""
SELECT c_custkey, c_mktsegment, c_nationkey FROM customer
WHERE c_mktsegment IN ({", ".join(f"'{s}'" for s in _SAMPLE)})
  AND c_nationkey NOT IN ({", ".join(str(n) for n in _SKIP_NATIONS)})""")
def project_filter(spark, sf_dir):
    """Keep the sampled projects, drop bugs on the skip list (anti join)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    skip = spark.createDataFrame([(n,) for n in _SKIP_NATIONS], "c_nationkey int")
    return c.filter(F.col("c_mktsegment").isin(_SAMPLE)).join(F.broadcast(skip), "c_nationkey", "left_anti").select(
        "c_custkey", "c_mktsegment", "c_nationkey")


_URL_RE = r"^(https?)://([^/]+)/([a-z]+)/([0-9]+)"


@register("path_keys", f"""
SELECT page_id, regexp_extract(url, '{_URL_RE}', 1) AS scheme, regexp_extract(url, '{_URL_RE}', 2) AS host,
       regexp_extract(url, '{_URL_RE}', 3) AS lang, CAST(regexp_extract(url, '{_URL_RE}', 4) AS BIGINT) AS item,
       concat(regexp_extract(url, '{_URL_RE}', 3), CAST(regexp_extract(url, '{_URL_RE}', 4) AS VARCHAR)) AS item_key,
       regexp_extract(url, '{_URL_RE}', 3) = regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang_agrees
FROM pages WHERE regexp_matches(url, '{_URL_RE}')""")
def path_keys(spark, sf_dir):
    """Keys taken from path segments; unmatched paths are skipped;
    the key must agree with the content (lang attribute)."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html").filter(F.col("url").rlike(_URL_RE))
    g = lambda i: F.regexp_extract("url", _URL_RE, i)
    return p.select("page_id", g(1).alias("scheme"), g(2).alias("host"), g(3).alias("lang"),
                    g(4).cast("long").alias("item"), F.concat(g(3), g(4)).alias("item_key"),
                    (g(3) == F.regexp_extract("html", r'<html lang="([a-z]+)"', 1)).alias("lang_agrees"))
