"""TF-IDF cosine between generated test and docstring, fitted per bug."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import similarity as SIM
from ..sources import views as V
from ..sources.views import with_views
from .registry import register

_GROUP = ["project", "bug_num"]


def _stop_values() -> str:
    return ", ".join("('" + w.replace("'", "''") + "')" for w in SIM.english_stop_words())


BASE_SQL = r"""
base AS (SELECT row_idx, project, bug_num, focal_method, split_part(generated_test, chr(10), 1) AS docstring,
                regexp_replace(generated_test, '^[^\n]*\n?', '') AS test_prefix, generated_test FROM cases),"""

# Over ``base`` (row_idx, project, bug_num and the four texts): ``sims``.
TFIDF_SQL = r"""
corpus AS (
  SELECT DISTINCT project, bug_num, 'f:' || md5(focal_method) AS doc_id, focal_method AS text FROM base
  UNION ALL SELECT DISTINCT project, bug_num, 'd:' || md5(docstring), docstring FROM base
  UNION ALL SELECT project, bug_num, 'p:' || CAST(row_idx AS VARCHAR), test_prefix FROM base
  UNION ALL SELECT project, bug_num, 't:' || CAST(row_idx AS VARCHAR), generated_test FROM base),
stop(token) AS (VALUES STOPWORDS),
ctok AS (SELECT project, bug_num, doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS token
         FROM corpus),
dfreq AS (SELECT project, bug_num, token, count(DISTINCT doc_id) AS df FROM ctok
          WHERE token NOT IN (SELECT token FROM stop) GROUP BY ALL),
ndocs AS (SELECT project, bug_num, count(*) AS n FROM corpus GROUP BY ALL),
idf AS (SELECT d.project, d.bug_num, d.token, ln(CAST(1 + n AS DOUBLE) / (1 + df)) + 1 AS idf
        FROM dfreq d JOIN ndocs USING (project, bug_num)),
ta AS (SELECT row_idx, project, bug_num, token, count(*) AS tf FROM (
         SELECT row_idx, project, bug_num, unnest(regexp_extract_all(lower(generated_test), '[\p{L}\p{N}_]{2,}')) AS token
         FROM base) WHERE token NOT IN (SELECT token FROM stop) GROUP BY ALL),
tb AS (SELECT row_idx, project, bug_num, token, count(*) AS tf FROM (
         SELECT row_idx, project, bug_num, unnest(regexp_extract_all(lower(docstring), '[\p{L}\p{N}_]{2,}')) AS token
         FROM base) WHERE token NOT IN (SELECT token FROM stop) GROUP BY ALL),
wa AS (SELECT ta.row_idx, ta.project, ta.bug_num, ta.token, ta.tf * i.idf AS w FROM ta JOIN idf i USING (project, bug_num, token)),
wb AS (SELECT tb.row_idx, tb.project, tb.bug_num, tb.token, tb.tf * i.idf AS w FROM tb JOIN idf i USING (project, bug_num, token)),
na AS (SELECT row_idx, sqrt(sum(w * w)) AS n FROM wa GROUP BY row_idx),
nb AS (SELECT row_idx, sqrt(sum(w * w)) AS n FROM wb GROUP BY row_idx),
dots AS (SELECT a.row_idx, sum(a.w * b.w) AS d FROM wa a JOIN wb b USING (row_idx, token) GROUP BY a.row_idx),
sims AS (SELECT dots.row_idx, round(d / (na.n * nb.n), 6) AS sim FROM dots JOIN na USING (row_idx) JOIN nb USING (row_idx))
""".replace("STOPWORDS", _stop_values())


@register("tfidf_cosine", with_views("""
SELECT c.row_idx, c.project, c.bug_num, coalesce(s.sim, 0.0) AS test_doc_sim
FROM cases c LEFT JOIN sims s USING (row_idx)""", "cases", ctes=BASE_SQL + TFIDF_SQL))
def tfidf_cosine(spark, sf_dir):
    """TF-IDF cosine of generated test vs docstring, vectorizer fitted per bug.

    Docstring = first line of the generated test, prefix = the remaining lines.
    """
    c = V.cases(spark, sf_dir, flags=False).select("row_idx", "project", "bug_num", "focal_method", "generated_test")
    c = c.withColumns({
        "docstring": F.substring_index("generated_test", "\n", 1),
        "test_prefix": F.regexp_replace("generated_test", r"^[^\n]*\n?", ""),
    })
    out = SIM.test_doc_similarity(c, _GROUP, "row_idx")
    return out.select("row_idx", "project", "bug_num", "test_doc_sim")
