"""Language ID by Bayesian evidence fusion.

Evidence for the language of a page:

* text: log-likelihoods of hashed byte trigrams of the visible text under one model per
  language, counted over a bounded sample of labelled documents (``TRAIN_ROWS`` on average) and
  tempered to ``EFFECTIVE`` trigrams, since neighbouring trigrams are not independent;
* declared markup language: P(declared | language), a table counted from the text posteriors;
* address: host priors, smoothed level by level (all pages -> address suffix -> domain -> host):
  prior(level) = (sum of posteriors + STRENGTH * prior(level above)) / (pages + STRENGTH). A page's
  own posterior is taken out of every level, so that it doesn't vouch for itself.

The text is read once; one small row per page goes on. Host sums are partial aggregates, so a
host with a third of all pages is one row per task; the join of pages with the host table is
left to adaptive execution, which broadcasts it or splits a hot host. To the driver go only the
trigram counts of the model (languages x BUCKETS) and the table of declarations.

Defined results: null or empty html has no text evidence (the priors decide); a null url has the
empty host; an undeclared or unknown declaration is a value of its own; repeated rows count as
pages; a null id stays null; without labelled documents lang is null. Ties go to the language
that comes first in the alphabet. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import A_Z, A_Z_LOWER, keep_copy
from .op7_html import FURNITURE, blocks_of

BUCKETS = 1 << 13
TRAIN_ROWS = 4000
SEED = 17
EFFECTIVE = 60.0
STRENGTH = 4.0
ALPHA = 0.5


def trigram_counts(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text, white space as one blank."""
    b = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(BUCKETS, np.int64)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    return np.bincount((h * np.uint32(0x2C1B3C6D)) >> np.uint32(19), minlength=BUCKETS)


class Model:
    """Languages in order and log P(bucket | language)."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.log = np.log((counts + ALPHA) / (counts.sum(1, keepdims=True) + ALPHA * BUCKETS))


def evidence(log: np.ndarray, text: str) -> np.ndarray:
    c = trigram_counts(text)
    n = c.sum()
    return log @ c * (EFFECTIVE / max(n, EFFECTIVE)) if n else np.zeros(len(log))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, id_col: str = "doc_id") -> Model:
    """Grouped trigram counts of about ``train_rows`` labelled rows (all, if there are fewer).

    Which rows: those whose hash of id and text is below a limit, so that the model depends on the rows alone, not on
    files, partitions or order. Without a column ``id_col`` the text alone is hashed, and copies are taken together."""
    by = [F.col(c) for c in (id_col, text_col) if c in labelled.columns]
    rows = (labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(SEED), *by).alias("h"))
            .filter("lang is not null and text is not null"))
    n = rows.count()
    if n > train_rows:
        rows = rows.filter(F.pmod("h", F.lit(1 << 40)) < int(train_rows / n * (1 << 40)))
    rows = rows.drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = trigram_counts(text)
                sums[lang] = sums[lang] + c if lang in sums else c
        for lang, c in sums.items():
            used = np.nonzero(c)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(c[used])],
                                             names=["lang", "bucket", "n"])

    found = rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = sorted({x["lang"] for x in found})
    counts = np.zeros((len(languages), BUCKETS))
    for x in found:
        counts[languages.index(x["lang"]), x["bucket"]] = x["n"]
    return Model(languages, counts)


def _address(url) -> tuple:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), A_Z, A_Z_LOWER)
    return host, F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def declared_of(html):
    """Primary tag of the first <html lang=...>, wherever it starts, lower-cased ('' if none)."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-zA-Z]+)""", 1))


def identify(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, lang, confidence, text_lang (by the text alone), declared, host per input row."""
    langs = model.languages
    host, domain, suffix = _address(F.col("url"))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    base = base.select("page_id", "url", host.alias("host"), domain.alias("domain"), suffix.alias("suffix"),
                       declared_of(F.col("html")).alias("declared"), "html")
    if not langs:
        none = F.lit(None).cast("string")
        return base.select("page_id", "url", none.alias("lang"), F.lit(None).cast("double").alias("confidence"), none.alias("text_lang"),
                           "declared", "host")
    shared = pages.sparkSession.sparkContext.broadcast(model.log)  # languages x BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = shared.value
        for b in batches:
            e = np.array([evidence(log, " ".join(t for place, t in blocks_of(x or "")[1] if place != FURNITURE))
                          for x in b.column(6).to_pylist()]).reshape(b.num_rows, len(langs))
            e -= e.max(1, keepdims=True) if len(e) else 0
            yield pa.RecordBatch.from_arrays([*b.columns[:6], *[pa.array(e[:, i].copy()) for i in range(len(langs))]],
                                             names=[*b.schema.names[:6], *[f"e{i}" for i in range(len(langs))]])

    schema = "page_id long, url string, host string, domain string, suffix string, declared string, " + ", ".join(
        f"e{i} double" for i in range(len(langs)))
    rows = base.mapInArrow(run, schema)
    every = range(len(langs))
    total = sum((F.exp(F.col(f"e{i}")) for i in every[1:]), F.exp(F.col("e0")))
    known = F.when(F.col("declared").isin(*langs), F.col("declared")).otherwise(F.when(F.col("declared") == "", "").otherwise("?"))
    rows = rows.select("*", known.alias("said"), *[(F.exp(F.col(f"e{i}")) / total).alias(f"p{i}") for i in every])
    rows = keep_copy(rows)  # no html

    # sums of text posteriors level by level
    sums = lambda x, of="p": [F.sum(f"{of}{i}").alias(f"{x}{i}") for i in every]
    by_host = rows.groupBy("host", "domain", "suffix").agg(F.count(F.lit(1)).alias("hn"), *sums("h"))
    by_domain = by_host.groupBy("domain").agg(F.sum("hn").alias("dn"), *sums("d", "h"))
    by_suffix = by_host.groupBy("suffix").agg(F.sum("hn").alias("sn"), *sums("s", "h"))
    hosts = keep_copy(by_host.join(by_domain, "domain").join(by_suffix, "suffix").drop("domain", "suffix"))
    said = {x["said"]: [x[f"a{i}"] for i in every] for x in rows.groupBy("said").agg(*sums("a")).collect()}  # languages + 2 rows
    all_pages = [sum(v[i] for v in said.values()) for i in every]
    n_pages = sum(all_pages)

    k = STRENGTH
    out = rows.join(hosts, "host")

    def prior(i: int):
        own = F.col(f"p{i}")
        p = (F.lit(all_pages[i]) - own + F.lit(k / len(langs))) / F.lit(n_pages - 1 + k)
        for x, n in (("s", "sn"), ("d", "dn"), ("h", "hn")):
            p = (F.greatest(F.col(f"{x}{i}") - own, F.lit(0.0)) + k * p) / (F.col(n) - 1 + k)
        return F.greatest(p, F.lit(1e-12))

    def says(i: int):
        n = all_pages[i] + k * (len(said))
        log = F.lit(0.0)
        for word, v in said.items():
            log = F.when(F.col("said") == word, F.lit(math.log((v[i] + k) / n))).otherwise(log)
        return log

    out = out.select("page_id", "url", "host", "declared", *[f"e{i}" for i in every],
                     *[(F.col(f"e{i}") + F.log(prior(i)) + says(i)).alias(f"f{i}") for i in every])
    top = F.greatest(*[F.col(f"f{i}") for i in every]) if len(langs) > 1 else F.col("f0")
    best = lambda of: F.array_max(F.array(*[F.struct(F.col(f"{of}{i}").alias("x"), F.lit(-i).alias("i")) for i in every]))["i"]
    name = lambda of: F.get(F.array(*[F.lit(x) for x in langs]), -best(of))
    mass = sum((F.exp(F.col(f"f{i}") - top) for i in every[1:]), F.exp(F.col("f0") - top))
    return out.select("page_id", "url", name("f").alias("lang"), (F.lit(1.0) / mass).alias("confidence"), name("e").alias("text_lang"),
                      "declared", "host")
