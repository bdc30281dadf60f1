"""HTML extraction: a suffix array per host against boilerplate, and the page's own marks.

A page is read tag by tag into text blocks. A block lies in the article (``<article>`` or
``<main>``), in page furniture (menus, headers, footers, sidebars, notices, adverts, forms,
reader comments: by tag, role, class or id) or elsewhere. Scripts, styles and markup give no block; neither
do hidden elements, adverts inside a line and paragraphs that are notices. A ``<header>`` is furniture inside an article
too, so a headline in one is not text. A script or style that is never closed takes the rest of the page.

1. Streams: the tokens of every page outside its article, furniture included, and the tokens of its article. Of a host,
   pages with the same blocks are one page, and copies of an article one article. Pages and articles of a host are dealt into
   chunks; most hosts are one chunk of each kind.
2. Suffix array: each chunk sorts the suffixes of its streams by their first ``RUN`` tokens (prefix
   doubling). Suffixes with RUN tokens in common are neighbours; where enough pages stand among them, the string is a
   candidate, and so is a whole block outside articles. Longer repeated strings are chains of such strings.
3. Counts over the host: a string (or block) is boilerplate if at least ``SHARE`` % of the host's distinct pages, and at
   least ``LEAST_PAGES``, hold it outside their articles, or if at least ``ARTICLE_SHARE`` % of its distinct articles, and at least
   ``LEAST_ARTICLES``, hold it: an ordinary phrase, a passage that some pages share and a copied article stay. What a share
   of a host's pages hold, that share of the pages of some chunk hold, so no string is missed;
   where a chunk left a candidate of another one out, it is counted once more on the pages.
4. Text: unique runs. Of a page without an article element, blocks elsewhere on the page less what pages hold as boilerplate.
   Of a page with one, the article's blocks less those that boilerplate strings cover to the last token. There, as an exact
   check, a string that stands outside articles counts only if at least LEAST_PAGES different articles of the host hold it,
   so what a sidebar quotes of one article stays in it; and an article that is boilerplate for more than half of its tokens is a copy and stays whole.

A host may hold any share of the pages: chunks have about ``CHUNK_PAGES`` pages and ``CHUNK_TOKENS`` tokens, a host of
many chunks is spread over tasks, and only candidates leave them. Candidates and boilerplate of a host are at most a few times
as many as its average page has tokens. Between chunks strings go by 64-bit hashes of their tokens; inside one they are compared.

Defined results: null or empty html gives an empty text; unclosed and stray tags are read as
browsers do as far as blocks are concerned; a repeated row has the same blocks, so it does not
make its own text boilerplate; a null url has the empty host; other columns are not read.
On a host of fewer than LEAST_PAGES distinct pages nothing tells boilerplate from a copy, so all text stays.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import A_Z, A_Z_LOWER, keep_copy, small_batches
from .rolling import combined

RUN = 20
SHARE, ARTICLE_SHARE = 50, 90
LEAST_PAGES, LEAST_ARTICLES = 3, 10
CHUNK_PAGES = 500
CHUNK_TOKENS = 500_000
#: A chunk leaves a string out if fewer than this part of the share of its pages hold it. Below 1, so that a string must be a
#: candidate in chunks with a fifth of a host's pages to be counted again.
LOCAL = 0.75
#: Up to this many boilerplate strings (about 50 bytes each) the table of them is broadcast, else shuffled.
BROADCAST_UNITS = 1_000_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>\"']*(?:\"[^\"]*\"[^<>\"']*|'[^']*'[^<>\"']*)*)(?:>|\Z|(?=<))",
    re.S | re.I)
_END = re.compile(r"</([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|hidden|style)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME = re.compile(r"[a-z]+")
_QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
_HIDDEN = re.compile(r"(?:^|[\s/])hidden(?=[\s=/]|$)", re.I)
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Fixed values of HTML: elements that end a text block, and elements without an end tag.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset(
    "article aside blockquote body details dialog div dl fieldset figure footer form header li main menu nav ol section table tbody td "
    "th thead tr ul".split())
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Words of class and id names that mark furniture.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer "
    "disqus footer gdpr header menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo related "
    "reply replies share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
# Elements whose content is no text: up to their end tag; if there is none, the first ones take the rest of the page, as
# a browser reads on to the end in them, and of the others only the tag goes.
RAW = frozenset("script style textarea title iframe noscript".split())
SKIPPED = RAW | frozenset("template svg object select button head".split())
# Words that mark an element which holds no other blocks: adverts, and if it is a block itself, notices.
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement promo sponsor sponsored".split())
NOTICE_WORDS = ADVERT_WORDS | frozenset(
    "comment comments consent cookie cookies disclaimer gdpr newsletter notice notices popup replies reply share sharing social subscribe".split())
# Items and cells that the next one ends, unless a list or table was opened in them.
_LISTS, _TABLE = frozenset("ul ol menu".split()), frozenset(("table",))
ENDED_BY = {"li": (frozenset(("li",)), _LISTS), "td": (frozenset(("td", "th")), _TABLE), "th": (frozenset(("td", "th")), _TABLE)}
COMMENT_WORDS = frozenset("comment comments disqus reply replies".split())


def _furniture(tag: str, attributes: str) -> str:
    """'' | 'furniture' | 'comments'"""
    kind = "furniture" if tag in FURNITURE_TAGS else ""
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            words = set(_NAME.findall(value.lower()))
            name = name.lower()
            if name in ("class", "id"):
                if words & COMMENT_WORDS:
                    return "comments"
                if words & FURNITURE_WORDS:
                    kind = "furniture"
            elif name == "role" and words & FURNITURE_ROLES:
                kind = "furniture"
    return kind


def _hidden(attributes: str) -> bool:
    if _HIDDEN.search(_QUOTED.sub("", attributes)):
        return True
    return any(name.lower() == "style" and _HIDING.search(value) for name, value in _ATTRIBUTE.findall(attributes))


def _marked(tag: str, attributes: str) -> bool:
    """Whether an element that is no container is hidden, an advert or (a block) a notice."""
    words = NOTICE_WORDS if tag in BLOCKS else ADVERT_WORDS
    return _hidden(attributes) or any(name.lower() in ("class", "id") and not words.isdisjoint(_NAME.findall(value.lower()))
                                      for name, value in _ATTRIBUTE.findall(attributes))


ARTICLE, FURNITURE, ELSEWHERE = 0, 1, 2


def blocks_of(page: str) -> tuple[bool, list[tuple[int, str]]]:
    """(page has an article, [(place, text of the block)]), in one pass over the tags."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, str]] = []  # containers: (tag, '' | article | furniture | comments), and marked elements: gone
    kinds, tags = Counter(), Counter()  # of the stack
    text: list[str] = []
    has_article, place, pos = False, ELSEWHERE, 0
    ends: dict[str, list[int]] | None = None

    def end_block() -> None:
        if text:
            words = html.unescape("".join(text)).split()
            text.clear()
            if words:
                out.append((place, " ".join(words)))

    def settle() -> None:
        nonlocal place
        place = FURNITURE if kinds["furniture"] or kinds["comments"] else ARTICLE if kinds["article"] else ELSEWHERE

    def push(tag: str, kind: str) -> None:
        stack.append((tag, kind))
        kinds[kind] += 1
        tags[tag] += 1
        settle()

    def close(i: int) -> None:
        for t, k in stack[i:]:
            kinds[k] -= 1
            tags[t] -= 1
        del stack[i:]
        settle()

    def close_open(names: frozenset, inside: frozenset) -> None:
        """Close the innermost element of these names, unless one of ``inside`` was opened in it."""
        if any(tags[n] for n in names):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in names:
                    return close(i)
                if stack[i][0] in inside:
                    return

    def end_tag(tag: str, at: int) -> int:
        """Where the next end tag of that name starts, -1 if there is none; the page is searched for end tags once."""
        nonlocal ends
        if ends is None:
            ends = {}
            for m in _END.finditer(page):
                ends.setdefault(m.group(1).lower(), []).append(m.start())
        where = ends.get(tag, ())
        i = bisect_left(where, at)
        return where[i] if i < len(where) else -1

    while m := _TOKEN.search(page, pos):
        if m.start() > pos and not kinds["gone"]:
            text.append(page[pos:m.start()])
        pos = m.end()
        tag, closing, attributes = (m.group(2) or "").lower(), m.group(1), m.group(3)
        if not tag:
            continue
        if tag in SKIPPED and not closing:
            at = end_tag(tag, pos)
            if at >= 0:
                pos = max(page.find(">", at), at) + 1
            elif tag in RAW:
                pos = len(page)
            continue
        if tag in BLOCKS:
            end_block()
            if stack and stack[-1] == ("p", "gone") and not (closing and tag == "p"):
                close(len(stack) - 1)  # a block ends a paragraph
        if closing:
            # an end tag that is no container's stays inside its container
            close_open(frozenset((tag,)), frozenset() if tag in CONTAINERS else CONTAINERS)
        elif tag not in CONTAINERS:
            if tag not in VOID and not attributes.endswith("/"):
                if attributes and _marked(tag, attributes):
                    push(tag, "gone")
                elif kinds["gone"] and tags[tag]:
                    push(tag, "")  # so that its end tag does not end the marked one
        else:
            if tag in ENDED_BY:
                close_open(*ENDED_BY[tag])
            kind = _furniture(tag, attributes)
            if tag in ("article", "main") and kind != "comments":
                kind = "article"
                has_article = has_article or not kinds["comments"]
                # an article does not stand in a menu or footer: those were never closed
                if (kinds["furniture"] or kinds["gone"]) and not kinds["comments"]:
                    for t, k in stack:
                        if k in ("furniture", "gone"):
                            tags[t] -= 1
                    stack = [x for x in stack if x[1] not in ("furniture", "gone")]
                    kinds["furniture"] = kinds["gone"] = 0
            elif attributes and _hidden(attributes):
                kind = "gone"
            push(tag, kind)
    if pos < len(page) and not kinds["gone"]:
        text.append(page[pos:])
    end_block()
    return has_article, out


#: Stands for a page in counts of units; no key is 0.
PAGE = 0
PAGES, ARTICLES = 0, 1
NONE = np.zeros(0, np.int64)
_hashes: dict[str, int] = {}


def _hash(text: str, kind: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8, person=kind).digest(), "little", signed=True) | 1


def _run_keys(words: list[str]) -> np.ndarray:
    """Keys of the strings of RUN tokens, one for each start."""
    if len(words) < RUN:
        return NONE
    if len(_hashes) > 500_000:
        _hashes.clear()
    for w in set(words).difference(_hashes):
        _hashes[w] = _hash(w, b"token")
    h, n = np.fromiter(map(_hashes.__getitem__, words), np.int64, len(words)).view(np.uint64), 1
    while n < RUN:
        step = min(n, RUN - n)
        h, n = combined(h[:-step], h[step:]), n + step
    return h.view(np.int64) | 1


def _words(texts: list[str]) -> list[str]:
    return [w for t in texts for w in t.split(" ")]


def _covered(words: list[str], runs: np.ndarray) -> np.ndarray:
    """True for tokens that one of the strings ``runs`` (keys) covers."""
    edges = np.zeros(len(words) + 1, np.int64)
    if len(runs) and len(words) >= RUN:
        at = np.nonzero(np.isin(_run_keys(words), runs))[0]
        edges[at] += 1
        edges[at + RUN] -= 1
    return np.cumsum(edges[:-1]) > 0


def article_text(blocks: list[tuple[int, str]], repeated: np.ndarray = NONE) -> str:
    """Blocks of the article without those that repeated strings cover wholly; all of them if such strings are the greater part."""
    texts = [t for place, t in blocks if place == ARTICLE]
    if len(repeated):
        gone = _covered(_words(texts), repeated)
        ends = np.cumsum([t.count(" ") + 1 for t in texts])
        if 2 * gone.sum() <= len(gone):
            texts = [t for t, g in zip(texts, np.split(gone, ends[:-1])) if not g.all()]
    return "\n".join(texts)


def unique_text(blocks: list[tuple[int, str]], repeated: np.ndarray = NONE) -> str:
    """Blocks elsewhere on the page without repeated blocks and the tokens that repeated strings cover."""
    outside = [(place, t) for place, t in blocks if place != ARTICLE]
    gone, whole, at, out = _covered(_words([t for _, t in outside]), repeated), set(repeated.tolist()), 0, []
    for place, t in outside:
        words = t.split(" ")
        if place == ELSEWHERE and not (whole and _hash(t, b"block") in whole):
            left = [w for i, w in enumerate(words) if not gone[at + i]]
            if left:
                out.append(" ".join(left))
        at += len(words)
    return "\n".join(out)


def suffix_array(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in the order of their first ``depth`` codes, rank of each suffix), by prefix doubling; suffixes that
    have these codes in common are neighbours with one rank. Codes are 1 or more; the end sorts before them."""
    rank, n = codes.astype(np.int64), 1
    while n < depth:
        step = min(n, depth - n)
        after = np.zeros_like(rank)
        after[:-step] = rank[step:]
        rank, n = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)[1] + 1, n + step
    return np.argsort(rank, kind="stable"), rank


def repeated_blocks(pages: list[list[str]], least: float) -> dict[int, int]:
    """{key: pages} of the whole blocks that at least ``least`` of the pages hold."""
    blocks = Counter(t for streams in pages for t in {t for s in streams for t in s.split("\n") if t})
    return {_hash(t, b"block"): n for t, n in blocks.items() if n >= least}


def repeated_strings(pages: list[list[str]], least: float) -> dict[int, int]:
    """{key: pages} of the strings of RUN tokens that at least ``least`` of the pages hold. A page is
    its streams, a stream its blocks with line ends between; strings may go over block ends."""
    out: dict[int, int] = {}
    words, sizes = [], []
    for page in pages:
        before = len(words)
        for s in page:
            words += s.replace("\n", " ").split(" ")
            words.append("\n")  # ends a stream
        sizes.append(len(words) - before)
    if len(words) <= RUN:
        return out
    tokens = list(dict.fromkeys(["\n", *words]))
    codes = np.fromiter(map({w: c for c, w in enumerate(tokens, 1)}.__getitem__, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(pages)), sizes)
    ends = np.concatenate([[0], np.cumsum(codes == 1)])
    order, rank = suffix_array(codes, RUN)
    order = order[order + RUN <= len(codes)]
    order = order[ends[order + RUN] == ends[order]]  # RUN tokens of one stream
    # the array's neighbours with one rank, each page of them once
    held = np.stack([rank[order], owner[order]])  # sorted, since suffixes of one rank are in the order of the text
    held = held[0, np.concatenate([[True], (held[:, 1:] != held[:, :-1]).any(0)])[:held.shape[1]]]
    ranks, n = np.unique(held, return_counts=True)
    often = n >= least
    first = np.zeros(int(rank.max()) + 1, np.int64)
    first[rank[order]] = order
    for i, n_pages in zip(first[ranks[often]].tolist(), n[often].tolist()):
        out[int(_run_keys(words[i:i + RUN])[0])] = n_pages
    return out


def _host(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), A_Z, A_Z_LOWER)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars per input row."""
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    pages = pages.withColumn("host", _host(F.col("url")))
    repeats = keep_copy(boilerplate(pages))
    n, outside = repeats.count(), repeats.filter(F.col("kind") == PAGES)
    # pages are parsed where they are needed: a copy of them would be larger than the input
    found = pages.select("host", "html").join(_by_host(outside, n, outside=F.col("unit")), "host").select("host", "html", "outside")
    found = found.mapInArrow(_emit_article_runs, "host string, unit long, article binary").distinct()
    found = found.groupBy("host", "unit").count().filter(F.col("count") >= LEAST_PAGES)
    units = keep_copy(repeats.join(found, ["host", "unit"], "left"))
    is_outside, is_inside = F.col("kind") == PAGES, (F.col("kind") == ARTICLES) | F.col("count").isNotNull()
    joined = pages.join(_by_host(units, n, outside=F.when(is_outside, F.col("unit")), inside=F.when(is_inside, F.col("unit"))), "host", "left")
    return joined.select("page_id", "url", "html", "outside", "inside").mapInArrow(_extract, RESULT)


def boilerplate(pages: DataFrame) -> DataFrame:
    """(host, kind, unit): keys of the strings and blocks that enough pages of their host hold outside the article (kind
    PAGES), and of the strings that enough of its articles hold (kind ARTICLES)."""
    parts = F.ceil(F.count(F.lit(1)) / CHUNK_PAGES).alias("parts")
    spread = keep_copy(pages.groupBy("host").agg(parts).filter("parts > 1"))
    counts = keep_copy(_distinct_pages(pages, spread).mapInArrow(_emit_candidates, "host string, kind int, unit long, n long, pages long"))
    of = counts.filter(F.col("unit") == PAGE).groupBy("host", "kind").agg(F.sum("n").alias("of"))
    found = counts.filter(F.col("unit") != PAGE).groupBy("host", "kind", "unit").agg(F.sum("n").alias("n"), F.sum("pages").alias("seen"))
    found = found.join(of, ["host", "kind"])
    articles = F.col("kind") == ARTICLES
    share, least = F.when(articles, ARTICLE_SHARE).otherwise(SHARE), F.when(articles, LEAST_ARTICLES).otherwise(LEAST_PAGES)
    enough = (F.col("n") * 100 >= F.col("of") * share) & (F.col("n") >= least)
    most = F.col("n") * 100 + (F.col("of") - F.col("seen")) * share * LOCAL  # chunks that left it out hold it less often
    again = keep_copy(found.filter(~enough & (F.col("seen") < F.col("of")) & (most >= F.col("of") * share)).select("host", "kind", "unit", "of"))
    sure, n_again = found.filter(enough).select("host", "kind", "unit"), again.count()
    if not n_again:
        return sure
    # these are hosts of several chunks, so they are few
    some = _distinct_pages(pages.join(F.broadcast(again.select("host").distinct()), "host", "left_semi"), spread)
    units = _by_host(again, n_again, "kind", units=F.col("unit"))
    held = some.join(units, ["host", "kind"]).select("host", "kind", "streams", "units").mapInArrow(_emit_held, "host string, kind int, unit long, n long")
    counted = held.groupBy("host", "kind", "unit").agg(F.sum("n").alias("n")).join(again, ["host", "kind", "unit"])
    return sure.unionByName(counted.filter(enough).select("host", "kind", "unit"))


def _by_host(df: DataFrame, n: int, *keys: str, **columns: Column) -> DataFrame:
    """One row a host, to join with its pages."""
    rows = df.groupBy("host", *keys).agg(*[F.collect_list(c).alias(name) for name, c in columns.items()])
    return F.broadcast(rows) if n <= BROADCAST_UNITS else rows


def _distinct_pages(pages: DataFrame, spread: DataFrame) -> DataFrame:
    """(host, kind, parts, part, page, streams): each page and each article of a host once, those of a part of a host together."""
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    streams = pages.select("host", "html").mapInArrow(_emit_streams, "host string, kind int, page binary, stream string")
    dealt = streams.join(F.broadcast(spread), "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("page"), F.col("parts"))).repartition(n, "host", "kind", "part")
    pages = dealt.groupBy("host", "kind", "parts", "part", "page").agg(F.collect_set("stream").alias("streams"))
    return pages.sortWithinPartitions("host", "kind", "part")


RESULT = "page_id long, url string, text string, n_chars long"


def _batch(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _page_key(texts: list[str]) -> bytes:
    return hashlib.blake2b("\n".join(texts).encode("utf-8", "replace"), digest_size=16, person=b"page").digest()


def _units(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy() if column[i].is_valid else NONE


def _emit_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) -> (host, kind, page, stream): the blocks outside the article, where pages with the same blocks are the
    same page, and those of the article, if there is one."""
    for b in small_batches(batches, 1):
        rows = {}
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            blocks = blocks_of(page)[1]
            article = [t for place, t in blocks if place == ARTICLE]
            rows[host, PAGES, _page_key([t for _, t in blocks]), "\n".join(t for place, t in blocks if place != ARTICLE)] = None
            if article:
                rows[host, ARTICLES, _page_key(article), "\n".join(article)] = None
        yield _batch(["host", "kind", "page", "stream"], [pa.string(), pa.int32(), pa.binary(), pa.string()], list(rows))


def _emit_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages sorted by host, kind and part -> (host, kind, unit, n, pages): of each chunk its pages (unit PAGE) and what enough of them hold."""

    def candidates(host: str, kind: int, whole: bool) -> pa.RecordBatch:
        n, share, fewest = len(chunk), *((SHARE, LEAST_PAGES) if kind == PAGES else (ARTICLE_SHARE, LEAST_ARTICLES))
        least = max(fewest, n * share / 100) if whole else n * share * LOCAL / 100
        rows = [(host, kind, PAGE, n, n)]
        if n >= least:
            found = repeated_strings(chunk, least) | (repeated_blocks(chunk, least) if kind == PAGES else {})
            rows += [(host, kind, u, k, n) for u, k in found.items()]
        return _batch(["host", "kind", "unit", "n", "pages"], [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], rows)

    chunk: list[list[str]] = []
    at, size, whole = None, 0, True
    for b in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
        for host, kind, parts, part, streams in zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in ("host", "kind", "parts", "part", "streams"))):
            same = (host, kind, part) == at
            if chunk and (not same or size >= CHUNK_TOKENS):
                whole = whole and not same
                yield candidates(*at[:2], whole)
                chunk, size = [], 0
            if not same:
                at, whole = (host, kind, part), parts == 1
            chunk.append(streams)
            size += sum(s.count(" ") + s.count("\n") + 1 for s in streams)
    if chunk:
        yield candidates(*at[:2], whole)


def _emit_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, kind, streams, units) -> (host, kind, unit, n): how many pages hold each of the units."""
    for b in batches:
        held: Counter = Counter()
        for i, (host, kind, streams) in enumerate(zip(*(b.column(k).to_pylist() for k in range(3)))):
            keys = [_hash(t, b"block") for s in streams for t in s.split("\n") if t]
            keys = np.concatenate([np.array(keys, np.int64), *(_run_keys(s.replace("\n", " ").split(" ")) for s in streams)])
            held.update((host, kind, u) for u in np.intersect1d(keys, _units(b.column(3), i)).tolist())
        yield _batch(["host", "kind", "unit", "n"], [pa.string(), pa.int32(), pa.int64(), pa.int64()], [(*k, n) for k, n in held.items()])


def _emit_article_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html, outside) -> (host, unit, article): the boilerplate strings of the host that stand in an article."""
    for b in small_batches(batches, 1):
        out = {}
        for i, (host, page) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            texts = [t for place, t in blocks_of(page)[1] if place == ARTICLE]
            found = np.intersect1d(_run_keys(_words(texts)), _units(b.column(2), i)).tolist()
            article = _page_key(texts) if found else b""
            out.update(((host, u, article), None) for u in found)
        yield _batch(["host", "unit", "article"], [pa.string(), pa.int64(), pa.binary()], list(out))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html, outside, inside) -> RESULT"""
    for b in small_batches(batches, 2):
        rows = []
        for i, (page_id, url, page) in enumerate(zip(*(b.column(k).to_pylist() for k in range(3)))):
            has_article, blocks = blocks_of(page)
            text = article_text(blocks, _units(b.column(4), i)) if has_article else unique_text(blocks, _units(b.column(3), i))
            rows.append((page_id, url, text, len(text)))
        yield _batch(["page_id", "url", "text", "n_chars"], [pa.int64(), pa.string(), pa.string(), pa.int64()], rows)
