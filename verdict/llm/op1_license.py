"""License scans by sentence rules.

A text is normalised (A-Z lower-cased, every run of other characters than letters and digits,
comment leaders included, to one blank) with marks for sentence ends, blank lines and line ends.
A single line end is a blank inside a known sentence, so wrapped texts count as unwrapped ones.
A known wording starts at a sentence or line start and ends at a sentence or line end; those of
``STARTS`` are whole-word starts of a longer published sentence (its end is not compared), those
of ``INSIDE`` may also follow the free subject of theirs. The identifiers found, in text order,
are then matched against licence rules.
A rule names identifiers that must appear in that order; rules are tried in their order and
each consumes its identifiers, so a specific rule stands before a general one.

All of it is column expressions of one row (no shuffle, no Python). Only texts with a
cue word are normalised; every known sentence holds a cue word (``_check``), so none is lost.
``SQL`` is the older rule, line by line and whole sentences of ``SENTENCES`` only: it agrees where
sentences stand on lines of their own, as in the given tables, and not on wrapped or full texts.

Defined results: null or empty text has no sentence and no licence; a sentence that has a cue
of ``UNKNOWN_CUES`` but no identifier counts as unknown; repeated rows are scanned one by one;
a null id stays null; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import A_Z, A_Z_LOWER, with_value

# Identifier -> wordings of one licence sentence, in normal form.
SENTENCES: dict[str, tuple[str, ...]] = {
    "MIT_NAME": ("released under the mit license", "licensed under the mit license",
                 "this software is released under the mit license", "spdx license identifier mit"),
    "MIT_GRANT": ("permission is hereby granted free of charge to any person obtaining a copy of this software and "
                  "associated documentation files the software to deal in the software without restriction",),
    "MIT_NOTICE": ("the above copyright notice and this permission notice shall be included in all copies or "
                   "substantial portions of the software",),
    "APACHE_2": ("licensed under the apache license version 2 0", "spdx license identifier apache 2 0",
                 "licensed under the apache license version 2 0 the license"),
    "APACHE_LIMITS": ("you may not use this file except in compliance with the license",),
    "GPL_3": ("this work is licensed under the gnu general public license version 3",
              "licensed under the gnu general public license version 3", "spdx license identifier gpl 3 0"),
    "GPL_LATER": ("either version 3 of the license or at your option any later version",),
    "CC_BY_NC_4": ("licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0"),
    "CC_BY_4": ("licensed under cc by 4 0", "this work is licensed under cc by 4 0"),
    "CC0": ("this work is in the public domain", "licensed under cc0 1 0"),
    "BSD_REDIST": ("redistribution and use in source and binary forms with or without modification are permitted "
                   "provided that the following conditions are met",),
    "BSD_3": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
              "promote products derived from this software without specific prior written permission",),
    "NO_WARRANTY": ("the software is provided as is without warranty of any kind",
                    "this software is provided by the copyright holders and contributors as is"),
    "ALL_RIGHTS": ("all rights reserved",),
}
# Published sentences besides: wording -> identifiers it gives.
PUBLISHED: dict[str, str] = {
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies "
    "or substantial portions of the software": "MIT_NOTICE",
    "apache license version 2 0 january 2004": "APACHE_2",
    "the asf licenses this file to you under the apache license version 2 0 the license": "APACHE_2",
    "gnu general public license version 3 29 june 2007": "GPL_3",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
    "software foundation either version 3 of the license or at your option any later version": "GPL_3,GPL_LATER",
}
STARTS = (*SENTENCES["MIT_GRANT"], *SENTENCES["NO_WARRANTY"])
INSIDE = tuple(w for w in PUBLISHED if w.startswith("you can redistribute"))
# The holder's name in BSD_3 is free: what stands for it in a text, and in the wording.
HOLDER, ANY_HOLDER = "name of the copyright holder nor", "names? of [^P]+? nor"
# Ordered rules: licence -> identifiers in the order in which they must appear.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("MIT_GRANT", "MIT_NOTICE", "NO_WARRANTY")),
    ("MIT", ("MIT_GRANT",)),
    ("MIT", ("MIT_NAME",)),
    ("Apache-2.0", ("APACHE_2", "APACHE_LIMITS")),
    ("Apache-2.0", ("APACHE_2",)),
    ("GPL-3.0-or-later", ("GPL_3", "GPL_LATER")),
    ("GPL-3.0", ("GPL_3",)),
    ("BSD-3-Clause", ("BSD_REDIST", "BSD_3")),
    ("BSD-2-Clause", ("BSD_REDIST",)),
    ("CC-BY-NC-4.0", ("CC_BY_NC_4",)),
    ("CC-BY-4.0", ("CC_BY_4",)),
    ("CC0-1.0", ("CC0",)),
    ("Proprietary", ("ALL_RIGHTS",)),
)
CUES = ("licens", "permission", "permitted", "copyright", "warranty", "redistribution", "public domain", "reserved",
        "any later version")
UNKNOWN_CUES = ("license", "licence", "licensed")

END = r"[.!?;][\x20\x09-\x0D]+"
OTHER = "[^0-9A-Za-z\u0080-\U0010FFFF]+"
BLANK_LINES = "\n[^0-9a-z\u0080-\U0010FFFF]*\n"


def _check(sentences=SENTENCES) -> dict[str, str]:
    """wording -> identifier; every wording is normal and holds a cue."""
    out = {}
    for name, wordings in sentences.items():
        for w in wordings:
            if w != re.sub(OTHER, " ", w.lower()).strip() or not any(c in w for c in CUES) or w in out:
                raise ValueError(f"licence sentence {w!r} of {name}")
            out[w] = name
    return out


def normal(low: Column) -> Column:
    """Words of a lower-cased text between blanks, or P (blank line, either end of the text), S (sentence end) or L (line end)."""
    x = F.regexp_replace(F.regexp_replace(low, BLANK_LINES, "P"), END, "S")
    x = F.regexp_replace(F.translate(x, "\n", "L"), "[^0-9a-zPSL\u0080-\U0010FFFF]+", " ")
    x = F.concat(F.lit("P"), x, F.lit("P"))
    for marks, mark in ((" PSL", "P"), (" SL", "S"), (" L", "L")):  # a run of marks is its strongest
        x = F.regexp_replace(x, f"(?<![ PSL])[{marks}]*{mark}[{marks}]*", mark)
    return x


def known_pattern(wordings) -> str:
    """Any wording over ``normal``, longest first."""
    def one(w: str) -> str:
        body = w.replace(HOLDER, ANY_HOLDER).replace(" ", "[ SL]" if HOLDER in w else "[ L]")
        if HOLDER in w:  # also as an item of a list
            body = "(?:[0-9]{1,2} |[a-z] )?" + body
        return f"(?<=[{' ' if w in INSIDE else ''}PSL])" + body + f"(?=[{' ' if w in STARTS else ''}PSL])"
    return "|".join(one(w) for w in sorted(wordings, key=len, reverse=True))


def _has(text: Column, cues, between: str) -> Column:
    return text.rlike("|".join(c.replace(" ", between) for c in cues))


def rule_pattern(ids: tuple[str, ...]) -> str:
    """Over ',A,B,C,': the identifiers in order, others may stand between."""
    return "," + ",(?:[^,]+,)*?".join(ids) + ","


def match_rules(sequence: Column, rules=RULES) -> Column:
    """Licences of the rules that match, in rule order; a rule's identifiers are consumed."""
    state = F.struct(sequence.alias("left"), F.lit("").alias("found"))
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(rule_pattern(ids)).alias("pattern"),
                               F.lit(rule_pattern(ids).replace("(?:[^,]+,)*?", "((?:[^,]+,)*?)")).alias("cut"),
                               F.lit("," + "".join(f"${i + 1}" for i in range(len(ids) - 1))).alias("rest"))
                      for name, ids in rules])

    def step(acc: Column, rule: Column) -> Column:
        hit = F.regexp_like(acc["left"], rule["pattern"])
        left = F.when(hit, F.regexp_replace(acc["left"], rule["cut"], rule["rest"])).otherwise(acc["left"])
        new = hit & (F.find_in_set(rule["name"], acc["found"]) == 0)
        found = F.when(new, F.concat_ws(",", F.when(acc["found"] != "", acc["found"]), rule["name"])).otherwise(acc["found"])
        return F.struct(left.alias("left"), found.alias("found"))

    return F.aggregate(table, state, step, lambda acc: acc["found"])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences=SENTENCES, rules=RULES) -> DataFrame:
    """id, sentence_ids ('A,B', '' if none), n_known, n_unknown, licenses (by rule order), license (first, else
    'UNKNOWN' if an unknown licence sentence stands there, else null)."""
    known = _check(sentences) | PUBLISHED
    names = F.create_map(*[x for w, name in known.items() for x in (F.lit(w), F.lit(name))])
    pattern = F.lit(known_pattern(known))
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), A_Z, A_Z_LOWER)
    # texts without a cue are not normalised; the cue test is one pass
    norm = F.when(_has(low, CUES, OTHER), normal(low)).otherwise(F.lit(""))

    def identifier(hit: Column) -> Column:
        wording = F.regexp_replace(F.translate(hit, "LS", "  "), "^.*?neither the names? of .* nor", f"neither the {HOLDER}")
        return F.element_at(names, wording)

    def found(text: Column) -> Column:
        ids = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), identifier)
        # sentences, each known wording in them as a mark
        rest = F.split(F.regexp_replace(text, pattern, F.lit("K")), "[PS]", -1)
        strange = F.filter(rest, lambda s: ~s.contains("K") & _has(s, CUES, "[ L]") & _has(s, UNKNOWN_CUES, " "))
        return with_value(ids, lambda x: F.struct(
            F.concat_ws(",", x).alias("sentence_ids"), F.size(x).cast("long").alias("n_known"),
            F.size(strange).cast("long").alias("n_unknown")))

    hits = df.select(F.col(id_col), with_value(norm, found).alias("_h")).select(F.col(id_col), "_h.*")
    lic = F.when(F.col("n_known") > 0, match_rules(F.concat(F.lit(","), F.col("sentence_ids"), F.lit(",")), rules)).otherwise(F.lit(""))
    out = hits.withColumn("licenses", lic)
    first = F.when(F.col("licenses") != "", F.substring_index(F.col("licenses"), ",", 1))
    return out.withColumn("license", F.coalesce(first, F.when(F.col("n_unknown") > 0, F.lit("UNKNOWN"))))


def _sql(sentences=SENTENCES, rules=RULES) -> str:
    known = _check(sentences)
    table = ", ".join(f"('{w}', '{name}')" for w, name in known.items())
    low = f"translate({{}}, '{A_Z}', '{A_Z_LOWER}')"
    ctes = []
    for i, (name, ids) in enumerate(rules):
        pattern = rule_pattern(ids)
        cut, rest = pattern.replace("(?:[^,]+,)*?", "((?:[^,]+,)*?)"), "," + "".join(f"\\{k + 1}" for k in range(len(ids) - 1))
        hit = f"regexp_matches(l, '{pattern}')"
        ctes.append(f"r{i + 1} AS (SELECT rid, doc_id, ids, n_known, n_unknown, CASE WHEN {hit} THEN regexp_replace(l, '{cut}', '{rest}') "
                    f"ELSE l END AS l, CASE WHEN {hit} AND NOT list_contains(f, '{name}') THEN list_append(f, '{name}') ELSE f END AS f "
                    f"FROM r{i})")
    other = OTHER.replace("\u0080", "\\x{80}").replace("\U0010FFFF", "\\x{10FFFF}")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT rid, unnest(string_split(regexp_replace(text, '([.!?;])[\x20\x09-\x0D]+|\n+', '\1' || chr(10), 'g'), chr(10))) AS s,
             generate_subscripts(string_split(regexp_replace(text, '([.!?;])[\x20\x09-\x0D]+|\n+', '\1' || chr(10), 'g'), chr(10)), 1) AS i
      FROM d),
n AS (SELECT rid, i, trim(regexp_replace({low.format("s")}, '{other}', ' ', 'g')) AS s FROM s
      WHERE regexp_matches({low.format("s")}, '{"|".join(CUES)}')),
k AS (SELECT rid, i, s, v.name FROM n LEFT JOIN (VALUES {table}) v(wording, name) ON n.s = v.wording),
a AS (SELECT rid, string_agg(name, ',' ORDER BY i) FILTER (name IS NOT NULL) AS ids, count(name)::BIGINT AS n_known,
             count(*) FILTER (name IS NULL AND regexp_matches(s, '{"|".join(UNKNOWN_CUES)}'))::BIGINT AS n_unknown
      FROM k GROUP BY rid),
r0 AS (SELECT d.rid, doc_id, coalesce(ids, '') AS ids, coalesce(n_known, 0) AS n_known, coalesce(n_unknown, 0) AS n_unknown,
              ',' || coalesce(ids, '') || ',' AS l, []::VARCHAR[] AS f FROM d LEFT JOIN a USING (rid)),
{", ".join(ctes)}
SELECT doc_id, ids AS sentence_ids, n_known, n_unknown, array_to_string(f, ',') AS licenses,
       coalesce(f[1], CASE WHEN n_unknown > 0 THEN 'UNKNOWN' END) AS license FROM r{len(rules)}
"""


SQL = _sql()
