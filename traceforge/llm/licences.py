"""Licence scan by a positional index of rare tokens, in DataFrame functions alone.

Notices are templates: a short mark ("mit license"), an identifier line, or a whole licence header with several
mandatory phrases. A word's IDF is taken over the templates. Each template is listed under its *anchor*, the
highest-IDF word of its mandatory phrases, with the anchor's place in it. Of a file only the anchors are looked up:
each one found stands for placements (template, word where it would begin). A placement is then intersected with the
rest of the template by relative position, word for word in the file: it counts if every mandatory phrase stands there
in full and enough IDF weight is matched. As an anchor is itself mandatory, no notice is missed, and common words
("license", "the") cost nothing. The base phrases are templates that are mandatory from end to end.

Files with none of the templates' marks are done after one pattern test. The index is a constant of under a
hundred rows inside the plan; a document is scanned in its own row, so nothing is shuffled, broadcast or grouped, and a
row's memory is some times its text.

Rows and edge cases: a null text counts as empty (no words, no labels, null places, score 0); texts of
any length are read whole; ties do not arise, as a placement has one anchor; repeated rows each give a row; an empty
table gives an empty result; a null doc_id is a row like any other; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a text in lower case, and what stands between words in any case.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: name: (label, whole text, mandatory phrases). The base phrases come first and are wholly mandatory.
BASE = {
    "base-cc": ("cc-by", "cc by", ("cc by",)),
    "base-gpl": ("gpl", "general public license", ("general public license",)),
    "base-reserved": ("reserved", "all rights reserved", ("all rights reserved",)),
}
#: Licence identifiers of "SPDX-License-Identifier:" lines. Fixed values.
IDENTIFIERS = "MIT Apache-2.0 GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 BSD-2-Clause BSD-3-Clause ISC MPL-2.0 EPL-2.0 Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0".split()
#: Marks and headers in the licences' own words. Fixed values.
NOTICES = {
    "mit-note": ("mit", "released under the mit license", ("mit license",)),
    "mit-title": ("mit", "mit license", ("mit license",)),
    "mit-grant": ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted",)),
    "mit-terms": (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
        " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "to deal in the software without restriction", "sublicense and or sell copies"),
    ),
    "apache-2": ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    "apache-id": ("apache-2.0", "apache 2 0", ("apache 2 0",)),
    "apache-header": (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"
        " you may obtain a copy of the license at http www apache org licenses license 2 0"
        " unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        ("apache license version 2 0", "except in compliance with the license"),
    ),
    "cc-by-nc": ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    "cc-by-nc-id": ("cc-by-nc-4.0", "cc by nc 4 0", ("cc by nc 4 0",)),
    "cc-by-nc-name": ("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0 international", ("creative commons attribution noncommercial 4 0",)),
    "cc-by-sa": ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    "cc-by-sa-id": ("cc-by-sa-4.0", "cc by sa 4 0", ("cc by sa 4 0",)),
    "cc-by-sa-name": ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0 international", ("creative commons attribution sharealike 4 0",)),
    "cc-by-4": ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    "cc-by-4-id": ("cc-by-4.0", "cc by 4 0", ("cc by 4 0",)),
    "cc-by-4-name": ("cc-by-4.0", "creative commons attribution 4 0 international", ("creative commons attribution 4 0",)),
    "gpl-3": ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    "gpl-3-header": (
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
        " as published by the free software foundation either version 3 of the license or at your option any later version",
        ("you can redistribute it and or modify it", "gnu general public license", "version 3 of the license"),
    ),
    "gpl-2": ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    "gpl-2-header": (
        "gpl-2.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
        " as published by the free software foundation either version 2 of the license or at your option any later version",
        ("you can redistribute it and or modify it", "gnu general public license", "version 2 of the license"),
    ),
    "lgpl": ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    "lgpl-header": (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"
        " as published by the free software foundation either version 2 1 of the license or at your option any later version",
        ("you can redistribute it and or modify it", "gnu lesser general public license", "of the license or at your option"),
    ),
    "agpl": ("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    "agpl-header": (
        "agpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"
        " as published by the free software foundation either version 3 of the license or at your option any later version",
        ("you can redistribute it and or modify it", "gnu affero general public license", "version 3 of the license"),
    ),
    "mpl-2": ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "2 0")),
    "mpl-2-header": (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        ("source code form is subject to the terms", "mozilla public license v 2 0", "if a copy of the mpl"),
    ),
    "bsd": ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    "bsd-terms": (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
        " 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        ("redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice"),
    ),
    "isc": ("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission to use copy modify",)),
    "isc-plain": (
        "isc",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify and distribute this software", "with or without fee is hereby granted"),
    ),
    "cc0": ("cc0-1.0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    "unlicense": ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
}
TEMPLATES = BASE | NOTICES | {f"id-{i}": (i.lower(), t := "spdx license identifier " + " ".join(i.lower().replace(".", "-").split("-")), (t,)) for i in IDENTIFIERS}
#: A word of each template without which no mandatory phrase can stand.
MARKS = "license|reserved|permission|redistribution|unencumbered|cc0|cc[^a-z0-9]+by|creative[^a-z0-9]+commons|apache[^a-z0-9]+2"
#: The least matched share of IDF.
LEAST_SHARE = 0.6


def _index() -> list[tuple[str, str, str, bool, int, float, bool]]:
    """(word, template, label, is base, place, idf, mandatory) of every template word."""
    texts = {name: t[1].split() for name, t in TEMPLATES.items()}
    seen_in = Counter(w for ws in texts.values() for w in set(ws))
    out = []
    for name, (label, _, phrases) in TEMPLATES.items():
        ws = texts[name]
        must = {i + j for p in (p.split() for p in phrases) for i in range(len(ws)) if ws[i : i + len(p)] == p for j in range(len(p))}
        out += [(w, name, label, name in BASE, i, round(math.log(len(texts) / seen_in[w]) + 0.1, 6), i in must) for i, w in enumerate(ws)]
    return out


def _needs() -> list[tuple[str, int, float]]:
    """(template, mandatory words, IDF weight)."""
    rows = _index()
    return [(name, sum(r[6] for r in rows if r[1] == name), round(sum(r[5] for r in rows if r[1] == name), 6)) for name in TEMPLATES]


def _anchors() -> list[tuple[str, str, int]]:
    """(word, template, place): of each template the mandatory word of highest IDF; of equals the longest, then the first."""
    rows = _index()
    best = {name: max((r for r in rows if r[1] == name and r[6]), key=lambda r: (r[5], len(r[0]), -r[4])) for name in TEMPLATES}
    return [(word, name, place) for name, (word, _, _, _, place, _, _) in best.items()]


def _constants() -> tuple[Column, Column]:
    """The anchors as an array of (word, of, place), ``of`` being a number of the array of templates (label, is_base, weight, words)."""
    words: dict[str, list] = {name: [] for name in TEMPLATES}
    for word, name, _, _, place, idf, must in _index():
        words[name].append(f"named_struct('place', {place}, 'word', '{word}', 'idf', {idf}D, 'must', {must})")
    number = {name: k for k, name in enumerate(TEMPLATES)}
    anchors = [f"named_struct('word', '{word}', 'of', {number[name]}, 'place', {place})" for word, name, place in _anchors()]
    templates = [f"named_struct('label', '{TEMPLATES[name][0]}', 'is_base', {name in BASE}, 'weight', {weight}D, 'words', array({', '.join(words[name])}))" for name, _, weight in _needs()]
    return F.expr(f"array({', '.join(anchors)})"), F.expr(f"array({', '.join(templates)})")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _standing(words: Column) -> Column:
    """Array of (label, is_base, begin, share) of the notices that stand in an array of words."""
    anchors, templates = _constants()
    rare = sorted({word for word, _, _ in _anchors()})

    def stands(ws: Column, t: Column, begin: Column) -> Column:
        there = lambda w: F.get(ws, begin + w["place"]).eqNullSafe(w["word"])
        weight = F.aggregate(t["words"], F.lit(0.0), lambda s, w: s + F.when(there(w), w["idf"]).otherwise(0.0))
        share = F.when(F.forall(t["words"], lambda w: ~w["must"] | there(w)), F.round(weight / t["weight"], 6))
        return F.struct(t["label"].alias("label"), t["is_base"].alias("is_base"), begin.cast("long").alias("begin"), share.alias("share"))

    def scan(ws: Column) -> Column:
        hits = F.array_compact(F.transform(ws, lambda w, at: F.when(w.isin(rare), at)))
        listed = lambda at: _bound(F.get(ws, at), lambda word: F.filter(anchors, lambda a: a["word"] == word))
        placed = F.flatten(F.transform(hits, lambda at: F.transform(F.filter(listed(at), lambda a: a["place"] <= at), lambda a: F.struct(a["of"].alias("of"), (at - a["place"]).alias("begin")))))
        judged = F.transform(placed, lambda p: _bound(F.get(templates, p["of"]), lambda t: stands(ws, t, p["begin"])))
        return F.filter(judged, lambda x: x["share"].isNotNull() & (x["is_base"] | (x["share"] >= LEAST_SHARE)))

    return _bound(words, scan)


def licence_scan(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    words = F.array_remove(F.split(F.translate("text", UPPER, LOWER), BETWEEN), "")
    # Splitting is far cheaper than finding each word; what stands before the first and after the last one is no word.
    edges = [F.when(F.substring("text", at, 1).rlike(BETWEEN), 1).otherwise(0) for at in (1, -1)]
    n_words = F.when(F.length("text") > 0, F.size(F.split("text", BETWEEN)) - edges[0] - edges[1]).otherwise(0)
    found = F.when(F.col("text").rlike(f"(?i){MARKS}"), _standing(words))
    scanned = documents.select("doc_id", n_words.cast("long").alias("n_words"), found.alias("found"))
    base = F.filter("found", lambda x: x["is_base"])
    begins = F.transform(base, lambda x: x["begin"])
    labels = lambda of: F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda x: x["label"]))), ","), F.lit(""))
    return scanned.select(
        "doc_id", "n_words", F.when(F.col("found").isNotNull(), F.size(base)).otherwise(0).cast("long").alias("n_base"),
        F.array_min(begins).alias("first_word"), F.array_max(begins).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("found")).alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """The same scan as DuckDB SQL."""
    q = lambda v: "'" + v + "'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else repr(v)
    rows = lambda r: ", ".join("(" + ", ".join(map(q, x)) + ")" for x in r)
    return rf"""
WITH ix(word, template, label, is_base, place, idf, must) AS (VALUES {rows(_index())}),
needs(template, n_must, weight) AS (VALUES {rows(_needs())}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS ws FROM documents),
u AS (SELECT rid, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM d),
hits AS (SELECT rid, pos, ix.* FROM u JOIN ix USING (word)),
placed AS (
  SELECT rid, template, label, is_base, pos - place AS begin_at, count(DISTINCT place) FILTER (WHERE must) AS got, sum(CAST(idf AS DOUBLE)) AS matched
  FROM hits GROUP BY ALL
), standing AS (
  SELECT p.*, round(matched / CAST(weight AS DOUBLE), 6) AS share FROM placed p JOIN needs USING (template)
  WHERE begin_at >= 0 AND got = n_must AND (is_base OR round(matched / CAST(weight AS DOUBLE), 6) >= {LEAST_SHARE})
), k AS (
  SELECT rid, count(*) FILTER (WHERE is_base) AS n_base, min(begin_at) FILTER (WHERE is_base) AS first_word, max(begin_at) FILTER (WHERE is_base) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE is_base), '') AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM standing GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN k USING (rid)
"""
