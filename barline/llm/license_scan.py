"""License scans: an exact containment join of text blocks with license templates.

Only DataFrame functions are used. A text is lower-cased (A-Z) and cut into words of ASCII
letters, digits and non-ASCII characters. Two kinds of evidence are reported:

* places where a phrase's words stand consecutively (the base labels);
* blocks that hold at least THRESHOLD of a template's distinct words. Blocks are windows of twice a
  template's length, one beginning every template length, over the whole text; so any passage as
  long as the template lies in one. The join is exact. All templates' words have one order by the
  number of documents that hold them, rarest first, and blocks keep to it. Of t template words and b
  in a block, `needed` must be common; so both have a common word in their prefixes, the first
  t - needed + 1 and b - needed + 1 words. Windows are made only around words of a template's prefix;
  then a block with fewer than `needed` words is too short, one without a common prefix word is out,
  and from the first common word on both must have words enough left. What passes is verified in
  full, once per block and template.

Everything happens within a text's row; nothing but the count of template words is shuffled.

The template list is fixed and small, so its vocabulary (some 200 words) and prefixes are literals
or scalars whose size doesn't depend on the documents.

Null and empty texts have no words and no labels; first_word and last_word are null and the score
is 0. Repeated rows are scanned one by one. Other columns are not read.
"""

import re

from pyspark.sql import DataFrame, functions as F

from .common import documents

#: Phrase and label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Well-known passages of license texts, a published paragraph each, by label.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution International License"],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at mozilla.org"
    ],
}
THRESHOLD = 80  # per cent of a template's distinct words
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _template_words() -> list[tuple[str, list[str], int]]:
    """Label, distinct words and length in words of every template."""
    cut = [
        (label, [w for w in re.split(_BREAK, text.translate(str.maketrans(_UPPER, _SMALL))) if w])
        for label, texts in TEMPLATES.items() for text in texts
    ]
    return [(label, sorted(set(words)), len(words)) for label, words in cut]


def _spaced(text):
    """The words of a text, each between two blanks of its own, so that neighbours share none."""
    single = F.trim(F.regexp_replace(F.translate(text, _UPPER, _SMALL), _BREAK, " "))
    return F.when(single == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.replace(single, F.lit(" "), F.lit("  ")), F.lit(" ")))


def _count(text, part: str):
    """How often a short text occurs, never overlapping itself."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))) / len(part.encode())).cast("bigint")


def _wrapped(phrase: str) -> str:
    return " " + phrase.replace(" ", "  ") + " "


def _base(df: DataFrame) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word and the base labels from the column `_spaced`."""
    spaced = F.col("_spaced")
    df = df.withColumn("n_words", F.when(spaced == "", F.lit(0)).otherwise(_count(spaced, "  ") + 1).cast("bigint"))
    df = df.withColumns({f"_places_{k}": _count(spaced, _wrapped(p)) for k, p in enumerate(PHRASES)})
    places = [F.col(f"_places_{k}") for k in range(len(PHRASES))]
    firsts, lasts = [], []
    for k, phrase in enumerate(PHRASES):
        wrapped, size = _wrapped(phrase), len(phrase.split(" "))
        before = F.substring_index(spaced, wrapped, 1)
        after = F.substring_index(spaced, wrapped, -1)
        # a word before or after is enclosed in blanks, so words count as half the blanks
        blanks = lambda t: F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit("")))
        firsts.append(F.when(places[k] > 0, (blanks(before) / 2).cast("bigint")))
        lasts.append(F.when(places[k] > 0, (F.col("n_words") - blanks(after) / 2 - size).cast("bigint")))
    total = sum(places[1:], places[0])
    some = total > 0
    return df.select(
        *[c for c in df.columns if not c.startswith("_places_")],
        total.alias("n_base"),
        F.when(some, F.least(*firsts)).alias("first_word"),
        F.when(some, F.greatest(*lasts)).alias("last_word"),
        F.when(some, F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(p > 0, F.lit(v)) for p, v in zip(places, PHRASES.values())])))))
        .otherwise(F.array().cast("array<string>")).alias("_base"),
    )


def _words(spaced):
    return F.split(F.trim(spaced), "  ")


def word_order(docs: DataFrame) -> list[str]:
    """All template words, those of the fewest texts first; as many as the fixed templates have."""
    vocabulary = sorted({w for _, words, _ in _template_words() for w in words})
    held = docs.select(F.explode(F.array_intersect(_words(F.col("_spaced")), F.array(*map(F.lit, vocabulary)))).alias("word"))
    texts = {r.word: r["count"] for r in held.groupBy("word").count().collect()}
    return sorted(vocabulary, key=lambda w: (texts.get(w, 0), w))


def _literals(words: list[str]):
    return F.array(*map(F.lit, words))


def _prefix(words, needed: int):
    """The first words of a set, of which one must be shared if `needed` are."""
    return F.slice(words, F.lit(1), F.greatest(F.size(words) - needed + 1, F.lit(0)))


def passes(block, words: list[str], needed: int):
    """The length, prefix and position filters of a block and a template's words, both in the global order."""
    first = F.get(F.array_intersect(_prefix(block, needed), _literals(words[: len(words) - needed + 1])), F.lit(0))
    left = F.least(F.lit(len(words)) - F.array_position(_literals(words), first), F.size(block) - F.array_position(block, first))
    return (F.size(block) >= needed) & first.isNotNull() & (1 + left >= needed)


def _matches(words, order: list[str], label: str, held: list[str], length: int):
    """(label, share) of the windows of a text that hold enough of a template's words `held`."""
    needed = -(-len(held) * THRESHOLD // 100)
    ordered = [w for w in order if w in held]
    rare = ordered[: len(ordered) - needed + 1]
    placed = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(rare))
    around = F.transform(placed, lambda x: F.floor(x["i"] / F.lit(length)).cast("int"))
    starts = F.filter(F.array_distinct(F.flatten(F.transform(around, lambda g: F.array(g, g - 1)))), lambda g: g >= 0)
    blocks = F.transform(starts, lambda g: F.array_intersect(_literals(order), F.slice(words, g * length + 1, F.lit(2 * length))))
    met = F.filter(blocks, lambda block: passes(block, ordered, needed))
    shares = F.transform(met, lambda block: F.size(F.array_intersect(block, _literals(ordered))) / F.lit(len(ordered)))
    return F.transform(
        F.filter(shares, lambda share: share * 100 >= THRESHOLD), lambda share: F.struct(F.lit(label).alias("label"), share.alias("share"))
    )


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text) with the base places, all labels and the score."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_spaced", _spaced(F.col("text")))
    order, templates = word_order(docs), _template_words()
    rare = set()
    for _, held, _ in templates:
        rare.update([w for w in order if w in held][: len(held) - -(-len(held) * THRESHOLD // 100) + 1])
    words = _words(F.col("_spaced"))
    none = F.array().cast("array<struct<label:string,share:double>>")
    found = F.concat(*[_matches(F.col("_words"), order, *template) for template in templates])
    rows = _base(docs.withColumn("_words", F.when(F.arrays_overlap(words, _literals(sorted(rare))), words)))
    rows = rows.withColumn("_found", F.when(F.col("_words").isNull(), none).otherwise(found))
    best = F.array_max(F.transform("_found", lambda x: x["share"]))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", F.transform("_found", lambda x: x["label"]))), ",").alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("score"),
    )


def op1_license_scan(spark, sf_dir) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _sql() -> str:
    words = "[x for x in string_split_regex(translate({0}, '" + _UPPER + "', '" + _SMALL + "'), '" + _BREAK + "') if x <> '']"
    places = " UNION ALL ".join(
        f"SELECT k, i - 1 AS place, '{label}' AS label FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM words) WHERE "
        + " AND ".join(f"w[i + {n}] = '{part}'" if n else f"w[i] = '{part}'" for n, part in enumerate(phrase.split(" ")))
        for phrase, label in PHRASES.items()
    )
    templates = " UNION ALL ".join(f"SELECT '{label}' AS template, {held} AS t, {length} AS size" for label, held, length in _template_words())
    return f"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS body FROM documents),
words AS (SELECT k, doc_id, {words.format('body')} AS w FROM docs),
places AS ({places}),
based AS (
  SELECT k, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY k
), templates AS ({templates}),
blocks AS (
  SELECT k, template, t, list_distinct(w[g * size + 1:g * size + 2 * size]) AS b
  FROM (SELECT k, w, template, t, size, unnest(range(0, (len(w) + size - 1) // size)) AS g FROM words, templates)
), met AS (
  SELECT k, template, max(len(list_intersect(b, t)) / len(t)) AS share FROM blocks
  WHERE 100 * len(list_intersect(b, t)) >= {THRESHOLD} * len(t) GROUP BY k, template
), labelled AS (
  SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT k, label FROM places UNION SELECT k, template FROM met) GROUP BY k
), best AS (SELECT k, max(share) AS share FROM met GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, greatest(coalesce(share, 0), CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM words LEFT JOIN based USING (k) LEFT JOIN labelled USING (k) LEFT JOIN best USING (k)
"""


SQL = _sql()
