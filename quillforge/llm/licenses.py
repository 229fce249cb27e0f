"""License scans by a positional rare-token index, in DataFrame expressions only.

The index is a table of postings and one of templates, carried in one row: for a word, the templates in whose
key phrases it is one of the two rarest (those that fewest documents contain, the highest IDF), with its place in
each. A file looks up those of its words that the index knows, rarest first: a template whose rarest word it lacks is settled, however often it holds the
other one. For the others every place of a word
gives for each posting the offset at which that template would lie. Offsets on which both words of a template agree
are left; there the key phrases must stand word for word, and the score is the IDF-weighted share
of the template's words that stand in place, the best over all matches. The two words are words that
a match must have, so the index loses no match. Templates are data: any number of them
gives the same plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (phrase, label) whose places are counted whatever stands around them.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Fixed values: (label, template, key phrases), notices and licence texts in common use, as words.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        ("in compliance with the license", "without warranties or conditions of any kind"),
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "source and binary forms")),
    (
        "bsd-2-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice "
        "this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
        "materials provided with the distribution",
        ("redistributions of source code must retain", "redistributions in binary form must reproduce"),
    ),
    (
        "boost-1.0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
        ("any person or organization obtaining", "use reproduce display distribute execute and transmit"),
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    (
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        ("free software foundation", "merchantability or fitness for a particular purpose"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify", "with or without fee is hereby granted"),
    ),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted", "free of charge")),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use "
        "copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the software",
        ("copy modify merge publish distribute sublicense", "all copies or substantial portions of the software"),
    ),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any "
        "purpose including commercial applications and to alter it and redistribute it freely",
        ("in no event will the authors be held liable", "alter it and redistribute it freely"),
    ),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANCHORS = 2
DIGITS = 6


def _place(words: list[str], phrase: str) -> list[int]:
    part = phrase.split()
    at = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
    return list(range(at, at + len(part)))


Templates = tuple[tuple[str, str, tuple[str, ...]], ...]


def template_words(templates: Templates = TEMPLATES) -> list[tuple[int, str, int, str, bool]]:
    """(template, label, place, word, mandatory) of every template word."""
    out = []
    for t, (label, text, phrases) in enumerate(templates):
        words = text.split()
        keys = {i for p in phrases for i in _place(words, p)}
        if len(keys) < ANCHORS:
            raise ValueError(f"the key phrases of {label} need two words or more")
        out += [(t, label, i, w, i in keys) for i, w in enumerate(words)]
    return out


def words_of(text: Column) -> Column:
    """Words of a text, A-Z folded; a null text has none.

    lower() also folds other letters, which no phrase has; the Kelvin sign, the one other character that it turns
    into an ASCII letter, is put out of the way first.
    """
    folded = F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\u212b")))
    return F.array_remove(F.split(folded, SEPARATORS), "")


def document_frequencies(docs: DataFrame, templates: Templates = TEMPLATES) -> tuple[int, dict[str, int]]:
    """Number of documents, and how many of them hold each template word (one row for each of those words)."""
    vocabulary = sorted({w for _, _, _, w, _ in template_words(templates)} | {w for p, _ in BASE for w in p.split()})
    one = docs.sparkSession.createDataFrame([(vocabulary,)], "vocabulary array<string>")
    some = docs.select(words_of(F.col("text")).alias("words")).join(F.broadcast(one), F.lit(True)).select(F.array_intersect("words", "vocabulary").alias("found"))
    rows = some.select(F.explode(F.concat("found", F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}
    return found.pop("", 0), {w: found.get(w, 0) for w in vocabulary}


POSTING = "struct<t:int,j:int,other:string>"
TEMPLATE = "struct<label:string,base:boolean,needed:array<struct<j:int,w:string>>,words:array<struct<j:int,w:string,v:double>>>"


def index(spark: SparkSession, templates: Templates, n: int, df: dict[str, int]) -> DataFrame:
    """One row with the postings (word -> places in templates, each with the template's other anchor), the words that have postings, rarest first, and the templates.

    Base phrases are templates without a score, with their rarest word as their only anchor.
    """
    idf = {w: math.log((n + 1) / (k + 1)) for w, k in df.items()}
    grouped: dict[int, list[tuple[int, str, bool]]] = {}
    for t, _, i, w, key in template_words(templates):
        grouped.setdefault(t, []).append((i, w, key))
    postings: dict[str, list[tuple[int, int, str | None]]] = {}
    entries = []
    for t, rows in sorted(grouped.items()):
        (i, one, _), (j, two, _) = sorted((x for x in rows if x[2]), key=lambda x: (df[x[1]], x[0]))[:ANCHORS]
        postings.setdefault(one, []).append((t, i, two))
        postings.setdefault(two, []).append((t, j, one))
        whole = sum(idf[w] for _, w, _ in rows)
        entries.append((templates[t][0], False, [(j, w) for j, w, key in rows if key], [(j, w, idf[w] / whole if whole > 0 else 0.0) for j, w, _ in rows]))
    for phrase, label in BASE:
        words = phrase.split()
        at = min((df[w], i) for i, w in enumerate(words))[1]
        postings.setdefault(words[at], []).append((len(entries), at, None))
        entries.append((label, True, list(enumerate(words)), []))
    kinds = f"postings map<string,array<{POSTING}>>, rarest array<string>, templates array<{TEMPLATE}>"
    return spark.createDataFrame([(postings, sorted(postings, key=lambda w: (df[w], w)), entries)], kinds)


def scan(docs: DataFrame, templates: Templates = TEMPLATES) -> DataFrame:
    """``docs`` plus n_words, base_places (starts of base phrases, words from 0), base_labels, method_labels and score.

    Null and empty texts have no words: empty arrays and score 0. Repeated rows give repeated rows;
    columns of ``docs`` with those names are replaced, others pass through. Document frequencies cover
    all documents. An empty table gives no rows. There is no shuffle of texts; what is broadcast is one row, the index,
    whose size is that of the templates.
    """
    n, df = document_frequencies(docs, templates)
    one = index(docs.sparkSession, templates, n, df)
    user = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in user)).alias("row"), words_of(F.col("text")).alias("words")).join(F.broadcast(one), F.lit(True))
    size = F.size("words")
    every = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    # the file's words that have postings, rarest first; a template whose rarer anchor the file lacks is settled by that
    rows = rows.withColumn("found", F.array_intersect("rarest", "words"))
    rows = rows.withColumn("hits", F.when(F.size("found") > 0, F.filter(every, lambda i: F.array_contains("found", F.get("words", i)))).otherwise(F.array().cast("array<int>")))

    def offsets(word: Column) -> Column:
        open_ = F.filter(F.element_at("postings", word), lambda p: p["other"].isNull() | F.array_contains("found", p["other"]))
        places = F.filter("hits", lambda i: F.get("words", i) == word)
        return F.flatten(F.transform(open_, lambda p: F.transform(places, lambda i: F.struct(p["t"].alias("t"), (i - p["j"]).alias("o"), p["j"].alias("j")))))

    rows = rows.withColumn("asked", F.flatten(F.transform("found", offsets)))
    # both anchors of a template agree on an offset: sorted, they are neighbours
    rows = rows.withColumn("sorted", F.array_sort("asked"))
    rows = rows.withColumn("agreed", F.filter("sorted", lambda c, k: _base_at(c["t"]) | ((F.get("sorted", k + 1)["t"] == c["t"]) & (F.get("sorted", k + 1)["o"] == c["o"]))))
    stands = lambda c: F.forall(_template(c["t"])["needed"], lambda x: F.coalesce(F.get("words", c["o"] + x["j"]) == x["w"], F.lit(False)))
    rows = rows.withColumn("matches", F.filter("agreed", lambda c: (c["o"] >= 0) & stands(c)))
    weight = lambda c: F.aggregate(_template(c["t"])["words"], F.lit(0.0), lambda acc, x: acc + F.when(F.get("words", c["o"] + x["j"]) == x["w"], x["v"]).otherwise(0.0))
    of = lambda base: F.filter("matches", lambda c: _base_at(c["t"]) == F.lit(base))
    labels = lambda base: F.array_sort(F.array_distinct(F.transform(of(base), lambda c: _template(c["t"])["label"])))
    best = F.coalesce(F.array_max(F.transform(of(False), weight)), F.lit(0.0))
    added = {
        "n_words": size.cast("long"),
        "base_places": F.array_sort(F.transform(of(True), lambda c: c["o"])),
        "base_labels": labels(True),
        "method_labels": labels(False),
        "score": F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), best)), DIGITS),
    }
    return rows.select(*(F.col(f"row.`{c}`") for c in user if c.lower() not in added), *(v.alias(k) for k, v in added.items()))


def _template(t: Column) -> Column:
    return F.get("templates", t)


def _base_at(t: Column) -> Column:
    return _template(t)["base"]


def licenses_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    Null and empty texts have no words, labels or places, and score 0; repeated rows give repeated rows; an empty table gives none.
    """
    found = scan(docs.select("doc_id", "text"))
    joined = F.array_join(F.array_sort(F.array_union("base_labels", "method_labels")), ",")
    edge = lambda f: f("base_places").cast("long")
    return found.select("doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"), edge(F.array_min).alias("first_word"), edge(F.array_max).alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"), joined.alias("labels"), "score")


def oracle() -> str:
    """The same result in DuckDB SQL: words as rows, anchors by rank, matches by joins."""
    quoted = ", ".join(f"({t}, '{lab}', {i}, '{w}', {str(key).lower()})" for t, lab, i, w, key in template_words())
    phrases = ", ".join(f"({k}, '{lab}', {i}, '{w}', {len(p.split())})" for k, (p, lab) in enumerate(BASE) for i, w in enumerate(p.split()))
    return rf"""
WITH tmpl(t, label, j, w, is_key) AS (VALUES {quoted}),
base(b, label, j, w, size) AS (VALUES {phrases}),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), toks AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM docs
), df AS (
  SELECT v.w, count(DISTINCT doc_id) AS n FROM (SELECT DISTINCT w FROM tmpl) v LEFT JOIN toks USING (w) GROUP BY v.w
), idf AS (
  SELECT w, n, ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (n + 1)) AS v FROM df
), anchors AS (
  SELECT t, j, w, row_number() OVER (PARTITION BY t ORDER BY n, j) AS r FROM tmpl JOIN idf USING (w) WHERE is_key
), cand AS (
  SELECT DISTINCT x.doc_id, a.t, x.p - a.j AS o
  FROM anchors a JOIN toks x ON x.w = a.w AND a.r = 1
  JOIN anchors b ON b.t = a.t AND b.r = 2 JOIN toks y ON y.doc_id = x.doc_id AND y.w = b.w AND y.p = x.p - a.j + b.j
), checked AS (
  SELECT c.doc_id, c.t, c.o, any_value(m.label) AS label, bool_and(NOT m.is_key OR x.p IS NOT NULL) AS ok,
         sum(CASE WHEN x.p IS NOT NULL THEN i.v ELSE 0 END) / nullif(sum(i.v), 0) AS share
  FROM cand c JOIN tmpl m ON m.t = c.t JOIN idf i ON i.w = m.w
  LEFT JOIN toks x ON x.doc_id = c.doc_id AND x.p = c.o + m.j AND x.w = m.w GROUP BY c.doc_id, c.t, c.o
), method AS (
  SELECT doc_id, label, share FROM checked WHERE ok
), places AS (
  SELECT x.doc_id, b.b, any_value(b.label) AS label, x.p - b.j AS s FROM base b JOIN toks x ON x.w = b.w
  GROUP BY x.doc_id, b.b, x.p - b.j HAVING count(*) = any_value(b.size)
), based AS (
  SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id
), labelled AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM method) GROUP BY doc_id
), best AS (
  SELECT doc_id, max(share) AS score FROM method GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(least(1.0, coalesce(score, 0.0)), {DIGITS})::DOUBLE AS score
FROM docs d LEFT JOIN based USING (doc_id) LEFT JOIN labelled USING (doc_id) LEFT JOIN best USING (doc_id)
"""
