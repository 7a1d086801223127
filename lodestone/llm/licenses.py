"""Operator 11: licence scan with a positional index of rare words. DataFrame operations only.

Licence notices are templates of words. One scan over the texts notes where licence words stand (all template words of
two characters and more that aren't common ones), and from these the places of the base phrases and of the templates'
mandatory key phrases; what it writes is a small row per document. Document frequencies of the licence words come from
these rows, over all documents. Of each template the LOOKUPS licence words of highest inverse document frequency that
the document has are looked up; each of their places puts the template at one start. The postings of all its words are
intersected there by relative position: a template stands where half or more of its licence words are in place and all
its key phrases are complete at their own places. It then adds its label.

Nothing is sent to all executors but the templates, a fixed number of rows. Counts are added up per document, template
and start before they are shuffled.

score is 1 for a document with a base phrase, else the largest share of licence words in place among the templates that
stand (0 for none). Null and empty texts have no words and no places; null ids and rows that share an id are judged row
by row; texts of any length are read whole; no rows give no rows. Other columns are not read by `scan`, whatever their
names. A-Z are lower-cased, other letters don't matter: a word that has them is no licence word (the Kelvin sign, which
Unicode lower-cases to k, is kept apart).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._common import Workspace, table

LOOKUPS = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
COMMON = {"a", "an", "and", "any", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "under", "with", "you"}
#: Phrase -> label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, words of the notice, its mandatory key phrases.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge", "obtaining a copy of this software"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["modify and or distribute this software"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license", "free software foundation"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["gnu affero general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international license"]),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ["cc0 1 0 universal"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]


def _indexed(words: list[str]) -> list[tuple[int, str]]:
    return [(i, w) for i, w in enumerate(words) if len(w) > 1 and w not in COMMON]


def _phrases(templates: list) -> dict[str, int]:
    """Base phrases and key phrases, numbered."""
    return {p: i for i, p in enumerate(dict.fromkeys([*BASE, *(k for _, _, keys in templates for k in keys)]))}


def _anchor(phrase: str) -> tuple[int, str]:
    """The longest licence word of a phrase, and where it stands in it."""
    return max(_indexed(phrase.split()), key=lambda x: (len(x[1]), -x[0]))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138"))), F.lit(WORD), F.lit(0))


def scanned(docs: DataFrame, templates: list = TEMPLATES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n_words, hits (pos, word: the licence words), places (of each phrase, the starts)."""
    known = sorted({w for _, t, _ in templates for _, w in _indexed(t.split())} | {_anchor(p)[1] for p in _phrases(templates)})
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words(F.col(text_col).cast("string")).alias("w"))
    marked = rows.select("row", "doc_id", "w", F.filter(F.transform("w", lambda w, i: F.when(w.isin(known), F.struct(i.alias("pos"), w.alias("word")))), lambda x: x.isNotNull()).alias("hits"))

    def starts(phrase: str) -> Column:
        at, word = _anchor(phrase)
        others = [(i - at, w) for i, w in enumerate(phrase.split()) if i != at]
        stands = lambda h: _all([F.coalesce(F.get("w", h["pos"] + k) == w, F.lit(False)) for k, w in others])
        return F.transform(F.filter("hits", lambda h: (h["word"] == word) & stands(h)), lambda h: h["pos"] - at)

    return marked.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), "hits", F.when(F.size("hits") > 0, F.array(*(starts(p) for p in _phrases(templates)))).alias("places"))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def postings(spark: SparkSession, templates: list = TEMPLATES) -> DataFrame:
    """template, at, word: a fixed number of rows."""
    rows = [F.struct(F.lit(k).alias("template"), F.lit(i).alias("at"), F.lit(w).alias("word")) for k, (_, text, _) in enumerate(templates) for i, w in _indexed(text.split())]
    return spark.range(1).select(F.inline(F.array(*rows)))


def alignments(found: DataFrame, templates: list = TEMPLATES) -> DataFrame:
    """row, template, start, matched: where half or more of a template's licence words are in place, one of those looked up among them."""
    spark = found.sparkSession
    seen = found.filter(F.size("hits") > 0)
    index = postings(spark, templates)
    df = seen.select(F.explode(F.array_distinct("hits.word")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    per = index.select("template", "word").distinct().join(F.broadcast(df), "word")  # both bounded by the templates' words
    ranks = F.broadcast(per.groupBy("template").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("ranks")))
    # a template's words by document frequency; of those that the document has, the first are looked up
    of_doc = seen.select("row", F.posexplode(F.array_distinct("hits.word")).alias("_", "word")).join(F.broadcast(index.select("template", "word").distinct()), "word")
    present = of_doc.groupBy("row", "template").agg(F.collect_set("word").alias("present")).join(ranks, "template")
    chosen = present.select("row", "template", F.slice(F.filter("ranks", lambda r: F.array_contains("present", r["word"])), 1, LOOKUPS)["word"].alias("chosen"))
    pairs = seen.select("row", F.inline("hits")).join(F.broadcast(index), "word").select("row", "template", (F.col("pos") - F.col("at")).alias("start"), "word")
    met = pairs.groupBy("row", "template", "start").agg(F.count("*").alias("matched"), F.collect_set("word").alias("in_place"))
    least = F.element_at(F.array(*(F.lit(len(_indexed(t.split()))) for _, t, _ in templates)), F.col("template") + 1)
    return met.filter(2 * F.col("matched") >= least).join(chosen, ["row", "template"]).filter(F.arrays_overlap("in_place", "chosen")).select("row", "template", "start", "matched", least.alias("of"))


def _keys_of(templates: list) -> Column:
    """Per template: its key phrases as (phrase number, place in the template)."""
    numbers, out = _phrases(templates), []
    for _, text, keys in templates:
        at = [len(text[: re.search(rf"(?<!\S){re.escape(k)}(?!\S)", text).start()].split()) for k in keys]
        out.append(F.array(*(F.struct(F.lit(numbers[k]).alias("phrase"), F.lit(a).alias("at")) for k, a in zip(keys, at, strict=True))))
    return F.array(*out)


def scan(docs: DataFrame, templates: list = TEMPLATES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, found (label, start, matched, of: the templates that stand)."""
    ws = Workspace(docs.sparkSession, "licenses")
    found = ws.keep("found", scanned(docs, templates, id_col=id_col, text_col=text_col))
    near = alignments(found, templates).join(found.select("row", "places"), "row")
    keys = F.element_at(_keys_of(templates), F.col("template") + 1)
    stand = near.filter(F.forall(keys, lambda k: F.array_contains(F.get("places", k["phrase"]), F.col("start") + k["at"])))
    label = F.element_at(F.array(*(F.lit(name) for name, _, _ in templates)), F.col("template") + 1)
    share = F.col("matched").cast("double") / F.col("of")
    per = stand.groupBy("row").agg(F.max(share).alias("share"), F.collect_set(label).alias("more"), F.array_sort(F.collect_list(F.struct("start", label.alias("label"), "matched", "of"))).alias("found"))
    base = F.slice("places", 1, len(BASE))
    every = F.flatten(base)
    own = F.array_compact(F.array(*(F.when(F.size(F.get("places", F.lit(i))) > 0, name) for i, name in enumerate(BASE.values()))))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    none = F.array().cast("array<string>")
    out = found.join(per, "row", "left").select(
        F.col("doc_id").alias(id_col), "n_words", F.coalesce(F.size(every), F.lit(0)).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        joined(F.coalesce(own, none)).alias("base_labels"), joined(F.concat(F.coalesce(own, none), F.coalesce("more", none))).alias("labels"), F.when(F.size(every) > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"), "found",
    )
    return out


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("found")


def _sql() -> str:
    """The same rules over single words, with the templates as values."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    idx = ", ".join(f"({k}, {i}, {quote(w)})" for k, (_, t, _) in enumerate(TEMPLATES) for i, w in _indexed(t.split()))
    names = ", ".join(f"({k}, {quote(n)}, {len(_indexed(t.split()))})" for k, (n, t, _) in enumerate(TEMPLATES))
    keys = ", ".join(f"({k}, {len(t[: re.search(rf'(?<!\S){re.escape(p)}(?!\S)', t).start()].split())}, {quote(p)})" for k, (_, t, ps) in enumerate(TEMPLATES) for p in ps)
    base = ", ".join(f"({quote(p)}, {quote(n)})" for p, n in BASE.items())
    return rf"""
WITH idx(template, place, word) AS (VALUES {idx}), names(template, label, total) AS (VALUES {names}), keys(template, place, phrase) AS (VALUES {keys}), base(phrase, label) AS (VALUES {base}),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
x AS MATERIALIZED (SELECT row, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
phrases AS (SELECT DISTINCT phrase, string_split(phrase, ' ') AS p FROM (SELECT phrase FROM base UNION SELECT phrase FROM keys)),
places AS (SELECT x.row, x.pos, phrase FROM x JOIN phrases ON x.word = p[1] JOIN d ON d.row = x.row WHERE array_to_string(d.w[x.pos + 1:x.pos + len(p)], ' ') = phrase),
hits AS (SELECT x.* FROM x WHERE word IN (SELECT word FROM idx)),
df AS (SELECT word, count(DISTINCT row) AS df FROM hits GROUP BY word),
of_doc AS (SELECT DISTINCT row, template, word FROM hits JOIN idx USING (word)),
chosen AS (SELECT row, template, word FROM of_doc JOIN df USING (word) QUALIFY row_number() OVER (PARTITION BY row, template ORDER BY df, word) <= {LOOKUPS}),
met AS (SELECT row, template, pos - place AS start, count(*) AS matched FROM hits JOIN idx USING (word) GROUP BY ALL),
near AS (SELECT m.*, label, total FROM met m JOIN names USING (template) WHERE 2 * matched >= total
         AND EXISTS (SELECT 1 FROM hits h JOIN idx i USING (word) JOIN chosen c USING (row, template, word) WHERE h.row = m.row AND i.template = m.template AND h.pos - i.place = m.start)),
stand AS (SELECT n.* FROM near n WHERE NOT EXISTS (SELECT 1 FROM keys k WHERE k.template = n.template AND NOT EXISTS (SELECT 1 FROM places p WHERE p.row = n.row AND p.phrase = k.phrase AND p.pos = n.start + k.place))),
b AS (SELECT row, count(*) AS n, min(pos) AS lo, max(pos) AS hi FROM places JOIN base USING (phrase) GROUP BY row),
own AS (SELECT DISTINCT row, label FROM places JOIN base USING (phrase)),
every AS (SELECT row, label FROM own UNION SELECT row, label FROM stand),
own_list AS (SELECT row, string_agg(label, ',' ORDER BY label) AS l FROM own GROUP BY row),
all_list AS (SELECT row, string_agg(label, ',' ORDER BY label) AS l FROM every GROUP BY row),
best AS (SELECT row, max(matched::DOUBLE / total) AS s FROM stand GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word, coalesce(o.l, '') AS base_labels, coalesce(a.l, '') AS labels,
       CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best.s, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (row) LEFT JOIN own_list o USING (row) LEFT JOIN all_list a USING (row) LEFT JOIN best USING (row)
"""


ORACLE_SQL = {"op11_licenses": _sql()}
