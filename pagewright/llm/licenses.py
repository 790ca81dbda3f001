"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A template matches where a window of a document, twice as many words long as the
template, holds at least ``THRESHOLD`` of the template's distinct words.  Windows
begin at every word, so no match depends on where in its text it stands.  The
join is exact and needs no shuffle of texts:

* Order.  One aggregate over all documents counts the templates' words; each
  template's words are sorted from the globally rarest to the commonest.
* Prefix.  A window that holds c of a template's n words holds two of its n-c+2
  rarest ones (one of n-c+1 for templates with a single required word).  Only
  documents with these words are looked at.
* Position.  With its first rare word given, a window begins after the rare word
  before, and not so early that the nearest other rare word falls behind its end;
  of the windows left, those that begin at a word of the template hold all that
  the others hold.  Where no other rare word is near, there is no window.
* Length.  Windows cut short by the end of the text to fewer than c words go.
* What is left is verified by counting the template's words in the window.

Templates are a parameter: they are few and go into the plan as constants, as do
their word counts; nothing that grows with the documents does.

A null text counts as empty and has no words.  Documents without a label get
empty strings, score 0 and null places.  Very long texts are scanned whole.
Rows are worked on one by one, so repeated rows repeat in the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.frames import aside, known, restored
from pagewright.plans.once import with_once

THRESHOLD = 0.8
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases that name a license, and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

#: Wordings by which works state their license, and their labels.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("all-rights-reserved", "all rights reserved"),
]


def words_of(text: str) -> Column:
    """The words of a text, with A to Z in lower case."""
    plain = known(text)
    # Two other characters have a lower case that is, or begins with, an ASCII letter.
    odd = plain.contains("İ") | plain.contains("K")
    lower = F.when(odd, F.translate(plain, _UPPER, _LOWER)).otherwise(F.lower(plain))
    return F.regexp_extract_all(lower, F.lit(WORDS), F.lit(0))


@dataclass(frozen=True)
class Template:
    label: str
    length: int
    words: tuple[str, ...]  # distinct, globally rarest first
    needed: int

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.words[: len(self.words) - self.needed + min(2, self.needed)]


def ordered_templates(
    docs: DataFrame, text: str, templates: list[tuple[str, str]], threshold: float
) -> list[Template]:
    """Templates with their words in the order of the words' counts in all documents."""
    split = [(label, wording.split()) for label, wording in templates]
    vocabulary = sorted({w for _, words in split for w in words})
    found = docs.select(F.explode(words_of(text)).alias("word")).where(F.col("word").isin(vocabulary))
    counts = {r["word"]: r["count"] for r in found.groupBy("word").count().collect()}
    result = []
    for label, words in split:
        distinct = sorted(set(words), key=lambda w: (counts.get(w, 0), w))
        needed = math.ceil(threshold * len(distinct) - 1e-9)
        result.append(Template(label, len(words), tuple(distinct), needed))
    return result


def _constants(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _places(phrase: str) -> Column:
    """Where the words of ``phrase`` stand one after another."""
    wanted = phrase.split()
    last = F.size("words") - len(wanted)

    def here(i: Column) -> Column:
        same = F.lit(True)
        for k, word in enumerate(wanted):
            same = same & (F.get("words", i + k) == word)
        return same

    there = F.arrays_overlap("words", _constants([max(wanted, key=len)]))
    found = F.filter(F.sequence(F.lit(0), last), here)
    return F.when(there & (last >= 0), found).otherwise(F.array().cast("array<int>"))


def _rare_words(template: Template) -> Column:
    return F.filter("hits", lambda h: h["word"].isin(list(template.prefix)))


def _containment(template: Template, number: int) -> Column:
    """The largest share of the template's words in a window, 0 below what is needed."""
    reach, needed, total = 2 * template.length, template.needed, len(template.words)
    hits = F.get("rare", F.lit(number))  # a column, so that lambdas do not make it again
    last = F.size(hits) - 1

    def spans(h: Column, i: Column) -> Column:
        """From where to where windows begin whose first rare word is ``h``."""
        other = lambda j: (F.get(hits, j)["word"] != h["word"]) & (F.get(hits, j)["at"] < h["at"] + reach)
        following = F.when(i < last, F.filter(F.sequence(i + 1, F.least(i + reach, last)), other))
        second = F.get(hits, F.get(following, F.lit(0)))["at"] if needed > 1 else h["at"]
        before = F.when(i > 0, F.get(hits, i - 1)["at"]).otherwise(F.lit(-1))
        return F.struct(second.alias("second"), before.alias("before"), h["at"].alias("high"))

    def starts(span: Column) -> Column:
        low = F.greatest(span["second"] - reach + 1, span["before"] + 1)
        begins = lambda b: F.get("words", b).isin(list(template.words)) & (F.size("words") - b >= needed)
        return F.filter(F.sequence(low, span["high"]), begins)

    def overlap(b: Column) -> Column:
        places = F.sequence(b, F.least(b + reach, F.size("words")) - 1)
        return F.size(F.array_intersect(F.transform(places, lambda i: F.get("words", i)), _constants(template.words)))

    open_ = F.filter(
        F.transform(hits, spans),
        lambda s: s["second"].isNotNull() & (s["second"] - reach < s["high"]),
    )
    most = F.coalesce(F.array_max(F.transform(F.flatten(F.transform(open_, starts)), overlap)), F.lit(0))
    return F.when(last + 1 < min(2, needed), F.lit(0.0)).otherwise(
        F.when(most >= needed, most / F.lit(float(total))).otherwise(F.lit(0.0))
    )


def license_scan(
    docs: DataFrame,
    text: str = "text",
    phrases: dict[str, str] = PHRASES,
    templates: list[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score.

    n_base counts all places of the phrases, first_word and last_word are the
    smallest and largest of them, counted in words from 0.  score is 1 where a
    phrase stands, else the largest share of a template found.
    """
    chosen = ordered_templates(docs, text, templates, threshold)
    rare = sorted({w for t in chosen for w in t.prefix})

    rows = with_once(aside(docs, words=words_of(text)), "words", F.col("words"))
    hits = F.filter(
        F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))),
        lambda h: h["word"].isin(rare),
    )
    none = F.array().cast("array<struct<word:string,at:int>>")
    rows = with_once(rows, "hits", F.when(F.arrays_overlap("words", _constants(rare)), hits).otherwise(none))
    names = list(phrases)
    rows = with_once(rows, "places", F.array(*[_places(p) for p in names]))
    rows = with_once(rows, "rare", F.array(*[_rare_words(t) for t in chosen]))
    rows = with_once(rows, "shares", F.array(*[_containment(t, i) for i, t in enumerate(chosen)]))
    every = F.flatten("places")
    base = F.array_compact(
        F.array(*[F.when(F.size(F.get("places", F.lit(i))) > 0, F.lit(phrases[p])) for i, p in enumerate(names)])
    )
    similar = F.array_compact(
        F.array(*[F.when(F.get("shares", F.lit(i)) > 0, F.lit(t.label)) for i, t in enumerate(chosen)])
    )
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return restored(
        rows,
        docs.columns,
        {
            "n_words": F.size("words").cast("long"),
            "n_base": F.size(every).cast("long"),
            "first_word": F.array_min(every).cast("long"),
            "last_word": F.array_max(every).cast("long"),
            "base_labels": joined(base),
            "labels": joined(F.concat(base, similar)),
            "score": F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.array_max("shares")),
        },
    )


def license_scan_sql(
    phrases: dict[str, str] = PHRASES,
    templates: list[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> str:
    """The same by counting in every window that begins at a template's word, in DuckDB's SQL."""
    base, terms = [], []
    for phrase in phrases:
        wanted = phrase.split()
        same = " AND ".join(f"words[i + {k + 1}] = '{w}'" for k, w in enumerate(wanted))
        base.append(f"list_filter(range(0, len(words) - {len(wanted) - 1}), lambda i: {same})")
    for t, (label, wording) in enumerate(templates):
        words = wording.split()
        distinct = sorted(set(words))
        needed = math.ceil(threshold * len(distinct) - 1e-9)
        terms += [f"({t}, '{label}', {2 * len(words)}, {len(distinct)}, {needed}, '{w}')" for w in distinct]
    labelled = ", ".join(
        f"CASE WHEN len(places[{i + 1}]) > 0 THEN '{label}' END" for i, label in enumerate(phrases.values())
    )
    join = "coalesce(array_to_string(list_sort(list_distinct(list_filter({0}, lambda x: x IS NOT NULL))), ','), '')"
    return f"""
    WITH split AS MATERIALIZED (
        SELECT row_number() OVER () AS line, doc_id,
               regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORDS}') AS words
        FROM documents
    ), found AS MATERIALIZED (
        SELECT line, doc_id, len(words) AS n_words, [{", ".join(base)}] AS places FROM split
    ), terms(t, label, reach, total, needed, word) AS (VALUES {", ".join(terms)}
    ), placed AS (
        SELECT line, unnest(words) AS word, unnest(range(0, len(words))) AS place FROM split
    ), windows AS (
        SELECT line, label, total, needed,
               count(DISTINCT word) OVER (PARTITION BY line, t ORDER BY place
                                          RANGE BETWEEN CURRENT ROW AND (reach - 1) FOLLOWING) AS n
        FROM placed JOIN terms USING (word)
    ), matched AS (
        SELECT line, list(label) AS labels, max(n / total::DOUBLE) AS share
        FROM windows WHERE n >= needed GROUP BY line
    )
    SELECT doc_id, n_words, len(flatten(places)) AS n_base,
           list_min(flatten(places)) AS first_word, list_max(flatten(places)) AS last_word,
           {join.format("[" + labelled + "]")} AS base_labels,
           {join.format("list_concat([" + labelled + "], coalesce(labels, []))")} AS labels,
           CASE WHEN len(flatten(places)) > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
    FROM found LEFT JOIN matched USING (line)
    """
