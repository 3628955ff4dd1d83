"""Licence scan with a positional index of rare words, in Spark SQL functions only.

Templates are sequences of words with mandatory key phrases.  The words' document
frequencies over the whole corpus give their IDF; the index, an array of
templates, holds for each template its rarest mandatory words and their positions
(postings).  Each file that holds a key phrase takes the licence words that it
has, those of the highest IDF of every template that they can make up are looked
up: every place of such a word gives the place where the template would begin,
and the postings of a template are intersected by that relative position.  Where
they agree, the mandatory phrases are verified word by word, and the share of all
template words in place is the score.

Texts are brought to words with one blank between them, in which a phrase is a
plain substring; only texts with a key phrase are split.  Each text is scanned in
its own row, so nothing is shuffled but the counts of the templates' words, whose
number the templates bound.

Defined results: null and empty texts have 0 words and no label; long texts are
read whole; ties of IDF go to the smaller word; rows repeat as they come; other
columns pass through whatever their names, but those named like added ones are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.llm.common import ascii_lower, fresh

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words: all of ASCII but letters and digits.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """Words of a licence notice; keys: phrases in it that must stand at their places; base: asked for by contract."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def key_places(self) -> list[int]:
        """Positions of the words of the key phrases (of all words, if there are none)."""
        words, places = self.words, set()
        for key in self.keys or (self.text,):
            part = key.split()
            at = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
            places.update(range(at, at + len(part)))
        return sorted(places)


BASE = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
)
#: Opening words of widely used licences and notices (public texts).
NOTICES = (
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("mit", "released under the mit license", ("under the mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify", "with or without fee"),
    ),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ("free and unencumbered software", "public domain"),
    ),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ("cc by nc sa 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc0-1.0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
)
TEMPLATES = BASE + NOTICES


def array(items) -> str:
    return f"array({', '.join(items)})"


def spaced(text: Column) -> Column:
    """The words of a text, a blank before and behind each."""
    return F.concat(F.lit(" "), F.regexp_replace(F.coalesce(text, F.lit("")), GAP, " "), F.lit(" "))


def holds(column: str, phrase: str) -> str:
    """SQL: whether the words of `phrase` stand one behind the other; most texts fail the first test, which is the faster one."""
    return f"(contains({column}, '{phrase} ') and contains({column}, ' {phrase} '))"


def document_frequencies(texts: DataFrame, templates: tuple[Template, ...]) -> dict[str, int]:
    """How many texts (column `low`, spaced and in lower case) hold each word of the key phrases; at most a row for each such word reaches the driver."""
    vocabulary = sorted({t.words[i] for t in templates for i in t.key_places()})
    held = texts.select(F.explode(F.expr(f"filter({array(f"'{w}'" for w in vocabulary)}, w -> contains(low, concat(w, ' ')) and contains(low, concat(' ', w, ' ')))")).alias("w"))
    counts = {r.w: r.n for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: counts.get(w, 0) for w in vocabulary}


def postings(template: Template, frequencies: dict[str, int], depth: int) -> list[tuple[str, int]]:
    """The template's `depth` rarest mandatory words, each at one place."""
    words, places = template.words, template.key_places()
    once = {w: i for i in reversed(places) for w in [words[i]]}  # the first place of each word
    return [(w, once[w]) for w in sorted(once, key=lambda w: (frequencies[w], w))[:depth]]


def indexed(templates: tuple[Template, ...], frequencies: dict[str, int], depth: int) -> str:
    """SQL: the index as an array of structs, so that one expression serves any number of templates."""

    def placed(pairs) -> str:
        return array(f"named_struct('w', '{w}', 'p', {p})" for w, p in pairs)

    return array(
        f"named_struct('label', '{t.label}', 'base', {str(t.base).lower()}, 'rare', {placed(postings(t, frequencies, depth))}, "
        f"'keys', {placed((t.words[p], p) for p in t.key_places())}, 'words', {placed((w, p) for p, w in enumerate(t.words))})"
        for t in templates
    )


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, depth: int = 2, text_col: str = "text") -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and places to every row.

    places: array of (label, start, base) of all verified templates.
    depth: how many rare words of a template must agree on where it begins.
    """
    added = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places")
    docs = docs.drop(*added)
    frequencies = document_frequencies(docs.select(F.lower(spaced(F.col(text_col))).alias("low")), templates)
    index = indexed(templates, frequencies, depth)
    rare = ", ".join(sorted({f"'{w}'" for t in templates for w, _ in postings(t, frequencies, depth)}))
    low, words, hits = (fresh(n, docs.columns) for n in ("low", "words", "hits"))

    plain = docs.withColumn(low, spaced(F.col(text_col)))
    blanks = F.octet_length(F.trim(low)) - F.octet_length(F.replace(F.trim(low), F.lit(" "), F.lit("")))
    counted = plain.withColumn("n_words", F.when(F.trim(low) == "", F.lit(0)).otherwise(blanks + 1).cast("long")).withColumn(low, F.lower(low))
    # a file without a key phrase of any template needs no look at its words
    likely = " or ".join(sorted(" and ".join(holds(low, key) for key in t.keys or (t.text,)) for t in templates))
    split = F.split(F.trim(spaced(ascii_lower(F.col(text_col)))), " ")
    scanned = counted.withColumn(words, F.when(F.expr(likely), split)).drop(low)
    scanned = scanned.withColumn(hits, F.expr(f"filter(transform({words}, (w, i) -> named_struct('w', w, 'i', i)), x -> x.w in ({rare}))"))
    starts = f"transform(filter({hits}, x -> x.w = r.w), x -> x.i - r.p)"
    agreed = f"aggregate(t.rare, cast(null as array<int>), (acc, r) -> if(acc is null, {starts}, array_intersect(acc, {starts})))"
    fits = f"s >= 0 and forall(t.keys, k -> get({words}, s + k.p) <=> k.w)"
    share = f"cast(size(filter(t.words, k -> get({words}, s + k.p) <=> k.w)) as double) / size(t.words)"
    found = f"transform(filter({agreed}, s -> {fits}), s -> named_struct('label', t.label, 'start', cast(s as bigint), 'base', t.base, 'share', {share}))"
    able = f"filter({index}, t -> forall(t.rare, r -> exists({hits}, x -> x.w = r.w)))"
    empty = "cast(array() as array<struct<label:string,start:bigint,base:boolean,share:double>>)"
    placed = scanned.withColumn("places", F.expr(f"if({words} is null, {empty}, flatten(transform({able}, t -> {found})))"))
    base = "filter(places, p -> p.base)"
    return placed.select(
        "*",
        F.expr(f"cast(size({base}) as long)").alias("n_base"),
        F.expr(f"array_min(transform({base}, p -> p.start))").alias("first_word"),
        F.expr(f"array_max(transform({base}, p -> p.start))").alias("last_word"),
        F.expr(f"array_join(array_sort(array_distinct(transform({base}, p -> p.label))), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(transform(places, p -> p.label))), ',')").alias("labels"),
        F.expr("coalesce(array_max(transform(places, p -> p.share)), 0D)").alias("score"),
    ).drop(words, hits)
