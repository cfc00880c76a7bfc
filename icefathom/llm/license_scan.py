"""Licence scan by a positional index of rare licence words, in SQL functions only.

Each licence template is a short notice. The index holds, for every template word that
is rare among the templates (inverse document frequency), its postings: template and
position. A file looks up its rare licence words, each posting proposes the alignment
``file position - template position``, postings that agree on an alignment are
intersected by counting, and an alignment stands if every mandatory phrase of the
template is at its place. All of it happens in expressions over one row: no shuffle, no
key, nothing gathered, so a hot licence costs no more than a rare one.

Defined cases: a null text counts as empty; an empty text has no words, no labels and
score 0. Texts are scanned whole. Repeated rows give repeated results, ties between
templates keep all labels. Other input columns stay; one called like an output is
replaced by it.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icefathom.llm.columns import shield

#: What separates words, after lower-casing.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases and labels of the base scan, fixed values.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Licence notices as their stewards word them, fixed values: label, notice, mandatory phrases.
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    ("lgpl-2.1", "licensed under the GNU Lesser General Public License, version 2.1", ["gnu lesser general public license version 2 1"]),
    ("lgpl-3.0", "licensed under the GNU Lesser General Public License, version 3", ["gnu lesser general public license version 3"]),
    ("agpl-3.0", "licensed under the GNU Affero General Public License, version 3", ["gnu affero general public license version 3"]),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license v 2 0"]),
    ("epl-2.0", "under the terms of the Eclipse Public License 2.0", ["eclipse public license 2 0"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("bsd", "Released under the BSD License", ["bsd license"]),
    ("isc", "Released under the ISC License", ["isc license"]),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ["boost software license version 1 0"]),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", ["cc by nd 4 0"]),
    ("cc0-1.0", "dedicated to the public domain under CC0 1.0", ["cc0 1 0"]),
    ("unlicense", "free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
]


@dataclass(frozen=True)
class Template:
    """A notice's words, their integer weights, and which positions are mandatory."""

    label: str
    words: tuple[str, ...]
    weights: tuple[int, ...]
    mandatory: frozenset[int]
    rare: tuple[int, ...]


def words_of(text: str) -> list[str]:
    """Words of a short text, by the same rule as the columns."""
    return [w for w in re.split(SEPARATOR, text.translate(str.maketrans(UPPER, LOWER))) if w]


def build_templates(notices=NOTICES, rare_per_template: int = 2) -> list[Template]:
    """Weighs words by 1000 * log(1 + templates / templates with the word).

    The ``rare_per_template`` heaviest words of a notice (ties: the earlier), taken from
    its mandatory phrases, are its entries in the index.
    """
    split = [(label, words_of(text), [words_of(p) for p in phrases]) for label, text, phrases in notices]
    spread: dict[str, int] = {}
    for _, ws, _ in split:
        for w in set(ws):
            spread[w] = spread.get(w, 0) + 1
    made = []
    for label, ws, phrases in split:
        weights = [round(1000 * math.log(1 + len(split) / spread[w])) for w in ws]
        must: set[int] = set()
        for phrase in phrases:
            at = next((i for i in range(len(ws)) if ws[i : i + len(phrase)] == phrase), None)
            if at is None or not phrase:
                raise ValueError(f"{label}: the notice lacks its phrase {' '.join(phrase)!r}")
            must.update(range(at, at + len(phrase)))
        rare = sorted(sorted(must), key=lambda i: -weights[i])[:rare_per_template]
        made.append(Template(label, tuple(ws), tuple(weights), frozenset(must), tuple(sorted(rare))))
    return made


def file_words(text: Column) -> Column:
    """The lower-cased words of a text as an array."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, SEPARATOR), "")


def scan(docs: DataFrame, text: str = "text", templates: list[Template] | None = None) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels and score.

    ``score`` is the best share of a template's weight found at a standing alignment, and
    at least 0.5 where a base phrase is found.
    """
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    docs, restore = shield(docs, (text,), names)
    templates = build_templates() if templates is None else templates
    base = [(words_of(phrase), label) for phrase, label in BASE_PHRASES.items()]
    heads = sorted({p[0] if len(p[0]) <= 2 else p[-1] for p, _ in base})
    postings: dict[str, list[tuple[int, int]]] = {}
    for n, t in enumerate(templates):
        for i in t.rare:
            postings.setdefault(t.words[i], []).append((n, i))
    wanted = sorted({*heads, *postings})
    none = F.array().cast("array<struct<i:int,w:string>>")

    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    likely = F.lit(False)
    for w in wanted:  # a substring test is far cheaper than looking at each word
        if not any(o != w and o in w for o in wanted):
            likely = likely | lowered.contains(w)
    words = docs.withColumn("_words", file_words(F.col(text)))

    def lookup(w: Column, i: Column) -> Column:
        return F.when(w.isin(wanted), F.struct(i.alias("i"), w.alias("w")))

    hits = words.withColumn("_hits", F.when(likely, F.array_compact(F.transform("_words", lookup))).otherwise(none))

    def word(at: Column) -> Column:
        return F.get(F.col("_words"), at)

    def stands(start: Column, parts: list[str] | tuple[str, ...], places) -> Column:
        test = F.lit(True)
        for i in places:  # outside the text there is no word, and null is no match
            test = test & F.coalesce(word(start + i) == parts[i], F.lit(False))
        return test

    def share_of(t: Template):
        def share(s: Column) -> Column:
            weight = F.lit(0)
            for i, w in enumerate(t.words):
                weight = weight + F.when(word(s + i) == w, t.weights[i]).otherwise(0)
            return F.struct(F.lit(t.label).alias("label"), (weight / F.lit(float(sum(t.weights)))).alias("share"))

        return share

    # Base phrases: each trigger word proposes the one start its phrase would have.
    starts = []
    for parts, label in base:
        key = 0 if parts[0] in heads else len(parts) - 1
        proposed = F.transform(F.filter("_hits", lambda h: h["w"] == parts[key]), lambda h: h["i"] - key)  # noqa: B023
        true_starts = F.filter(proposed, lambda s: stands(s, parts, range(len(parts))))  # noqa: B023
        starts.append(F.transform(true_starts, lambda s: F.struct(s.alias("at"), F.lit(label).alias("label"))))  # noqa: B023

    # The method: every rare word proposes alignments, and those that all of a template's
    # rare words propose are looked at word by word.
    aligned = []
    for t in templates:
        proposals = [
            F.transform(F.filter("_hits", lambda h: h["w"] == t.words[i]), lambda h: h["i"] - i)  # noqa: B023
            for i in t.rare
        ]
        shared = proposals[0]
        for more in proposals[1:]:
            shared = F.array_intersect(shared, more)
        standing = F.filter(shared, lambda s: stands(s, t.words, sorted(t.mandatory)))  # noqa: B023

        aligned.append(F.transform(standing, share_of(t)))
    no_place = F.array().cast("array<struct<at:int,label:string>>")
    no_match = F.array().cast("array<struct<label:string,share:double>>")
    some = F.size("_hits") > 0
    found = hits.withColumns(
        {
            "_base": F.when(some, F.flatten(F.array(*starts))).otherwise(no_place),
            "_found": F.when(some, F.flatten(F.array(*aligned))).otherwise(no_match),
        }
    )
    both = F.array_union(F.col("_base.label"), F.col("_found.label"))
    best = F.coalesce(F.array_max(F.col("_found.share")), F.lit(0.0))
    result = found.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "n_base": F.size("_base").cast("long"),
            "first_word": F.array_min(F.col("_base.at")).cast("long"),
            "last_word": F.array_max(F.col("_base.at")).cast("long"),
            "base_labels": F.array_join(F.array_sort(F.array_distinct(F.col("_base.label"))), ","),
            "labels": F.array_join(F.array_sort(both), ","),
            "score": F.greatest(best, F.when(F.size("_base") > 0, 0.5).otherwise(0.0)),
        }
    )
    return restore(result.drop("_words", "_hits", "_base", "_found"))
