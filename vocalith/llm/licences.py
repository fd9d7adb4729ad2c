"""Licence scans by Dice coefficient over word bigrams, on DataFrame operations alone.

A text's units are its lines, its paragraphs (between blank lines) and itself as a whole. A
unit and a template are normalised to lower-case words of letters and digits and stand for
their sets of word bigrams; the unit bears the licence if twice the common bigrams are at
least `THRESHOLD` of all. Sizes prune first: sets of a and b bigrams can reach t only if
t / (2 - t) <= a / b <= (2 - t) / t, so a unit is compared with the few templates of about
its size, and one too short for all of them is never cut into bigrams. Of a template's n
bigrams such a set has at least t / (2 - t), so it has one of any n - need + 1 of them: the
anchors, those of the longest words. A text without any template's anchor, which nearly all
are, is normalised, searched with one pattern, and done.

Licences that no unit bears are then looked for in windows: all runs, anywhere in the text, of
as many words as the template has. One that shares words with a unit at least as like some
licence doesn't count, so a notice of one isn't taken for a worse copy of another. Bounds
prune these too, and lose none: `need` of the template's bigrams lie within a window's length,
and of `STRIDE` windows in a row one tells how good the others can be.

All of it is one projection over the scan, without a shuffle, so hot sources or copies don't
matter.

Defined cases: a null text counts as empty; units of fewer than two words have no bigrams and
match nothing. A licence found by windows alone counts as one match, that of the highest
coefficient. A document with several licences reports all by name, and as its own the one
of the highest coefficient, ties going to the first by name. Repeated rows count each. An
empty table gives an empty result. Only id and text are read, so other columns can't clash.

Templates are the notices below and the whole texts in `license_texts`. The AGPL's text is
not among them; it differs from the GPL's in a section and is reported as that.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

THRESHOLD = 0.8
#: Of the windows of a text so many in a row are looked at by one of them first.
STRIDE = 16
_MATCHES = "array<struct<dice:double,name:string>>"

# The wording of common licences and of the notices that stand for them.
NOTICES: dict[str, list[str]] = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU Affero General Public License v3.0"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD": ["Released under the BSD License.", "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


#: The licence that a whole text is reported as, where the file's name isn't it.
FAMILY = {"BSD-2-Clause": "BSD", "BSD-3-Clause": "BSD"}


def _templates() -> dict[str, list[str]]:
    out = {name: list(texts) for name, texts in NOTICES.items()}
    for file in sorted(resources.files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            name = file.name.removesuffix(".txt")
            out.setdefault(FAMILY.get(name, name), []).append(file.read_text(encoding="utf-8"))
    return dict(sorted(out.items()))


TEMPLATES = _templates()


def _words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


@functools.lru_cache(256)
def bigrams(text: str) -> frozenset[str]:
    words = _words(text)
    return frozenset(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))


def _literal(grams: list[str]) -> Column:
    """An array of bigrams: one literal, split when the plan is made."""
    return F.split(F.lit("|".join(grams)), r"\|")


def _bounds(threshold: float) -> tuple[float, float]:
    """Between what the ratio of two sets' sizes lies if they reach the threshold, with room for rounding."""
    return threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9


def _rated(unit: Column, templates: list[tuple[str, list[str]]], threshold: float) -> Column:
    """The matches of a unit (an array of words): coefficient and name."""
    sizes = [len(grams) for _, grams in templates]
    low, high = _bounds(threshold)
    known = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(len(grams)).alias("n"), _literal(grams).alias("grams")) for name, grams in templates])
    pairs = F.array_distinct(F.zip_with(F.slice(unit, 1, F.size(unit) - 1), F.slice(unit, 2, F.size(unit)), lambda a, b: F.concat(a, F.lit(" "), b)))

    def against(grams: Column) -> Column:
        n = F.size(grams)
        near = F.filter(known, lambda t: (n >= t["n"] * low) & (n <= t["n"] * high))
        rated = F.transform(near, lambda t: F.struct((F.size(F.array_intersect(grams, t["grams"])) * 2.0 / (n + t["n"])).alias("dice"), t["name"].alias("name")))
        return F.filter(rated, lambda r: r["dice"] >= threshold)

    # a one-element array binds the bigrams, so they are made once
    rated = F.flatten(F.transform(F.array(pairs), against))
    # repeated bigrams may shorten a long unit, but never lengthen a short one
    return F.when(F.size(unit) - 1 >= min(sizes) * low, rated)


def _need(n: int, threshold: float) -> int:
    """The least number of a template's n bigrams in any set that reaches the threshold."""
    return max(1, math.ceil(n * _bounds(threshold)[0]))


def anchors(grams: list[str], threshold: float = THRESHOLD) -> list[str]:
    """Bigrams of a template of which any set that reaches the threshold has one; of long words, since those are rare."""
    return sorted(grams, key=lambda g: (-min(map(len, g.split())), -len(g), g))[: len(grams) - _need(len(grams), threshold) + 1]


def _any_of(grams: set[str]) -> str:
    """A pattern that finds any of the bigrams in words between single spaces, branching by character."""
    tree: dict = {}
    for gram in sorted(grams):
        at = tree
        for c in gram:
            at = at.setdefault(c, {})
        at[" "] = {}

    def pattern(node: dict) -> str:
        # only a bigram's end has an empty node: its closing space
        branches = [re.escape(c) + (pattern(below) if below else "") for c, below in node.items()]
        return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"

    return " " + pattern(tree)


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of a value that is made once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _places(words: Column, rated: Column) -> Column:
    """from, to (places of words) and the coefficient of units that bear a licence. Lines, paragraphs and the whole each make up all words."""
    size = lambda u: F.when(F.get(u, F.lit(0)) == "", 0).otherwise(F.size(u))
    first = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<from:int,to:int,dice:double>>").alias("places"))

    def step(acc: Column, x: Column) -> Column:
        n, at = size(x["words"]), acc["n"] % F.greatest(size(F.element_at(words, -1)), F.lit(1))
        place = F.struct(at.alias("from"), (at + n).alias("to"), F.array_max(F.transform(x["rated"], lambda m: m["dice"])).alias("dice"))
        return F.struct((acc["n"] + n).alias("n"), F.when(F.size(x["rated"]) > 0, F.concat(acc["places"], F.array(place))).otherwise(acc["places"]).alias("places"))

    return F.aggregate(F.zip_with(words, rated, lambda w, r: F.struct(w.alias("words"), r.alias("rated"))), first, step)["places"]


def _windows(words: Column, rated: Column, templates: list[tuple[str, list[str], int]], threshold: float) -> Column:
    """The best match of each licence that no unit bears among the windows of a text.

    words, rated: of each unit, the last being the whole text. templates: name, bigrams, number of words.
    """
    every = sorted({g for _, grams, _ in templates for g in grams})
    # templates are data: one expression serves all of them
    known = F.array(*[F.struct(F.lit(name).alias("name"), _literal(grams).alias("grams"), F.lit(len(grams)).alias("size"), F.lit(n - 1).alias("span"), F.lit(_need(len(grams), threshold)).alias("need")) for name, grams, n in templates])

    def within(pairs: Column, spots: Column, grams: Column) -> Column:
        """Those spots whose bigram is one of grams; which bigrams are is found by hash first."""
        return _bound(F.array_intersect(F.transform(spots, lambda i: F.get(pairs, i)), grams), lambda known: F.filter(spots, lambda i: F.array_contains(known, F.get(pairs, i))))

    def starts(need: Column, span: Column, at: Column, n: Column) -> Column:
        """at: places of the template's bigrams. Where windows with enough of them start, from 0."""
        close = F.filter(F.sequence(F.lit(1), F.size(at) - need + 1), lambda j: F.element_at(at, j + need - 1) - F.element_at(at, j) < span)
        runs = F.transform(close, lambda j: F.sequence(F.greatest(F.element_at(at, j + need - 1) - span + 1, F.lit(0)), F.least(F.element_at(at, j), n - span)))
        # a text no longer than a window is a unit
        return F.when((F.size(at) >= need) & (n > span), F.array_distinct(F.flatten(runs))).otherwise(F.array().cast("array<int>"))

    def best(t: Column, names: Column, pairs: Column, spots: Column, places: Column) -> Column:
        def rate(start: Column) -> Column:
            some = F.array_distinct(F.slice(pairs, start + 1, t["span"]))
            rated = lambda both, n: F.struct((both * 2.0 / (n + t["size"])).alias("dice"), start.alias("start"), both.alias("both"), n.alias("n"))
            return _bound(some, lambda some: rated(F.size(F.array_intersect(some, t["grams"])), F.size(some)))

        def highest(windows: Column) -> Column:
            free = F.filter(windows, lambda x: (x["dice"] >= threshold) & ~F.exists(places, lambda p: (p["from"] <= x["start"] + t["span"]) & (p["to"] > x["start"]) & (p["dice"] >= x["dice"])))
            return F.array_max(F.transform(free, lambda x: x["dice"]))

        def refined(coarse: Column, last: Column) -> Column:
            """The best of all windows, of which every STRIDE-th is rated: one d words on has at most d more common bigrams, and d fewer of its own."""
            both = lambda x: F.least(x["both"] + (STRIDE - 1), t["size"])
            may = lambda x: both(x) * 2.0 / (F.greatest(x["n"] - (STRIDE - 1), both(x)) + t["size"])
            near = lambda least: F.filter(coarse, lambda x: may(x) >= least - 1e-9)
            each = lambda x: F.sequence(x["start"], F.least(x["start"] + (STRIDE - 1), last))
            return _bound(F.coalesce(highest(coarse), F.lit(threshold)), lambda least: highest(F.transform(F.flatten(F.transform(near(least), each)), rate)))

        def search(at: Column) -> Column:
            n = F.size(pairs)
            strides = F.array_distinct(F.transform(starts(t["need"], t["span"], at, n), lambda s: F.floor(s / STRIDE).cast("int")))
            dice = _bound(F.transform(strides, lambda k: rate(k * STRIDE)), lambda coarse: refined(coarse, n - t["span"]))
            return _bound(dice, lambda dice: F.when(dice.isNotNull(), F.struct(dice.alias("dice"), t["name"].alias("name"))))

        possible = ~F.array_contains(names, t["name"]) & (F.size(spots) >= t["need"]) & (F.size(pairs) > t["span"])
        return F.when(possible, _bound(within(pairs, spots, t["grams"]), search))

    def search(pairs: Column) -> Column:
        spots = within(pairs, F.sequence(F.lit(0), F.size(pairs) - 1), _literal(every))
        names = F.transform(F.flatten(rated), lambda m: m["name"])
        each = lambda spots, places: F.transform(known, lambda t: best(t, names, pairs, spots, places))
        found = _bound(spots, lambda spots: _bound(_places(words, rated), lambda places: F.filter(each(spots, places), lambda m: m.isNotNull())))
        return _bound(found, lambda m: F.array_distinct(F.filter(m, lambda x: ~F.exists(m, lambda y: (y["name"] == x["name"]) & (y["dice"] > x["dice"])))))

    whole = F.element_at(words, -1)
    pairs = F.zip_with(F.slice(whole, 1, F.size(whole) - 1), F.slice(whole, 2, F.size(whole)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(whole) > 1, _bound(pairs, search)).otherwise(F.array().cast(_MATCHES))


def _normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_matches (units with a template that they match, and licences of windows alone), license, dice, licenses."""
    sized = [(name, sorted(grams), len(_words(t))) for name, texts in (templates or TEMPLATES).items() for t in texts if (grams := bigrams(t))]
    flat = [(name, grams) for name, grams, _ in sized]
    text = F.coalesce(F.col(text_col), F.lit(""))
    nothing = F.array().cast(_MATCHES)

    def matched(text: Column) -> Column:
        lines, paragraphs = F.split(text, "\n"), F.split(text, r"\n[\x20\t\r]*\n")
        units = F.concat(lines, F.when(F.size(paragraphs) > 1, paragraphs).otherwise(F.array().cast("array<string>")), F.when(F.size(lines) > 1, F.array(text)).otherwise(F.array().cast("array<string>")))
        words = F.transform(units, lambda u: F.split(_normalised(u), " "))
        of_units = lambda words: F.transform(words, lambda u: F.coalesce(_rated(u, flat, threshold), nothing))
        return _bound(words, lambda words: _bound(of_units(words), lambda rated: F.concat(F.flatten(rated), _windows(words, rated, sized, threshold))))

    # each unit's and window's bigrams are some of the whole text's
    pattern = _any_of({a for _, grams in flat for a in anchors(grams, threshold)})
    some = F.rlike(F.concat(F.lit(" "), _normalised(text), F.lit(" ")), F.lit(pattern))
    matches = F.when(some, matched(text)).otherwise(nothing)

    def summary(m: Column) -> Column:
        best = F.array_max(F.transform(m, lambda x: x["dice"]))
        names = F.array_sort(F.array_distinct(F.transform(m, lambda x: x["name"])))
        first = F.array_min(F.transform(F.filter(m, lambda x: x["dice"] == best), lambda x: x["name"]))
        return F.struct(F.size(m).cast("long").alias("n_matches"), first.alias("license"), best.alias("dice"), F.array_join(names, ",").alias("licenses"))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.inline(F.transform(F.array(matches), summary)))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def sql(templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> str:
    """The same rows in DuckDB's SQL, but for licences that only windows find: it has the units alone."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(name)}, [{', '.join(map(quote, sorted(bigrams(t))))}])" for name, texts in (templates or TEMPLATES).items() for t in texts)
    low, high = _bounds(threshold)
    return rf"""
WITH t(name, grams) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT r, string_split(text, chr(10)) AS lines, regexp_split_to_array(text, '\n[\x20\t\r]*\n') AS paragraphs, text FROM d),
u AS (SELECT r, unnest(lines || CASE WHEN len(paragraphs) > 1 THEN paragraphs ELSE [] END || CASE WHEN len(lines) > 1 THEN [text] ELSE [] END) AS unit FROM p),
w AS (SELECT r, string_split(trim(regexp_replace(lower(unit), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS words FROM u),
g AS (SELECT r, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams FROM w WHERE len(words) > 1),
m AS (
  SELECT r, name, len(list_intersect(g.grams, t.grams)) * 2.0::DOUBLE / (len(g.grams) + len(t.grams)) AS dice
  FROM g JOIN t ON len(g.grams) BETWEEN len(t.grams) * {low!r}::DOUBLE AND len(t.grams) * {high!r}::DOUBLE
),
b AS (
  SELECT r, count(*) AS n, max(dice) AS dice, arg_min(name, (-dice, name)) AS license, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses
  FROM m WHERE dice >= {threshold!r}::DOUBLE GROUP BY r
)
SELECT d.doc_id, coalesce(b.n, 0) AS n_matches, b.license, b.dice, coalesce(b.licenses, '') AS licenses FROM d LEFT JOIN b USING (r)
"""
