"""Licence scans: passages compared with licence templates by Dice coefficient over word bigrams.

A passage is a line, a paragraph (lines between blank ones) or the whole text.  Where none of these matches a template, every run of adjacent words
is a passage, so a licence of several paragraphs, or a notice within a long line, is found in any surroundings.  Text is normalised to words of
lower-case letters and digits.  With bags of bigrams A and B, Dice is twice the size of their intersection over the sum of their sizes, so at a
threshold t only sizes with ``|A| >= |B| * t / (2 - t)``, and the other way round, can match, and as many bigrams of B at least must be
in A.  Texts meet only the templates of which they hold enough different bigrams, which spares nearly all texts the rest.

The best run is exact.  It begins and ends with a bigram of the template.  From a given start a bigram adds to the intersection unless the
template's number of it has been seen since, that is if the occurrence that many before it lies before the start.

Everything is made of DataFrame functions.  Templates are a fixed list; nothing is shuffled but the matches.

Results: one row per document and template that matches, with the best coefficient and the number of distinct passages that match.  Runs count only
where no line, paragraph or whole text matches, and then as one passage, the best one.  Null and empty
texts, and documents without a match, give none; a null id is a group of its own; repeated rows give the same row once.
"""

from __future__ import annotations

import re
from collections import Counter
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Fixed texts: short notices, and the opening or whole of common licences.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit-notice": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "all-rights-reserved": "All rights reserved.",
}


def words(passage: Column) -> Column:
    return F.array_remove(F.split(F.lower(passage), "[^a-z0-9]+"), "")


def bigrams(passage_words: Column) -> Column:
    """The bigrams in order; none for fewer than two words."""
    first = F.slice(passage_words, F.lit(1), F.greatest(F.size(passage_words) - 1, F.lit(0)))
    return F.transform(first, lambda w, n: F.concat_ws(" ", w, F.element_at(passage_words, n + 2)))


def made_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column by a generator.  The optimizer would copy a plain one into filters and lambdas, to be computed for each element anew."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def template_rows(templates: dict[str, str], threshold: float) -> list[tuple]:
    """Per template: name, number of bigrams, fewest and most bigrams that match it, different bigrams that a match holds at least, bigrams, how often each."""
    out = []
    for name, text in templates.items():
        found = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
        counts = Counter(f"{a} {b}" for a, b in zip(found, found[1:], strict=False))
        size = counts.total()
        if not size:
            continue
        # The bounds of runs are a little loose, as quotients are rounded.
        low, high = max(1, ceil(size * threshold / (2 - threshold) - 1e-9)), floor(size * (2 - threshold) / threshold + 1e-9)
        least, held = 0, 0
        for n in sorted(counts.values(), reverse=True):
            if held < low:
                least, held = least + 1, held + n
        out.append((name, size, low, high, least, list(counts), list(counts.values())))
    return out


TEMPLATE_SCHEMA = "template string, _size int, _low int, _high int, _least int, _plain array<string>, _times array<int>"


def marked(hits: Column) -> Column:
    """Each hit with ``back``, the place of the occurrence that uses up the template's number of its bigram, or -1."""

    def mark(hit: Column, n: Column) -> Column:
        same = F.filter(F.slice(hits, F.greatest(n + 1 - F.col("_high"), F.lit(1)), F.least(n, F.col("_high"))), lambda x: x["gram"] == hit["gram"])
        before = F.get(same, F.size(same) - F.element_at(F.col("_times"), hit["gram"]))
        return F.struct(hit["at"].alias("at"), F.coalesce(before["at"], F.lit(-1)).alias("back"))

    return F.transform(hits, mark)


def best_run(hits: Column, starts: Column) -> Column:
    """``dice, begin, end`` of the best run of bigrams from one of the starts, each with its place among the hits."""

    def best_from(start: Column) -> Column:
        ahead = F.slice(hits, start["n"] + 1, F.col("_high"))
        adding = F.filter(ahead, lambda x: (x["at"] - start["at"] < F.col("_high")) & (x["back"] < start["at"]))
        dice = lambda x, k: 2.0 * (k + 1) / (x["at"] - start["at"] + 1 + F.col("_size"))
        return F.array_max(F.transform(adding, lambda x, k: F.struct(dice(x, k).alias("dice"), start["at"].alias("begin"), x["at"].alias("end"))))

    return F.array_max(F.transform(starts, best_from))


def matches(
    rows: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: dict[str, str] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """``doc_id, template, passage, dice, run`` of every line, paragraph and whole text that reaches the threshold, and of the best run of words that does."""
    fixed = template_rows(templates or TEMPLATES, threshold)
    table = rows.sparkSession.createDataFrame(fixed, TEMPLATE_SCHEMA)
    every = F.array(*[F.lit(g) for g in dict.fromkeys(g for row in fixed for g in row[5])]).cast("array<string>")
    given = rows.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text")).where(F.col("_text").isNotNull())
    worded = made_once(given, "_all", words(F.col("_text")))
    told = made_once(worded, "_present", F.array_intersect(bigrams(F.col("_all")), every)).drop("_all")
    # Templates are a fixed list, so this side is a few rows.
    met = told.join(F.broadcast(table), F.size(F.array_intersect("_present", "_plain")) >= F.col("_least")).drop("_present")

    whole = F.col("_text")
    passages = F.array_distinct(F.concat(F.split(whole, "\n"), F.split(whole, r"\n[ \t\r]*\n"), F.array(whole)))
    asked = F.concat(F.transform(passages, lambda p: F.struct(p.alias("passage"), F.lit(False).alias("run"))), F.array(F.struct(whole.alias("passage"), F.lit(True).alias("run"))))
    found = met.select("*", F.inline(asked)).drop("_text")
    cut = made_once(found, "_words", words(F.col("passage"))).withColumn("_grams", F.size("_words") - 1)
    low, high = F.ceil(F.col("_size") * threshold / (2 - threshold)), F.floor(F.col("_size") * (2 - threshold) / threshold)
    cut = cut.where(F.col("run") | F.col("_grams").between(low, high))
    held = made_once(cut, "_pairs", bigrams(F.col("_words")))
    places = F.transform("_pairs", lambda g, n: F.struct(n.alias("at"), F.array_position("_plain", g).cast("int").alias("gram")))
    held = made_once(held, "_hits", F.filter(places, lambda x: x["gram"] > 0)).drop("_pairs")
    # An upper bound first: how many bigrams occur in the template at all, in the passage or within reach of a start.
    reach = lambda h, n: F.get("_hits", n + F.col("_low") - 1)["at"] - h["at"] < F.col("_high")
    ordered = F.transform("_hits", lambda h, n: F.struct(h["at"].alias("at"), n.alias("n")))
    held = made_once(held, "_starts", F.when(F.col("run"), F.filter(ordered, lambda s: reach(s, s["n"]))))
    enough = threshold / 2 * (F.col("_grams") + F.col("_size")) - 1e-9
    near = held.where(F.when(F.col("run"), F.size("_starts") > 0).otherwise(F.size("_hits") >= enough))
    near = made_once(near, "_marked", marked(F.col("_hits"))).drop("_hits")
    common = F.size(F.filter("_marked", lambda x: x["back"] < 0))
    given_run = F.struct((2.0 * common / (F.col("_grams") + F.col("_size"))).alias("dice"), F.lit(0).alias("begin"), (F.col("_grams") - 1).alias("end"))
    scored = made_once(near, "_best", F.when(F.col("run"), best_run(F.col("_marked"), F.col("_starts"))).otherwise(given_run))
    scored = scored.where(F.col("_best.dice") >= threshold)
    run_text = F.array_join(F.slice("_words", F.col("_best.begin") + 1, F.col("_best.end") - F.col("_best.begin") + 2), " ")
    passage = F.when(F.col("run"), run_text).otherwise(F.col("passage"))
    return scored.select(F.col("_id").alias(doc_id), "template", passage.alias("passage"), F.col("_best.dice").alias("dice"), "run")


def licenses(rows: DataFrame, text: str = "text", doc_id: str = "doc_id", **settings) -> DataFrame:
    """``doc_id, template, dice, passages``: the templates that each document holds."""
    found = matches(rows, text, doc_id, **settings).groupBy(doc_id, "template")
    given = lambda c: F.when(~F.col("run"), F.col(c))
    return found.agg(F.coalesce(F.max(given("dice")), F.max("dice")).alias("dice"), F.greatest(F.countDistinct(given("passage")), F.lit(1)).alias("passages"))
