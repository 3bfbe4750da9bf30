"""Licence scans by the Dice coefficient over word bigrams, in DataFrame operations alone.

A text is normalised to words (letters A-Z in lower case, punctuation and line
breaks dropped).  Of every licence template a window of its size slides over the
whole text, and window and template are compared as bags of word bigrams: twice
the common bigrams over the sum of both sizes.  So a notice counts wherever it
stands: alone, inside a paragraph, or wrapped over lines.

Size bounds prune before anything is compared.  A similarity of `least` leaves
room for only so many missing bigrams; a few long words of each template touch
more of them than that, so a text without any of those words has no such window,
and only texts with one are split into words.  A template needs a text of
fitting size with enough of its bigrams in it; only then are windows formed, and
only where they start with one of them.  Bigrams meet the templates, a bounded
table, before anything is shuffled.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.prefix_join import _LOWER, _UPPER, WORD, words_of
from tidemark.llm.tables import bounded
from tidemark.sources.staging import stage

LEAST = 0.8

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."

# Notices by which licences are declared, and bodies of short licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", _CONDITIONS),
    ("BSD-3-Clause", _CONDITIONS + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _AS_IS),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
)


def needed_words(text: str, least: float) -> list[str]:
    """Words of a template, longest first, one of which every window that reaches `least` has.

    A window of the template's size, or a shorter one at the end of a text,
    lacks at most a share (2 - 2 * least) / (2 - least) of its bigrams; the words
    taken touch more of them than that.
    """
    words = re.findall(WORD, text.translate(str.maketrans(_UPPER, _LOWER)))
    pairs = list(zip(words, words[1:]))
    lacking = math.floor(len(pairs) * (2 - 2 * least) / (2 - least) + 1e-9)
    taken: list[str] = []
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        if sum(a in taken or b in taken for a, b in pairs) > lacking:
            break
        taken.append(word)
    return taken


def _bigrams(array: str) -> str:
    return f"transform(sequence(1, size({array}) - 1), i -> concat({array}[i - 1], ' ', {array}[i]))"


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row per input row: id, licence (the most alike, null if none reaches `least`), dice, start (its window's first word, from 0), n_found (windows that reach it).

    Ties go to the larger template, then to the smaller start, then to the first
    template.  Null and empty texts, and texts of one word, match nothing;
    repeated rows and null ids get a row each; an empty table gives none; other
    columns are not read; texts are never cut.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(templates)], "template int, licence string, text string").withColumn("w", words_of(F.col("text"))).where(F.size("w") > 1)
    bags = known.select("template", "licence", (F.size("w") - 1).alias("m"), F.explode(F.expr(_bigrams("w"))).alias("bigram")).groupBy("template", "licence", "m", "bigram").agg(F.count(F.lit(1)).alias("k"))
    bags = bounded(bags, "licence-bigrams")

    lower = F.translate(F.col("text"), _UPPER, _LOWER)
    words = sorted({w for _, text in templates for w in needed_words(text, least)})
    may = reduce(lambda a, b: a | b, [lower.contains(w) for w in words], F.lit(False))
    text = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = stage(text.select("row", "id", F.when(may, words_of(F.col("text"))).alias("w")), "licence-words")

    placed = held.where(F.size("w") > 1).select("row", (F.size("w") - 1).alias("size"), F.posexplode(F.expr(_bigrams("w"))).alias("at", "bigram"))
    hits = placed.join(F.broadcast(bags), "bigram").where(F.col("size") >= least / (2 - least) * F.col("m"))
    # The k-th earlier place of a hit's bigram: the hit counts in windows that start after it, for the template has the bigram k times.
    by_bigram = F.array_sort(F.collect_list("at"))
    earlier = F.expr("transform(places, (p, i) -> named_struct('at', p, 'before', if(i >= k, places[cast(i - k as int)], -1)))")
    hits = hits.groupBy("row", "size", "template", "licence", "m", "bigram", "k").agg(by_bigram.alias("places")).withColumn("hits", earlier)
    hits = hits.groupBy("row", "size", "template", "licence", "m").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    hits = hits.where(F.size("hits") >= least / (2 - least) * F.col("m"))
    common = "size(filter(slice(hits, i + 1, m), x -> x.at < h.at + m AND x.before < h.at))"
    windows = hits.withColumn("windows", F.expr(f"filter(transform(hits, (h, i) -> named_struct('dice', 2 * {common} / (least(m, size - h.at) + m), 'at', h.at)), x -> x.dice >= {least}D)"))
    found = windows.where(F.size("windows") > 0).select("row", "m", "template", "licence", F.size("windows").alias("n"), F.expr("array_min(transform(windows, x -> named_struct('d', -x.dice, 'at', x.at)))").alias("b"))
    best = found.groupBy(F.col("row").alias("_row")).agg(F.min(F.struct(F.col("b.d").alias("d"), (-F.col("m")).alias("m"), F.col("b.at").alias("at"), "template", "licence")).alias("b"), F.sum("n").alias("n_found"))
    return held.join(best, F.col("row") == F.col("_row"), "left").select(F.col("id").alias(id_col), F.col("b.licence").alias("licence"), (-F.col("b.d")).alias("dice"), F.col("b.at").cast("bigint").alias("start"), F.coalesce("n_found", F.lit(0)).alias("n_found"))


def licence_sql() -> str:
    """The same in DuckDB's dialect, over `documents`, without the pruning by words."""
    def words(text: str) -> str:
        return f"regexp_extract_all(translate({text}, '{_UPPER}', '{_LOWER}'), '{WORD}')"

    rows = ",\n".join("({}, '{}', '{}')".format(k, n, t.replace("'", "''")) for k, (n, t) in enumerate(TEMPLATES))
    pairs = "unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram"
    return f"""
WITH known AS (SELECT template, licence, {words("text")} AS w FROM (VALUES {rows}) AS t(template, licence, text)),
tb AS (SELECT template, licence, len(w) - 1 AS m, bigram, count(*) AS k FROM (SELECT *, {pairs} FROM known) GROUP BY ALL),
db AS (SELECT doc_id, len(w) - 1 AS size, unnest(range(0, len(w) - 1)) AS spot, {pairs} FROM (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents) WHERE len(w) > 1),
hits AS (SELECT * FROM db JOIN tb USING (bigram) QUALIFY count(*) OVER (PARTITION BY doc_id, template) >= {LEAST} / (2 - {LEAST}) * m),
seen AS (SELECT s.doc_id, s.template, s.licence, s.m, s.size, s.spot, p.bigram, p.k, count(*) AS n FROM hits s JOIN hits p ON p.doc_id = s.doc_id AND p.template = s.template AND p.spot >= s.spot AND p.spot < s.spot + s.m GROUP BY ALL),
alike AS (SELECT doc_id, template, licence, m, spot, 2 * CAST(sum(least(n, k)) AS BIGINT) / (least(m, size - spot) + m) AS dice FROM seen GROUP BY doc_id, template, licence, m, size, spot),
good AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, m DESC, spot, template) AS r, count(*) OVER (PARTITION BY doc_id) AS n_found FROM alike WHERE dice >= {LEAST})
SELECT d.doc_id, licence, dice, CAST(spot AS BIGINT) AS start, CAST(coalesce(n_found, 0) AS BIGINT) AS n_found FROM documents d LEFT JOIN (SELECT * FROM good WHERE r = 1) USING (doc_id)"""
