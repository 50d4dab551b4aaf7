"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a run of consecutive words of a text, a quarter longer than the template it is held
against, wherever its lines end; a shorter text is one block. A block matches a template if it holds at
least ``containment`` of the template's distinct words, or all of them where they are fewer than
``SHORT``. Every block that matches counts, and the best one of each template gives its containment.

Tokens have one global order, rarest in the corpus first; the counts cover all documents, but only
words of templates are counted, so their number is bounded by the templates. In that order, the text
of a matching block must hold one of the first |T| - need + 1 words of the template T (prefix
filter), at least ``need`` of its words (length filter), and after the first shared prefix word
enough words must remain on both sides (positional filter). Of the texts that pass, the places of
template words, and nothing else, are swept once: a word covers the starts of all blocks in which it
stands for the first time, and the largest number of words over one start is the largest overlap of
all blocks. The templates, a few rows given by the caller, are what is broadcast.

Where two templates are alike (one has enough words of the other to match), the one with the larger
containment wins, of equal ones the longer; equal lengths both stay. Besides the templates, fixed
phrases are looked up: places where their words stand consecutively.

Null and empty texts have no words and no labels. Every row is judged by its own text, so ids may be
null, shared or of any type, and repeated rows get equal results. An empty table gives an empty result;
other columns are left alone, whatever their names. Very long texts are whole: what is held of a text
is the places of template words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyfold.llm.frames import alnum_words, ascii_lower, emptied, texts, written

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public notices and license texts, by label.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files to deal in the Software without restriction"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS "
        "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
        "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN "
        "ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of "
        "this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would "
        "be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed "
        "or altered from any source distribution.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or "
        "as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version.",
    ),
    (
        "lgpl",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version.",
    ),
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version.",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
)
CONTAINMENT = 0.85
#: Templates of fewer distinct words must be there whole: a single word tells some of them apart.
SHORT = 18


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", text.lower()) if w]


def template_rules(templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> list[tuple[int, str, list[str], int, int]]:
    """(number, label, distinct words, overlap needed, words of a block) of each template."""
    out = []
    for k, (label, text) in enumerate(templates):
        words = template_words(text)
        distinct = sorted(set(words))
        need = len(distinct) if len(distinct) < SHORT else max(1, math.ceil(containment * len(distinct) - 1e-9))
        out.append((k, label, distinct, need, len(words) + len(words) // 4))
    return out


def alike(rules: list[tuple[int, str, list[str], int, int]]) -> list[tuple[int, int]]:
    """Pairs (t, u) of templates of which one has enough words of the other to match."""
    return [(a[0], b[0]) for a in rules for b in rules if a[0] != b[0] and len(set(a[2]) & set(b[2])) >= min(a[3], b[3])]


def _ranked(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """All template words, rarest in the corpus first; ties by word."""
    found = docs.select(F.explode(F.array_intersect(alnum_words(ascii_lower(F.col("text"))), F.array(*map(F.lit, vocabulary)))).alias("w"))
    counts = {r.w: r.n for r in found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a template word
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split(" ")
    n = F.size(words)
    at = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == w for k, w in enumerate(parts)])
    return F.when(n >= len(parts), F.filter(F.sequence(F.lit(0), n - len(parts)), at)).otherwise(F.array().cast("array<int>"))


def _matches(hits: DataFrame, rules: list, order: dict[str, int]) -> DataFrame:
    """(row, t, containment) of every template that a block of a row matches; hits: (row, hits), the places of template words."""
    spark = hits.sparkSession
    starts, members = [], []
    for t, _, words, need, _ in rules:
        ranks = sorted(order[w] for w in words)
        starts += [(rank, t, at) for at, rank in enumerate(ranks[: len(ranks) - need + 1])]
        members += [(t, rank) for rank in ranks]
    few = lambda rows, schema: F.broadcast(spark.createDataFrame(rows, schema))  # noqa: E731  as many as the templates have words
    sizes = few([(t, len(words), need, block) for t, _, words, need, block in rules], "t int, size int, need int, block int")
    places = hits.select("row", F.explode("hits").alias("p")).select("row", "p.w", "p.i").join(few(list(order.items()), "w string, rank int"), "w")
    have = places.groupBy("row").agg(F.sort_array(F.collect_set("rank")).alias("have"))
    tokens = have.select("row", F.size("have").alias("all"), F.posexplode("have").alias("pos", "rank"))
    left = F.least(F.col("size") - F.col("at"), F.col("all") - F.col("pos"))
    pairs = tokens.join(few(starts, "rank int, t int, at int"), "rank").join(sizes, "t").filter(left >= F.col("need")).select("row", "t").distinct()
    # Sweep over the starts of blocks; what lies before the text's start adds nothing to its first block.
    inside = places.join(pairs, "row").join(few(members, "t int, rank int"), ["t", "rank"]).join(sizes, "t")
    last = F.lag("i").over(Window.partitionBy("row", "t", "rank").orderBy("i"))
    reach = inside.select("row", "t", F.greatest(F.coalesce(last + 1, F.col("i") - F.col("block") + 1), F.col("i") - F.col("block") + 1).alias("lo"), (F.col("i") + 1).alias("hi"))
    steps = reach.select("row", "t", F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("d")), F.struct(F.col("hi").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = steps.groupBy("row", "t", "e.at").agg(F.sum("e.d").alias("d"))
    over = steps.withColumn("over", F.sum("d").over(Window.partitionBy("row", "t").orderBy("at"))).groupBy("row", "t").agg(F.max("over").alias("overlap"))
    return over.join(sizes, "t").filter("overlap >= need").select("row", "t", "size", (F.col("overlap") / F.col("size")).alias("containment"))


def license_scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row a document.

    score: 1 where a phrase stands, else the largest containment of a template; 0 without a match.
    """
    docs = texts(docs, id_col, text_col)
    spark = docs.sparkSession
    rules = template_rules(templates, containment)
    order = {w: k for k, w in enumerate(_ranked(docs, sorted({w for r in rules for w in r[2]})))}
    rare = {w for _, _, words, need, _ in rules for w in sorted(words, key=order.get)[: len(words) - need + 1]}

    words = docs.select("doc_id", alnum_words(ascii_lower(F.col("text"))).alias("ws"))
    none = F.array().cast("array<int>")
    maybe = F.arrays_overlap("ws", F.array(*map(F.lit, sorted({p.split(" ")[-1] for p in phrases}))))
    every = [F.when(maybe, _places(F.col("ws"), p)).otherwise(none) for p in phrases]
    hits = F.filter(F.transform("ws", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(sorted(order)))
    cut = words.select("doc_id", F.size("ws").cast("long").alias("n_words"), *(c.alias(f"p{k}") for k, c in enumerate(every)), F.when(F.exists("ws", lambda w: w.isin(sorted(rare))), hits).alias("hits"))
    rows = written(cut.withColumn("row", F.monotonically_increasing_id()))  # written, and fixed thereby

    found = written(_matches(rows.filter("hits is not null").select("row", "hits"), rules, order))
    rivals = spark.createDataFrame(alike(rules) or [(-1, -1)], "t int, u int")
    better = found.select("row", F.col("t").alias("u"), F.struct("containment", "size").alias("theirs"))
    beaten = found.join(F.broadcast(rivals), "t").join(better, ["row", "u"]).filter(F.col("theirs") > F.struct("containment", "size")).select("row", "t").distinct()
    label = F.element_at(F.create_map(*(F.lit(x) for t, name, *_ in rules for x in (t, name))), F.col("t"))
    own = written(found.join(beaten, ["row", "t"], "left_anti").groupBy("row").agg(F.collect_set(label).alias("own"), F.max("containment").alias("best")))
    emptied(found)

    places = [F.col(f"p{k}") for k in range(len(every))]
    both = F.flatten(F.array(*places))
    base = F.array_distinct(F.array_compact(F.array(*(F.when(F.size(c) > 0, F.lit(name)) for c, name in zip(places, phrases.values(), strict=True)))))
    text_of = lambda c: F.array_join(F.sort_array(c), ",")
    return rows.join(own, "row", "left").select(
        "doc_id", "n_words", F.size(both).cast("long").alias("n_base"), F.array_min(both).cast("long").alias("first_word"), F.array_max(both).cast("long").alias("last_word"),
        text_of(base).alias("base_labels"), text_of(F.array_union(base, F.coalesce("own", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size(both) > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
