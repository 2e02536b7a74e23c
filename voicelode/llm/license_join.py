"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame operations.

A template is a paragraph of a license text.  A text block is any run of as many consecutive words as the template
has, and a tenth more; line breaks mean nothing.  A block meets a template when it holds at least `THRESHOLD` of the
template's different words, and a text gets the template's label when any of its blocks does.

Words of all templates are ordered by the number of documents that hold them.  Of a template, the rarest
|T| - need + 1 words are its prefix: a block that meets it holds one of them.  Texts with such a word are cut into
stretches that overlap by the longest block, so that every block lies whole in one of them.  A stretch joins the
templates by equality on its prefix words; those with too few template words, and those whose places in both ordered
sets leave too few, are left out, and of several common prefix words only the rarest counts.  In what remains, every
block that starts at a word of the template is measured (any other one holds no more than the next that does).  The
filters only save work: the result does not depend on the word counts.

Besides, four fixed phrases are counted wherever their words follow each other.

Defined results: a null text counts as empty; a row's number, not its id, keeps rows apart, so null and
repeated ids and equal rows are scanned each; an empty table gives an empty result.  A text of any length is read as
a whole.  Templates are a table of (label, text) of at most `MOST_WORDS` different words, whose paragraphs of fewer than
`SHORTEST` words are titles and no templates; null labels and texts are left out.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelode.llm.common import Scratch

#: Phrases and their labels: fixed values.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Share of a template's different words that a block must hold.
THRESHOLD = 0.9
#: Words of the shortest paragraph that is a template.
SHORTEST = 4
#: Different words of all templates together: they are literals of the plan.
MOST_WORDS = 1 << 14
#: Labels and texts, fixed values: usual notices, and public license texts with a blank line between paragraphs.
TEMPLATES = [
    ("mit-notice", "released under the mit license"),
    ("apache-notice", "licensed under the apache license version 2 0"),
    ("gpl-notice", "licensed under the gnu general public license"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    (
        "mit-text",
        """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
    ),
    (
        "bsd-text",
        """
Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
""",
    ),
    (
        "isc-text",
        """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
""",
    ),
    (
        "apache-notice",
        """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.
""",
    ),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(lowered: Column) -> Column:
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def paragraphs(templates: list[tuple[str | None, str | None]]) -> list[tuple[str, list[str], int]]:
    """(label, different words in alphabetical order, words of a block) of every paragraph that is a template."""
    out = []
    for label, text in templates:
        for part in re.split(r"\n[ \t]*\n", text or "") if label is not None else ():
            words = [w for w in re.split(_BETWEEN, part.translate(str.maketrans(_UPPER, _LOWER))) if w]
            if len(words) >= SHORTEST:
                out.append((label, sorted(set(words)), len(words) + len(words) // 10))
    return out


def need(size: int) -> int:
    """Shared words that a template of `size` words asks for."""
    return math.ceil(THRESHOLD * size - 1e-9)


def _literal(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


def _places(padded: Column, phrase: str) -> tuple[Column, Column, Column]:
    """How often a phrase stands in the text, and the first and the last word number (null if nowhere).

    `padded` has every word between two spaces of its own, so neighbouring places share none.
    """
    mark = "".join(f" {w} " for w in phrase.split(" "))
    n = ((F.length(padded) - F.length(F.replace(padded, F.lit(mark), F.lit("")))) / len(mark)).cast("long")

    def words_before(length: Column) -> Column:
        before = F.left(padded, length)
        inner = F.length(before) - F.length(F.replace(before, F.lit("  "), F.lit("")))
        return F.when(length > 0, (inner / 2).cast("long") + 1).otherwise(F.lit(0).cast("long"))

    first = F.instr(padded, mark) - 1
    last = F.length(padded) - F.length(F.substring_index(padded, mark, -1)) - len(mark)
    return n, F.when(n > 0, words_before(first)), F.when(n > 0, words_before(last))


def document_counts(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each word of the vocabulary occurs; one row a word."""
    own = words.select(F.explode(F.array_intersect("words", _literal(vocabulary))).alias("word"))
    return {r[0]: r[1] for r in own.groupBy("word").count().collect()}


def scan(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    `templates` has the columns label and text; without it, `TEMPLATES` are used.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    given = TEMPLATES if templates is None else [(r[0], r[1]) for r in templates.select("label", "text").toLocalIterator()]
    blocks_of = paragraphs(given)
    vocabulary = sorted({w for _, words, _ in blocks_of for w in words})
    if len(vocabulary) > MOST_WORDS:
        raise ValueError(f"the templates have {len(vocabulary)} different words, at most {MOST_WORDS} are allowed")

    lowered = docs.select("doc_id", F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER).alias("low"))
    rows = lowered.select("doc_id", "low", words_of(F.col("low")).alias("words"))
    counts = document_counts(rows, vocabulary)
    vocabulary.sort(key=lambda w: (counts.get(w, 0), w))
    place = {w: i for i, w in enumerate(vocabulary)}
    prefixes = []  # (word, label, its place in the template, words needed, words of a block, words of the template)
    for label, words, length in blocks_of:
        ordered = sorted(words, key=place.get)
        least = need(len(words))
        prefixes += [(w, label, i, least, length, ordered) for i, w in enumerate(ordered[: len(words) - least + 1])]
    rare = _literal(sorted({p[0] for p in prefixes}, key=place.get))

    # what a text must hold for any phrase
    likely = F.contains(F.col("low"), F.lit("license")) | (F.contains(F.col("low"), F.lit("cc")) & F.contains(F.col("low"), F.lit("by")))
    some = F.arrays_overlap("words", rare)
    padded = F.when(likely, F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))).otherwise(F.lit(""))
    found = rows.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        padded.alias("padded"),
        F.when(some, F.col("words")).alias("words"),
    )
    each = {label: _places(F.col("padded"), phrase) for phrase, label in PHRASES.items()}
    base = F.filter(
        F.array(*(F.when(each[label][0] > 0, F.lit(label)) for label in sorted(each))), lambda x: x.isNotNull()
    )
    found = found.select(
        "row",
        "doc_id",
        "n_words",
        sum((n for n, _, _ in each.values()), F.lit(0).cast("long")).alias("n_base"),
        F.least(*(first for _, first, _ in each.values())).alias("first_word"),
        F.greatest(*(last for _, _, last in each.values())).alias("last_word"),
        base.alias("base"),
        "words",
    )
    found = scratch.table(found, "found")

    index = spark.createDataFrame(
        prefixes, "word string, label string, i int, need int, block int, template array<string>"
    )
    longest = max((length for _, _, length in blocks_of), default=1)
    step = 4 * longest
    stretch = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("words") - 1) / step).cast("int")),
        lambda k: F.slice("words", k * step + 1, step + longest - 1),
    )
    stretches = found.filter("words is not null").select("row", F.explode(stretch).alias("stretch"))
    # in the order of the vocabulary, which array_intersect keeps
    stretches = stretches.withColumn("own", F.array_intersect(_literal(vocabulary), F.col("stretch")))
    fewest = min((p[3] for p in prefixes), default=1)
    common = F.array_intersect("own", "template")
    starts = F.filter(
        F.sequence(F.lit(1), F.least(F.size("stretch"), F.lit(step))),
        lambda at: F.array_contains("template", F.element_at("stretch", at)),
    )
    shared = F.array_max(
        F.transform(starts, lambda at: F.size(F.array_intersect("template", F.slice("stretch", at, F.col("block")))))
    )
    matched = (
        stretches.filter(F.size("own") >= fewest)
        .select("row", "stretch", "own", F.explode(F.array_intersect("own", rare)).alias("word"))
        .join(index, "word")
        .filter(F.size("own") >= F.col("need"))
        .filter(F.least(F.size("template") - F.col("i"), F.size("own") - F.array_position("own", F.col("word")) + 1) >= F.col("need"))
        .filter((F.size(common) >= F.col("need")) & (F.element_at(common, 1) == F.col("word")))
        .select("row", "label", "need", F.size("template").alias("size"), shared.alias("shared"))
        .filter("shared >= need")
        .groupBy("row")
        .agg(F.collect_set("label").alias("more"), F.max(F.col("shared") / F.col("size")).alias("contained"))
    )
    join = lambda labels: F.array_join(F.array_sort(labels), ",")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return found.join(matched, "row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        join(F.col("base")).alias("base_labels"),
        join(F.array_union("base", more)).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("contained", F.lit(0.0))).alias("score"),
    )
