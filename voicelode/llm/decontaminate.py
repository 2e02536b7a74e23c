"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items.

A text's words are its runs of letters and digits (ASCII) and of other characters, A to Z lower-cased.  A
window is `size` consecutive words of an item; an item with fewer words, but not none, is one window.  The
patterns of the automaton are the windows as sequences of word numbers, so a document's normalised words are
scanned once, whatever the number of items, and every occurrence is found, overlapping ones too.  Places
are word numbers; they are mapped back to character offsets of the original text.  Words are compared by
64-bit hashes.  Stretches of a document without enough words that any item knows are not walked through.

The items travel to the tasks in blocks of about `BLOCK_WINDOWS` windows.  Usually that is one block and
documents are read once, without a shuffle; a larger benchmark makes several passes, whose few hits are
put together by document.

Defined results: a null or empty text has no words; an item without words has no window; an item without
id takes no part, and rows of items that share an id are one item with the windows of all; a document
without id, or repeated, has a row of its own; an empty table of items leaves all documents clean.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicelode.llm.common import Scratch, SpanHasher, small_batches
from voicelode.llm.pii import PlacedWords
from voicelode.llm.words import ALNUM, Words, lowered

SIZE = 10
#: Windows of an automaton, about; one has at most ten nodes a window.
BLOCK_WINDOWS = 1 << 17


def item_windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """(item, words): the distinct windows of each item as hashes of their words."""

    def cut(batches):
        hasher = SpanHasher()
        for batch in small_batches(batches):
            words = Words(lowered(batch.column("text")), ALNUM, hasher)
            names = batch.column("item").to_pylist()
            item, flat, ends = [], [], []
            for i, (a, b) in enumerate(zip(words.at[:-1].tolist(), words.at[1:].tolist(), strict=True)):
                if b > a:
                    n = min(size, b - a)
                    windows = np.lib.stride_tricks.sliding_window_view(words.hashes[a:b], n)
                    item += [names[i]] * len(windows)
                    flat.append(windows.ravel())
                    ends += [n] * len(windows)
            values = np.concatenate(flat) if flat else np.zeros(0, np.uint64)
            offsets = np.cumsum([0, *ends]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), lists], names=["item", "words"])

    named = items.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    return named.mapInArrow(cut, "item string, words array<long>").distinct()


def _patterns(block: DataFrame) -> tuple:
    """The windows of a block as plain arrays: word hashes, ends of the windows, item numbers, item names."""
    rows = block.toArrow()
    words = rows.column("words").combine_chunks()
    names, number = np.unique(np.array(rows.column("item").to_pylist(), object), return_inverse=True)
    return words.flatten().to_numpy(), words.value_lengths().to_numpy(), number, names.tolist()


def _scanner(patterns: tuple):
    """A function from a text's word hashes to the (first, last) words and items of all occurrences."""
    import ahocorasick

    flat, lengths, number, _ = patterns
    flat = flat.view(np.uint64)
    known = np.unique(flat)
    ids = (np.searchsorted(known, flat) + 1).tolist()  # 0 is any other word
    held: dict[tuple, list[int]] = {}
    at = 0
    for n, item in zip(lengths.tolist(), number.tolist(), strict=True):
        held.setdefault(tuple(ids[at : at + n]), []).append(item)
        at += n
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for window, items in held.items():
        automaton.add_word(window, (len(window), items))
    automaton.make_automaton()
    shortest = int(lengths.min())

    def scan(hashes: np.ndarray):
        place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        word = np.where(known[place] == hashes, place + 1, 0)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], word > 0, [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= shortest:
                for end, (n, items) in automaton.iter(tuple(word[a:b].tolist())):
                    yield a + end - n + 1, a + end, items

    return scan


def merged(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches (first, last) as disjoint ones that do not touch."""
    out: list[list[int]] = []
    for a, b in sorted(places):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


_PLACE = "array<struct<first: long, last: long, start: long, end: long>>"


def _pass(docs: DataFrame, patterns: tuple, all_rows: bool) -> DataFrame:
    """(doc_id, text_key, n_words, places, items) of all documents, or of those with hits."""
    sent = docs.sparkSession.sparkContext.broadcast(patterns)

    def find(batches):
        hasher = SpanHasher()
        scan = _scanner(sent.value) if len(sent.value[1]) else lambda hashes: ()
        names = sent.value[3]
        for batch in small_batches(batches):
            words = PlacedWords(lowered(batch.column("text")), hasher)
            rows, places, items = [], [], []
            for i, (a, b) in enumerate(zip(words.at[:-1].tolist(), words.at[1:].tolist(), strict=True)):
                hits, own = [], set()
                for first, last, which in scan(words.hashes[a:b]):
                    hits.append((first, last))
                    own.update(which)
                if not (hits or all_rows):
                    continue
                rows.append(i)
                found = np.array(merged(hits), np.int64).reshape(-1, 2)
                start, _ = words.places(i, found[:, 0] + a)
                _, end = words.places(i, found[:, 1] + a)
                columns = zip(found[:, 0].tolist(), found[:, 1].tolist(), start.tolist(), end.tolist(), strict=True)
                places.append([dict(zip(("first", "last", "start", "end"), x, strict=True)) for x in columns])
                items.append(sorted(names[k] for k in own))
            take = pa.array(rows, pa.int64())
            kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("first", "last", "start", "end")]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("text_key").take(take)]
                + [pa.array(np.diff(words.at)[rows] if rows else [], pa.int64())]
                + [pa.array(places, kind), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "text_key", "n_words", "places", "items"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(find, f"doc_id {id_type}, text_key long, n_words long, places {_PLACE}, items array<string>")


def _joined(places):
    """Sorted stretches of several passes as disjoint ones."""

    def add(done, p):
        last = F.element_at(done, -1)
        grown = F.struct(
            last["first"].alias("first"), F.greatest(last["last"], p["last"]).alias("last"),
            last["start"].alias("start"), F.greatest(last["end"], p["end"]).alias("end"),
        )
        touches = (F.size(done) > 0) & (p["first"] <= last["last"] + 1)
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(
            F.concat(done, F.array(p))
        )

    return F.aggregate(F.array_sort(places), F.array().cast(_PLACE), add)


def contaminated_places(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, places, items of every document.

    `places` are the disjoint stretches of words that windows of the items cover: first and last word,
    and the characters [start, end) of the original text.  `items` are the sorted ids of the items met.
    """
    scratch = Scratch(docs.sparkSession)
    windows = scratch.table(item_windows(items, size), "windows")
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    block = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
    parts = (_patterns(windows.filter(block == b)) for b in range(blocks))
    if blocks == 1:
        return _pass(docs, next(parts), all_rows=True).drop("text_key")
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), [])
    hits = [scratch.table(_pass(docs, p, all_rows=False), f"hits-{b}") for b, p in enumerate(parts)]
    found = reduce(DataFrame.unionByName, hits).groupBy("doc_id", "text_key").agg(
        F.flatten(F.collect_set("places")).alias("places"), F.flatten(F.collect_set("items")).alias("items")
    )
    found = found.select(
        F.col("doc_id").alias("d"), F.col("text_key").alias("k"),
        _joined(F.col("places")).alias("places"), F.array_sort(F.array_distinct("items")).alias("items"),
    )
    every = _pass(docs, nothing, all_rows=True).select("doc_id", "text_key", "n_words")
    joined = every.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    return joined.select(
        "doc_id", "n_words",
        F.coalesce("places", F.array().cast(_PLACE)).alias("places"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of `docs`, with all their columns, in whose text no window of the items occurs."""
    hit = contaminated_places(docs, items, size).filter(F.size("places") > 0).select("doc_id").distinct()
    hit = Scratch(docs.sparkSession).table(hit, "contaminated").withColumnRenamed("doc_id", "_hit_id")
    return docs.join(hit, docs["doc_id"].eqNullSafe(F.col("_hit_id")), "left_anti")
