"""Periodic runs of words, found by string synchronising sets.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and length of
at least max(6, 4 q) that no neighbouring word extends with that period.  Periods are looked for at dyadic
scales t = 1, 2, 4, ...; scale t finds those with t <= q < 2 t.

At a scale every window of t words has a hash.  Position i is in the synchronising set if the smallest hash
of the windows i .. i + t stands at i or at i + t; so it depends on the 2 t words from i on only, and every
t neighbouring positions hold one, except inside regions of a period of at most t / 4.  Windows inside such
regions are left out: the regions are runs that the scales below have found already, so small periods come
from there, and the set stays sparse.  In a run of period q, position i of the set and i + q have equal
contexts of 2 t words, and no position between them has (the period would be smaller): two neighbours among
the positions of the set with equal contexts propose their distance.  A proposal is extended word by word to
both sides, once for each stretch.

All texts of a slice are worked on together, between separators that are equal to nothing.  Words are compared
by 64-bit hashes.  A document is one row of work; nothing shuffles.

Defined results: a null or empty text has no words and no run; equal rows have equal results; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voicelode.llm.common import SpanHasher, mix64, small_batches
from voicelode.llm.words import NOT_BLANK, Words

#: Times that a period must fit into a run, and the words that a run has at least.
TIMES = 4
LEAST = 6
_FACTOR = np.uint64(0x9FB21C651E98DF25)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def synchronising(ids: np.ndarray, t: int, periodic: np.ndarray) -> np.ndarray:
    """Positions whose windows i .. i + t have their smallest hash at i or i + t; `periodic` windows are left out."""
    ids = np.where(periodic, _NONE, ids)
    least, size = ids, 1
    while size < t:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    n = max(len(ids) - t, 0)
    least = np.minimum(least[:n], ids[t:])
    return np.flatnonzero(((least == ids[:n]) | (least == ids[t:])) & (least != _NONE))


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """In how many first places `a` and `b` are equal, looked at in growing pieces."""
    at, step, n = 0, 64, min(len(a), len(b))
    while at < n:
        differ = np.flatnonzero(a[at : min(at + step, n)] != b[at : min(at + step, n)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 2
    return n


def _extended(words: np.ndarray, at: np.ndarray, q: int, least: int) -> list[tuple[int, int, int]]:
    """The stretches of period q around proposed places: (start, end, q) of those that are long enough."""
    out, k = [], 0
    while k < len(at):
        i = int(at[k])
        right = i + _reach(words[i:-q], words[i + q :])
        left = i - _reach(words[:i][::-1], words[q : i + q][::-1])
        if right + q - left >= least:
            out.append((left, right + q, q))
        k = int(np.searchsorted(at, max(right, i + 1)))
    return out


def runs_of(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(start, end, period) of all stretches that a period fits into `TIMES` times.

    `words` are hashes of several texts' words, with a value of its own at the place `ends` behind each text.
    """
    sizes = np.repeat(np.diff(np.concatenate([[-1], ends])), np.diff(np.concatenate([[-1], ends])))  # with the separator
    found = np.zeros((0, 3), np.int64)
    place, ids, t = np.arange(len(words)), words, 1
    while True:
        keep = sizes[place] > TIMES * t
        place, ids = place[keep], ids[keep]
        if len(ids) <= 2 * t:
            return found
        change = np.zeros(len(ids) + 1, np.int64)
        inside = found[(found[:, 2] * 4 <= t) & (found[:, 1] - found[:, 0] >= t)]
        np.add.at(change, np.searchsorted(place, inside[:, 0]), 1)
        np.add.at(change, np.searchsorted(place, inside[:, 1] - t, side="right"), -1)
        chosen = synchronising(ids, t, np.cumsum(change[:-1]) > 0)
        ids = mix64(ids[:-t] * _FACTOR + ids[t:])  # now of windows of 2 t words: the contexts
        place = place[: len(ids)]
        chosen = chosen[chosen < len(ids)]
        context = ids[chosen]
        order = np.argsort(context, kind="stable")
        context, chosen = context[order], chosen[order]
        step = np.diff(chosen)
        near = np.flatnonzero((context[1:] == context[:-1]) & (step >= t) & (step < 2 * t))
        at, periods = place[chosen[near]], step[near]
        new = []
        for q in np.unique(periods).tolist():
            new += _extended(words, np.sort(at[periods == q]), q, TIMES * q)
        found = np.concatenate([found, np.array(new, np.int64).reshape(-1, 3)])
        t *= 2


def runs_of_texts(texts: list[np.ndarray]) -> list[np.ndarray]:
    """The runs of each text, given as hashes of its words: (start, length, period), by start, then period."""
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    long = [i for i, w in enumerate(texts) if len(w) >= LEAST]
    if not long:
        return out
    pieces = [x for k, i in enumerate(long) for x in (texts[i], np.array([k], np.uint64))]
    ends = np.cumsum([len(texts[i]) + 1 for i in long]) - 1
    found = runs_of(np.concatenate(pieces), ends)
    found = found[found[:, 1] - found[:, 0] >= LEAST]
    found = found[np.lexsort([found[:, 2], found[:, 0]])]
    text = np.searchsorted(ends, found[:, 0])
    cut = np.searchsorted(text, np.arange(len(long) + 1))
    for k, i in enumerate(long):
        own = found[cut[k] : cut[k + 1]]
        if len(own):
            first = own[:, 0] - (ends[k - 1] + 1 if k else 0)
            out[i] = np.stack([first, own[:, 1] - own[:, 0], own[:, 2]], axis=1)
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: a run keeps its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


_RUNS = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))


def find_runs(docs: DataFrame, order: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, runs, collapsed of every document.

    `runs` are (start, length, period) in words, by start and period; `collapsed` is the text with the words that
    repeat a run's first period left out, the others joined by one space.  With `order`, a function of the id and
    the number of words, the words are first taken in the order of the numbers it returns (None: as they are).
    """

    def find(batches):
        hasher = SpanHasher()
        for batch in small_batches(batches):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            words = Words(texts, NOT_BLANK, hasher)
            hashes, orders = [], []
            for i, key in enumerate(batch.column("doc_id").to_pylist()):
                own = words.hashes[words.at[i] : words.at[i + 1]]
                orders.append(order(key, len(own)) if order is not None and len(own) else None)
                hashes.append(own if orders[-1] is None else own[orders[-1]])
            runs = runs_of_texts(hashes)
            collapsed = []
            for text, own, places in zip(texts, runs, orders, strict=True):
                parts = text.split()
                if places is not None:
                    parts = [parts[k] for k in places.tolist()]
                if len(own):
                    parts = [parts[k] for k in np.flatnonzero(kept_words(len(parts), own)).tolist()]
                collapsed.append(b" ".join(parts))
            flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
            ends = np.cumsum([0, *(len(r) for r in runs)]).astype(np.int32)
            fields = pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(ends, fields).cast(_RUNS)]
                + [pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=["doc_id", "runs", "collapsed"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        find, f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )
