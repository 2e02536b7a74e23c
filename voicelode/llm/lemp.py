"""Ranked lexical search by norm buckets: the highest inner products of query vectors and impact vectors.

Terms are runs of letters and digits (ASCII) and of other characters, A to Z lower-cased.  A query holds the
weights of its terms, a document the impacts of its terms:

    weight = floor(1000 ln((2 N + 2) / (2 df + 1)))
    impact = (1000000000 tf) div (1000 tf + 20 m),   m = 100 - 50 + ((50 n N) div L)

Its score is their inner product over whole numbers.  Only terms that some query has matter, so vectors and
their lengths are over those.  Documents are ordered by the length of their vector; neighbours in that order
make buckets.  For a query whose k-th best score so far is b,

- a bucket is passed over when |query| * longest vector < b (Cauchy and Schwarz);
- inside a bucket a vector must have, in each of the query's heaviest terms, a share of its length within the
  bounds that the angle b / (|query| * longest vector) leaves;
- what is left is scored exactly, in 64-bit integers, and may raise b.

The longest vectors are searched first; their k-th best scores bound the search of all others, whose buckets
that no query can use are not read.  Every task keeps k documents a query, so k times the tasks are ranked in
the end, first in parts, then together.  Queries are worked on in blocks of a bounded number of terms.

Defined results: a null or empty text has no terms: such a document is in no result, such a query has none;
documents that are repeated are ranked each; ties go to the smaller doc_id, one without id last; equal rows
of the query table count once, rows that share an id but not a text are searched each; an empty table gives
an empty result.  Terms are compared by 64-bit hashes.  A document has an id that is a whole number.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voicelode.llm.common import Scratch, SpanHasher, small_batches
from voicelode.llm.words import ALNUM, Words, lowered

BEST = 50
#: Terms of a block of queries, about.
BLOCK_TERMS = 1 << 18
#: Vectors, about, that are searched first.
HEAD = 8192
#: Vectors of a bucket inside a task, and heaviest terms of a query that bound its vectors.
BUCKET = 1024
FOCUS = 2
#: Steps of the order by length in a factor of two.
STEPS = 8
#: What rounding may take from a bound.
SLACK = 1e-9


def query_terms(queries: DataFrame) -> DataFrame:
    """(item_id, text_key, terms) of the distinct rows of `queries` that have terms."""

    def cut(batches):
        hasher = SpanHasher()
        for batch in small_batches(batches):
            words = Words(lowered(batch.column("text")), ALNUM, hasher)
            lists = [np.unique(words.hashes[a:b]) for a, b in zip(words.at[:-1], words.at[1:], strict=True)]
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
            terms = pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), batch.column("text_key"), terms], names=["item_id", "text_key", "terms"]
            )

    kind = queries.schema["item_id"].dataType.simpleString()
    rows = queries.select("item_id", "text", F.xxhash64("text").alias("text_key")).dropDuplicates(["item_id", "text_key"])
    return rows.mapInArrow(cut, f"item_id {kind}, text_key long, terms array<long>").filter(F.size("terms") > 0)


def _lists(ends: np.ndarray, *columns: np.ndarray) -> list[pa.ListArray]:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns]


def term_counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs): each document's number of terms, and how often it has those of the sorted vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        hasher, known = SpanHasher(), sent.value
        for batch in small_batches(batches):
            words = Words(lowered(batch.column("text")), ALNUM, hasher)
            h = words.hashes.view(np.int64)
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = np.flatnonzero(known[place] == h)
            doc = np.searchsorted(words.at, hit, side="right") - 1
            pair, tf = np.unique(doc * len(known) + place[hit], return_counts=True)
            ends = np.searchsorted(pair // len(known), np.arange(batch.num_rows), side="right")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(words.at).astype(np.int64))]
                + _lists(ends, (pair % len(known)).astype(np.int32), tf.astype(np.int32)),
                names=["doc_id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


def document_frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """In how many documents each of `size` terms is; tasks sum before they send."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            terms = batch.column("terms").flatten().to_numpy()
            total += np.bincount(terms, minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some), "df": pa.array(total[some])})

    rows = counted.select("terms").mapInArrow(count, "term long, df long")
    found = rows.groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return df


def impact_vectors(counted: DataFrame, documents: int, all_terms: int) -> DataFrame:
    """(doc_id, terms, impacts, length, step) of the documents with terms; `step` grows with the vector's length."""

    def weigh(batches):
        for batch in batches:
            tf, sizes = batch.column("tfs").flatten().to_numpy().astype(np.int64), batch.column("tfs").value_lengths().to_numpy()
            n = batch.column("n").to_numpy()
            m = np.repeat(100 - 50 + (50 * n * documents) // all_terms, sizes)
            impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m)
            ends = np.cumsum(sizes)
            length = np.sqrt(np.add.reduceat(impact.astype(np.float64) ** 2, ends - sizes)) if len(sizes) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("terms"), *_lists(ends, impact.astype(np.int32)), pa.array(length)],
                names=["doc_id", "terms", "impacts", "length"],
            )

    full = counted.filter(F.size("terms") > 0)
    rows = full.mapInArrow(weigh, "doc_id long, terms array<int>, impacts array<int>, length double")
    rows = rows.filter("length > 0").withColumn("step", F.floor(F.log2("length") * STEPS).cast("int"))
    # copies have equal lengths: the id spreads them
    order = [F.col("step").desc(), F.xxhash64("doc_id")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


class _Best:
    """The best documents of one query so far."""

    def __init__(self, bound: int):
        self.bound = max(bound, 1)
        self.scores, self.ids, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray, k: int) -> None:
        scores, ids, none = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.none, none)))
        order = np.lexsort([ids, none, -scores])[:k]
        self.scores, self.ids, self.none = scores[order], ids[order], none[order]
        if len(order) == k:
            self.bound = max(self.bound, int(self.scores[-1]))


def _search(vectors: DataFrame, queries: tuple, bounds: np.ndarray, k: int) -> DataFrame:
    """(query, doc_id, score): each task's best documents of each query with at least its bound."""
    sent = vectors.sparkSession.sparkContext.broadcast((queries, bounds))
    bucket = BUCKET

    def search(batches):
        (ends, term, weight), least = sent.value
        queries = []
        for a, b, bound in zip(np.concatenate([[0], ends[:-1]]), ends, least, strict=True):
            w = weight[a:b]
            norm = math.sqrt(float((w.astype(np.float64) ** 2).sum()))
            heavy = np.argsort(-w, kind="stable")[:FOCUS]
            queries.append((term[a:b], w, norm, heavy, _Best(int(bound))))
        for whole in batches:
            for at in range(0, whole.num_rows, bucket):
                batch = whole.slice(at, bucket)
                sizes = batch.column("terms").value_lengths().to_numpy()
                row = np.repeat(np.arange(batch.num_rows), sizes)
                terms = batch.column("terms").flatten().to_numpy()
                order = np.argsort(terms, kind="stable")  # by term, then by row
                row, terms, impact = row[order], terms[order], batch.column("impacts").flatten().to_numpy()[order].astype(np.int64)
                lengths = batch.column("length").to_numpy()
                longest = float(lengths.max())
                none = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                ids = batch.column("doc_id").fill_null(0).to_numpy()
                for own, w, norm, heavy, best in queries:
                    if norm * longest * (1 + SLACK) < best.bound:
                        continue
                    starts, stops = np.searchsorted(terms, own), np.searchsorted(terms, own, side="right")
                    left = np.ones(batch.num_rows, bool)
                    angle = math.acos(min(1.0, best.bound / (norm * longest) * (1 - SLACK)))
                    for f in heavy.tolist():
                        share = np.zeros(batch.num_rows)
                        cut = slice(starts[f], stops[f])
                        share[row[cut]] = impact[cut] / lengths[row[cut]]
                        middle = math.acos(min(1.0, w[f] / norm))
                        high = 1.0 if middle <= angle else math.cos(middle - angle)
                        low = math.cos(min(math.pi, middle + angle))
                        left &= (share >= low - SLACK) & (share <= high + SLACK)
                    if not left.any():
                        continue
                    score = np.zeros(batch.num_rows, np.int64)
                    for a, b, x in zip(starts.tolist(), stops.tolist(), w.tolist(), strict=True):
                        score[row[a:b]] += x * impact[a:b]  # a document has a term once
                    new = np.flatnonzero(left & (score >= best.bound))
                    if len(new):
                        best.add(score[new], ids[new], none[new], k)
        for number, (*_, best) in enumerate(queries):
            if len(best.scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(best.scores), number)), pa.array(best.ids, mask=best.none), pa.array(best.scores)],
                    names=["query", "doc_id", "score"],
                )

    return vectors.select("doc_id", "terms", "impacts", "length").mapInArrow(search, "query long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, first of its parts."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["query", F.pmod(F.xxhash64("doc_id"), F.lit(16))], ["query"]):
        place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
        found = found.withColumn("rank", place).filter(F.col("rank") <= k)
    return found


def _search_block(block: pa.Table, docs: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """The ranked documents of the queries of one block, numbered by their place in it."""
    spark = docs.sparkSession
    flat = block.column("terms").combine_chunks()
    sizes = flat.value_lengths().to_numpy()
    vocabulary, term = np.unique(flat.flatten().to_numpy(), return_inverse=True)
    counted = scratch.table(term_counts(docs, vocabulary), "counted")
    documents, all_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(counted, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    queries = (np.cumsum(sizes), term.astype(np.int32), weights[term])
    vectors = scratch.table(impact_vectors(counted, documents, max(all_terms, 1)), "vectors")
    steps = vectors.groupBy("step").count().orderBy(F.desc("step")).collect()  # a few hundred at most
    seen, head = 0, 0
    for step, count in steps:
        if seen >= HEAD:
            break
        seen, head = seen + count, step
    bounds = np.zeros(len(sizes), np.int64)
    first = scratch.table(_search(vectors.filter(F.col("step") >= head), queries, bounds, k), "first")
    known = _ranked(first, k).filter(F.col("rank") == k).select("query", "score").toArrow()
    bounds[known.column("query").to_numpy()] = known.column("score").to_numpy()
    squares = np.add.reduceat(queries[2].astype(np.float64) ** 2, queries[0] - sizes)
    shortest = float((bounds / np.sqrt(np.maximum(squares, 1))).min()) * (1 - SLACK)
    rest = vectors.filter((F.col("step") < head) & (F.col("length") >= shortest))
    second = _search(rest, queries, bounds, k)
    ids = spark.createDataFrame(
        pa.table({"query": pa.array(range(len(sizes)), pa.int64()), "item_id": block.column("item_id")})
    )
    return _ranked(first.unionByName(second), k).join(ids, "query").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of each row of `queries` (item_id, text)."""
    scratch = Scratch(docs.sparkSession)
    terms = scratch.table(query_terms(queries), "queries")
    total = terms.agg(F.sum(F.size("terms"))).first()[0] or 0
    if not total:
        kind = queries.schema["item_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    blocks = -(-total // BLOCK_TERMS)
    block = F.pmod(F.xxhash64("item_id", "text_key"), F.lit(blocks))
    parts = (terms.filter(block == b).select("item_id", "terms").toArrow() for b in range(blocks))
    results = [_search_block(p, docs, k, scratch) for p in parts if p.num_rows]
    return reduce(DataFrame.unionByName, results)
