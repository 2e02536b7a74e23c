"""N-gram Jaccard join: a MinHash LSH forest proposes, exact shingle sets decide.

A text's words are its runs of letters and digits, ASCII letters lower-cased; its set holds the hashes
of its runs of `size` words (one of all words, if it has fewer).  Texts with equal sets are one class and
stand for each other.  Each class has a signature for every tree of the forest: `DEPTH` values, each equal
between two sets with the probability of their similarity s.

A tree is the sorted list of all signatures: sorted by them, the classes below one node of the prefix trie are
neighbours, and the longest common prefix of two neighbours says from which depth on they part.  Classes
that share less than `LEAST_DEPTH` values with their neighbours, in a tree, leave it.  Matching starts with
whole signatures.  The similarity that the signatures of all neighbours show tells how like
the pairs are that may reach the threshold; at a depth such a pair has a common prefix in some tree with the
probability 1 - (1 - s^depth)^trees.  The matched prefix is shortened by one value until that recall
meets the target for the least similar of them.  (One word of a text replaced changes `size` shingles of n: two texts of n shingles
and one such word are at (n - size) / (n + size), so 0.8 takes 45 shingles of five words.)

Classes that share a node are put into blocks of bounded volume, and blocks are compared whole where a
node joins them: the sizes of all intersections come from products of 0/1 matrices over the shingles
that two texts or more of the two blocks share, a bounded number of columns at a time.  So every pair of
a common node is verified exactly once per pair of blocks, a large group of near copies spreads over
many tasks, and nothing is emitted per pair: a task returns the number of links of each class and a
spanning forest of the links it has seen.

Defined results: a null or empty text has an empty set, all of these are one class without links; equal
rows are one class; a row without id belongs to its class, whose id is the smallest there is; an empty
table gives an empty result.  Sets and classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicelode.llm.common import Scratch, SpanHasher, mix64, small_batches
from voicelode.llm.components import components
from voicelode.llm.exact_dedup import mark_known
from voicelode.llm.words import ALNUM, Words, lowered, shingles

THRESHOLD = 0.8
SHINGLE = 5
TREES = 36
#: Values of a whole signature in one tree.
DEPTH = 8
LEAST_DEPTH = 4
TARGET_RECALL = 0.99999
#: What chance may add to the similarity that two signatures show.
DOUBT = 0.03
#: Texts and shingles of a block, about.
BLOCK_TEXTS = 128
BLOCK_SHINGLES = 1 << 16
#: Columns of the 0/1 matrices at a time.
COLUMNS = 4096


def recall_at(depth: int, similarity: np.ndarray, trees: int) -> np.ndarray:
    """The probability that two sets share a prefix of that depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(similarity: np.ndarray, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> int:
    """The longest prefix that finds even the least similar pairs, of those that may reach the threshold, with the target recall.

    `similarity` is what the signatures of pairs show that share `LEAST_DEPTH` values in some tree.
    """
    some = np.clip(similarity[similarity >= threshold - DOUBT] - DOUBT, threshold, 1.0)
    depth = DEPTH
    while depth > LEAST_DEPTH and len(some) and recall_at(depth, some, TREES).min() < target:
        depth -= 1
    return depth


def _sets(batches: Iterator[pa.RecordBatch], size: int):
    """(batch slice, shingle sets) of bounded runs of texts."""
    hasher = SpanHasher()
    for batch in small_batches(batches):
        yield batch, shingles(Words(lowered(batch.column("text")), ALNUM, hasher), size)


def _node_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each set; 0 for the empty one."""
    return np.array([mix64(mix64(s).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(s)))[0] if len(s) else 0 for s in sets], np.uint64).view(np.int64)


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, node, size, paths): the hash and size of each text's set, and its signature in each tree."""

    def sign(batches):
        rng = np.random.default_rng(20260101)
        factors = rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        offsets = rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
        half = np.uint64(32)
        for batch, sets in _sets(batches, size):
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            values = np.zeros((len(sets), TREES * DEPTH), ">u2")
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                starts = np.cumsum(sizes[full]) - sizes[full]
                for k in range(TREES * DEPTH):
                    low = np.minimum.reduceat((flat * factors[k] + offsets[k]) >> half, starts)
                    values[full, k] = (mix64(low) & np.uint64(0xFFFF)).astype(np.uint16)
            paths = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(2 * DEPTH), len(sets) * TREES, [None, pa.py_buffer(values.tobytes())]
            )
            lists = pa.ListArray.from_arrays(
                np.arange(0, len(paths) + 1, TREES, dtype=np.int32), paths.cast(pa.binary())
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(_node_ids(sets)), pa.array(sizes.astype(np.int32)), lists],
                names=["doc_id", "node", "size", "paths"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {id_type}, node long, size int, paths array<binary>")


def common_prefixes(tree: np.ndarray, path: np.ndarray) -> np.ndarray:
    """How many first values each row has in common with the one before; the rows are sorted."""
    same = np.cumprod(path[1:] == path[:-1], axis=1).sum(axis=1)
    return np.where(tree[1:] == tree[:-1], same, 0)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sorted trees with `depth`, the longest prefix shared with a neighbour, and the next row's node.

    What stands next to the first and the last row of a task is not known; both stay at any depth.
    """
    held, before = None, DEPTH
    for batch in batches:
        table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        n = table.num_rows
        if not n:
            continue
        paths = np.frombuffer(b"".join(table.column("path").to_pylist()), ">u2").reshape(n, DEPTH)
        lcp = common_prefixes(table.column("tree").to_numpy(), paths)
        yield _with_depth(table.slice(0, n - 1), np.maximum(np.r_[before, lcp[:-1]], lcp) if n > 1 else lcp, lcp, table)
        held, before = table.slice(n - 1), int(lcp[-1]) if n > 1 else before
    if held is not None:
        yield _with_depth(held, np.array([DEPTH]), np.zeros(0, np.int64), held)


def _with_depth(rows: pa.RecordBatch, depth: np.ndarray, lcp: np.ndarray, table: pa.RecordBatch) -> pa.RecordBatch:
    follows = table.column("node").slice(1, len(lcp)).to_numpy() if len(lcp) else np.zeros(rows.num_rows, np.int64)
    unlike = lcp < LEAST_DEPTH if len(lcp) else np.ones(rows.num_rows, bool)
    out = pa.RecordBatch.from_arrays(
        [*rows.columns, pa.array(depth[: rows.num_rows].astype(np.int32)), pa.array(follows[: rows.num_rows], mask=unlike[: rows.num_rows])],
        names=["tree", "path", "node", "depth", "next"],
    )
    return out.filter(pa.array(depth[: rows.num_rows] >= LEAST_DEPTH))


def _shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The similarity that two signatures show: the share of equal values."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).flatten().to_pylist()), ">u2").reshape(batch.num_rows, -1) for k in "ab")
        yield pa.RecordBatch.from_pydict({"similarity": (a == b).mean(axis=1)})


def forest(classes: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """(node, key): the classes below each node of the tries that two classes or more share, at the depth that the recall takes."""
    rows = classes.filter("size > 0").select("node", F.posexplode("paths").alias("tree", "path"))
    order = ["tree", "path", "node"]
    ordered = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    near = ordered.mapInArrow(_neighbours, "tree int, path binary, node long, depth int, next long")
    near = scratch.table(near, "trees")
    rows = near.count()

    pair = near.filter("next is not null").select(F.least("node", "next").alias("u"), F.greatest("node", "next").alias("v"))
    pairs = scratch.table(pair.distinct(), "neighbours", rows)
    shown = pairs
    for side, name in (("u", "a"), ("v", "b")):
        shown = shown.join(classes.select(F.col("node").alias(side), F.col("paths").alias(name)), side)
    shown = shown.select("a", "b").mapInArrow(_shown, "similarity double").distinct()  # few: shares of a signature
    shown = shown.toArrow().column("similarity").to_numpy()
    depth = prefix_depth(shown, threshold)

    keyed = near.filter(F.col("depth") >= depth).select(
        "node", F.xxhash64("tree", F.substring("path", 1, 2 * depth)).alias("key")
    )
    repeated = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    return scratch.table(keyed.join(scratch.table(repeated, "repeated", rows), "key"), "shared", rows)


def intersections(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Shared elements of each of the first `left` sets with each other set (with each set, if all are left)."""
    n = len(sets)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    use = shared[column]
    rows, column = rows[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    right = slice(0, n) if left == n else slice(left, n)
    out = np.zeros((left, len(range(n)[right])), np.float32)
    for c in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [c, c + COLUMNS])
        dense = np.zeros((n, COLUMNS), np.float32)
        dense[rows[a:b], column[a:b] - c] = 1
        out += dense[:left] @ dense[right].T
    return out


def _forest(us: np.ndarray, vs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Those of the pairs that join what was not joined before."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for u, v in zip(us.tolist(), vs.tolist(), strict=True):
        a, b = root(u), root(v)
        if a != b:
            parent[a] = b
            out.append((u, v))
    return out


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from batches that are sorted by them."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changed = np.zeros(batch.num_rows, bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        changed[0] = last is not None and first != last
        cuts = np.flatnonzero(changed).tolist()
        at = 0
        for cut in cuts:
            if cut > at:
                rest.append(batch.slice(at, cut - at))
            if rest:
                yield pa.Table.from_batches(rest)
            rest, at = [], cut
        rest.append(batch.slice(at))
        last = tuple(c[-1] for c in columns)
    if rest:
        yield pa.Table.from_batches(rest)


def _verify(threshold: float):
    def verify(batches):
        for group in groups(batches, ["left", "right"]):
            sides, nodes = group.column("side").to_numpy(), group.column("node").to_numpy()
            _, once = np.unique(nodes, return_index=True)  # rows may repeat an id and its text
            once = once[np.argsort(sides[once], kind="stable")]
            group, nodes = group.take(pa.array(once)), nodes[once]
            column = group.column("shingles").combine_chunks()
            values, at = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
            sets = [values[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
            sizes = np.diff(at)
            left = int((sides[once] == 0).sum())
            shared = intersections(sets, left)
            same = left == len(sets)
            right = 0 if same else left
            union = sizes[:left, None] + sizes[None, right:] - shared
            alike = shared / union >= threshold
            if same:
                np.fill_diagonal(alike, False)
            us, vs = np.nonzero(np.triu(alike) if same else alike)
            vs = vs + right
            links = np.bincount(us, minlength=len(sets)) + np.bincount(vs, minlength=len(sets))
            linked = np.flatnonzero(links)
            tree = np.array(_forest(us, vs, len(sets)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict(
                {
                    "u": np.concatenate([nodes[linked], nodes[tree[:, 0]]]),
                    "v": pa.array([None] * len(linked) + nodes[tree[:, 1]].tolist(), pa.int64()),
                    "links": np.concatenate([links[linked], np.zeros(len(tree), np.int64)]),
                }
            )

    return verify


def _block_pairs(shared: DataFrame, classes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, class_id, block) of the classes below common trie nodes, and the pairs (left, right) of blocks to compare."""
    rows = shared.count()
    low = shared.groupBy("key").agg(F.min("node").alias("low"))
    labels = shared.join(low, "key").groupBy("node").agg(F.min("low").alias("label"))
    labels = scratch.table(labels.join(classes, "node"), "labels", rows)
    volume = labels.groupBy("label").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("size") / BLOCK_SHINGLES), F.lit(1).cast("long")
        ).alias("blocks")
    )
    members = labels.join(volume, "label").select(
        "node", "class_id", F.xxhash64("label", F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("block")
    )
    members = scratch.table(members, "members", rows)
    at = shared.join(members, "node").select("key", "block").distinct()
    at = scratch.table(at, "at", rows)
    pairs = (
        at.withColumnRenamed("block", "left")
        .join(at.withColumnRenamed("block", "right"), "key")
        .filter("left <= right")
        .select("left", "right")
        .distinct()
    )
    return members, scratch.table(pairs, "pairs")


def similarity_links(
    docs: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, size: int = SHINGLE
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, set_id) of every row of `docs`, and the verified (u, v, links).

    Rows with v are links of a spanning forest; rows without v add `links` to the links of class u.
    """
    signed = scratch.table(signatures(docs, size), "signatures")
    classes = signed.groupBy("node").agg(
        F.min("doc_id").alias("class_id"), F.first("size").alias("size"), F.first("paths").alias("paths")
    )
    classes = scratch.table(classes, "classes")
    shared = forest(classes, scratch, threshold)
    members, pairs = _block_pairs(shared, classes.select("node", "class_id", "size"), scratch)

    def sets(batches):
        for batch, found in _sets(batches, size):
            own = np.flatnonzero(_node_ids(found) == batch.column("node").to_numpy())  # an id may be repeated
            flat = np.concatenate([found[i] for i in own]) if len(own) else np.zeros(0, np.uint64)
            ends = np.cumsum([0, *(len(found[i]) for i in own)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node").take(pa.array(own)),
                    batch.column("block").take(pa.array(own)),
                    pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(flat.view(np.int64))),
                ],
                names=["node", "block", "shingles"],
            )

    # texts that cannot be members do not move; a second Python step in these tasks would double an executor's workers
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    rows = mark_known(rows, members.select(F.xxhash64("class_id").alias("h")), scratch).filter("maybe_known")
    chosen = rows.join(members.withColumnRenamed("class_id", "doc_id"), "doc_id").select("node", "block", "text")
    with_sets = scratch.table(chosen.mapInArrow(sets, "node long, block long, shingles array<long>"), "sets")
    side = F.explode(
        F.when(F.col("left") == F.col("right"), F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("block"))))
        .otherwise(
            F.array(
                F.struct(F.lit(0).alias("side"), F.col("left").alias("block")),
                F.struct(F.lit(1).alias("side"), F.col("right").alias("block")),
            )
        )
    )
    placed = (
        pairs.select("left", "right", side.alias("s"))
        .select("left", "right", "s.side", "s.block")
        .join(with_sets, "block")
        .select("left", "right", "side", "node", "shingles")
        .repartition("left", "right")
        .sortWithinPartitions("left", "right")
    )
    links = scratch.table(placed.mapInArrow(_verify(threshold), "u long, v long, links long"), "links")
    scratch.drop("sets", "shared", "repeated", "at", "labels", "trees", "neighbours")
    rows = signed.select("doc_id", "node").join(classes.select("node", F.col("class_id").alias("set_id")), "node")
    return rows, links


def _grouped(rows: DataFrame, links: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """`rows` with the label of their group of linked classes, and (label, smallest id) of the groups."""
    labels = components(links.filter("v is not null").select("u", "v"), scratch).withColumnRenamed("node", "_node")
    grouped = rows.join(labels, rows["node"] == F.col("_node"), "left")
    grouped = scratch.table(grouped.withColumn("label", F.coalesce("label", "node")).drop("_node"), "grouped")
    groups = grouped.groupBy("label").agg(F.min("doc_id").alias("group_id"))
    return grouped, scratch.table(groups, "groups", grouped.count())


def link_counts(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """doc_id, class_id, set_id, n_links of every row.

    `class_id` is the smallest id of the texts that are linked, directly or by others; `set_id` the smallest of
    those with an equal set, and `n_links` the number of other sets that are similar.
    """
    scratch = Scratch(docs.sparkSession)
    rows, links = similarity_links(docs, scratch, threshold, size)
    counted = links.filter("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("n_links"))
    grouped, groups = _grouped(rows, links, scratch)
    return grouped.join(groups, "label").join(counted, "node", "left").select(
        "doc_id", F.col("group_id").alias("class_id"), "set_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    )


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """`docs` with one document of each group of linked texts: the one with the smallest id.

    Rows with the id of a document that stays all stay; a row without id always stays.
    """
    scratch = Scratch(docs.sparkSession)
    grouped, keep = _grouped(*similarity_links(docs, scratch, threshold, size), scratch)
    gone = grouped.join(keep, "label").filter("doc_id != group_id").select("doc_id").distinct()
    gone = scratch.table(gone.join(keep.select(F.col("group_id").alias("doc_id")), "doc_id", "left_anti"), "gone")
    scratch.drop("signatures", "classes", "members", "pairs", "links", "grouped", "groups")
    # documents that certainly stay do not move
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("doc_id").alias("h"))
    marked = mark_known(rows, gone.select(F.xxhash64("doc_id").alias("h")), scratch)
    stay = marked.filter(~F.col("maybe_known")).select("row.*")
    return stay.unionByName(marked.filter("maybe_known").join(gone, "doc_id", "left_anti").select("row.*"))
