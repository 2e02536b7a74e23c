"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Equal vectors become one node that knows its smallest ids.  A first graph comes from a few random
orders in which near nodes are often close: they are cut into runs, and the nearest of a node's run are
its first neighbours.  Then neighbours of neighbours are tried: every node gathers its neighbours and
those that have it as theirs (as many of the nearest ones), with their vectors, compares them with each
other and proposes pairs that are nearer than what one of the two has.  Rounds go on until few edges
change.  All of it are joins and shuffles of bounded rows; no task holds more than a run or a node's
surroundings.

A query is a node of the graph, and its search begins there; in each step the neighbours of its best
nodes that have not been looked at are measured, and the best are kept, until the best have all been
looked at.  Reported distances are computed in double precision from the original vectors.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part,
neither do those of another length than most; ids may repeat or be null: a null id takes no part, a
repeated one (id and vector) counts once; ties go to the smaller id; with fewer candidates all are
returned; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voicelode.llm.common import Scratch
from voicelode.llm.jaccard_join import groups

#: Neighbours of a node.
K = 32
#: Orders and the length of their runs for the first graph.
PROJECTIONS = 8
RUN = 2048
#: Rounds end when less than this share of edges is new.
SETTLED = 0.05
#: Nodes that a search keeps, and those of them that it goes on from.
BEAM = 160
EXPAND = 80
SEED = 20260101


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): rows whose vectors take part, v as doubles."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
    )
    rows = rows.filter(whole & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return rows.join(F.broadcast(usual.select("n")), F.size("v") == F.col("n")).drop("n")


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of two matrices."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


_EDGE = "u long, v long, d float"


def _edges(u: np.ndarray, v: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"u": u, "v": v, "d": d.astype(np.float32)})


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each node, each neighbour once, numbered by `place`; one shuffle, by node."""
    order = Window.partitionBy("u").orderBy("d", "v")
    once = edges.repartition("u").groupBy("u", "v").agg(F.min("d").alias("d"), F.max("old").alias("old"))
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def first_graph(nodes: DataFrame, k: int) -> DataFrame:
    """(u, v, d, old, place) from runs along random projections; `nodes` has node and x (floats).

    In each of several orders nodes are sorted by the sides of random hyperplanes they lie on, then by a
    random projection, and cut into runs; the nearest of a node's run are its first neighbours.
    """
    n = nodes.count()
    bits = max(1, math.ceil(math.log2(max(n, 1) / RUN)))

    def place(batches):
        for batch in batches:
            x = _matrix(batch.column("x"))
            for p in range(PROJECTIONS if batch.num_rows else 0):
                sides = x @ np.random.default_rng(SEED + p).normal(size=(x.shape[1], bits + 1))
                cell = (sides[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                order = pa.array(np.full(len(x), p, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [order, pa.array(cell), pa.array(sides[:, bits]), batch.column("node"), batch.column("x")],
                    names=["p", "cell", "at", "node", "x"],
                )

    def compare(batches):
        for group in groups(batches, ["p"]):
            group = group.combine_chunks()
            node, x = group.column("node").to_numpy(), _matrix(group.column("x").combine_chunks())
            for a in range(0, len(node), RUN):
                own, d = node[a : a + RUN], _distances(x[a : a + RUN], x[a : a + RUN])
                np.fill_diagonal(d, np.inf)
                m = min(k, len(own) - 1)
                if m:
                    near = np.argpartition(d, m - 1, axis=1)[:, :m]
                    rows = np.repeat(np.arange(len(own)), m)
                    yield _edges(own[rows], own[near.ravel()], d[rows, near.ravel()])

    parts = max(1, n * PROJECTIONS // (4 * RUN))
    placed = nodes.select("node", "x").mapInArrow(place, "p int, cell long, at double, node long, x array<float>")
    order = ["p", "cell", "at", "node"]
    runs = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("p", "node", "x")
    return _nearest(runs.mapInArrow(compare, _EDGE).withColumn("old", F.lit(False)), k)


def _backward(graph: DataFrame, k: int) -> DataFrame:
    """The edges turned round, the k nearest of each node."""
    back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "d", "old")
    order = Window.partitionBy("u").orderBy("d", "v")
    return back.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def improved(graph: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Edges that a round proposes: pairs met at a common neighbour, one of them new there, nearer than one's last neighbour.

    `graph` has u, v, d and old (whether the edge has been used before).
    """
    around = graph.select("u", "v", "old").unionByName(_backward(graph, k).select("u", "v", "old"))
    reach = graph.filter(F.col("place") == k).select("u", F.col("d").alias("reach"))
    known = nodes.join(reach, F.col("node") == F.col("u"), "left").select("node", "x", "reach")
    gathered = (
        around.join(known, F.col("v") == F.col("node"))
        .groupBy("u")
        .agg(F.collect_list(F.struct("v", "old", "reach", "x")).alias("near"))
    )

    def compare(batches):
        for batch in batches:
            near = batch.column("near")
            ends, flat = near.offsets.to_numpy(), near.values
            v = flat.field("v").to_numpy(zero_copy_only=False)
            fresh = ~flat.field("old").to_numpy(zero_copy_only=False)
            reach = flat.field("reach").fill_null(np.inf).to_numpy(zero_copy_only=False)
            x = _matrix(flat.field("x"))
            out: list[list[np.ndarray]] = [[], [], []]
            for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True):
                own = slice(a, b)
                d = _distances(x[own], x[own])
                # a neighbour may stand there twice, forward and backward
                better = (d < reach[own][:, None]) & (fresh[own][:, None] | fresh[own][None, :])
                better &= v[own][:, None] != v[own][None, :]
                i, j = np.nonzero(better)
                for column, values in zip(out, (v[own][i], v[own][j], d[i, j]), strict=True):
                    column.append(values)
            if out[0]:
                u, w, d = (np.concatenate(c) for c in out)
                order = np.lexsort([d, w, u])  # a batch proposes each pair once
                u, w, d = u[order], w[order], d[order]
                once = np.ones(len(u), bool)
                once[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
                u, w, d = u[once], w[once], d[once]
                order = np.lexsort([d, u])  # and the k nearest of a node
                u, w, d = u[order], w[order], d[order]
                start = np.searchsorted(u, u, side="left")
                few = np.arange(len(u)) - start < k
                yield _edges(u[few], w[few], d[few])

    return gathered.mapInArrow(compare, _EDGE)


def neighbour_graph(nodes: DataFrame, scratch: Scratch, k: int = K) -> DataFrame:
    """(u, v, d): about the k nearest nodes of each node, d the squared distance."""
    graph = scratch.table(first_graph(nodes, k), "graph")
    for step in itertools.count():  # edges only get shorter, so it ends
        total, fresh = graph.agg(F.count(F.lit(1)), F.sum((~F.col("old")).cast("long"))).first()
        if not total or fresh <= SETTLED * total:
            break
        proposed = improved(graph, nodes, k).withColumn("old", F.lit(False))
        used = graph.withColumn("old", F.lit(True)).drop("place")
        graph = scratch.table(_nearest(used.unionByName(proposed), k), f"graph-{step}")
    return graph


def search(queries: DataFrame, links: DataFrame, nodes: DataFrame, scratch: Scratch, beam: int = BEAM) -> DataFrame:
    """(q, v): the nodes that a greedy search from each query's own node ends with; `queries` has q (a node).

    In each step the neighbours of the `EXPAND` best nodes that have not been looked at are measured.
    """

    def keep(batches):
        for group in groups(batches, ["q"]):
            q = group.column("q")[0].as_py()
            v, d, old = (group.column(c).to_numpy() for c in ("v", "d", "old"))
            x = group.column("x").combine_chunks()
            new = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False))
            vectors = _matrix(x.take(pa.array(new)))
            own = vectors[np.flatnonzero(v[new] == q)[0]]
            d, old = d.copy(), old.copy()
            d[new] = ((vectors - own) ** 2).sum(axis=1)
            order = np.lexsort([~old, v])  # what has been looked at stands for what has been reached again
            order = order[np.r_[True, v[order][1:] != v[order][:-1]]]
            order = order[np.lexsort([v[order], d[order]])][:beam]
            v, d, old = v[order], d[order], old[order]
            ahead = np.zeros(len(v), bool)
            ahead[:EXPAND] = ~old[:EXPAND]
            yield pa.RecordBatch.from_pydict(
                {"q": np.full(len(v), q), "v": v, "d": d.astype(np.float32), "old": old | ahead, "ahead": ahead}
            )

    q, no_vector = F.col("q"), F.lit(None).cast("array<float>")
    own = queries.select("q", q.alias("v"))
    found = None
    for step in itertools.count():  # no node is looked at twice, so it ends
        if found is None:
            reached = own
        else:
            ahead = found.filter("ahead")
            if ahead.isEmpty():
                break
            reached = ahead.select("q", "v").join(links, F.col("v") == F.col("from")).select("q", F.col("to").alias("v"))
            reached = reached.unionByName(own)  # its own node brings the query's vector
        measured = reached.join(nodes, F.col("v") == F.col("node")).select(
            "q", "v", F.lit(0.0).cast("float").alias("d"), F.lit(False).alias("old"), "x"
        )
        if found is not None:
            measured = measured.unionByName(found.select("q", "v", "d", "old", no_vector.alias("x")))
        dealt = measured.repartition("q").sortWithinPartitions("q")
        found = scratch.table(
            dealt.mapInArrow(keep, "q long, v long, d float, old boolean, ahead boolean"), f"found-{step}"
        )
    return found.select("q", "v")


def nearest(
    vectors: DataFrame, is_query, n: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K
) -> DataFrame:
    """query_id, rank, vec_id, score: of each row that `is_query` holds for, the n nearest other rows."""
    scratch = Scratch(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col).withColumn("node", F.xxhash64("v"))
    rows = scratch.table(rows.dropDuplicates(["vec_id", "node"]), "vectors")
    nodes = rows.groupBy("node").agg(F.first(F.transform("v", lambda x: x.cast("float"))).alias("x"))
    nodes = scratch.table(nodes, "nodes")
    graph = neighbour_graph(nodes, scratch, k)
    links = graph.select(F.col("u").alias("from"), F.col("v").alias("to"))
    back = _backward(graph, k).select(F.col("u").alias("from"), F.col("v").alias("to"))
    links = scratch.table(links.unionByName(back), "links")

    asked = scratch.table(rows.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("node").alias("q"), F.col("v").alias("y")), "asked")
    found = scratch.table(search(asked.select("q").distinct(), links, nodes, scratch), "nearby")
    # of equal vectors, one more than asked for: one of them may be the query itself
    order = Window.partitionBy("node").orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n + 1)
    few = scratch.table(few.select("node", "vec_id", "v"), "few")
    difference = F.aggregate(F.zip_with("v", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, z: s + z)
    scored = (
        asked.join(found.withColumnRenamed("v", "near"), "q")
        .join(few, F.col("near") == F.col("node"))
        .filter("vec_id != query_id")
        .select("query_id", "vec_id", F.sqrt(difference).alias("score"))
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= n).select("query_id", "rank", "vec_id", "score")
