"""Connected components by alternating star operations, on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicelode.llm.common import Scratch


def _smallest(edges: DataFrame, name: str, scratch: Scratch, rows: int) -> DataFrame:
    """Each edge (u, v) becomes (v, the smallest node next to u); there are `rows` edges at most."""
    low = scratch.table(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low")), f"{name}-low", rows)
    return edges.join(low, "u")


def components(edges: DataFrame, scratch: Scratch, name: str = "edges") -> DataFrame:
    """(node, label) for every node of `edges` (u, v: long): the label is the smallest node that it is connected to.

    Each round links larger neighbours, then smaller ones, to the smallest node next to them; the
    tables of a round are written.  It ends when a round changes nothing: after that all edges lead
    to the labels.  Both steps count with map-side combining and join by key, which adaptive
    execution splits for a node with very many neighbours.
    """
    edges = scratch.table(
        edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name
    )
    last, step = (edges.count(), None), 0
    while last[0]:
        rows = 2 * last[0]  # of both directions; the steps of a round have no more
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = scratch.table(both, f"{name}-both-{step}", rows)
        large = _smallest(both, f"{name}-large-{step}", scratch, rows).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = scratch.table(large.filter("u != v").distinct(), f"{name}-star-{step}", rows)
        small = _smallest(large, f"{name}-small-{step}", scratch, rows)
        linked = small.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            small.select("u", F.col("low").alias("v"))
        )
        edges = scratch.table(linked.filter("u != v").distinct(), f"{name}-next-{step}", rows)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(f"{name}-both-{step}", f"{name}-star-{step}", f"{name}-large-{step}-low", f"{name}-small-{step}-low")
        if now == last:
            break
        last, step = now, step + 1
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
