"""Collapsing repeated hits into posts, and joining comments to posts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first row, or the first `n` rows, of each key.

    Spark turns the bound on the row number into a group limit that also runs before the
    shuffle, so a hot key sends at most `n` rows per map task.
    """
    numbered = df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return numbered.filter(F.col("_n") <= n).drop("_n")


def collapse_hits(hits: DataFrame, keep: str = "all", keys: list[str] | None = None) -> DataFrame:
    """One post per key: the first hit gives the fields, the hits' queries are collected.

    `keep='all'` lists every distinct query in arrival order, `keep='first'` the first.
    Hits are first reduced to one row per post and query, which combines on the map
    side; only then are queries listed, so a list is never longer than the number of
    queries a topic is searched with, however often a post was hit.
    """
    keys = keys or ["topic", "id"]
    fields = [c for c in hits.columns if c not in keys and c not in ("query", "hit_seq")]
    record = F.struct(*fields)
    if keep == "first":
        best = hits.groupBy(*keys).agg(
            F.min_by(F.struct(record.alias("record"), F.col("query")), "hit_seq").alias("best"),
            F.min("hit_seq").alias("seq"),
        )
        return best.select(
            *keys, "best.record.*", F.array("best.query").alias("matched_queries"), "seq"
        )
    if keep != "all":
        raise ValueError(f"unknown keep: {keep}")
    per_query = hits.groupBy(*keys, "query").agg(
        F.min_by(record, "hit_seq").alias("record"), F.min("hit_seq").alias("first_seq")
    )
    return (
        per_query.groupBy(*keys)
        .agg(
            F.min_by("record", "first_seq").alias("record"),
            F.min("first_seq").alias("seq"),
            F.sort_array(F.collect_list(F.struct("first_seq", "query"))).alias("queries"),
        )
        .select(*keys, "record.*", F.col("queries.query").alias("matched_queries"), "seq")
    )


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Bag union in the given order; `seq` then orders by source first, arrival second."""
    numbered = [
        df.withColumn("seq", F.lit(n << 50) + F.col("seq")) for n, df in enumerate(frames)
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def enrich_with_comments(
    posts: DataFrame, comments: DataFrame, header: str, separator: str, min_comments: int = 10
) -> DataFrame:
    """Append the comments to the body of posts that have at least `min_comments`.

    The threshold is part of the join condition, so the key stays the post id and posts
    below the threshold do not pile up under one null key.
    """
    earliest = first_per_key(comments, ["id"], [F.col("fetched_seq").asc()])
    extra = earliest.select(
        F.col("id").alias("_id"), F.array_join("comments", separator).alias("_extra")
    ).filter("_extra <> ''")
    matches = (F.col("id") == F.col("_id")) & (F.col("num_comments") >= min_comments)
    body = F.when(
        F.col("_extra").isNotNull(), F.concat("body", F.lit(header), "_extra")
    ).otherwise(F.col("body"))
    return posts.join(extra, matches, "left").withColumn("body", body).drop("_id", "_extra")
