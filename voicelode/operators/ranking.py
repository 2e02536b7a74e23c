"""Ranking, top-n selection, batching."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voicelode.scratch import materialize
from voicelode.settings import Settings


def relevance_order() -> list[Column]:
    """Relevance descending, arrival order among equals."""
    return [F.col("relevance_score").desc(), F.col("seq").asc()]


def rank_posts(scored: DataFrame) -> DataFrame:
    """Posts in relevance order; a range-partitioned sort."""
    return scored.orderBy(*relevance_order())


def rank_table(scored: DataFrame) -> DataFrame:
    """(id, relevance_score, seq, rank) of all posts, ranks from 1.

    The narrow rows are written first: range partitioning reads its input twice, once for
    a sample, and would score every text twice.
    """
    narrow = materialize(scored.select("id", "relevance_score", "seq"), "ranked")
    return number_rows(narrow, relevance_order(), "rank")


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number all rows 1..n in a total order without a window over the whole table.

    Rows are range-partitioned, sorted and numbered inside their partition, and that
    layout is written down.  Then the sizes of the partitions before it are added to each
    row's number; only these sizes, one per partition, pass through the driver.  Pass
    narrow rows: key and order columns.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # monotonically_increasing_id is (partition << 33) + place in the partition
    laid_out = materialize(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_no", F.monotonically_increasing_id()),
        "numbered",
    ).withColumns(
        {
            "_part": F.shiftright("_no", 33),
            "_at": F.col("_no").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    sizes = laid_out.groupBy("_part").agg((F.max("_at") + 1).alias("size")).collect()
    starts, total = [0] * parts, 0
    for row in sorted(sizes, key=lambda r: r["_part"]):
        starts[row["_part"]] = total
        total += row["size"]
    # a literal per partition, so that the result stays a projection of a table whose size
    # the optimizer knows
    start = F.element_at(F.lit(np.array(starts, dtype="int64")), (F.col("_part") + 1).cast("int"))
    return laid_out.withColumn(name, start + F.col("_at") + 1).drop("_no", "_part", "_at")


def number_rows_within(
    df: DataFrame, group: Column, order: list[Column], name: str
) -> DataFrame:
    """Number rows 1..n inside each group, however large, without one task per group.

    All rows are numbered first; the number that a group begins with is joined by group, a null
    group like any other.
    """
    numbered = number_rows(df.withColumn("_g", group), [F.col("_g").asc(), *order], "_all")
    firsts = numbered.groupBy("_g").agg(F.min("_all").alias("_first")).withColumnRenamed("_g", "_h")
    joined = numbered.join(firsts, F.col("_g").eqNullSafe(F.col("_h")))
    return joined.withColumn(name, F.col("_all") - F.col("_first") + 1).drop("_g", "_h", "_all", "_first")


def select_for_analysis(
    scored: DataFrame, settings: Settings = Settings(), per: str | None = None
) -> DataFrame:
    """The best posts at or above the threshold: in all, or for each value of `per`.

    In all this is a top-n over partial top-n's; per group the group limit runs before
    the shuffle, so at most n rows of a group leave each map task.
    """
    eligible = scored.filter(F.col("relevance_score") >= settings.min_score)
    if per is None:
        return eligible.orderBy(*relevance_order()).limit(settings.max_analyzed)
    order = W.partitionBy(per).orderBy(*relevance_order())
    return (
        eligible.withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= settings.max_analyzed)
        .drop("_n")
    )


def assign_batches(
    selected: DataFrame, settings: Settings = Settings(), per: str | None = None
) -> DataFrame:
    """Add `rank` and `batch`: consecutive groups in rank order, numbered from 0.

    `selected` is the output of `select_for_analysis`, so a window holds at most
    `max_analyzed` rows.
    """
    keys = [per] if per else []
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*relevance_order()))
    return selected.withColumn("rank", rank).withColumn(
        "batch", F.floor((F.col("rank") - 1) / settings.batch_size).cast("int")
    )


def analysis_payload(
    posts: DataFrame, settings: Settings = Settings(), keep: list[str] | None = None
) -> DataFrame:
    """The nine fields of a post that go to the model, bodies cut to the field's limit."""
    return posts.withColumn(
        "body", F.substring(F.coalesce("body", F.lit("")), 1, settings.body_limit)
    ).select(*(keep or []), *PAYLOAD_FIELDS)


PAYLOAD_FIELDS = [
    "url", "title", "body", "author", "points", "platform", "community",
    "pain_score", "demand_score",
]


def points_order() -> list[Column]:
    """Findings: platforms, users, intensity descending; then order of appearance."""
    return [
        F.coalesce("platform_count", F.lit(1)).desc(),
        F.coalesce("unique_users", F.lit(0)).desc(),
        F.coalesce("emotional_intensity", F.lit(0)).desc(),
        F.col("ord").asc(),
    ]


def rank_points(points: DataFrame) -> DataFrame:
    return points.orderBy(*points_order())
