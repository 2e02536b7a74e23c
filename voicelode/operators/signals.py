"""Signals of findings: platforms, confidence tiers, numbering inside a tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelode.functions.urls import platform_of_url, platforms_of_urls
from voicelode.operators.clusters import first_of_cluster
from voicelode.operators.ranking import number_rows_within, points_order
from voicelode.scratch import few_rows


def _signal(count: Column) -> Column:
    return F.when(count >= 3, "strong").when(count == 2, "moderate").otherwise("single")


def _with_signal(df: DataFrame) -> DataFrame:
    count = F.greatest(F.size("platforms"), F.lit(1))
    return df.withColumn("platform_count", count).withColumn(
        "cross_platform_signal", _signal(F.col("platform_count"))
    )


def cross_platform(points: DataFrame, mode: str = "substring") -> DataFrame:
    """Platforms of findings that carry their own `source_urls`: a projection."""
    return _with_signal(
        points.withColumn("platforms", platforms_of_urls(F.col("source_urls"), mode))
    )


def cross_platform_clusters(
    merged: DataFrame, sources: DataFrame, mode: str = "substring", links: int = 5
) -> DataFrame:
    """Platforms, source count and first links of merged findings, from the source table.

    A cluster has at most as many platforms as are known, so the set stays small however
    many sources there are.
    """
    named = sources.withColumn("platform", platform_of_url(F.col("url"), mode))
    facts = named.groupBy("leader").agg(
        F.sort_array(F.collect_set("platform")).alias("platforms"),
        F.count("*").alias("source_count"),
    )
    first = first_of_cluster(sources, ["first_ord", "first_pos"], "url", links)
    facts = facts.join(first.withColumnRenamed("url", "links"), "leader", "left")
    none = F.array().cast("array<string>")
    joined = merged.join(facts.withColumnRenamed("leader", "ord"), "ord", "left").withColumns(
        {
            "platforms": F.coalesce("platforms", none),
            "source_count": F.coalesce("source_count", F.lit(0)),
            "links": F.coalesce("links", none),
        }
    )
    return _with_signal(joined)


TIERS = ["high", "medium", "low"]


def confidence_tier() -> Column:
    users = F.coalesce("unique_users", F.lit(0))
    intensity = F.coalesce("emotional_intensity", F.lit(0))
    pays = F.coalesce("payment_signal", F.lit(False))
    return (
        F.when((users >= 3) | (intensity >= 4), "high")
        .when((users >= 2) | pays, "medium")
        .otherwise("low")
    )


def confidence_tiers(points: DataFrame) -> DataFrame:
    return points.withColumn("tier", confidence_tier())


def tiered_points(points: DataFrame) -> DataFrame:
    """Add `tier` and `position`, the finding's number inside its tier.

    Three tiers are three groups, so they are numbered by range partitioning and not by
    a window per tier; only the key and order columns take part.  The positions go to the
    findings, whose texts stay in place.
    """
    tiered = confidence_tiers(points)
    narrow = tiered.select(
        "ord", "tier", "platform_count", "unique_users", "emotional_intensity"
    )
    numbered = number_rows_within(narrow, F.col("tier"), points_order(), "position")
    return tiered.join(few_rows(numbered.select("ord", "position")), "ord")
