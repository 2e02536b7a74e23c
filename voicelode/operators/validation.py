"""Rules that grade findings by their evidence.

`evidence` has one row per post behind a finding: point, platform, url, author,
created_at.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voicelode import values
from voicelode.functions.text import count_terms, scoring_text

# fixed values: bounds of the rules
MIN_INDEPENDENT_SOURCES = 3
STALE_MONTHS = 12
PATTERN_OCCURRENCES = 3
SEARCHES_MARKET, SEARCHES_NICHE = 1000, 100
SIGNUPS_STRONG, SIGNUPS_MEDIUM = 10, 3


def signal_strength(points: DataFrame, evidence: DataFrame) -> DataFrame:
    """0 no post, 1 one post, 2 several posts on one platform, 3 several platforms."""
    counts = evidence.groupBy("point").agg(
        F.count_distinct("platform").alias("platforms"), F.count_distinct("url").alias("posts")
    )
    strength = (
        F.when(F.col("platforms") >= 2, 3)
        .when(F.col("posts") >= 2, 2)
        .when(F.col("posts") == 1, 1)
        .otherwise(0)
    )
    return points.select("point").join(counts, "point", "left").select(
        "point", strength.alias("signal_strength")
    )


def source_rules(evidence: DataFrame) -> DataFrame:
    """Whether a finding is upgraded, rests on a single source, or on a single author."""
    counts = evidence.groupBy("point").agg(
        F.count_distinct("url").alias("sources"), F.count_distinct("author").alias("authors")
    )
    return counts.withColumns(
        {
            "upgraded": F.col("sources") >= MIN_INDEPENDENT_SOURCES,
            "single_source": F.col("sources") == 1,
            "single_author": F.col("authors") == 1,
        }
    )


def vocal_minority(evidence: DataFrame, user_base: Column) -> DataFrame:
    """Posts per author, the most by one author, and complainers as a share of the users.

    Posts are counted per author first, so a finding with very many posts reaches the
    second step as one row per author.
    """
    per_author = evidence.groupBy("point", "author").agg(F.count("*").alias("posts"))
    return per_author.groupBy("point").agg(
        F.sum("posts").alias("posts"),
        F.count("*").alias("authors"),
        F.max("posts").alias("most_by_one"),
        (F.count("*") / user_base).alias("share_of_users"),
    )


def staleness(evidence: DataFrame, as_of: dt.date) -> DataFrame:
    """Findings whose newest post is older than a year."""
    bound = F.add_months(F.lit(as_of), -STALE_MONTHS)
    return evidence.groupBy("point").agg(F.max("created_at").alias("newest")).withColumn(
        "stale", F.col("newest") < bound
    )


def counter_evidence(
    posts: DataFrame, by: str, terms=None, partial: int = 1, solved: int = 10
) -> DataFrame:
    """none, partial or solved, by the number of posts that speak of a solution."""
    terms = terms or values.RESOLVED_TERMS
    mentions = count_terms(scoring_text(F.col("title"), F.col("body")), terms) > 0
    counts = posts.groupBy(by).agg(F.count_if(mentions).alias("resolving_posts"))
    n = F.col("resolving_posts")
    return counts.withColumn(
        "verdict", F.when(n >= solved, "solved").when(n >= partial, "partial").otherwise("none")
    )


def opportunity_total() -> Column:
    return (
        F.col("signal") + F.col("frequency") + F.col("payment") + F.col("buildability")
        + F.col("ai_leverage") - F.col("saturation")
    )


def opportunities(ratings: DataFrame, n: int = 3) -> DataFrame:
    """The best findings by total rating, at most 14; equal totals share a rank."""
    rated = ratings.withColumn("total", opportunity_total())
    top = rated.orderBy(F.col("total").desc(), F.col("point").asc()).limit(n)
    return top.withColumn("rank", F.rank().over(W.orderBy(F.col("total").desc())))


def confidence_label(has_engagement: Column, platforms: Column, tested: Column, proven: Column):
    """probing, data-backed or verified."""
    backed = has_engagement & (platforms >= 2) & tested
    return F.when(backed & proven, "verified").when(backed, "data-backed").otherwise("probing")


def price_anchors(prices: DataFrame, by: str, price: str) -> DataFrame:
    """Highest and lowest competitor price of an area."""
    return prices.groupBy(by).agg(
        F.max(price).alias("price_ceiling"), F.min(price).alias("price_floor")
    )


def market_size(searches: Column) -> Column:
    return (
        F.when(searches > SEARCHES_MARKET, "market")
        .when(searches >= SEARCHES_NICHE, "niche")
        .otherwise("too_small")
    )


def signup_signal(signups: DataFrame, launches: DataFrame, hours: int = 24) -> DataFrame:
    """Sign-ups in the first hours after each launch: strong, medium or weak.

    `launches` has launch and start; `signups` has ts and launch.  The sign-ups are joined
    to their launch by its key and counted with map-side combining.
    """
    end = F.col("start") + F.make_dt_interval(hours=F.lit(hours))
    within = (F.col("ts") >= F.col("start")) & (F.col("ts") < end)
    counts = (
        signups.join(launches, "launch").filter(within).groupBy("launch")
        .agg(F.count("*").alias("n"))
    )
    n = F.coalesce("n", F.lit(0))
    return launches.join(counts, "launch", "left").select(
        "launch",
        n.alias("signups"),
        F.when(n > SIGNUPS_STRONG, "strong").when(n >= SIGNUPS_MEDIUM, "medium").otherwise("weak")
        .alias("signal"),
    )


def patterns(mentions: DataFrame, by: str, minimum: int = PATTERN_OCCURRENCES) -> DataFrame:
    """Findings that occur often enough to count as a pattern."""
    return mentions.groupBy(by).agg(F.count("*").alias("occurrences")).filter(
        F.col("occurrences") >= minimum
    )
