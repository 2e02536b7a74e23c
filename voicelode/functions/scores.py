"""Score expressions: engagement, length bonus, weighted score, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voicelode.settings import Settings


def engagement(points: Column) -> Column:
    """Logarithm of the points, at most 5; 0 without positive points."""
    points = F.coalesce(points, F.lit(0))
    return F.when(points > 0, F.least(F.log1p(points), F.lit(5.0))).otherwise(F.lit(0.0))


def length_bonus(text: Column) -> Column:
    """One per 500 characters, at most 2."""
    return F.least(F.length(text) / F.lit(500.0), F.lit(2.0))


def weighted_score(
    pain: Column, demand: Column, n_queries: Column, engaged: Column, length: Column,
    settings: Settings,
) -> Column:
    """Score before the topic multiplier.  The order of operations fixes the last bits."""
    return (
        F.lit(settings.pain_weight) * pain * 8
        + F.lit(settings.demand_weight) * demand * 15
        + F.lit(settings.cross_query_weight) * n_queries * 4
        + F.lit(settings.engagement_weight) * engaged * 2
        + length
    )


def round_cents(x: Column) -> Column:
    """Round a non-negative double to two places by its exact binary value, ties to even.

    Spark's `round` works on the shortest decimal text of a double, which moves values
    such as 2.675 (in binary just below the tie) upwards.  Here 100*x is compared with
    the tie without rounding error: x is split into a float part and a rest, both of
    which can be multiplied by 100 exactly.
    """
    cents = F.floor(x * 100.0)
    head = x.cast("float").cast("double")
    rest = x - head
    above = (head * 100.0 - (cents + F.lit(0.5))) + rest * 100.0
    up = (above > 0) | ((above == 0) & (cents % 2 == 1))
    return (cents + up.cast("int")) / F.lit(100.0)
