"""Streaming removal of repeated posts."""

from __future__ import annotations

from pyspark.sql import DataFrame


def stream_dedup(posts: DataFrame, max_age: str = "180 days") -> DataFrame:
    """The first of each post (id, platform) within the age limit.

    The watermark bounds the state: keys older than the age limit are forgotten, and
    posts that old are not wanted anyway.
    """
    return posts.withWatermark("created_at", max_age).dropDuplicatesWithinWatermark(
        ["id", "platform"]
    )
