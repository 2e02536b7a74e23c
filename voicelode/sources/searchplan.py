"""Search plan: which queries a topic is searched with, per platform and kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicelode import values

TEMPLATES: list[tuple[str, str, str, list[str]]] = (
    [("hn", "comment", t, []) for t in values.HN_COMMENT_TEMPLATES]
    + [("hn", "story", t, []) for t in values.HN_STORY_TEMPLATES]
    + [("reddit", "post", t, alts) for t, alts in values.REDDIT_TEMPLATES]
    + [("twitter", "tweet", t, alts) for t, alts in values.TWITTER_TEMPLATES]
)


def search_plan(topics: DataFrame, templates=None) -> DataFrame:
    """One row per topic and template.

    The templates are a fixed short list, so they are exploded from a literal array in
    the projection: no join, and the plan keeps the partitioning of `topics`.
    """
    templates = templates if templates is not None else TEMPLATES
    rows = F.array(*[
        F.struct(
            F.lit(platform).alias("platform"),
            F.lit(kind).alias("kind"),
            F.lit(template).alias("template"),
            (F.array(*map(F.lit, alts)) if alts else F.array().cast("array<string>"))
            .alias("alternatives"),
        )
        for platform, kind, template, alts in templates
    ])
    return topics.select("topic", F.posexplode(rows).alias("query_no", "t")).select(
        "topic",
        "query_no",
        "t.platform",
        "t.kind",
        F.replace(F.col("t.template"), F.lit("{topic}"), F.col("topic")).alias("query"),
        F.col("topic").alias("phrase"),
        "t.alternatives",
    )


def boolean_queries(plan: DataFrame) -> DataFrame:
    """The plan's boolean queries: a phrase and at least one of several alternatives."""
    return plan.filter(F.size("alternatives") > 0)
