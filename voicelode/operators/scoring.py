"""Scoring of posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelode.functions.scores import engagement, length_bonus, round_cents, weighted_score
from voicelode.functions.text import count_terms, scoring_text
from voicelode.functions.topics import (
    TopicTerms,
    topic_relevance,
    topic_relevance_by_row,
    topic_terms,
)
from voicelode.settings import Settings


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add computed columns that later filters cannot repeat.

    A filter on a projected column is moved below the projection with a copy of the whole
    expression, so a filter on a score would scan the text for every term again.  As the
    fields of a one-element array the columns are made once per row, in generated code.
    """
    fields = [expr.alias(name) for name, expr in columns.items()]
    return df.select("*", F.inline(F.array(F.struct(*fields))))


def pain_demand_counts(posts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Add pain_score and demand_score."""
    text = F.col("_text")
    return compute_once(
        posts.withColumn("_text", scoring_text(F.col("title"), F.col("body"))),
        {
            "pain_score": count_terms(text, settings.pain_terms),
            "demand_score": count_terms(text, settings.demand_terms),
        },
    ).drop("_text")


def score_posts(
    posts: DataFrame,
    settings: Settings = Settings(),
    topic: str | None = None,
    own_topic: bool = False,
) -> DataFrame:
    """Add pain_score, demand_score, topic_relevance and relevance_score.

    With `topic` all posts are scored against that topic, with `own_topic` each against the topic
    it carries.  The terms are an expression of the topic, so both are one projection over the scan.
    """
    text = scoring_text(F.col("title"), F.col("body"))
    scored = posts.withColumn("_text", text)
    text = F.col("_text")
    if own_topic:
        terms = topic_terms(F.col("topic"))
        scored = compute_once(scored, {f"_{name}": expr for name, expr in terms.items()})
        graded = topic_relevance_by_row(text, F.col("_words"), F.col("_phrases"), F.col("_stems"))
        relevance = F.when(F.coalesce("topic", F.lit("")) == "", F.lit(1.0)).otherwise(graded)
    else:
        terms = TopicTerms.of(posts.sparkSession, topic) if topic else None
        relevance = topic_relevance(text, terms)
    n_queries = F.greatest(F.coalesce(F.size("matched_queries"), F.lit(0)), F.lit(0))
    scored = compute_once(
        scored,
        {
            "pain_score": count_terms(text, settings.pain_terms),
            "demand_score": count_terms(text, settings.demand_terms),
            "topic_relevance": relevance,
            "_queries": n_queries,
            "_engagement": engagement(F.col("points")),
            "_length": length_bonus(text),
        },
    )
    raw = weighted_score(
        F.col("pain_score"), F.col("demand_score"), F.col("_queries"), F.col("_engagement"),
        F.col("_length"), settings,
    )
    return scored.withColumn("relevance_score", round_cents(raw * F.col("topic_relevance"))).drop(
        "_text", "_words", "_phrases", "_stems", "_queries", "_engagement", "_length"
    )
