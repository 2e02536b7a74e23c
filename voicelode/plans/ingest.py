"""One load: drop processed posts, score, store, extend the history, raise alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelode.operators.scoring import score_posts
from voicelode.operators.tables import drop_processed, new_history, new_posts
from voicelode.scratch import materialize
from voicelode.settings import Settings
from voicelode.sources.store import PostStore


def ingest(
    posts: DataFrame,
    store: PostStore,
    load_id: str,
    now: Column,
    settings: Settings = Settings(),
    topic: str | None = None,
    written: bool = False,
) -> DataFrame:
    """Run one load and return its scored posts.

    `load_id` names the load in the store; see `sources.store.load_name`.  The same load can
    be run again: it looks only at what other loads stored and replaces its own rows.  Collected and scored posts are written down, so payloads are
    parsed once, posts are scored once, and the joins with the stored tables are planned
    from the size of the batch.  Of a store with many loads only those that may hold
    the batch's ids are read.  With `written`, the posts are read from a written table already.
    """
    posts = posts if written else materialize(posts, "collected", "zstd")
    history = store.holding("history", posts, but=load_id)
    fresh = drop_processed(posts, history)
    scored = score_posts(fresh, settings, topic=topic, own_topic=topic is None)
    scored = materialize(scored.withColumn("fetched_at", now), "scored", "zstd")

    stored = store.holding("posts", scored, but=load_id)
    store.write(new_posts(stored, scored), "posts", load_id)
    store.write(new_history(history, scored, now), "history", load_id)
    alerts = scored.filter(F.col("relevance_score") >= settings.min_score)
    store.write(alerts, "alerts", load_id)
    return scored


def revise(
    posts: DataFrame, store: PostStore, stream: str, load_id: str, now: Column, settings: Settings = Settings()
) -> DataFrame:
    """Score posts again that loads of the same stream have stored, and write them as their latest revision.

    `stream` is what the names of those loads begin with.  Posts that other runs have stored stay as they are.
    """
    stored = store.read("posts", but=load_id).filter(F.col("load_id").startswith(stream))
    own = posts.join(stored.select("id", "topic"), ["id", "topic"], "left_semi")
    scored = materialize(score_posts(own, settings, own_topic=True).withColumn("fetched_at", now), "revised", "zstd")
    store.write(scored, "revisions", load_id)
    store.write(scored.filter(F.col("relevance_score") >= settings.min_score), "raised", load_id)
    return scored
