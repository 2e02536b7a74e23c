"""Table maintenance as DataFrame operators: new rows, updates by key, look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelode.operators.collapse import first_per_key
from voicelode.operators.ranking import relevance_order

HISTORY_KEY = ["id", "platform"]


def missing_keys(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet.

    The stored table is cut down to the keys at hand first.  With a small batch those
    keys are broadcast (the optimizer decides by size), and the large stored table is
    scanned in place and not shuffled.
    """
    at_hand = rows.select(*keys).distinct()
    seen = stored.select(*keys).join(at_hand, keys, "left_semi")
    return rows.join(seen, keys, "left_anti")


def drop_processed(posts: DataFrame, history: DataFrame) -> DataFrame:
    """Posts that no earlier run has processed, by id and true platform."""
    return missing_keys(posts, history, HISTORY_KEY)


def new_posts(existing: DataFrame, batch: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The rows an insert-or-ignore adds: best-scored of each key, keys not stored yet."""
    keys = keys or ["id"]
    return first_per_key(missing_keys(batch, existing, keys), keys, relevance_order())


# what an insert writes where a post lacks a field
INSERT_DEFAULTS = dict.fromkeys(["title", "body", "author", "community", "created_raw", "topic"], "") | dict.fromkeys(
    ["points", "num_comments", "pain_score", "demand_score", "relevance_score"], 0
)


def with_insert_defaults(rows: DataFrame, kinds: dict[str, object]) -> DataFrame:
    """`rows` with the defaults of an insert for columns of `kinds` (name: type) that are missing; nulls stay."""
    missing = {c: F.lit(v).cast(kinds[c]) for c, v in INSERT_DEFAULTS.items() if c in kinds and c not in rows.columns}
    if "matched_queries" in kinds and "matched_queries" not in rows.columns:
        missing["matched_queries"] = F.array().cast(kinds["matched_queries"])
    return rows.withColumns(missing) if missing else rows


def merge_new_posts(
    existing: DataFrame, batch: DataFrame, keys: list[str] | None = None
) -> DataFrame:
    added = new_posts(existing, batch, keys)
    added = with_insert_defaults(added, {f.name: f.dataType for f in existing.schema.fields})
    return existing.unionByName(added, allowMissingColumns=True)


def new_history(history: DataFrame, posts: DataFrame, now: Column) -> DataFrame:
    """The history rows that are not there yet."""
    keys = posts.select(*HISTORY_KEY).distinct()
    return missing_keys(keys, history, HISTORY_KEY).withColumn("processed_at", now)


def extend_history(history: DataFrame, posts: DataFrame, now: Column) -> DataFrame:
    return history.unionByName(new_history(history, posts, now), allowMissingColumns=True)


def last_per_id(updates: DataFrame, columns: list[str], order: str | None) -> DataFrame:
    """One update per id: the last by the column `order`, or else by the rows' place in the table."""
    place = F.col(order) if order else F.monotonically_increasing_id()
    numbered = updates.select("id", F.struct(*columns).alias("update"), place.alias("place"))
    return numbered.groupBy("id").agg(F.max_by("update", "place").alias("update")).select("id", "update.*")


def apply_scores(posts: DataFrame, updates: DataFrame, order: str | None = None) -> DataFrame:
    """Overwrite scores and matched queries of the posts that have an update.

    `updates` has id, the three scores and matched_queries; an update replaces all four, and of
    several for one id the last counts.
    """
    columns = ["pain_score", "demand_score", "relevance_score", "matched_queries"]
    renamed = last_per_id(updates, columns, order).select(
        F.col("id"), F.lit(True).alias("_hit"), *[F.col(c).alias("_" + c) for c in columns]
    )
    joined = posts.join(renamed, "id", "left")
    replaced = {c: F.when(F.col("_hit"), F.col("_" + c)).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(replaced).select(*posts.columns)


def mark_analyzed(posts: DataFrame, results: DataFrame, order: str | None = None) -> DataFrame:
    """Set `analyzed` and the result text, or null, of the posts in `results`; the last result of an id counts."""
    renamed = last_per_id(results, ["analysis_result"], order).select(
        F.col("id"), F.lit(True).alias("_hit"), F.col("analysis_result").alias("_result")
    )
    joined = posts.join(renamed, "id", "left")
    return joined.withColumns(
        {
            "analyzed": F.coalesce("_hit", "analyzed", F.lit(False)),
            "analysis_result": F.when(F.col("_hit"), F.col("_result")).otherwise(
                F.col("analysis_result")
            ),
        }
    ).select(*posts.columns)


def posts_for_topic(posts: DataFrame, topic: str) -> DataFrame:
    """A topic's posts, best first.  The filter prunes the topic partitions."""
    return posts.filter(F.col("topic") == topic).orderBy(*relevance_order())


def top_unanalyzed(posts: DataFrame, topic: str, n: int = 50, min_score: float = 0.0) -> DataFrame:
    """A topic's best posts that have not been analyzed."""
    return (
        posts.filter(
            (F.col("topic") == topic)
            & ~F.coalesce("analyzed", F.lit(False))
            & (F.col("relevance_score") >= min_score)
        )
        .orderBy(*relevance_order())
        .limit(n)
    )


def latest_run(runs: DataFrame, topic: str | None = None) -> DataFrame:
    """The run with the highest id, of one topic or of all."""
    if topic:
        runs = runs.filter(F.col("topic") == topic)
    return runs.orderBy(F.col("id").desc()).limit(1)


def latest_run_per_topic(runs: DataFrame) -> DataFrame:
    rest = [c for c in runs.columns if c != "topic"]
    return runs.groupBy("topic").agg(F.max_by(F.struct(*rest), "id").alias("run")).select(
        "topic", "run.*"
    )


def next_run_id(runs: DataFrame) -> DataFrame:
    return runs.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))


def run_record(
    runs: DataFrame, topic: str, platforms: list[str], now: Column, posts_fetched: Column,
    posts_analyzed: Column, report_path: str,
) -> DataFrame:
    """The row a finished run adds to the runs table."""
    return next_run_id(runs).select(
        "id",
        F.lit(topic).alias("topic"),
        F.array(*map(F.lit, platforms)).alias("platforms"),
        now.alias("started_at"),
        now.alias("completed_at"),
        posts_fetched.cast("bigint").alias("posts_fetched"),
        posts_analyzed.cast("bigint").alias("posts_analyzed"),
        F.lit(report_path).alias("report_path"),
    )
