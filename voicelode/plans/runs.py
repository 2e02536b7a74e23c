"""Whole runs: search over landed payloads, import of a file, analysis of stored posts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicelode.operators.clusters import cluster_sources, leader_clusters, merge_clusters
from voicelode.operators.collapse import collapse_hits, enrich_with_comments, union_sources
from voicelode.operators.extract import extract_points
from voicelode.operators.filters import filter_max_age, requested_platforms
from voicelode.operators.ranking import assign_batches, select_for_analysis
from voicelode.operators.report import report_lines, report_name, write_report
from voicelode.operators.signals import cross_platform_clusters
from voicelode.operators.tables import posts_for_topic, run_record, top_unanalyzed
from voicelode.plans.ingest import ingest
from voicelode.scratch import materialize
from voicelode.settings import Settings
from voicelode.sources import payloads
from voicelode.sources.imports import read_import
from voicelode.sources.store import PostStore, load_name

ModelFn = Callable[[str], str]


@dataclass
class RunResult:
    scored: DataFrame
    points: DataFrame | None
    analyzed: int
    report_path: str


def collect_landed(
    spark: SparkSession, landed: str, topic: str, now: dt.datetime,
    settings: Settings = Settings(),
) -> DataFrame:
    """Posts of all landed payloads of a topic: collapsed per source, enriched, united."""

    def landed_payloads(kind):
        try:
            lines = payloads.read_payloads(spark, f"{landed}/{kind}", kind)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            lines = spark.createDataFrame([], payloads.schemas.PAYLOADS[kind])
        return lines.filter(F.col("topic") == topic)

    def enriched(posts, kind, platform):
        comments = (
            payloads.read_reddit_comments if platform == "reddit" else payloads.read_launch_comments
        )
        header, separator = payloads.COMMENT_STYLES[platform]
        return enrich_with_comments(
            posts, comments(landed_payloads(kind)), header, separator, settings.comment_threshold
        )

    def hn_comments():
        return collapse_hits(payloads.read_hn_comments(landed_payloads("hn_comments")))

    def hn_stories():
        lines = landed_payloads("hn_stories")
        return collapse_hits(payloads.read_hn_stories(lines, settings.min_points))

    def reddit():
        posts = collapse_hits(payloads.read_reddit_posts(landed_payloads("reddit_posts")))
        return enriched(posts, "reddit_comments", "reddit")

    def launches():
        hits = payloads.read_launch_posts(landed_payloads("launch_posts"), topic)
        recent = filter_max_age(hits, now, settings.max_age_days)
        return enriched(collapse_hits(recent, keep="first"), "launch_comments", "producthunt")

    def tweets():
        return collapse_hits(payloads.read_tweets(landed_payloads("tweets")), keep="first")

    # in the order of the sources; payloads of other platforms are not read
    sources = {"hn": [hn_comments, hn_stories], "reddit": [reddit], "producthunt": [launches], "twitter": [tweets]}
    wanted = requested_platforms(settings.platforms, settings.enabled)
    frames = [read() for platform, reads in sources.items() if platform in wanted for read in reads]
    return union_sources(frames or [hn_comments().limit(0)])


def merge_points(extracted: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Extracted findings -> merged findings with platforms and links."""
    assignment = materialize(
        leader_clusters(extracted, settings.similarity, scope="topic"), "assignment"
    )
    sources = cluster_sources(extracted, assignment)
    merged = merge_clusters(extracted, assignment, settings.quotes_kept)
    return cross_platform_clusters(merged, sources)


def _analyze(
    selected: DataFrame, store: PostStore, load_id: str, now: dt.datetime,
    settings: Settings, fn: ModelFn,
) -> tuple[DataFrame, int]:
    selected = materialize(selected, "selected")
    extracted = materialize(extract_points(assign_batches(selected, settings), fn, settings), "found")
    points = materialize(merge_points(extracted, settings), "points")
    marks = selected.select(
        "id", F.lit(None).cast("string").alias("analysis_result"), F.lit(now).alias("analyzed_at")
    )
    store.write(marks, "analyzed", load_id)
    return points, selected.count()


def _empty_points(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "ord bigint, platform_count int")


def _finish(
    posts: DataFrame, store: PostStore, load_id: str, topic: str, platforms: list[str],
    now: dt.datetime, out_dir: str, settings: Settings, fn: ModelFn | None, only_new: bool,
) -> RunResult | None:
    """The part that search and import share: store, analyze, report, run row.

    None when there is nothing to do: no post at all, or with `only_new` no new post.
    """
    spark = store.spark
    scored = ingest(posts, store, load_id, F.lit(now), settings, topic)
    if scored.isEmpty() and (only_new or posts.isEmpty()):
        return None
    points, analyzed = None, 0
    if fn is not None:
        points, analyzed = _analyze(
            select_for_analysis(scored, settings), store, load_id, now, settings, fn
        )
    lines = report_lines(
        topic, scored, points if points is not None else _empty_points(spark), now, analyzed,
        settings,
    )
    path = write_report(lines, f"{out_dir}/{report_name(topic, now.date())}", single_file=True)
    record = run_record(
        store.read("runs", but=load_id), topic, platforms, F.lit(now),
        F.lit(scored.count()), F.lit(analyzed), path,
    )
    store.write(record, "runs", load_id)
    return RunResult(scored, points, analyzed, path)


def run_search(
    spark: SparkSession, landed: str, store: PostStore, topic: str, out_dir: str,
    now: dt.datetime, load_id: str, settings: Settings = Settings(), fn: ModelFn | None = None,
) -> RunResult | None:
    """Search: landed payloads of a topic to scored posts, findings and report."""
    posts = collect_landed(spark, landed, topic, now, settings)
    return _finish(
        posts, store, load_name("search", topic, load_id), topic, list(settings.platforms), now, out_dir, settings, fn,
        only_new=False,
    )


def run_import(
    spark: SparkSession, path: str, store: PostStore, topic: str, out_dir: str,
    now: dt.datetime, load_id: str, platform: str = "x", settings: Settings = Settings(),
    fn: ModelFn | None = None,
) -> RunResult | None:
    """Import: a JSON array file to scored posts, findings and report."""
    posts = read_import(spark, path, topic, platform)
    return _finish(
        posts, store, load_name("import", topic, load_id), topic, [platform], now, out_dir, settings, fn, only_new=True
    )


def run_analysis(
    store: PostStore, topic: str, out_dir: str, now: dt.datetime, load_id: str, fn: ModelFn,
    settings: Settings = Settings(),
) -> RunResult | None:
    """Analysis of stored posts not analyzed yet; None when there are none."""
    selected = materialize(
        top_unanalyzed(store.posts(), topic, settings.max_analyzed, settings.min_score), "top"
    )
    if selected.isEmpty():
        return None
    points, analyzed = _analyze(
        selected, store, load_name("analysis", topic, load_id), now, settings, fn
    )
    stored = posts_for_topic(store.posts(), topic)
    lines = report_lines(topic, stored, points, now, None, settings)
    path = write_report(lines, f"{out_dir}/{report_name(topic, now.date())}", single_file=True)
    return RunResult(stored, points, analyzed, path)
