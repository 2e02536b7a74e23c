"""Landed payloads -> posts.

Each reader takes one row per response (see `schemas.PAYLOADS`) and returns one row
per hit, with `query` and `hit_seq`, the hit's place in arrival order.  Readers only
project, explode and filter, so they run inside the scan stage without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voicelode import schemas, values
from voicelode.functions.text import clean_html, strip, text_or_empty
from voicelode.functions.times import parse_time
from voicelode.functions.topics import topic_keywords
from voicelode.functions.urls import clean_url
from voicelode.operators.filters import filter_keywords

# A response holds fewer hits than this, so hit_seq keeps (response, position) order.
_HITS_PER_RESPONSE = 1 << 20
# A run numbers its responses from 0 below this, so the order of sources stays above that of hits.
_RESPONSES = 1 << 30


def read_payloads(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Landed JSON lines of one kind; unreadable lines become null rows, see `rejected_payloads`."""
    return spark.read.schema(schemas.PAYLOADS[kind]).option("mode", "PERMISSIVE").json(path)


def rejected_payloads(lines: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """The landed lines that cannot be read as payloads of their kind; blank lines are none."""
    schema = schemas.PAYLOADS[kind] + ", _unreadable string"
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unreadable"})
    # an array or a bare value is JSON, but no payload
    no_object = ~F.startswith(F.ltrim(F.col(column)), F.lit("{"))
    unreadable = F.coalesce(parsed["_unreadable"].isNotNull(), F.lit(True)) | no_object
    return lines.filter((F.trim(F.col(column)) != "") & unreadable)


def parse_payloads(lines: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """The same for lines already in a text column, for instance from a message source."""
    parsed = F.from_json(F.col(column), schemas.PAYLOADS[kind])
    return lines.select(parsed.alias("payload")).select("payload.*")


def _arrival(fetched_seq: Column, position: Column) -> Column:
    """The place of a hit in arrival order; numbers that would mix with those of other sources are refused."""
    outside = (fetched_seq < 0) | (fetched_seq >= _RESPONSES) | (position >= _HITS_PER_RESPONSE)
    refuse = F.raise_error(F.concat(F.lit("fetched_seq out of bounds: "), fetched_seq.cast("string")))
    return F.when(outside, refuse.cast("bigint")).otherwise(fetched_seq * _HITS_PER_RESPONSE + position)


def _hits(payloads: DataFrame, array: Column) -> DataFrame:
    return payloads.select(
        "topic", "query", "fetched_seq", F.posexplode(array).alias("hit_pos", "hit")
    )


def _post(hits: DataFrame, id_: Column, platform: str, **fields: Column) -> DataFrame:
    """Lay out the common post columns; a field that is not given takes its default."""
    blank, zero = F.lit(""), F.lit(0).cast("bigint")
    created = fields.get("created_raw", blank)
    return hits.select(
        id_.alias("id"),
        F.lit(platform).alias("platform"),
        fields.get("url", blank).alias("url"),
        text_or_empty(fields.get("title", blank)).alias("title"),
        text_or_empty(fields.get("body", blank)).alias("body"),
        text_or_empty(fields.get("author", blank)).alias("author"),
        text_or_empty(fields.get("community", blank)).alias("community"),
        F.coalesce(fields.get("points", zero), zero).alias("points"),
        F.coalesce(fields.get("num_comments", zero), zero).alias("num_comments"),
        text_or_empty(created).alias("created_raw"),
        parse_time(created).alias("created_at"),
        F.col("topic"),
        fields.get("website", F.lit(None).cast("string")).alias("website"),
        F.col("query"),
        _arrival(F.col("fetched_seq"), F.col("hit_pos")).alias("hit_seq"),
    )


def read_hn_comments(payloads: DataFrame) -> DataFrame:
    hit = F.col("hit")
    return _post(
        _hits(payloads, F.col("hits")),
        F.concat(F.lit("hn_"), hit["objectID"]),
        "hn",
        url=F.concat(F.lit("https://news.ycombinator.com/item?id="), hit["objectID"]),
        title=hit["story_title"],
        body=clean_html(hit["comment_text"]),
        author=hit["author"],
        community=F.lit("hn"),
        points=hit["points"],
        created_raw=hit["created_at"],
    )


def read_hn_stories(payloads: DataFrame, min_points: int = 2) -> DataFrame:
    """Stories; with a positive minimum only those with strictly more points."""
    hits = _hits(payloads, F.col("hits"))
    hit = F.col("hit")
    if min_points > 0:
        hits = hits.filter(hit["points"] > min_points)
    return _post(
        hits,
        F.concat(F.lit("hn_"), hit["objectID"]),
        "hn",
        url=F.concat(F.lit("https://news.ycombinator.com/item?id="), hit["objectID"]),
        title=hit["title"],
        author=hit["author"],
        community=F.lit("hn"),
        points=hit["points"],
        num_comments=hit["num_comments"],
        created_raw=hit["created_at"],
    )


def read_reddit_posts(payloads: DataFrame) -> DataFrame:
    hits = _hits(payloads, F.col("data.children")).filter(F.col("hit.kind") == "t3")
    post = F.col("hit.data")
    return _post(
        hits,
        F.concat(F.lit("reddit_"), post["id"]),
        "reddit",
        url=F.concat(F.lit("https://reddit.com"), post["permalink"]),
        title=post["title"],
        body=post["selftext"],
        author=F.coalesce(post["author"], F.lit("[deleted]")),
        community=post["subreddit"],
        points=post["score"],
        num_comments=post["num_comments"],
        created_raw=post["created_utc"],
    )


def read_reddit_comments(payloads: DataFrame, first: int = 5) -> DataFrame:
    """Top comments per post: of the first `first` children the real, readable comments."""
    children = F.slice(F.get("listings", F.lit(1))["data"]["children"], 1, first)
    readable = F.filter(
        children,
        lambda c: (c["kind"] == "t1")
        & ~text_or_empty(c["data"]["body"]).isin("", "[deleted]", "[removed]"),
    )
    return payloads.select(
        F.concat(F.lit("reddit_"), F.col("post_id")).alias("id"),
        "fetched_seq",
        F.transform(readable, lambda c: c["data"]["body"]).alias("comments"),
    )


def read_launch_posts(payloads: DataFrame, topic: str | None = None) -> DataFrame:
    """Launches; with a topic only those that hold one of its words."""
    hits = _hits(payloads, F.col("data.posts.edges"))
    node = F.col("hit.node")
    if topic is not None:
        text = [text_or_empty(node[name]) for name in ("name", "tagline", "description")]
        hits = filter_keywords(hits, F.concat_ws(" ", *text), topic_keywords(topic))
    lines = F.concat(
        text_or_empty(node["tagline"]), F.lit("\n"), text_or_empty(node["description"])
    )
    names = F.transform(node["topics"]["edges"], lambda t: t["node"]["name"])
    return _post(
        hits,
        F.concat(F.lit("ph_"), node["id"]),
        "producthunt",
        url=clean_url(text_or_empty(node["url"])),
        title=node["name"],
        body=strip(lines),
        community=F.array_join(F.slice(names, 1, 3), ", "),
        points=node["votesCount"],
        num_comments=node["commentsCount"],
        created_raw=node["createdAt"],
        website=text_or_empty(node["website"]),
    )


def read_launch_comments(payloads: DataFrame, first: int = 10) -> DataFrame:
    """The first comments of each launch, empty ones included."""
    edges = F.slice(F.col("data.post.comments.edges"), 1, first)
    return payloads.select(
        F.concat(F.lit("ph_"), F.col("post_id")).alias("id"),
        "fetched_seq",
        F.transform(edges, lambda e: text_or_empty(e["node"]["body"])).alias("comments"),
    )


def read_tweets(payloads: DataFrame) -> DataFrame:
    tweet = F.col("hit")
    metrics = tweet["public_metrics"]
    zero = F.lit(0).cast("bigint")
    return _post(
        _hits(payloads, F.col("data")),
        F.concat(F.lit("x_"), tweet["id"]),
        "twitter",
        url=F.concat(F.lit("https://x.com/i/status/"), tweet["id"]),
        body=tweet["text"],
        author=tweet["author_id"],
        community=F.lit("twitter"),
        points=F.coalesce(metrics["like_count"], zero)
        + F.coalesce(metrics["retweet_count"], zero),
        num_comments=metrics["reply_count"],
        created_raw=tweet["created_at"],
    )


COMMENT_STYLES = {
    "reddit": (values.REDDIT_COMMENT_HEADER, values.REDDIT_COMMENT_SEPARATOR),
    "producthunt": (values.LAUNCH_COMMENT_HEADER, values.LAUNCH_COMMENT_SEPARATOR),
}
