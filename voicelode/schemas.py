"""Explicit schemas of stored tables, landed payloads and model output, as DDL."""

from __future__ import annotations

# Stored tables -------------------------------------------------------------------

POST_FIELDS = """
    id string, platform string, url string, title string, body string, author string,
    community string, points bigint, num_comments bigint, created_raw string,
    created_at timestamp, topic string, matched_queries array<string>, website string,
    seq bigint
"""
SCORED_POST = (
    POST_FIELDS
    + """, pain_score int, demand_score int, relevance_score double,
    topic_relevance double, fetched_at timestamp, load_id string"""
)
HISTORY = "id string, platform string, processed_at timestamp, load_id string"
ANALYZED = "id string, analysis_result string, analyzed_at timestamp, load_id string"
RUNS = (
    "id bigint, topic string, platforms array<string>, started_at timestamp, "
    "completed_at timestamp, posts_fetched bigint, posts_analyzed bigint, "
    "report_path string, load_id string"
)

# Extracted findings ----------------------------------------------------------------

# What the model is asked for, read loosely: numbers and booleans arrive in several
# spellings, so they are read as text first and cast afterwards.
RESPONSE_ITEMS = (
    "array<struct<description:string, category:string, emotional_intensity:string, "
    "payment_signal:string, payment_quote:string, current_workaround:string, "
    "unique_users:string, representative_quotes:array<string>, source_urls:array<string>>>"
)

# Landed payloads: one JSON line per response ------------------------------------------
# `query`, `topic` and `fetched_seq` are written by whatever landed the response;
# `fetched_seq` is the arrival order of responses inside a run.

_LANDED = "query string, topic string, fetched_seq bigint"

HN_COMMENTS = (
    "hits array<struct<objectID:string, story_title:string, comment_text:string, "
    "author:string, points:bigint, created_at:string>>, nbHits bigint, " + _LANDED
)
HN_STORIES = (
    "hits array<struct<objectID:string, title:string, author:string, points:bigint, "
    "num_comments:bigint, created_at:string>>, nbHits bigint, " + _LANDED
)
REDDIT_POSTS = (
    "data struct<children:array<struct<kind:string, data:struct<id:string, permalink:string, "
    "title:string, selftext:string, author:string, subreddit:string, score:bigint, "
    "num_comments:bigint, created_utc:string>>>>, " + _LANDED
)
REDDIT_COMMENTS = (
    "post_id string, listings array<struct<data:struct<children:array<struct<kind:string, "
    "data:struct<body:string>>>>>>, " + _LANDED
)
LAUNCH_POSTS = (
    "data struct<posts:struct<edges:array<struct<node:struct<id:string, name:string, "
    "tagline:string, description:string, url:string, votesCount:bigint, commentsCount:bigint, "
    "createdAt:string, website:string, "
    "topics:struct<edges:array<struct<node:struct<name:string, slug:string>>>>>>>, "
    "pageInfo:struct<hasNextPage:boolean, endCursor:string>>>, " + _LANDED
)
LAUNCH_COMMENTS = (
    "post_id string, data struct<post:struct<comments:struct<edges:array<struct<node:struct<"
    "id:string, body:string, votesCount:bigint, createdAt:string>>>>>>, " + _LANDED
)
TWEETS = (
    "data array<struct<id:string, text:string, author_id:string, created_at:string, "
    "public_metrics:struct<like_count:bigint, retweet_count:bigint, reply_count:bigint>>>, "
    "meta struct<result_count:bigint>, " + _LANDED
)
IMPORT_ITEM = (
    "id string, url string, title string, body string, author string, community string, "
    "points bigint, likes bigint, num_comments bigint, replies bigint, created_at string, "
    "date string"
)

PAYLOADS = {
    "hn_comments": HN_COMMENTS,
    "hn_stories": HN_STORIES,
    "reddit_posts": REDDIT_POSTS,
    "reddit_comments": REDDIT_COMMENTS,
    "launch_posts": LAUNCH_POSTS,
    "launch_comments": LAUNCH_COMMENTS,
    "tweets": TWEETS,
}
