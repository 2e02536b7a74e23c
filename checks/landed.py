"""Registered queries over payloads, responses and streams that Spark derives from the tables.

A landed response holds 30 hits.  Spark builds the JSON lines from `documents` and
`conversations`; the readers then parse them as they would parse landed files.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks import views
from checks.queries import (
    SELECTED_BY_TOPIC_SQL,
    batched_by_topic,
    big,
    clean_html_sql,
    joined,
    query,
)
from checks.views import SETTINGS, posts, table
from voicelode.operators import extract
from voicelode.operators.collapse import collapse_hits, first_per_key
from voicelode.scratch import drop_path, scratch_path
from voicelode.sources import imports, payloads
from voicelode.sources.store import PostStore
from voicelode.streaming.dedup import stream_dedup
from voicelode.streaming.ingest import read_stream, start_ingest

_PER_RESPONSE = 30
_DOCS_SQL = """land as (select *, concat('query ', cast(doc_id // 30 as varchar)) as query,
  (doc_id // 30) * 1048576 + row_number() over (partition by doc_id // 30 order by doc_id) - 1
  as hit_seq from documents)"""


def documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents")


def lines(docs: DataFrame, hit: Column, wrap, topic: str = "any") -> DataFrame:
    """JSON lines of responses: `hit` per document, `wrap` puts the hits into the payload."""
    response = F.floor(F.col("doc_id") / _PER_RESPONSE)
    grouped = docs.groupBy(response.alias("response")).agg(
        F.sort_array(F.collect_list(F.struct("doc_id", hit.alias("hit")))).alias("rows")
    )
    payload = F.struct(
        *wrap(F.col("rows.hit")),
        F.concat(F.lit("query "), F.col("response").cast("string")).alias("query"),
        F.lit(topic).alias("topic"),
        F.col("response").alias("fetched_seq"),
    )
    return grouped.select(F.to_json(payload).alias("value"))


def text_of(number: Column) -> Column:
    return number.cast("string")


def created() -> Column:
    day = F.lpad(text_of(1 + F.col("doc_id") % 28), 2, "0")
    return F.concat(F.lit("2024-01-"), day, F.lit("T00:00:00Z"))


CREATED_SQL = "1704067200 + (doc_id % 28) * 86400"


def out(df: DataFrame, *columns: str) -> DataFrame:
    plain = ["id", "url", "title", "body", "author", "community", "points", "num_comments"]
    return df.select(
        *plain, *columns, F.unix_seconds("created_at").alias("created"), "query", "hit_seq"
    )


@query(f"""with {_DOCS_SQL} select concat('hn_', cast(doc_id as varchar)) as id,
 concat('https://news.ycombinator.com/item?id=', cast(doc_id as varchar)) as url,
 concat('Story ', source) as title,
 {clean_html_sql("concat('<p>', text, ' &amp; <i>more</i>')")} as body, source as author,
 'hn' as community, case when doc_id % 7 = 0 then 0 else doc_id % 100 end as points,
 0 as num_comments, {CREATED_SQL} as created, query, hit_seq from land""")
def hn_comments(spark, sf):
    hit = F.struct(
        text_of(F.col("doc_id")).alias("objectID"),
        F.concat(F.lit("Story "), "source").alias("story_title"),
        F.concat(F.lit("<p>"), "text", F.lit(" &amp; <i>more</i>")).alias("comment_text"),
        F.col("source").alias("author"),
        F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 100).alias("points"),
        created().alias("created_at"),
    )
    landed = lines(documents(spark, sf), hit, lambda hits: [hits.alias("hits")])
    return out(payloads.read_hn_comments(payloads.parse_payloads(landed, "hn_comments")))


@query(f"""with {_DOCS_SQL} select concat('hn_', cast(doc_id as varchar)) as id,
 concat('https://news.ycombinator.com/item?id=', cast(doc_id as varchar)) as url,
 text as title, '' as body, source as author, 'hn' as community, doc_id % 10 as points,
 case when doc_id % 3 = 0 then 0 else doc_id % 50 end as num_comments, {CREATED_SQL} as created,
 query, hit_seq from land where doc_id % 10 > 2""")
def hn_stories(spark, sf):
    hit = F.struct(
        text_of(F.col("doc_id")).alias("objectID"),
        F.col("text").alias("title"),
        F.col("source").alias("author"),
        (F.col("doc_id") % 10).alias("points"),
        F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 50).alias("num_comments"),
        created().alias("created_at"),
    )
    landed = lines(documents(spark, sf), hit, lambda hits: [hits.alias("hits")])
    return out(payloads.read_hn_stories(payloads.parse_payloads(landed, "hn_stories"), 2))


@query(f"""with {_DOCS_SQL} select concat('reddit_', cast(doc_id as varchar)) as id,
 concat('https://reddit.com/r/', source, '/', cast(doc_id as varchar)) as url, source as title,
 text as body, case when doc_id % 5 = 0 then '[deleted]' else lang end as author,
 source as community, doc_id % 90 as points, doc_id % 40 as num_comments,
 1704067200 + doc_id as created, query, hit_seq from land where doc_id % 11 <> 0""")
def reddit_posts(spark, sf):
    doc = F.col("doc_id")
    hit = F.struct(
        F.when(doc % 11 == 0, "t1").otherwise("t3").alias("kind"),
        F.struct(
            text_of(doc).alias("id"),
            F.concat(F.lit("/r/"), "source", F.lit("/"), text_of(doc)).alias("permalink"),
            F.col("source").alias("title"),
            F.col("text").alias("selftext"),
            F.when(doc % 5 != 0, F.col("lang")).alias("author"),
            F.col("source").alias("subreddit"),
            (doc % 90).alias("score"),
            (doc % 40).alias("num_comments"),
            (F.lit(1704067200.0) + doc).alias("created_utc"),
        ).alias("data"),
    )
    landed = lines(
        documents(spark, sf), hit, lambda hits: [F.struct(hits.alias("children")).alias("data")]
    )
    return out(payloads.read_reddit_posts(payloads.parse_payloads(landed, "reddit_posts")))


def _talk(spark, sf, entry: Column) -> DataFrame:
    # a conversation stands for the comments of one post; a response holds the first ten
    talk = first_per_key(
        table(spark, sf, "conversations"), ["conv_id"], [F.col("turn").asc()], n=10
    )
    return talk.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", entry.alias("entry")))).alias("turns")
    ).select(text_of(F.col("conv_id")).alias("post_id"), F.col("turns.entry").alias("entries"))


_BODY_SQL = "case turn % 4 when 1 then '[deleted]' when 3 then '' else text end"


@query(f"""with t as (select conv_id, turn, {_BODY_SQL} as body, row_number() over
  (partition by conv_id order by turn) as n from conversations)
 select concat('reddit_', cast(conv_id as varchar)) as id, coalesce(array_to_string(
  list(body order by turn) filter (where n <= 5 and turn <> 2 and body not in ('', '[deleted]')),
  '|'), '') as comments from t group by conv_id""")
def reddit_comments(spark, sf):
    body = F.when(F.col("turn") % 4 == 1, "[deleted]").when(F.col("turn") % 4 == 3, "").otherwise(
        F.col("text")
    )
    kind = F.when(F.col("turn") == 2, "more").otherwise("t1")
    entry = F.struct(kind.alias("kind"), F.struct(body.alias("body")).alias("data"))
    listing = F.struct(F.struct(F.col("entries").alias("children")).alias("data"))
    landed = _talk(spark, sf, entry).select(
        F.to_json(F.struct("post_id", F.array(listing, listing).alias("listings"))).alias("value")
    )
    parsed = payloads.parse_payloads(landed, "reddit_comments")
    return payloads.read_reddit_comments(parsed).select("id", joined("comments").alias("comments"))


@query("""with t as (select conv_id, turn, case when turn % 3 = 1 then '' else text end as body,
  row_number() over (partition by conv_id order by turn) as n from conversations)
 select concat('ph_', cast(conv_id as varchar)) as id, array_to_string(
  list(body order by turn) filter (where n <= 10), '|') as comments from t group by conv_id""")
def launch_comments(spark, sf):
    body = F.when(F.col("turn") % 3 != 1, F.col("text"))
    entry = F.struct(F.struct(body.alias("body")).alias("node"))
    edges = F.struct(F.struct(F.struct(F.col("entries").alias("edges")).alias("comments")).alias("post"))
    landed = _talk(spark, sf, entry).select(
        F.to_json(F.struct("post_id", edges.alias("data"))).alias("value")
    )
    parsed = payloads.parse_payloads(landed, "launch_comments")
    return payloads.read_launch_comments(parsed).select("id", joined("comments").alias("comments"))




def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{views._SPACES}|{views._SPACES}$', '', 'g')"



@query(f"""with {_DOCS_SQL} select concat('ph_', cast(doc_id as varchar)) as id,
 concat('https://www.producthunt.com/posts/', cast(doc_id as varchar), '?k=1#t') as url,
 concat('Launch ', source) as title,
 {strip_sql("concat(case when doc_id % 2 = 0 then lang else '' end, chr(10), text)")} as body,
 '' as author, concat(source, ', ', lang, ', Tools') as community, doc_id % 70 as points,
 doc_id % 30 as num_comments, concat('https://', source, '.example') as website,
 {CREATED_SQL} as created, query, hit_seq from land
 where contains(lower(concat('Launch ', source, ' ', case when doc_id % 2 = 0 then lang else '' end,
  ' ', text)), 'ndnd') or contains(lower(text), 'einheit')""")
def launch_posts(spark, sf):
    doc = F.col("doc_id")
    names = [F.col("source"), F.col("lang"), F.lit("Tools"), F.lit("Fourth")]
    topic = F.array(*[F.struct(F.struct(n.alias("name")).alias("node")) for n in names])
    hit = F.struct(F.struct(
        text_of(doc).alias("id"),
        F.concat(F.lit("Launch "), "source").alias("name"),
        F.when(doc % 2 == 0, F.col("lang")).alias("tagline"),
        F.col("text").alias("description"),
        F.concat(
            F.lit("https://www.producthunt.com/posts/"), text_of(doc),
            F.lit("?utm_source=a&k=1&utm_medium=b#t"),
        ).alias("url"),
        (doc % 70).alias("votesCount"),
        (doc % 30).alias("commentsCount"),
        created().alias("createdAt"),
        F.concat(F.lit("https://"), "source", F.lit(".example")).alias("website"),
        F.struct(topic.alias("edges")).alias("topics"),
    ).alias("node"))

    def wrap(hits):
        return [F.struct(F.struct(hits.alias("edges")).alias("posts")).alias("data")]

    landed = lines(documents(spark, sf), hit, wrap)
    parsed = payloads.parse_payloads(landed, "launch_posts")
    return out(payloads.read_launch_posts(parsed, "ndnd einheit"), "website")


def tweet_lines(spark, sf) -> DataFrame:
    doc = F.col("doc_id")
    hit = F.struct(
        text_of(doc).alias("id"),
        F.col("text"),
        F.concat(F.lit("a"), text_of(doc % 50)).alias("author_id"),
        created().alias("created_at"),
        F.struct(
            (doc % 60).alias("like_count"),
            F.when(doc % 2 == 0, doc % 9).alias("retweet_count"),
            (doc % 20).alias("reply_count"),
        ).alias("public_metrics"),
    )
    return lines(documents(spark, sf), hit, lambda hits: [hits.alias("data")], views.TOPIC)


def land(found: DataFrame, path: str) -> None:
    """Write landed lines, which hold whole texts, as compressed files."""
    found.write.option("zlib.compress.level", "BEST_SPEED").text(path, compression="gzip")


_TWEET_SQL = f"""concat('x_', cast(doc_id as varchar)) as id,
 concat('https://x.com/i/status/', cast(doc_id as varchar)) as url, '' as title, text as body,
 concat('a', cast(doc_id % 50 as varchar)) as author, 'twitter' as community,
 doc_id % 60 + case when doc_id % 2 = 0 then doc_id % 9 else 0 end as points,
 doc_id % 20 as num_comments, {CREATED_SQL} as created"""


@query(f"with {_DOCS_SQL} select {_TWEET_SQL}, query, hit_seq from land")
def tweets(spark, sf):
    return out(payloads.read_tweets(payloads.parse_payloads(tweet_lines(spark, sf), "tweets")))


@query("""select case when doc_id % 3 = 0 then concat('own_', cast(doc_id as varchar))
  when doc_id % 3 = 1 then concat('x_', substr(md5(concat('https://x.com/', cast(doc_id as varchar)
   )), 1, 12)) else concat('import_', cast(doc_id as varchar)) end as id, 'x' as platform,
 case when doc_id % 3 = 1 then concat('https://x.com/', cast(doc_id as varchar)) else '' end as url,
 case when doc_id % 2 = 0 then source else substr(text, 1, 80) end as title, text as body,
 case when doc_id % 4 = 0 then doc_id % 9 when doc_id % 4 = 1 then doc_id % 7 else 0 end as points,
 case when doc_id % 5 < 3 then doc_id % 8 else 0 end as num_comments,
 1704067200 + (doc_id % 28) * 86400 as created, 'import' as matched_queries from documents""")
def posts_import(spark, sf):
    doc = F.col("doc_id")
    items = documents(spark, sf).select(
        F.when(doc % 3 == 0, F.concat(F.lit("own_"), text_of(doc))).alias("id"),
        F.when(doc % 3 == 1, F.concat(F.lit("https://x.com/"), text_of(doc))).alias("url"),
        F.when(doc % 2 == 0, F.col("source")).alias("title"),
        F.col("text").alias("body"),
        F.lit(None).cast("string").alias("author"),
        F.lit(None).cast("string").alias("community"),
        F.when(doc % 4 == 0, doc % 9).alias("points"),
        F.when(doc % 4 == 1, doc % 7).alias("likes"),
        F.when(doc % 5 == 0, doc % 8).alias("num_comments"),
        F.when(doc % 5 < 3, doc % 8).alias("replies"),
        F.when(doc % 2 == 0, created()).alias("created_at"),
        created().alias("date"),
        doc.alias("pos"),
        doc.alias("seq"),
    )
    return imports.normalise_import(items, views.TOPIC).select(
        "id", "platform", "url", "title", "body", "points", "num_comments",
        F.unix_seconds("created_at").alias("created"),
        joined("matched_queries").alias("matched_queries"),
    )


# --- model prompts and responses -------------------------------------------------------------


@query(f"""with {SELECTED_BY_TOPIC_SQL} select topic, cast((rank - 1) // 25 as bigint) as batch,
 cast((rank - 1) % 25 as bigint) as pos, url, title, substr(body, 1, 2000) as body, author,
 points, platform, community, cast(pain_score as bigint) as pain_score,
 cast(demand_score as bigint) as demand_score from selected""")
def build_prompts(spark, sf):
    # the posts are read back from the finished prompts
    prompts = extract.build_prompts(batched_by_topic(spark, sf), SETTINGS)
    part = F.substring_index("prompt", "\nPosts:\n", -1)
    schema = """array<struct<url:string, title:string, body:string, author:string, points:bigint,
     platform:string, community:string, pain_score:bigint, demand_score:bigint>>"""
    return prompts.select(
        "topic", big("batch"), F.posexplode(F.from_json(part, schema)).alias("pos", "post")
    ).select("topic", "batch", big("pos"), "post.*")


def counting_model():
    """Stands in for a model: one finding per prompt, and a failure for one topic."""

    def answer(prompt: str) -> str:
        if '"que los"' in prompt:
            raise RuntimeError("no answer")
        found = json.loads(prompt.split("\nPosts:\n")[-1])
        finding = {
            "description": f"{len(found)} posts", "unique_users": len(found),
            "source_urls": [p["url"] for p in found],
        }
        return "```json\n" + json.dumps([finding]) + "\n```"

    return answer


@query(f"""with {SELECTED_BY_TOPIC_SQL}, b as (select topic, (rank - 1) // 25 as batch,
  count(*) as n, array_to_string(list(url order by rank), '|') as urls from selected
  where topic <> 'que los' group by 1, 2)
 select row_number() over (order by topic, batch) as ord, topic, cast(batch as bigint) as batch,
  n || ' posts' as description, n as unique_users, urls as source_urls from b""")
def extract_points(spark, sf):
    found = extract.extract_points(batched_by_topic(spark, sf), counting_model(), SETTINGS)
    return found.select(
        "ord", "topic", big("batch"), "description", big("unique_users"),
        joined("source_urls").alias("source_urls"),
    )


def responses(spark, sf) -> DataFrame:
    """Responses of 25 findings each, in all the shapes a model answers in."""
    doc = F.col("doc_id")
    fields = F.to_json(F.struct(
        F.col("text").alias("description"),
        F.lit("pricing").alias("category"),
        ((doc % 5 + 1) * 1.0).alias("emotional_intensity"),
        (doc % 3 == 0).alias("payment_signal"),
        F.when(doc % 6 == 0, F.col("source")).alias("payment_quote"),
        (doc % 4).alias("unique_users"),
        F.array("source", "lang").alias("source_urls"),
    ))
    item = F.concat(
        F.expr("left(fields, length(fields) - 1)"),
        F.lit(',"representative_quotes":["'), "lang", F.lit('",{"text":"'), "source",
        F.lit('","url":"u"}]}'),
    )
    batch = F.floor(doc / 25).cast("int")
    grouped = documents(spark, sf).withColumn("fields", fields).groupBy(batch.alias("batch")).agg(
        F.sort_array(F.collect_list(F.struct("doc_id", item.alias("item")))).alias("rows")
    )
    array = F.concat(F.lit("["), F.array_join("rows.item", ","), F.lit("]"))
    shape = F.col("batch") % 7
    text = (
        F.when(shape == 0, array)
        .when(shape == 1, F.concat(F.lit("```json\n"), array, F.lit("\n```")))
        .when(shape == 2, F.concat(F.lit("\n json "), array, F.lit("\n")))
        .when(shape == 3, F.concat(F.expr("left(rows.item[0], length(rows.item[0]) - 9)")))
        .when(shape == 4, F.concat(F.lit("```\n"), array, F.lit("```  ")))
        .when(shape == 5, F.get("rows.item", 0))
    )
    return grouped.select(
        F.lit("t").alias("topic"), "batch", text.alias("response"),
        F.when(shape == 6, F.lit("timeout")).alias("error"),
    )


@query("""with d as (select *, doc_id // 25 as batch from documents)
 select row_number() over (order by doc_id) as ord, cast(batch as bigint) as batch,
  row_number() over (partition by batch order by doc_id) - 1 as pos, text as description,
  'pricing' as category, doc_id % 5 + 1 as emotional_intensity,
  doc_id % 3 = 0 as payment_signal, case when doc_id % 6 = 0 then source end as payment_quote,
  doc_id % 4 as unique_users, concat(lang, '|', source) as representative_quotes,
  concat(source, '|', lang) as source_urls from d where batch % 7 in (0, 1, 2, 4)""")
def parse_responses(spark, sf):
    return extract.parse_responses(responses(spark, sf)).select(
        "ord", big("batch"), big("pos"), "description", "category", big("emotional_intensity"),
        "payment_signal", "payment_quote", big("unique_users"),
        joined("representative_quotes").alias("representative_quotes"),
        joined("source_urls").alias("source_urls"),
    )


@query("""select distinct doc_id // 25 as batch, case when doc_id // 25 % 7 = 6 then 'timeout'
  else 'not a JSON array' end as reason from documents where doc_id // 25 % 7 in (3, 5, 6)""")
def rejected_responses(spark, sf):
    return extract.rejected_responses(responses(spark, sf)).select(big("batch"), "reason")


@query("""select doc_id, case doc_id % 6 when 1 then 'cut' when 2 then 'array' else 'text' end as kind
 from documents where doc_id % 6 in (1, 2, 3)""")
def rejected_payloads(spark, sf):
    """Every second tweet line is damaged in one of three ways."""
    whole = F.concat(F.lit('{"data":[{"id":"1","text":"'), F.regexp_replace("text", r"[\"\\\\\x00-\x1f]", " "), F.lit('"}]}'))
    n = F.col("doc_id") % 6
    damaged = F.when(n == 1, F.left(whole, F.length(whole) - 2)).when(n == 2, F.concat(F.lit("["), whole, F.lit("]")))
    damaged = damaged.when(n == 3, F.lit("no JSON")).when(n == 4, F.lit("  ")).otherwise(whole)
    lines = table(spark, sf, "documents").select("doc_id", damaged.alias("value"))
    kind = F.when(n == 1, "cut").when(n == 2, "array").otherwise("text")
    return payloads.rejected_payloads(lines, "tweets").select("doc_id", kind.alias("kind"))


@query("""select n, case n % 3 when 1 then 'not a JSON array' else 'broken JSON' end as reason
 from (select distinct doc_id % 12 as n from documents) where n % 3 <> 0""")
def rejected_imports(spark, sf):
    """Twelve files of items, an item a line: whole arrays, objects and arrays that were cut off."""
    folder = scratch_path(spark, "imports")
    docs = table(spark, sf, "documents").select((F.col("doc_id") % 12).alias("n"), "doc_id", "text")
    item = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body")))
    body = docs.select("n", F.col("doc_id").alias("place"), F.concat(item, F.lit(",")).alias("value"))
    numbers = docs.select("n").distinct()
    last = F.lit((1 << 62) + 1)
    heads = numbers.select("n", F.lit(-1).cast("long").alias("place"), F.when(F.col("n") % 3 == 1, '{"items":[').otherwise("[").alias("value"))
    # an object behind the last comma; cut-off arrays have no end
    ends = numbers.filter("n % 3 <> 2").select("n", last.alias("place"), F.when(F.col("n") % 3 == 1, '{"id":"end"}]}').otherwise('{"id":"end"}]').alias("value"))
    rows = body.unionByName(heads).unionByName(ends)
    # a task of its own for every file: a hash may put several into one
    rows = rows.repartitionById(12, F.col("n").cast("int")).sortWithinPartitions("n", "place")
    rows.select("value", F.col("n").alias("file_no")).write.option("lineSep", "\n").partitionBy("file_no").text(folder)
    return imports.rejected_imports(spark, folder).select(
        F.regexp_extract("file", r"file_no=(\d+)", 1).cast("bigint").alias("n"), "reason"
    )


@query("""select concat('x_', cast(doc_id as varchar)) as id, 'twitter' as platform from documents
 union all select concat('hn_', cast(doc_id as varchar)), 'hn' from documents""")
def stream_two_kinds(spark, sf):
    """Two streams of different payloads with default names fill one store."""
    store = PostStore(spark, scratch_path(spark, "store"))
    comments = lines(
        documents(spark, sf),
        F.struct(F.col("doc_id").cast("string").alias("objectID"), F.col("text").alias("comment_text")),
        lambda hits: [hits.alias("hits")],
    )
    for kind, landed_lines, reader in (
        ("tweets", tweet_lines(spark, sf), payloads.read_tweets),
        ("hn_comments", comments, payloads.read_hn_comments),
    ):
        landed, progress = scratch_path(spark, "landed"), scratch_path(spark, "progress")
        land(landed_lines, landed)
        start_ingest(
            read_stream(spark, landed, kind), reader, store, progress, settings=SETTINGS, keep="first"
        ).awaitTermination()
        # a stream that has ended needs neither its files nor its state
        drop_path(spark, landed)
        drop_path(spark, progress)
    seen = store.read("history").select("id", "platform")
    return store.read("posts").select("id", "platform").join(seen, ["id", "platform"])


# --- streams ---------------------------------------------------------------------------------


@query(f"""with posts as (select doc_id as seq, 1 as n_queries, '{views.TOPIC}' as topic,
  {_TWEET_SQL} from documents), {views.scored_sql(None)}
 select id, url, body, points, cast(pain_score as bigint) as pain_score,
  cast(demand_score as bigint) as demand_score, topic_relevance, relevance_score,
  relevance_score >= 5 as alert from scored""")
def stream_ingest(spark, sf):
    # the landed folder has four files, each of which becomes a micro-batch
    landed = scratch_path(spark, "landed")
    tweet_lines(spark, sf).repartition(4).write.text(landed)
    store = PostStore(spark, scratch_path(spark, "store"))
    stream = start_ingest(
        read_stream(spark, landed, "tweets", files_per_batch=1), payloads.read_tweets, store,
        scratch_path(spark, "progress"), settings=SETTINGS, keep="first",
    )
    stream.awaitTermination()
    alerts = store.read("alerts").select("id", F.lit(True).alias("raised"))
    return store.read("posts").join(alerts, "id", "left").select(
        "id", "url", "body", "points", big("pain_score"), big("demand_score"),
        "topic_relevance", "relevance_score", F.coalesce("raised", F.lit(False)).alias("alert"),
    )


@query(f"""with posts as (select doc_id as seq, 2 as n_queries, '{views.TOPIC}' as topic,
  {_TWEET_SQL} from documents), {views.scored_sql(None)}
 select id, body, points, concat('query ', cast(cast(replace(id, 'x_', '') as bigint) // 30 as varchar), '|later')
  as matched_queries, topic_relevance, relevance_score, relevance_score >= 5 as alert from scored""")
def stream_hits_over_batches(spark, sf):
    """Every post is hit by two queries in lines of their own, the later hit with another text; a quarter of the files is a micro-batch."""
    landed, progress = scratch_path(spark, "landed"), scratch_path(spark, "progress")
    first = payloads.parse_payloads(tweet_lines(spark, sf), "tweets")
    later = first.withColumns(
        {
            "query": F.lit("later"),
            "fetched_seq": F.col("fetched_seq") + 1000000,
            "data": F.transform("data", lambda d: d.withField("text", F.lit("later"))),
        }
    )
    files = max(1, spark.sparkContext.defaultParallelism // 4)  # of a micro-batch; a task reads each whole
    land(first.unionByName(later).select(F.to_json(F.struct("*")).alias("value")).repartition(4 * files), landed)
    store = PostStore(spark, scratch_path(spark, "store"))
    start_ingest(
        read_stream(spark, landed, "tweets", files_per_batch=files), payloads.read_tweets, store,
        progress, settings=SETTINGS, keep="all",
    ).awaitTermination()
    drop_path(spark, landed)
    drop_path(spark, progress)
    return store.read("posts").select(
        "id", "body", "points", joined("matched_queries").alias("matched_queries"), "topic_relevance", "relevance_score",
        (F.col("relevance_score") >= SETTINGS.min_score).alias("alert"),
    )


@query(f"""with {views.POSTS_SQL} select id, platform, cast(epoch(created_at) as bigint) as created
 from posts""")
def stream_dedup_posts(spark, sf):
    # every post lands twice
    landed, target = scratch_path(spark, "landed"), scratch_path(spark, "deduped")
    once = posts(spark, sf).select("id", "platform", "created_at")
    once.unionAll(once).repartition(4).write.parquet(landed)
    stream = spark.readStream.schema(once.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    writer = stream_dedup(stream, "400 days").writeStream.format("parquet").option("path", target)
    writer = writer.option("checkpointLocation", scratch_path(spark, "progress"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(once.schema).parquet(target).select(
        "id", "platform", F.unix_seconds("created_at").alias("created")
    )


@query(f"""with {_DOCS_SQL} select {_TWEET_SQL}, query as matched_queries, hit_seq as seq
 from land""")
def collapse_tweets(spark, sf):
    """Landed twice, the second time under other queries: the first landing stays."""
    parsed = payloads.parse_payloads(tweet_lines(spark, sf), "tweets")
    again = parsed.withColumn("query", F.lit("later")).withColumn(
        "fetched_seq", F.col("fetched_seq") + 1000000
    )
    hits = payloads.read_tweets(parsed.unionByName(again))
    found = collapse_hits(hits, keep="first")
    return found.select(
        "id", "url", "title", "body", "author", "community", "points", "num_comments",
        F.unix_seconds("created_at").alias("created"),
        joined("matched_queries").alias("matched_queries"), "seq",
    )
