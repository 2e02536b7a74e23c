"""Registered queries over posts, hits and tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from checks.views import POSTS_SQL, SETTINGS, TOPIC, posts, table
from voicelode import values
from voicelode.functions import text as text_functions
from voicelode.functions import topics as topic_functions
from voicelode.functions import urls as url_functions
from voicelode.operators import collapse, filters, ranking, report, scoring, tables
from voicelode.scratch import materialize, scratch_path
from voicelode.sources.searchplan import TEMPLATES, search_plan
from voicelode.sources.store import PostStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def joined(col: str | Column) -> Column:
    return F.array_join(col, "|")


def big(col: str) -> Column:
    return F.col(col).cast("bigint").alias(col)


# --- search plan and topics ---------------------------------------------------------------

_TOPIC_EXPR = """concat('The ', p_name, ' ', lower(p_type), case p_partkey % 5
 when 0 then ' AI video tools' when 1 then ' for SaaS' when 2 then ' class' else '' end)"""


def part_topics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.expr(_TOPIC_EXPR).alias("topic")).distinct()


TOPICS_SQL = f"topics as (select distinct {_TOPIC_EXPR} as topic from part)"
_TEMPLATES_SQL = "templates(query_no, platform, kind, template) as (values " + ", ".join(
    f"({n}, '{p}', '{k}', '" + t.replace("'", "''") + "')"
    for n, (p, k, t, _) in enumerate(TEMPLATES)
) + ")"


@query(f"""with {TOPICS_SQL}, {_TEMPLATES_SQL}
 select topic, cast(query_no as bigint) as query_no, platform, kind,
  replace(template, '{{topic}}', topic) as query from topics cross join templates""",
       name="search_plan")
def search_plan_query(spark, sf):
    plan = search_plan(part_topics(spark, sf))
    return plan.select("topic", big("query_no"), "platform", "kind", "query")


@query(f"""with {TOPICS_SQL}, {views.terms_sql('topics')} select topic,
  array_to_string(words, '|') as words, array_to_string(phrases, '|') as phrases,
  array_to_string(stems, '|') as stems from terms""")
def topic_keywords(spark, sf):
    terms = topic_functions.topic_terms(F.col("topic"))
    return part_topics(spark, sf).select(
        "topic", *[joined(expr).alias(name) for name, expr in terms.items()]
    )


_SLUGS_SQL = ", ".join(
    f"('{w}', {views._list_sql(s)})" for w, s in values.TOPIC_SLUGS.items()
)


@query(f"""with {TOPICS_SQL}, slugs(word, names) as (values {_SLUGS_SQL}),
 known as (select topic, flatten(list(names)) as names from (select distinct topic,
   unnest(regexp_extract_all(lower(topic), '[a-z]+')) as word from topics)
  join slugs using (word) group by topic)
 select topic, array_to_string(list_sort(list_distinct(coalesce(names,
  {views._list_sql(values.DEFAULT_SLUGS)}))), '|') as slugs
 from topics left join known using (topic)""")
def topic_slugs(spark, sf):
    return part_topics(spark, sf).select(
        "topic", joined(topic_functions.topic_slugs(F.col("topic"))).alias("slugs")
    )


# --- clean-up ------------------------------------------------------------------------------

_STRIP = "[\\x{09}-\\x{0d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}" \
    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def clean_html_sql(col: str) -> str:
    chain = f"coalesce({col}, '')"
    for entity, char in values.COMMON_ENTITIES:
        chain = f"replace({chain}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    chain = f"regexp_replace(replace({chain}, '<p>', chr(10)), '<[^>]+>', '', 'g')"
    return f"regexp_replace({chain}, '^{_STRIP}|{_STRIP}$', '', 'g')"


@query(f"select page_id, {clean_html_sql('html')} as text from pages")
def clean_html(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", text_functions.clean_html(F.col("html")).alias("text"))


# URLs with fragments, repeated names, flags, empty parts and question marks inside values
_URLS_SQL = """select page_id, case page_id % 5 when 0 then url when 1 then concat(url, '#/p?utm_source=x&k=1')
  when 2 then concat(url, case when contains(url, '?') then '&' else '?' end,
   'k=1&flag&k=2&&utm_a=3&j=a%20b+c~*') when 3 then concat(url, '?k=1?utm_source=2') else concat(url, '#') end as url
 from {pages}"""


def clean_url_sql(col: str) -> str:
    # path, query and fragment are taken apart; the twin does not rely on the same functions
    head = f"split_part({col}, '#', 1)"
    query = f"case when contains({head}, '?') then substr({head}, position('?' in {head}) + 1) else '' end"
    fragment = f"case when contains({col}, '#') then substr({col}, position('#' in {col}) + 1) else '' end"
    pairs = f"""list_filter(list_transform(list_filter(string_split({query}, '&'), lambda p: p <> ''),
  lambda p: [url_decode(replace(split_part(p, '=', 1), '+', ' ')),
   url_decode(replace(case when contains(p, '=') then substr(p, position('=' in p) + 1) else '' end, '+', ' '))]),
  lambda p: not starts_with(p[1], 'utm_'))"""
    # a stable sort by the first place of the name keeps repeated names together
    ordered = f"""list_transform(list_sort(list_transform({pairs}, lambda p, i:
  {{'at': list_position(list_transform({pairs}, lambda q: q[1]), p[1]), 'i': i, 'p': p}})), lambda x: x.p)"""
    kept = f"""array_to_string(list_transform({ordered}, lambda p: concat(replace(url_encode(p[1]), '%20', '+'), '=',
  replace(url_encode(p[2]), '%20', '+'))), '&')"""
    return f"""concat(split_part({head}, '?', 1), case when {kept} <> '' then concat('?', {kept}) else '' end,
  case when {fragment} <> '' then concat('#', {fragment}) else '' end)"""


@query(f"with u as ({_URLS_SQL.format(pages='pages')}) select page_id, {clean_url_sql('url')} as url from u")
def clean_urls(spark, sf):
    pages = spark.sql(_URLS_SQL.format(pages="{pages}"), pages=table(spark, sf, "pages"))
    return pages.select("page_id", url_functions.clean_url(F.col("url")).alias("url"))


@query(f"""with {POSTS_SQL} select id, {views.platform_sql('url')} as platform from (
  select id, url from posts union all select concat('p', cast(page_id as varchar)), url from pages)
 u""")
def platform_of_url(spark, sf):
    pages = table(spark, sf, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), "url"
    )
    urls = posts(spark, sf).select("id", "url").unionAll(pages)
    return urls.select("id", url_functions.platform_of_url(F.col("url")).alias("platform"))


# --- filters ---------------------------------------------------------------------------------


@query(f"""with {POSTS_SQL} select id, platform from posts
 where platform in ('hn', 'producthunt')""")
def select_platforms(spark, sf):
    chosen = filters.select_platforms(
        posts(spark, sf), ("hn", "producthunt", "twitter"), {"twitter": False}
    )
    return chosen.select("id", "platform")


@query(f"""with {POSTS_SQL} select id from posts where
 contains(lower(concat(title, ' ', body)), 'ndnd') or contains(lower(concat(title, ' ', body)),
  'einheit') or contains(lower(concat(title, ' ', body)), 'que')""")
def keyword_filter(spark, sf):
    words = topic_functions.topic_keywords("a Ndnd-Einheit 7 QUE")
    text = F.concat_ws(" ", "title", "body")
    return filters.filter_keywords(posts(spark, sf), text, words).select("id")


@query(f"""with {POSTS_SQL} select id, cast(epoch(created_at) as bigint) as created from posts
 where created_at >= timestamp '2024-12-31' - interval 180 days""")
def max_age(spark, sf):
    recent = filters.filter_max_age(posts(spark, sf), views.AS_OF, 180)
    return recent.select("id", F.unix_seconds("created_at").alias("created"))


@query(f"with {POSTS_SQL} select id from posts where lang = 'en' and not is_repost")
def lang_filter(spark, sf):
    return filters.filter_lang_original(posts(spark, sf)).select("id")


# --- matching and collapsing --------------------------------------------------------------------


def matches(spark, sf) -> DataFrame:
    return filters.match_queries(posts(spark, sf), views.queries_frame(spark))


@query(f"""with {POSTS_SQL}, {views.MATCHES_SQL} select id, seq, query,
 cast(query_no as bigint) as query_no from matches""")
def match_queries(spark, sf):
    return matches(spark, sf).select("id", "seq", "query", big("query_no"))


# every row of `part` is a query: letters of part names, with an empty, a null and repeated phrases
_MANY_SQL = """select cast(p_partkey as bigint) as query_no, concat('q', cast(p_partkey % 290 as varchar(20))) as query,
 case when p_partkey = 1 then '' when p_partkey = 2 then null
  else substring(p_name, cast(p_partkey % 7 as int) + 1, cast(3 + p_partkey % 3 as int)) end
  as phrase, substring(p_name, 1, 1) as one, 'license' as two from {part}"""


@query(f"""with {POSTS_SQL}, q as ({_MANY_SQL.format(part='part')})
 select id, seq, query, query_no from posts p join q
  on contains(lower(concat(p.title, ' ', p.body)), lower(q.phrase))
  and (contains(lower(concat(p.title, ' ', p.body)), lower(one)) or
   contains(lower(concat(p.title, ' ', p.body)), two))""")
def match_queries_anchored(spark, sf):
    """A query table that is larger than a person writes; the name is that of an earlier form."""
    queries = spark.sql(_MANY_SQL.format(part="{part}"), part=table(spark, sf, "part"))
    queries = queries.withColumn("alternatives", F.array("one", "two"))
    return filters.match_queries(posts(spark, sf), queries).select("id", "seq", "query", "query_no")


@query(f"""with {POSTS_SQL}, {views.HITS_SQL} select topic, id, min_by(title, hit_seq) as title,
  min_by(points, hit_seq) as points, array_to_string(list(query order by hit_seq), '|')
  as matched_queries, min(hit_seq) as seq from hits group by topic, id""")
def collapse_hits_all(spark, sf):
    found = collapse.collapse_hits(views.hits(matches(spark, sf)))
    return found.select(
        "topic", "id", "title", "points", joined("matched_queries").alias("matched_queries"), "seq"
    )


@query(f"""with {POSTS_SQL}, {views.HITS_SQL} select topic, id, min_by(title, hit_seq) as title,
  min_by(points, hit_seq) as points, min_by(query, hit_seq) as matched_queries,
  min(hit_seq) as seq from hits group by topic, id""")
def collapse_hits_first(spark, sf):
    found = collapse.collapse_hits(views.hits(matches(spark, sf)), keep="first")
    return found.select(
        "topic", "id", "title", "points", joined("matched_queries").alias("matched_queries"), "seq"
    )


@query(f"""with {POSTS_SQL} select author, id, points, seq from (select *, row_number() over
 (partition by author order by points desc, seq) as n from posts) where n = 1""")
def first_per_key(spark, sf):
    best = collapse.first_per_key(
        posts(spark, sf), ["author"], [F.col("points").desc(), F.col("seq").asc()]
    )
    return best.select("author", "id", "points", "seq")


@query(f"""with {POSTS_SQL} select 'hn' as platform, id, cast(null as varchar) as website, seq
  from posts where platform = 'hn' union all
 select 'producthunt', concat('ph_', cast(page_id as varchar)), url,
  1125899906842624 + page_id from pages union all
 select platform, id, null, 2251799813685248 + seq from posts where platform = 'producthunt' union all
 select platform, id, null, 3377699720527872 + seq from posts where platform = 'reddit' union all
 select platform, id, null, 4503599627370496 + seq from posts where platform = 'twitter'""")
def union_sources(spark, sf):
    own = posts(spark, sf).select("platform", "id", "seq")
    launches = table(spark, sf, "pages").select(
        F.lit("producthunt").alias("platform"),
        F.concat(F.lit("ph_"), F.col("page_id").cast("string")).alias("id"),
        F.col("url").alias("website"),
        F.col("page_id").alias("seq"),
    )
    others = [own.filter(F.col("platform") == p) for p in ("producthunt", "reddit", "twitter")]
    return collapse.union_sources([own.filter("platform = 'hn'"), launches, *others]).select(
        "platform", "id", "website", "seq"
    )


def _enriched_sql(header: str, separator: str) -> str:
    quoted = ["' || chr(10) || '".join(x.split("\n")) for x in (header, separator)]
    return f"""with {POSTS_SQL}, extra as (select concat('doc_', cast(conv_id as varchar)) as id,
  array_to_string(list(text order by turn, text), '{quoted[1]}') as comments
  from conversations group by conv_id)
 select id, case when num_comments >= 10 and comments <> '' then body || '{quoted[0]}' || comments else body end as body
 from posts left join extra using (id)"""


def _enriched(spark, sf, header: str, separator: str) -> DataFrame:
    talk = table(spark, sf, "conversations")
    comments = talk.groupBy(
        F.concat(F.lit("doc_"), F.col("conv_id").cast("string")).alias("id")
    ).agg(
        F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("turns"),
        F.lit(0).alias("fetched_seq"),
    ).select("id", "fetched_seq", F.col("turns.text").alias("comments"))
    return collapse.enrich_with_comments(posts(spark, sf), comments, header, separator).select("id", "body")


@query(_enriched_sql(values.REDDIT_COMMENT_HEADER, values.REDDIT_COMMENT_SEPARATOR))
def enrich_with_comments(spark, sf):
    return _enriched(spark, sf, values.REDDIT_COMMENT_HEADER, values.REDDIT_COMMENT_SEPARATOR)


@query(_enriched_sql(values.LAUNCH_COMMENT_HEADER, values.LAUNCH_COMMENT_SEPARATOR))
def enrich_launches(spark, sf):
    return _enriched(spark, sf, values.LAUNCH_COMMENT_HEADER, values.LAUNCH_COMMENT_SEPARATOR)


# --- scoring and ranking --------------------------------------------------------------------------


def scored(spark, sf) -> DataFrame:
    return scoring.score_posts(posts(spark, sf), SETTINGS, topic=TOPIC)


def scored_by_topic(spark, sf) -> DataFrame:
    base = posts(spark, sf)
    return scoring.score_posts(base, SETTINGS, own_topic=True)


SCORED_SQL = f"{POSTS_SQL}, {views.scored_sql()}"
BY_TOPIC_SQL = f"{POSTS_SQL}, {views.scored_sql(None)}"
_SCORES = """id, cast(pain_score as bigint) as pain_score,
 cast(demand_score as bigint) as demand_score, topic_relevance, relevance_score"""


def _scores(df: DataFrame) -> DataFrame:
    return df.select(
        "id", big("pain_score"), big("demand_score"), "topic_relevance", "relevance_score"
    )


def _counts_sql(pain, demand) -> str:
    return f"""with {POSTS_SQL}, {views.scored_sql(TOPIC, pain, demand)}
 select id, cast(pain_score as bigint) as pain_score,
  cast(demand_score as bigint) as demand_score from scored"""


@query(_counts_sql(values.PAIN_TERMS, values.DEMAND_TERMS))
def pain_demand_counts(spark, sf):
    counted = scoring.pain_demand_counts(posts(spark, sf))
    return counted.select("id", big("pain_score"), big("demand_score"))


@query(f"with {BY_TOPIC_SQL} select id, topic, topic_relevance from scored")
def topic_relevance(spark, sf):
    return scored_by_topic(spark, sf).select("id", "topic", "topic_relevance")


@query(f"with {SCORED_SQL} select {_SCORES} from scored")
def score_posts(spark, sf):
    return _scores(scored(spark, sf))


@query(f"with {BY_TOPIC_SQL} select {_SCORES} from scored")
def score_posts_by_topic(spark, sf):
    return _scores(scored_by_topic(spark, sf))


@query(f"""with {SCORED_SQL} select id, relevance_score,
 row_number() over (order by relevance_score desc, seq) as rank from scored""")
def rank_posts(spark, sf):
    return ranking.rank_table(scored(spark, sf)).select("id", "relevance_score", "rank")


@query(f"""with {BY_TOPIC_SQL} select id, relevance_score, seq from scored
 where topic = '{TOPIC}'""")
def posts_for_topic(spark, sf):
    return tables.posts_for_topic(scored_by_topic(spark, sf), TOPIC).select(
        "id", "relevance_score", "seq"
    )


def with_analyzed(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"analyzed": F.col("seq") % 3 == 0, "analysis_result": F.lit(None).cast("string")}
    )


@query(f"""with {BY_TOPIC_SQL} select id, relevance_score from scored where topic = '{TOPIC}'
 and seq % 3 <> 0 and relevance_score >= 2 order by relevance_score desc, seq limit 50""")
def top_unanalyzed(spark, sf):
    top = tables.top_unanalyzed(with_analyzed(scored_by_topic(spark, sf)), TOPIC, 50, 2.0)
    return top.select("id", "relevance_score")


SELECTED_SQL = f"""{SCORED_SQL}, selected as (select *, row_number() over
  (order by relevance_score desc, seq) as rank from scored where relevance_score >= 5
  order by rank limit 50)"""
SELECTED_BY_TOPIC_SQL = f"""{BY_TOPIC_SQL}, selected as (select * from (select *, row_number()
  over (partition by topic order by relevance_score desc, seq) as rank from scored
  where relevance_score >= 5) where rank <= 50)"""


def batched(spark, sf) -> DataFrame:
    return ranking.assign_batches(ranking.select_for_analysis(scored(spark, sf), SETTINGS), SETTINGS)


def batched_by_topic(spark, sf) -> DataFrame:
    selected = ranking.select_for_analysis(scored_by_topic(spark, sf), SETTINGS, per="topic")
    return ranking.assign_batches(selected, SETTINGS, per="topic")


@query(f"with {SELECTED_SQL} select id, relevance_score from selected")
def select_for_analysis(spark, sf):
    selected = ranking.select_for_analysis(scored(spark, sf), SETTINGS)
    return selected.select("id", "relevance_score")


@query(f"""with {SELECTED_SQL} select id, cast(rank as bigint) as rank,
 cast((rank - 1) // 25 as bigint) as batch from selected""")
def assign_batches(spark, sf):
    return batched(spark, sf).select("id", big("rank"), big("batch"))


@query(f"""with {SELECTED_BY_TOPIC_SQL} select topic, id, cast(rank as bigint) as rank,
 cast((rank - 1) // 25 as bigint) as batch from selected""")
def assign_batches_by_topic(spark, sf):
    return batched_by_topic(spark, sf).select("topic", "id", big("rank"), big("batch"))


@query(f"""with {SELECTED_SQL} select url, title, substr(body, 1, 2000) as body, author, points,
 platform, community, cast(pain_score as bigint) as pain_score,
 cast(demand_score as bigint) as demand_score from selected""")
def analysis_payload(spark, sf):
    payload = ranking.analysis_payload(batched(spark, sf), SETTINGS)
    return payload.withColumns(
        {c: F.col(c).cast("bigint") for c in ("pain_score", "demand_score")}
    )


# --- table maintenance ----------------------------------------------------------------------------


def history(spark, sf) -> DataFrame:
    return posts(spark, sf).filter("seq % 5 = 0").select(
        "id", "platform", F.lit("before").alias("processed_at")
    )


HISTORY_SQL = "history as (select id, platform, 'before' as processed_at from posts where seq % 5 = 0)"


@query(f"""with {POSTS_SQL}, {HISTORY_SQL} select id, platform from posts
 where (id, platform) not in (select (id, platform) from history)""")
def drop_processed(spark, sf):
    return tables.drop_processed(posts(spark, sf), history(spark, sf)).select("id", "platform")


@query(f"""with {POSTS_SQL} select id, platform from posts where not is_repost""")
def drop_stored(spark, sf):
    """Reposts are stored, one load a platform; filters of the loads choose the folders that a load of all posts reads."""
    store = PostStore(spark, scratch_path(spark, "store"), few=0)
    own = materialize(posts(spark, sf).select("id", "platform", "is_repost"), "posts")
    for platform in ("hn", "reddit", "producthunt", "twitter"):
        store.write(own.filter((F.col("platform") == platform) & F.col("is_repost")), "history", platform)
    return tables.drop_processed(own, store.holding("history", own)).select("id", "platform")


@query(f"""with {POSTS_SQL} select id, platform, platform as load_id from posts where platform <> 'reddit'
 union all select id, platform, platform from posts where platform = 'reddit' and not is_repost""")
def compacted_store(spark, sf):
    """All posts, one load a platform, compacted; then one load is written anew with fewer rows, and all is compacted again."""
    store = PostStore(spark, scratch_path(spark, "store"))
    own = materialize(posts(spark, sf).select("id", "platform", "is_repost"), "posts")
    for platform in ("hn", "reddit", "producthunt", "twitter"):
        store.write(own.filter(F.col("platform") == platform), "history", platform)
    store.compact("history")
    store.write(own.filter("platform = 'reddit' and not is_repost"), "history", "reddit")
    store.compact("history")
    return store.read("history").select("id", "platform", "load_id")


# The batch holds every second post twice under one id, the copies with other scores.
_BATCH_SQL = """stored as (select id, relevance_score, seq from scored where seq % 3 = 0),
 batch as (select id, relevance_score, seq from scored union all
  select id, relevance_score + seq % 7, seq + 1000000 from scored where seq % 2 = 0)"""


def _stored_and_batch(spark, sf):
    rows = materialize(scored(spark, sf).select("id", "relevance_score", "seq"), "scores")
    copies = rows.filter("seq % 2 = 0").select(
        "id", (F.col("relevance_score") + F.col("seq") % 7).alias("relevance_score"),
        (F.col("seq") + 1000000).alias("seq"),
    )
    return rows.filter("seq % 3 = 0"), rows.unionAll(copies)


@query(f"""with {SCORED_SQL}, {_BATCH_SQL} select * from stored union all
 select id, relevance_score, seq from (select *, row_number() over (partition by id
  order by relevance_score desc, seq) as n from batch where id not in (select id from stored))
 where n = 1""")
def merge_new_posts(spark, sf):
    stored, batch = _stored_and_batch(spark, sf)
    return tables.merge_new_posts(stored, batch).select("id", "relevance_score", "seq")


@query(f"""with {SCORED_SQL} select id,
 cast(case when seq % 4 = 0 then pain_score + 1 else pain_score end as bigint) as pain_score,
 case when seq % 4 = 0 then 0e0 else relevance_score end as relevance_score,
 case when seq % 4 = 0 then 'again' else array_to_string(list_transform(range(1, n_queries + 1),
  lambda i: concat('q', cast(i as varchar))), '|') end as matched_queries from scored""")
def apply_scores(spark, sf):
    stored = scored(spark, sf)
    # every update comes twice, the one that counts has the higher number
    updates = stored.filter("seq % 4 = 0").select(
        "id", (F.col("pain_score") + 1).alias("pain_score"), "demand_score",
        F.lit(0.0).alias("relevance_score"), F.array(F.lit("again")).alias("matched_queries"),
        F.lit(2).alias("number"),
    )
    earlier = updates.withColumns({"pain_score": F.lit(99), "number": F.lit(1)})
    updates = updates.unionByName(earlier)
    return tables.apply_scores(stored, updates, order="number").select(
        "id", big("pain_score"), "relevance_score",
        joined("matched_queries").alias("matched_queries"),
    )


@query(f"""with {POSTS_SQL}, {HISTORY_SQL} select * from history union all
 select id, platform, 'now' from posts where seq % 5 <> 0""")
def extend_history(spark, sf):
    return tables.extend_history(history(spark, sf), posts(spark, sf), F.lit("now"))


@query(f"""with {POSTS_SQL} select id, seq % 3 = 0 or seq % 5 = 0 as analyzed,
 case when seq % 10 = 0 then '{{"n":1}}' end as analysis_result from posts""")
def mark_analyzed(spark, sf):
    base = with_analyzed(posts(spark, sf))
    results = base.filter("seq % 5 = 0").select(
        "id", F.when(F.col("seq") % 10 == 0, F.lit('{"n":1}')).alias("analysis_result")
    )
    twice = results.withColumn("number", F.lit(2)).unionByName(
        results.select("id", F.lit("old").alias("analysis_result"), F.lit(1).alias("number"))
    )
    return tables.mark_analyzed(base, twice, order="number").select("id", "analyzed", "analysis_result")


def runs(spark, sf) -> DataFrame:
    """Runs told from events: one per event, the event type as topic."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("topic"),
        F.col("user_id").alias("posts_fetched"),
    )


@query("""select event_id as id, event_type as topic, user_id as posts_fetched from events
 where event_type = 'signup' order by event_id desc limit 1""")
def latest_run(spark, sf):
    return tables.latest_run(runs(spark, sf), "signup").select("id", "topic", "posts_fetched")


@query("""select event_type as topic, max(event_id) as id, max_by(user_id, event_id)
 as posts_fetched from events group by 1""")
def latest_run_per_topic(spark, sf):
    return tables.latest_run_per_topic(runs(spark, sf)).select("topic", "id", "posts_fetched")


@query(f"""with {SCORED_SQL} select (select max(event_id) from events) + 1 as id,
 '{TOPIC}' as topic, 'hn|x' as platforms, count(*) as posts_fetched,
 count(*) filter (where relevance_score >= 5) as posts_analyzed, 'r.md' as report_path
 from scored""")
def run_record(spark, sf):
    counts = scored(spark, sf).agg(
        F.count("*").alias("fetched"),
        F.count_if(F.col("relevance_score") >= SETTINGS.min_score).alias("above"),
    ).first()
    record = tables.run_record(
        runs(spark, sf), TOPIC, ["hn", "x"], F.lit(views.AS_OF), F.lit(counts["fetched"]),
        F.lit(counts["above"]), "r.md",
    )
    return record.select(
        "id", "topic", joined("platforms").alias("platforms"), "posts_fetched", "posts_analyzed",
        "report_path",
    )


# --- report tables of posts -----------------------------------------------------------------------


@query(f"""with {SCORED_SQL} select cast(row_number() over (order by relevance_score desc, seq)
  as bigint) as number, id, substr(title, 1, 80) as title, url, platform, points,
  cast(pain_score as bigint) as pain_score, cast(demand_score as bigint) as demand_score,
  relevance_score, case when body <> '' then replace(substr(body, 1, 200), chr(10), ' ')
   || '...' end as preview
 from scored order by number limit 20""")
def top_posts_table(spark, sf):
    top = report.top_posts_table(scored(spark, sf))
    return top.withColumns(
        {c: F.col(c).cast("bigint") for c in ("number", "pain_score", "demand_score")}
    )


@query(f"""with {SCORED_SQL} select cast(row_number() over (order by points desc,
   relevance_score desc, seq) as bigint) as number, id, substr(title, 1, 80) as title, url,
  points, num_comments, platform from scored
 where num_comments > 10 and topic_relevance >= 0.4 order by number limit 10""")
def discussion_hubs(spark, sf):
    hubs = report.discussion_hubs(scored(spark, sf), SETTINGS)
    return hubs.withColumn("number", F.col("number").cast("bigint"))


@query(f"""with {SCORED_SQL}, {HISTORY_SQL} select (select count(*) from posts) as collected,
 count(*) as new, count(*) filter (where relevance_score >= 5) as above_threshold
 from scored where seq % 5 <> 0""")
def run_summary(spark, sf):
    collected = posts(spark, sf)
    new = tables.drop_processed(scored(spark, sf), history(spark, sf))
    return report.run_summary(collected, new, SETTINGS)
