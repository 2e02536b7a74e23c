"""Registered queries over findings: clusters, merging, signals, tiers, evidence rules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import views
from checks.queries import SCORED_SQL, big, joined, query, scored
from checks.views import SETTINGS, points, posts, table
from voicelode import values
from voicelode.operators import clusters, ranking, report, signals, validation
from voicelode.scratch import materialize


def assigned(spark, sf) -> tuple[DataFrame, DataFrame]:
    found = points(spark, sf)
    return found, materialize(clusters.leader_clusters(found), "assignment")


def merged(spark, sf) -> DataFrame:
    found, assignment = assigned(spark, sf)
    return signals.cross_platform_clusters(
        clusters.merge_clusters(found, assignment), clusters.cluster_sources(found, assignment)
    )


@query(f"with recursive {views.CLUSTERS_SQL} select ord, leader from clusters")
def leader_clusters(spark, sf):
    return clusters.leader_clusters(points(spark, sf))


@query(f"with recursive {views.CLUSTERS_SQL} select ord, leader from clusters")
def leader_clusters_sliced(spark, sf):
    """The same with a budget that cuts the order into several slices."""
    return clusters.leader_clusters(points(spark, sf), pair_budget=20_000)


@query(f"""with recursive {views.CLUSTERS_SQL} select c.ord, c.leader,
 cast(p.shared as double) / p.total as similarity
 from clusters c join pairs p on p.j = c.ord and p.i = c.leader""")
def similarity_to_leader(spark, sf):
    return clusters.similarity_to_leader(*assigned(spark, sf))


@query(f"""with recursive {views.SOURCES_SQL} select leader, url, first.o as first_ord,
 cast(first.p as bigint) as first_pos from sources""")
def cluster_sources(spark, sf):
    rows = clusters.cluster_sources(*assigned(spark, sf))
    return rows.select("leader", "url", "first_ord", big("first_pos"))


_MERGED_COLUMNS = """ord, description, category, cast(members as bigint) as members,
 cast(emotional_intensity as bigint) as emotional_intensity, payment_signal, payment_quote,
 cast(unique_users as bigint) as unique_users,
 array_to_string(representative_quotes, '|') as representative_quotes"""


@query(f"with recursive {views.MERGED_SQL} select {_MERGED_COLUMNS} from merged")
def merge_clusters(spark, sf):
    return clusters.merge_clusters(*assigned(spark, sf)).select(
        "ord", "description", "category", "members", big("emotional_intensity"),
        "payment_signal", "payment_quote", big("unique_users"),
        joined("representative_quotes").alias("representative_quotes"),
    )


_CROSS_COLUMNS = """ord, array_to_string(platforms, '|') as platforms,
 cast(platform_count as bigint) as platform_count, cross_platform_signal"""


@query(f"""with {views.POINTS_SQL}, named as (select ord, list_sort(list_distinct(list_filter(
  list_transform(source_urls, lambda u: {views.platform_sql('u')}), lambda p: p is not null)))
  as platforms from points),
 counted as (select *, greatest(len(platforms), 1) as platform_count from named)
 select ord, array_to_string(platforms, '|') as platforms,
  cast(platform_count as bigint) as platform_count, case when platform_count >= 3 then 'strong'
   when platform_count = 2 then 'moderate' else 'single' end as cross_platform_signal
 from counted""")
def cross_platform(spark, sf):
    return signals.cross_platform(points(spark, sf)).select(
        "ord", joined("platforms").alias("platforms"), big("platform_count"),
        "cross_platform_signal",
    )


@query(f"""with recursive {views.CROSS_SQL} select {_CROSS_COLUMNS},
 cast(source_count as bigint) as source_count, array_to_string(links, '|') as links from found""")
def cross_platform_clusters(spark, sf):
    return merged(spark, sf).select(
        "ord", joined("platforms").alias("platforms"), big("platform_count"),
        "cross_platform_signal", "source_count", joined("links").alias("links"),
    )


@query(f"""with {views.POINTS_SQL} select ord, case when unique_users >= 3
  or emotional_intensity >= 4 then 'high' when unique_users >= 2 or payment_signal then 'medium'
  else 'low' end as tier from points""")
def confidence_tiers(spark, sf):
    return signals.confidence_tiers(points(spark, sf)).select("ord", "tier")


_POINT_ORDER = "platform_count desc, unique_users desc, emotional_intensity desc, ord"


@query(f"""with recursive {views.CROSS_SQL} select ord, tier, row_number() over
 (partition by tier order by {_POINT_ORDER}) as position from found""")
def tiered_points(spark, sf):
    tiered = signals.tiered_points(materialize(merged(spark, sf), "points"))
    return tiered.select("ord", "tier", "position")


@query(f"""with recursive {views.CROSS_SQL} select ord, row_number() over
 (order by {_POINT_ORDER}) as rank from found""")
def rank_points(spark, sf):
    narrow = merged(spark, sf).select(
        "ord", "platform_count", "unique_users", "emotional_intensity"
    )
    return ranking.number_rows(narrow, ranking.points_order(), "rank").select("ord", "rank")


_TRANSPARENCY = f"""with recursive {views.CROSS_SQL.replace(views.POSTS_SQL, SCORED_SQL, 1)},
 metrics(ord, metric, value) as (
  select 1, 'total', count(*) from scored
  union all select 2, 'hn', count(*) from scored where platform = 'hn'
  union all select 3, 'reddit', count(*) from scored where platform = 'reddit'
  union all select 4, 'producthunt', count(*) from scored where platform = 'producthunt'
  union all select 5, 'twitter', count(*) from scored where platform = 'twitter'
  union all select 6, 'analyzed', 50
  union all select 7, 'pain_points', count(*) from found
  union all select 8, 'cross_platform', count(*) from found where platform_count >= 2)"""


@query(_TRANSPARENCY + " select cast(ord as bigint) as ord, metric, value from metrics")
def transparency(spark, sf):
    counts = report.transparency(scored(spark, sf), merged(spark, sf), analyzed=50)
    return counts.select(big("ord"), "metric", "value")


_AT = dt.datetime(2024, 12, 31, 8, 30)
_LINES_SQL = _TRANSPARENCY + f""",
 tiered as (select *, row_number() over (partition by tier order by {_POINT_ORDER}) as position
  from found),
 blocks as (select case tier when 'high' then 2 when 'medium' then 3 else 4 end as section,
  position as ord, list_concat(
   case when position > 1 then [] else [case tier when 'high' then '## High Confidence Pain Points'
    when 'medium' then '## Medium Confidence' else '## Low Confidence / Emerging Signals' end, '']
    end,
   ['### ' || position || '. ' || description, '', '- **Category**: ' || category,
    '- **Emotional intensity**: ' || emotional_intensity || '/5',
    '- **Unique users**: ' || unique_users,
    '- **Payment signal**: ' || case when payment_signal then 'Yes' else 'No' end],
   case cross_platform_signal
    when 'strong' then ['- **Cross-platform**: 🔥 Strong (' || array_to_string(platforms, ', ') || ')']
    when 'moderate' then ['- **Cross-platform**: ⚡ Moderate (' || array_to_string(platforms, ', ')
     || ')'] else [] end,
   case when payment_quote <> '' then ['  - > "' || payment_quote || '"'] else [] end,
   ['- **Quotes**:'],
   list_transform(representative_quotes[1:3], lambda q: '  - > "' || q || '"'),
   ['- **Sources**: ' || array_to_string(list_transform(links, lambda u: '[link](' || u || ')'),
    ', '), '']) as lines from tiered),
 labels(metric, label) as (values ('total', 'Total posts collected'), ('hn', 'HN posts'),
  ('reddit', 'Reddit posts'), ('producthunt', 'Product Hunt posts'),
  ('twitter', 'X/Twitter posts'), ('analyzed', 'Posts sent to Gemini'),
  ('pain_points', 'Pain points identified'), ('cross_platform', 'Cross-platform pain points')),
 hubs as (select *, row_number() over (order by points desc, relevance_score desc, seq) as ord
  from scored where num_comments > 10 and topic_relevance >= 0.4 order by ord limit 10),
 parts(section, ord, lines) as (
  select 0, -1, ['# Pain Point Research: {views.TOPIC}',
   '> Generated: 2024-12-31 08:30 | Tool: voicelode', '', '## Search Transparency', '',
   '| Metric | Value |', '|--------|-------|']
  union all select 1, ord, ['| ' || label || ' | ' || value || ' |'] from metrics
   join labels using (metric)
  union all select 1, 99,
   ['| Data source level | **Primary** — all from original posts with URLs |', '']
  union all select * from blocks
  union all select 5, ord, list_concat(case when ord > 1 then [] else [
   '## High-Engagement Discussion Hubs', '',
   'These posts have the most discussion — worth reading manually:', ''] end,
   ['- [' || substr(title, 1, 80) || '](' || url || ') — ' || points || '↑ ' || num_comments
    || '💬 (' || platform || ')']) from hubs
  union all select 5, 1073741824, [''] from hubs where ord = 1)
 select cast(section as bigint) as section, cast(ord as bigint) as ord,
  unnest(range(len(lines))) as line_no, unnest(lines) as line from parts"""


@query(_LINES_SQL)
def report_lines(spark, sf):
    found = materialize(merged(spark, sf), "points", "zstd")
    lines = report.report_lines(
        views.TOPIC, scored(spark, sf), found, _AT, analyzed=50, settings=SETTINGS
    )
    return lines.select(big("section"), "ord", big("line_no"), "line")


# --- evidence rules ------------------------------------------------------------------------
# Evidence: every post stands behind the finding of its community; days differ by community.

_EVIDENCE = """evidence as (select community as point, platform, url, author, created_at
 from posts)"""


def evidence(spark, sf) -> DataFrame:
    return posts(spark, sf).withColumnRenamed("community", "point").select(
        "point", "platform", "url", "author", "created_at"
    )


@query(f"""with {views.POSTS_SQL}, e as (select id as point, platform, url from posts
  where num_comments > 0 union all
  select id, 'reddit', concat(url, '/again') from posts where num_comments % 3 = 0),
 c as (select point, count(distinct platform) as platforms, count(distinct url) as n
  from e group by 1)
 select id as point, cast(case when platforms >= 2 then 3 when n >= 2 then 2 when n = 1 then 1
  else 0 end as bigint) as signal_strength from posts left join c on c.point = id""")
def signal_strength(spark, sf):
    base = posts(spark, sf).withColumnRenamed("id", "point")
    seen = base.filter("num_comments > 0").select("point", "platform", "url").unionAll(
        base.filter("num_comments % 3 = 0").select(
            "point", F.lit("reddit"), F.concat("url", F.lit("/again"))
        )
    )
    return validation.signal_strength(base, seen).select("point", big("signal_strength"))


@query(f"""with {views.POSTS_SQL}, e as (select concat(author, day_no % 3) as point, url, author
  from posts) select point, count(distinct url) as sources, count(distinct author) as authors,
  count(distinct url) >= 3 as upgraded, count(distinct url) = 1 as single_source,
  count(distinct author) = 1 as single_author from e group by 1""")
def source_rules(spark, sf):
    found = posts(spark, sf).select(
        F.concat("author", (F.col("day_no") % 3).cast("string")).alias("point"), "url", "author"
    )
    return validation.source_rules(found)


@query(f"""with {views.POSTS_SQL}, {_EVIDENCE}, a as (select point, author, count(*) as n
  from evidence group by 1, 2) select point, cast(sum(n) as bigint) as posts,
  count(*) as authors, max(n) as most_by_one, count(*) / 150e0 as share_of_users
  from a group by 1""")
def vocal_minority(spark, sf):
    return validation.vocal_minority(evidence(spark, sf), F.lit(150.0))


@query(f"""with {views.POSTS_SQL}, e as (select id as point, created_at from posts)
 select point, max(created_at) < timestamp '2025-07-01' - interval 12 months as stale
 from e group by 1""")
def staleness(spark, sf):
    found = posts(spark, sf).withColumnRenamed("id", "point")
    return validation.staleness(found, dt.date(2025, 7, 1)).select("point", "stale")


_RESOLVED = " or ".join(
    f"contains(lower(concat(title, ' ', body)), '{t}')" for t in values.RESOLVED_TERMS + ["ndnd"]
)


@query(f"""with {views.POSTS_SQL}, c as (select community, count(*) filter (where {_RESOLVED})
  as resolving_posts from posts group by 1) select *, case when resolving_posts >= 10 then 'solved'
  when resolving_posts >= 1 then 'partial' else 'none' end as verdict from c""")
def counter_evidence(spark, sf):
    return validation.counter_evidence(
        posts(spark, sf), "community", values.RESOLVED_TERMS + ["ndnd"]
    )


_RATINGS = """select id as point, seq % 4 as signal, seq % 3 as frequency, points % 4 as payment,
 num_comments % 4 as buildability, seq % 2 as ai_leverage, day_no % 3 as saturation from {posts}"""


@query(f"""with {views.POSTS_SQL}, r as ({_RATINGS.format(posts='posts')}),
 t as (select *, signal + frequency + payment + buildability + ai_leverage - saturation as total
  from r), three as (select * from t order by total desc, point limit 3)
 select point, total, rank() over (order by total desc) as rank from three""")
def opportunities(spark, sf):
    ratings = spark.sql(_RATINGS, posts=posts(spark, sf))
    return validation.opportunities(ratings).select("point", "total", big("rank"))


@query(f"""with {views.POSTS_SQL} select id, case when points > 0 and seq % 3 + 1 >= 2
  and num_comments > 10 and day_no % 2 = 0 then 'verified' when points > 0 and seq % 3 + 1 >= 2
  and num_comments > 10 then 'data-backed' else 'probing' end as label from posts""")
def confidence_label(spark, sf):
    label = validation.confidence_label(
        F.col("points") > 0, F.col("seq") % 3 + 1, F.col("num_comments") > 10,
        F.col("day_no") % 2 == 0,
    )
    return posts(spark, sf).select("id", label.alias("label"))


@query("""select p_brand, max(p_retailprice) as price_ceiling, min(p_retailprice) as price_floor
 from part group by 1""")
def price_anchors(spark, sf):
    return validation.price_anchors(table(spark, sf, "part"), "p_brand", "p_retailprice")


@query("""with s as (select user_id, count(*) * 7 as searches from events
  where event_type = 'view' group by 1) select user_id, case when searches > 1000 then 'market'
  when searches >= 100 then 'niche' else 'too_small' end as size from s""")
def market_size(spark, sf):
    views_ = table(spark, sf, "events").filter("event_type = 'view'")
    searches = views_.groupBy("user_id").agg((F.count("*") * 7).alias("searches"))
    return searches.select(
        "user_id", validation.market_size(F.col("searches")).alias("size")
    )


@query("""with l as (select user_id as launch, min(ts) as start from events
  where event_type = 'purchase' group by 1),
 c as (select launch, count(*) as n from l join events e on e.user_id = l.launch
  and e.event_type = 'signup' and e.ts >= l.start and e.ts < l.start + interval 240 hours
  group by 1)
 select launch, coalesce(n, 0) as signups, case when coalesce(n, 0) > 10 then 'strong'
  when coalesce(n, 0) >= 3 then 'medium' else 'weak' end as signal from l left join c using (launch)
""")
def signup_signal(spark, sf):
    events = table(spark, sf, "events").withColumnRenamed("user_id", "launch")
    launches = events.filter("event_type = 'purchase'").groupBy("launch").agg(
        F.min("ts").alias("start")
    )
    signups = events.filter("event_type = 'signup'").select("launch", "ts")
    return validation.signup_signal(signups, launches, hours=240)


@query(f"""with {views.POSTS_SQL} select author, count(*) as occurrences from posts
 group by 1 having count(*) >= 3""")
def patterns(spark, sf):
    return validation.patterns(posts(spark, sf), "author")
