"""Posts, hits, findings and evidence as views over the given tables.

Each view exists twice, as a DataFrame and as SQL text, so that every registered query
and its SQL twin start from the same rows.  All views cover whole tables and whole texts.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicelode.settings import Settings
from voicelode.sources.scan import read_texts

# The tables hold invented words, so the terms are ones that occur in them.
PAIN = ("hate", "worthless", "license", "free", "best")
DEMAND = ("of the", "in the", "the best")
SETTINGS = Settings(pain_terms=PAIN, demand_terms=DEMAND)
TOPIC = "ndnd onre enat"
AS_OF = dt.datetime(2024, 12, 31)
BOOLEAN_QUERIES = [
    (0, '"the" (free OR best)', "the", ["free", "best"]),
    (1, '"of the" (hate OR worthless)', "of the", ["hate", "worthless"]),
    (2, '"de la" (que OR "des ")', "de la", ["que", "des "]),
    (3, '"die" ("und der" OR ung)', "die", ["und der", "ung"]),
    (4, '"Que" (license OR los)', "Que", ["license", "los"]),
    (5, '"in" ("ing the" OR Nicht)', "in", ["ing the", "Nicht"]),
    (6, '"hate" (the OR die)', "hate", ["the", "die"]),
    (7, '"tion" (re OR "no such words")', "tion", ["re", "no such words"]),
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = f"{sf}/{name}.parquet"
    return read_texts(spark, path) if name in ("documents", "pages") else spark.read.parquet(path)


# --- posts -----------------------------------------------------------------------------

_POSTS = """
 select concat('doc_', cast(doc_id as varchar(20))) as id,
  case doc_id % 4 when 0 then 'hn' when 1 then 'reddit' when 2 then 'producthunt'
   else 'twitter' end as platform,
  concat(case doc_id % 4 when 0 then 'https://news.ycombinator.com/item?id='
   when 1 then 'https://reddit.com/r/x/' when 2 then 'https://www.producthunt.com/posts/'
   else 'https://x.com/i/status/' end, cast(doc_id as varchar(20))) as url,
  concat(source, ' post ', cast(doc_id as varchar(20))) as title, text as body,
  concat('u', cast(doc_id * 7 % 97 as varchar(20))) as author, source as community,
  doc_id * 37 % 500 as points, doc_id * 13 % 40 as num_comments, doc_id as seq, lang,
  case lang when 'en' then 'ndnd onre enat' when 'fr' then 'la le tions'
   when 'de' then 'der die einheit' else 'que los' end as topic,
  doc_id % 6 = 0 as is_repost, cast(doc_id % 365 as int) as day_no,
  1 + doc_id % 3 as n_queries
 from {documents}
"""
POSTS_SQL = f"""posts as (
 select *, timestamp '2024-01-01 00:00:00' + to_days(day_no) as created_at
 from ({_POSTS.format(documents='documents')}) d)"""


def posts(spark: SparkSession, sf: str) -> DataFrame:
    base = spark.sql(_POSTS, documents=table(spark, sf, "documents"))
    start = F.lit(dt.datetime(2024, 1, 1))
    names = F.transform(
        F.sequence(F.lit(1).cast("bigint"), F.col("n_queries")),
        lambda i: F.concat(F.lit("q"), i.cast("string")),
    )
    return base.withColumn("created_at", start + F.make_dt_interval(days=F.col("day_no"))).withColumn(
        "matched_queries", names
    )


# --- scored posts --------------------------------------------------------------------------

def _count_sql(terms) -> str:
    quoted = [t.replace("'", "''") for t in terms]
    return " + ".join(f"cast(contains(txt, '{t}') as int)" for t in quoted)


STOP_WORDS_SQL = (
    "'a','an','the','and','or','for','of','to','in','on','with','is','are','was','were','be',"
    "'been','being','that','this','it','its','my','your','our','their','what','how','why'"
)


def terms_sql(source: str, topic: str = "topic", name: str = "terms") -> str:
    """Words, phrases and stems per topic of `source`."""
    return f"""{name}_w as (
 select distinct {topic} as topic, list_filter(regexp_extract_all(lower({topic}), '[a-z0-9]+'),
   lambda w: len(w) >= 2 and w not in ({STOP_WORDS_SQL})) as words from {source}),
 {name} as (select topic, words,
  list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) as phrases,
  list_sort(list_distinct(list_concat(words, list_transform(words, lambda w:
   case when w[-1] = 's' and len(w) > 3 then w[:-2] else w || 's' end)))) as stems
 from {name}_w)"""


def relevance_sql(text: str = "txt") -> str:
    phrase = f"len(list_filter(phrases, lambda p: contains({text}, p)))"
    stem = f"len(list_filter(stems, lambda s: contains({text}, s)))"
    return f"""case when {phrase} >= 1 then least(1e0, 0.6e0 + 0.2e0 * {phrase})
  when {stem} = 0 then 0e0 when {stem} = 1 and len(words) > 1 then 0.1e0
  when {stem} >= len(words) then 0.4e0 else 0.15e0 end"""


def round_sql(source: str, column: str, out: str, name: str) -> str:
    """Rounding to cents by exact value, ties to even, as a chain of two CTEs."""
    return f"""{name}_r as (select *, floor({column} * 100e0) as cents,
  cast(cast({column} as real) as double) as head from {source}),
 {name} as (select * exclude (cents, head), (cents + case
   when (head * 100e0 - (cents + 0.5e0)) + ({column} - head) * 100e0 > 0 then 1
   when (head * 100e0 - (cents + 0.5e0)) + ({column} - head) * 100e0 = 0 and cents % 2 = 1 then 1
   else 0 end) / 100e0 as {out} from {name}_r)"""


def scored_sql(topic: str | None = TOPIC, pain=PAIN, demand=DEMAND, name: str = "scored") -> str:
    """Scored posts: against one topic, or with None each post against its own topic."""
    if topic is None:
        terms = terms_sql("posts")
        join = "join terms using (topic)"
    else:
        quoted = topic.replace("'", "''")
        terms = terms_sql(f"(select '{quoted}' as topic)")
        join = "cross join (select words, phrases, stems from terms) t"
    return f"""{terms},
 texts as (select *, lower(concat(title, ' ', body)) as txt from posts),
 counted as (select *, {_count_sql(pain)} as pain_score, {_count_sql(demand)} as demand_score,
  {relevance_sql()} as rel from texts {join}),
 raw as (select * exclude (words, phrases, stems), (0.3e0 * pain_score * 8
  + 0.25e0 * demand_score * 15 + 0.15e0 * n_queries * 4
  + 0.3e0 * (case when points > 0 then least(ln(1 + points), 5e0) else 0e0 end) * 2
  + least(length(txt) / 500e0, 2e0)) * rel as raw_score from counted),
 {round_sql('raw', 'raw_score', 'relevance_score', 'rounded')},
 {round_sql('rounded', 'rel', 'topic_relevance', name)}"""


# --- hits ----------------------------------------------------------------------------------

def queries_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        BOOLEAN_QUERIES, "query_no int, query string, phrase string, alternatives array<string>"
    )


def _list_sql(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


QUERIES_SQL = "queries(query_no, query, phrase, alternatives) as (values " + ", ".join(
    f"({n}, '{q}', '{p}', {_list_sql(a)})" for n, q, p, a in BOOLEAN_QUERIES
) + ")"
MATCHES_SQL = f"""{QUERIES_SQL},
 matches as (select p.*, q.query, q.query_no from posts p join queries q
  on contains(lower(concat(p.title, ' ', p.body)), lower(q.phrase))
  and len(list_filter(q.alternatives,
   lambda a: contains(lower(concat(p.title, ' ', p.body)), lower(a)))) > 0)"""

# Hits arrive query by query.  Points grow from hit to hit, so the first hit can be told.
HITS_SQL = MATCHES_SQL + """,
 hits as (select id, topic, platform, title, points + query_no as points, query,
  cast(query_no as bigint) * 1000000000 + seq as hit_seq from matches)"""


def hits(matched: DataFrame) -> DataFrame:
    return matched.select(
        "id", "topic", "platform", "title", (F.col("points") + F.col("query_no")).alias("points"),
        "query", (F.col("query_no").cast("bigint") * 1000000000 + F.col("seq")).alias("hit_seq"),
    )


# --- findings ------------------------------------------------------------------------------

_POINTS = """
 select seq as ord, body as description,
  case seq % 3 when 0 then 'pricing' when 1 then 'quality_issue' else 'missing_feature' end
   as category,
  cast(1 + seq % 5 as int) as emotional_intensity, seq % 3 = 0 as payment_signal,
  case when seq % 6 = 0 then concat(author, ' would pay') end as payment_quote,
  cast(null as varchar(20)) as current_workaround, cast(seq % 4 as int) as unique_users,
  {quotes} as representative_quotes, {urls} as source_urls
 from {posts}
"""
_QUOTES = "title, concat(author, ' in ', community), community"
_URLS = "url, concat('https://reddit.com/r/y/', cast(seq % 50 as varchar(20)))"
POINTS_SQL = POSTS_SQL + ", points as materialized (" + _POINTS.format(
    quotes=f"[{_QUOTES}]", urls=f"[{_URLS}]", posts="posts"
) + ")"


def points(spark: SparkSession, sf: str) -> DataFrame:
    sql = _POINTS.replace("{quotes}", f"array({_QUOTES})").replace("{urls}", f"array({_URLS})")
    return spark.sql(sql, posts=posts(spark, sf))


_SPACES = (
    "[\\x{09}-\\x{0d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
)
# Plain definition: all pairs by shared words, then one item after the other.
CLUSTERS_SQL = POINTS_SQL + f""",
 sets as materialized (select ord, list_filter(list_distinct(string_split_regex(
  lower(description), '{_SPACES}')), lambda w: w <> '') as words from points),
 tokens as materialized (select ord, len(words) as n, unnest(words) as w from sets),
 pairs as materialized (select a.ord as j, b.ord as i, count(*) as shared,
   any_value(a.n) + any_value(b.n) - count(*) as total
  from tokens a join tokens b on a.w = b.w and a.ord > b.ord group by 1, 2
  having count(*) * 2 >= any_value(a.n) + any_value(b.n) - count(*)),
 later as materialized (select j, list(i) as earlier, row_number() over (order by j) as rn
  from pairs group by j),
 walk as (select 0::bigint as rn, []::bigint[] as members union all
  select later.rn, case when len(list_filter(later.earlier,
    lambda p: not list_contains(walk.members, p))) > 0
   then list_append(walk.members, later.j) else walk.members end
  from walk join later on later.rn = walk.rn + 1),
 final as materialized (select members from walk order by rn desc limit 1),
 clusters as materialized (select p.ord, coalesce(list_min(list_filter(later.earlier,
   lambda e: not list_contains(final.members, e))), p.ord) as leader
  from points p cross join final left join later on later.j = p.ord)"""

SOURCES_SQL = CLUSTERS_SQL + """,
 sizes as materialized (select leader, count(*) as members from clusters group by 1),
 placed as materialized (select p.*, c.leader, s.members from points p
  join clusters c using (ord) join sizes s using (leader)),
 urls as (select leader, members, ord, unnest(source_urls) as url,
  unnest(range(len(source_urls))) as pos from placed),
 sources as materialized (select leader, url, min(struct_pack(o := ord, p := pos)) as first
  from urls group by leader, url, case when members = 1 then pos end)"""

MERGED_SQL = SOURCES_SQL + """,
 q as (select leader, ord, unnest(representative_quotes) as quote,
  unnest(range(len(representative_quotes))) as pos from placed),
 q5 as (select leader, list(quote order by ord, pos) as quotes from (select *, row_number() over
  (partition by leader order by ord, pos) as rn from q) where rn <= 5 group by leader),
 agg as (select leader, max(unique_users) as users, max(emotional_intensity) as intensity,
  bool_or(payment_signal) as pays, min_by(payment_quote, ord) filter (where ord > leader
   and payment_signal and payment_quote <> '') as offer
  from placed group by leader),
 merged as materialized (select b.ord, b.description, b.category, b.members,
  case when b.members = 1 then b.emotional_intensity else a.intensity end as emotional_intensity,
  case when b.members = 1 then b.payment_signal else a.pays end as payment_signal,
  case when b.members = 1 or b.payment_quote <> '' then b.payment_quote
   else coalesce(a.offer, b.payment_quote) end as payment_quote,
  b.current_workaround,
  case when b.members = 1 then b.unique_users else a.users end as unique_users,
  case when b.members = 1 then b.representative_quotes else q5.quotes end
   as representative_quotes
  from placed b join agg a on a.leader = b.ord left join q5 on q5.leader = b.ord
  where b.ord = b.leader)"""


def platform_sql(url: str) -> str:
    low = f"lower({url})"
    return f"""case when contains({low}, 'news.ycombinator.com') or contains({low}, 'hn_') then 'hn'
   when contains({low}, 'reddit.com') then 'reddit'
   when contains({low}, 'producthunt.com') then 'producthunt'
   when contains({low}, 'twitter.com') or contains({low}, 'x.com') then 'twitter'
   when contains({low}, 'g2.com') then 'g2' when contains({low}, 'capterra.com') then 'capterra'
   end"""


def _signal_sql(n: str) -> str:
    return f"case when {n} >= 3 then 'strong' when {n} = 2 then 'moderate' else 'single' end"


CROSS_SQL = MERGED_SQL + f""",
 facts as (select leader, list_sort(list(distinct {platform_sql('url')})
   filter (where {platform_sql('url')} is not null)) as platforms, count(*) as source_count,
  list(url order by first)[1:5] as links from sources group by leader),
 crossed as materialized (select m.*, coalesce(f.platforms, []) as platforms,
  coalesce(f.source_count, 0) as source_count, coalesce(f.links, []) as links,
  greatest(len(coalesce(f.platforms, [])), 1) as platform_count
  from merged m left join facts f on f.leader = m.ord),
 found as materialized (select *, {_signal_sql('platform_count')} as cross_platform_signal,
  case when unique_users >= 3 or emotional_intensity >= 4 then 'high'
   when unique_users >= 2 or payment_signal then 'medium' else 'low' end as tier from crossed)"""
