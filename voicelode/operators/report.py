"""Report tables and report text."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voicelode.functions.text import text_or_empty, truthy
from voicelode.operators.ranking import relevance_order
from voicelode.operators.signals import tiered_points
from voicelode.settings import Settings

X_LABELS = ("twitter", "x")  # search and import label the same site differently


def _limit_numbered(df: DataFrame, order: list[Column], n: int, name: str) -> DataFrame:
    """Top n with a number; the unpartitioned window sees only the n rows of the limit."""
    return df.orderBy(*order).limit(n).withColumn(
        name, F.row_number().over(W.orderBy(*order))
    )


def transparency(
    scored: DataFrame, points: DataFrame, analyzed: int | None = None
) -> DataFrame:
    """(ord, metric, value): what was collected, per platform, analyzed and found.

    One aggregation over the posts and one over the findings.  Launch, X and
    cross-platform rows only appear above zero.
    """
    if analyzed is not None:
        analyzed_count = F.lit(analyzed)
    elif "analyzed" in scored.columns:
        analyzed_count = F.count_if(F.col("analyzed"))
    else:
        analyzed_count = F.lit(0)
    of_posts = scored.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("platform") == "hn").alias("hn"),
        F.count_if(F.col("platform") == "reddit").alias("reddit"),
        F.count_if(F.col("platform") == "producthunt").alias("launches"),
        F.count_if(F.col("platform").isin(*X_LABELS)).alias("x"),
        analyzed_count.cast("bigint").alias("analyzed"),
    ).select(F.expr(
        "stack(6, 1, 'total', total, 2, 'hn', hn, 3, 'reddit', reddit, "
        "4, 'producthunt', launches, 5, 'twitter', x, 6, 'analyzed', analyzed) "
        "as (ord, metric, value)"
    ))
    of_points = points.agg(
        F.count("*").alias("found"),
        F.count_if(F.coalesce("platform_count", F.lit(1)) >= 2).alias("cross"),
    ).select(F.expr(
        "stack(2, 7, 'pain_points', found, 8, 'cross_platform', cross) as (ord, metric, value)"
    ))
    optional = F.col("metric").isin("producthunt", "twitter", "cross_platform")
    return of_posts.unionAll(of_points).filter(~optional | (F.col("value") > 0))


def run_summary(
    collected: DataFrame, scored: DataFrame, settings: Settings = Settings()
) -> DataFrame:
    """collected, new, above_threshold of a run in one row."""
    zero = F.lit(0).cast("bigint")
    total = collected.agg(F.count("*").alias("collected")).select(
        "collected", zero.alias("new"), zero.alias("above_threshold")
    )
    new = scored.agg(
        F.count("*").alias("new"),
        F.count_if(F.col("relevance_score") >= settings.min_score).alias("above_threshold"),
    ).select(zero.alias("collected"), "new", "above_threshold")
    names = ["collected", "new", "above_threshold"]
    return total.unionAll(new).agg(*[F.sum(n).alias(n) for n in names])


def top_posts_table(scored: DataFrame, n: int = 20) -> DataFrame:
    """The n best posts with number, shortened title and one-line preview."""
    top = _limit_numbered(scored, relevance_order(), n, "number")
    preview = F.replace(F.substring(text_or_empty(F.col("body")), 1, 200), F.lit("\n"), F.lit(" "))
    return top.select(
        "number",
        "id",
        F.substring(F.coalesce("title", F.lit("Untitled")), 1, 80).alias("title"),
        text_or_empty(F.col("url")).alias("url"),
        "platform",
        "points",
        "pain_score",
        "demand_score",
        "relevance_score",
        F.when(truthy(preview), F.concat(preview, F.lit("..."))).alias("preview"),
    )


def discussion_hubs(scored: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The most discussed posts on topic, by points; ties in relevance order."""
    hubs = scored.filter(
        (F.col("num_comments") > settings.hub_min_comments)
        & (F.coalesce("topic_relevance", F.lit(1.0)) >= settings.hub_min_relevance)
    )
    order = [F.col("points").desc(), *relevance_order()]
    return _limit_numbered(hubs, order, settings.report_hubs, "number").select(
        "number",
        "id",
        F.substring(F.coalesce("title", F.lit("Untitled")), 1, 80).alias("title"),
        text_or_empty(F.col("url")).alias("url"),
        "points",
        "num_comments",
        "platform",
    )


def report_name(topic: str, day: dt.date) -> str:
    slug = topic.lower().replace(" ", "-")
    return f"{day.isoformat()}-{slug[:40]}.md"


# Report text --------------------------------------------------------------------------
# Lines are rows (section, ord, line_no, line).  The strings below are fixed values: the
# format of the report.


def _fixed_lines(df_like: DataFrame, section: int, lines: list[str]) -> DataFrame:
    spark = df_like.sparkSession
    rows = [(section, -1, i, line) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "section int, ord bigint, line_no int, line string")


def _block_lines(df: DataFrame, section: Column, ord_: Column, lines: Column) -> DataFrame:
    return df.select(
        section.cast("int").alias("section"),
        ord_.cast("bigint").alias("ord"),
        F.posexplode(lines).alias("line_no", "line"),
    )


def _text(col) -> Column:
    return F.col(col).cast("string")


_METRIC_LABELS = {
    "total": "Total posts collected",
    "hn": "HN posts",
    "reddit": "Reddit posts",
    "producthunt": "Product Hunt posts",
    "twitter": "X/Twitter posts",
    "analyzed": "Posts sent to {model}",
    "pain_points": "Pain points identified",
    "cross_platform": "Cross-platform pain points",
}


def transparency_lines(table: DataFrame, settings: Settings) -> DataFrame:
    label = F.col("metric")
    for metric, text in _METRIC_LABELS.items():
        label = F.when(
            F.col("metric") == metric, F.lit(text.format(model=settings.model_name))
        ).otherwise(label)
    line = F.concat(F.lit("| "), label, F.lit(" | "), _text("value"), F.lit(" |"))
    return _block_lines(table, F.lit(1), F.col("ord"), F.array(line))


def point_block() -> Column:
    """The lines of one finding."""
    quotes = F.slice(F.coalesce("representative_quotes", F.array().cast("array<string>")), 1, 3)
    quote_lines = F.when(
        F.size(quotes) > 0,
        F.concat(
            F.array(F.lit("- **Quotes**:")),
            F.transform(quotes, lambda q: F.concat(F.lit('  - > "'), q, F.lit('"'))),
        ),
    ).otherwise(F.array().cast("array<string>"))
    links = F.slice(F.col("links"), 1, 5)
    platforms = F.concat(F.lit(" ("), F.array_join("platforms", ", "), F.lit(")"))
    single = F.array_compact(F.array(
        F.concat(
            F.lit("### "), _text("position"), F.lit(". "),
            F.coalesce("description", F.lit("Unknown")),
        ),
        F.lit(""),
        F.concat(F.lit("- **Category**: "), F.coalesce("category", F.lit("unknown"))),
        F.concat(
            F.lit("- **Emotional intensity**: "),
            F.coalesce(_text("emotional_intensity"), F.lit("?")), F.lit("/5"),
        ),
        F.concat(
            F.lit("- **Unique users**: "), F.coalesce(_text("unique_users"), F.lit("?"))
        ),
        F.concat(
            F.lit("- **Payment signal**: "),
            F.when(F.col("payment_signal"), "Yes").otherwise("No"),
        ),
        F.when(
            F.col("cross_platform_signal") == "strong",
            F.concat(F.lit("- **Cross-platform**: 🔥 Strong"), platforms),
        ).when(
            F.col("cross_platform_signal") == "moderate",
            F.concat(F.lit("- **Cross-platform**: ⚡ Moderate"), platforms),
        ),
        F.when(
            truthy(F.col("payment_quote")),
            F.concat(F.lit('  - > "'), "payment_quote", F.lit('"')),
        ),
        F.when(
            truthy(F.col("current_workaround")),
            F.concat(F.lit("- **Current workaround**: "), "current_workaround"),
        ),
    ))
    sources = F.when(
        F.size(links) > 0,
        F.array(F.concat(
            F.lit("- **Sources**: "),
            F.array_join(
                F.transform(links, lambda u: F.concat(F.lit("[link]("), u, F.lit(")"))), ", "
            ),
        )),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(single, quote_lines, sources, F.array(F.lit("")))


_TIER_TITLES = {
    "high": "## High Confidence Pain Points",
    "medium": "## Medium Confidence",
    "low": "## Low Confidence / Emerging Signals",
}


def point_lines(tiered: DataFrame) -> DataFrame:
    """All findings, tier by tier, each tier with its title when it has a finding."""
    section, title = F.lit(None), F.lit(None)
    for n, (tier, text) in enumerate(_TIER_TITLES.items()):
        section = F.when(F.col("tier") == tier, F.lit(2 + n)).otherwise(section)
        title = F.when(F.col("tier") == tier, F.lit(text)).otherwise(title)
    heading = F.when(F.col("position") == 1, F.array(title, F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    return _block_lines(tiered, section, F.col("position"), F.concat(heading, point_block()))


def top_post_lines(table: DataFrame) -> DataFrame:
    number = _text("number")
    lines = F.array_compact(F.array(
        F.concat(F.lit("**"), number, F.lit(". ["), "title", F.lit("]("), "url", F.lit(")**")),
        F.concat(
            F.lit("- Platform: "), "platform", F.lit(" | Points: "), _text("points"),
            F.lit(" | Pain: "), _text("pain_score"), F.lit(" | Demand: "), _text("demand_score"),
            F.lit(" | Score: "), _text("relevance_score"),
        ),
        F.when(F.col("preview").isNotNull(), F.concat(F.lit("- > "), "preview")),
        F.lit(""),
    ))
    return _block_lines(table, F.lit(2), F.col("number"), lines)


def hub_lines(hubs: DataFrame) -> DataFrame:
    heading = F.when(
        F.col("number") == 1,
        F.array(
            F.lit("## High-Engagement Discussion Hubs"), F.lit(""),
            F.lit("These posts have the most discussion — worth reading manually:"), F.lit(""),
        ),
    ).otherwise(F.array().cast("array<string>"))
    line = F.concat(
        F.lit("- ["), "title", F.lit("]("), "url", F.lit(") — "), _text("points"),
        F.lit("↑ "), _text("num_comments"), F.lit("💬 ("), "platform", F.lit(")"),
    )
    listed = _block_lines(
        hubs, F.lit(5), F.col("number"), F.concat(heading, F.array(line))
    )
    ending = _block_lines(
        hubs.filter("number = 1"), F.lit(5), F.lit(1 << 30), F.array(F.lit(""))
    )
    return listed.unionByName(ending)


def report_lines(
    topic: str,
    scored: DataFrame,
    points: DataFrame,
    now: dt.datetime,
    analyzed: int | None = None,
    settings: Settings = Settings(),
) -> DataFrame:
    """All lines of a report.  `points` come from `cross_platform_clusters`."""
    stamp = now.strftime("%Y-%m-%d %H:%M")
    parts = [
        _fixed_lines(scored, 0, [
            f"# Pain Point Research: {topic}",
            f"> Generated: {stamp} | Tool: {settings.tool_name}",
            "",
            "## Search Transparency",
            "",
            "| Metric | Value |",
            "|--------|-------|",
        ]),
        transparency_lines(transparency(scored, points, analyzed), settings),
        _fixed_lines(scored, 1, [
            "| Data source level | **Primary** — all from original posts with URLs |", "",
        ]).withColumn("ord", F.lit(99).cast("bigint")),
    ]
    if points.isEmpty():
        parts.append(_fixed_lines(scored, 2, [
            "## Results",
            "",
            f"No pain points identified by {settings.model_name} analysis.",
            "",
            "### Top Scored Posts (Rule-Based)",
            "",
        ]))
        parts.append(top_post_lines(top_posts_table(scored, settings.report_posts)))
    else:
        parts.append(point_lines(tiered_points(points)))
    parts.append(hub_lines(discussion_hubs(scored, settings)))
    return reduce(DataFrame.unionByName, parts)


def write_report(lines: DataFrame, path: str, single_file: bool = False) -> str:
    """Write the lines in order as text; parts of the folder follow each other.

    `single_file` is for the report of one run, whose size is set by the report's limits.
    """
    ordered = lines.orderBy("section", "ord", "line_no").select("line")
    if single_file:
        ordered = ordered.coalesce(1)
    ordered.write.mode("overwrite").text(path)
    return path
