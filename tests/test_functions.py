import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from voicelode import values
from voicelode.functions import scores, text, times, topics, urls
from voicelode.operators.scoring import score_posts
from voicelode.operators.signals import confidence_tiers


def column(spark, values_, type_="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values_)], f"i int, x {type_}")


def apply(spark, values_, expr, type_="string"):
    rows = column(spark, values_, type_).select("i", expr(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]


def test_rounding_equals_python(spark):
    rng = random.Random(7)
    xs = [0.125, 0.375, 2.675, 1.005, 0.285, 1.115, 0.0, 10.97]
    xs += [i / 8 for i in range(400)] + [i / 200 for i in range(4000)]
    xs += [rng.random() * 10 ** rng.randint(-3, 4) for _ in range(20000)]
    assert apply(spark, xs, scores.round_cents, "double") == [round(x, 2) for x in xs]


def test_clean_html(spark):
    cases = {
        "a<p>b <i>c</i> &amp; d": "a\nb c & d",
        "&lt;b&gt;x": "x",  # entities are decoded before tags are dropped
        None: "",
        "&amp;lt;": "&lt;",  # decoded once
        "&eacute;&#65; <br\n/>z": "éA z",
        "  x　\n": "x",
    }
    assert apply(spark, list(cases), text.clean_html) == list(cases.values())


def test_clean_url(spark):
    cases = {
        "https://a.b/c?utm_source=x&k=1#t": "https://a.b/c?k=1#t",
        "https://a.b/c?utm_source=x": "https://a.b/c",
        "https://a.b/c?k=1&utm_a=2&utm_b=3": "https://a.b/c?k=1",
        "https://a.b/c?x=&k=1": "https://a.b/c?x=&k=1",
        "https://a.b/utm_x": "https://a.b/utm_x",
    }
    assert apply(spark, list(cases), urls.clean_url) == list(cases.values())


def test_platform_of_url(spark):
    cases = {
        "https://NEWS.ycombinator.com/item?id=1": ("hn", "hn"),
        "https://x.com/i/1": ("twitter", "twitter"),
        "https://foox.com/a": ("twitter", None),
        "https://www.g2.com/p": ("g2", "g2"),
        "https://old.reddit.com/r": ("reddit", "reddit"),
        "https://example.org/": (None, None),
        "hn_12": ("hn", None),
    }
    loose = apply(spark, list(cases), urls.platform_of_url)
    strict = apply(spark, list(cases), lambda c: urls.platform_of_url(c, "host"))
    assert list(zip(loose, strict)) == list(cases.values())
    with pytest.raises(ValueError):
        urls.platform_of_url(F.lit("x"), "other")


def test_topic_terms(spark):
    terms = topics.TopicTerms.of(spark, "AI video tools")
    assert terms.words == ["ai", "video", "tools"]
    assert terms.phrases == ["ai video", "video tools"]
    assert sorted(terms.stems) == ["ai", "ais", "tool", "tools", "video", "videos"]
    none = topics.TopicTerms.of(spark, "the of a")
    assert (none.words, none.phrases, none.stems) == ([], [], [])
    assert topics.topic_keywords("A no-code AI 2 x") == ["no", "code", "ai"]


def test_topic_slugs(spark):
    got = apply(spark, ["AI video tools", "nothing here"], topics.topic_slugs)
    assert got[0] == sorted(values.TOPIC_SLUGS["ai"] + values.TOPIC_SLUGS["video"])
    assert got[1] == sorted(values.DEFAULT_SLUGS)


def test_word_set_and_jaccard(spark):
    assert apply(spark, [" b A  b\n c", "", None], text.word_set) == [["a", "b", "c"], [], []]
    pairs = spark.createDataFrame(
        [("a b c", "b c d"), ("", "a"), ("", ""), ("x", "x")], "l string, r string"
    )
    got = pairs.select(text.jaccard(text.word_set(F.col("l")), text.word_set(F.col("r")))).collect()
    assert [r[0] for r in got] == [0.5, 0.0, 0.0, 1.0]


def test_parse_time(spark):
    when = dt.datetime(2024, 1, 2, 3, 4, 5)
    epoch = when.replace(tzinfo=dt.timezone.utc).timestamp()
    raw = ["2024-01-02T03:04:05.000Z", f"{epoch}", f"{int(epoch)}", "x", "", None]
    assert apply(spark, raw, times.parse_time) == [when] * 3 + [None] * 3


POST = "id string, title string, body string, points bigint, matched_queries array<string>, seq int"


@pytest.mark.parametrize(
    "title, body, points, queries, topic, pain, demand, relevance, score",
    [
        ("API testing is slow and broken", "I wish there was a cheaper option", 10, 2,
         "API testing", 3, 1, 0.8, 10.97),
        ("", "AI videos", 0, 1, "video ai", 0, 0, 0.4, 0.25),
        ("Shut up and take my money", "", -3, 1, None, 0, 2, 1.0, 8.15),
        ("Tools", "unrelated", 148, 1, "API testing", 0, 0, 0.0, 0.0),
    ],
)
def test_score(spark, title, body, points, queries, topic, pain, demand, relevance, score):
    row = ("i", title, body, points, ["q"] * queries, 0)
    got = score_posts(spark.createDataFrame([row], POST), topic=topic).first()
    assert (got["pain_score"], got["demand_score"]) == (pain, demand)
    assert (got["topic_relevance"], got["relevance_score"]) == (relevance, score)


def test_score_of_missing_fields(spark):
    row = ("i", None, None, None, None, 0)
    got = score_posts(spark.createDataFrame([row], POST)).first()
    assert (got["pain_score"], got["relevance_score"]) == (0, 0.0)


def test_engagement_saturates(spark):
    got = apply(spark, [-1, 0, 1, 147, 148, 10**9], scores.engagement, "bigint")
    assert got[:2] == [0.0, 0.0]
    assert got[2] == pytest.approx(math.log(2))
    assert got[3] < 5.0
    assert got[4:] == [5.0, 5.0]


def test_score_by_own_topic_equals_single_topic(spark):
    rows = [("a", "API testing slow", "x", 3, ["q"], 0), ("b", "video", "ai broken", 0, ["q"], 1)]
    posts = spark.createDataFrame(rows, POST)
    for topic in ("API testing", "video ai"):
        single = score_posts(posts, topic=topic)
        labelled = posts.withColumn("topic", F.lit(topic))
        own = score_posts(labelled, own_topic=True)
        columns = ["id", "pain_score", "topic_relevance", "relevance_score"]
        assert sorted(single.select(columns).collect()) == sorted(own.select(columns).collect())


def test_filters_do_not_repeat_the_scoring(spark):
    posts = spark.createDataFrame([("i", "t", "b", 1, ["q"], 0)], POST)
    plan = score_posts(posts, topic="API testing").filter("relevance_score > 1")
    text_ = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text_.count("frustrat") == 1


def test_tiers(spark):
    rows = [(3, 1, None, "high"), (0, 4, None, "high"), (2, 1, None, "medium"),
            (1, 1, True, "medium"), (1, 3, False, "low"), (None, None, None, "low")]
    frame = spark.createDataFrame(
        rows, "unique_users int, emotional_intensity int, payment_signal boolean, expected string"
    )
    assert confidence_tiers(frame).filter("tier <> expected").count() == 0
