import datetime as dt

from pyspark.sql import functions as F

from voicelode.operators import filters, ranking, tables
from voicelode.plans.ingest import ingest
from voicelode.settings import Settings
from voicelode.sources.store import PostStore

NOW = dt.datetime(2026, 2, 1)


def ids(frame):
    return sorted(r["id"] for r in frame.collect())


def scored(spark, rows):
    return spark.createDataFrame(rows, "id string, relevance_score double, seq bigint, topic string")


def test_insert_or_ignore(spark):
    stored = scored(spark, [("a", 1.0, 0, "t")])
    batch = scored(spark, [("a", 9.0, 1, "t"), ("b", 2.0, 2, "t"), ("b", 5.0, 3, "t"),
                           ("b", 5.0, 4, "u"), ("c", 0.0, 5, "t")])
    merged = tables.merge_new_posts(stored, batch)
    got = {r["id"]: (r["relevance_score"], r["seq"]) for r in merged.collect()}
    assert got == {"a": (1.0, 0), "b": (5.0, 3), "c": (0.0, 5)}
    again = tables.merge_new_posts(merged, batch)
    assert sorted(again.collect()) == sorted(merged.collect())
    by_topic = tables.merge_new_posts(stored, batch, keys=["topic", "id"])
    assert by_topic.count() == 4


def test_history(spark):
    posts = spark.createDataFrame([("a", "hn"), ("a", "x"), ("a", "hn")], "id string, platform string")
    history = spark.createDataFrame([("a", "hn", "old")], "id string, platform string, processed_at string")
    assert [tuple(r) for r in tables.drop_processed(posts, history).select("id", "platform").collect()] \
        == [("a", "x")]
    longer = tables.extend_history(history, posts, F.lit("now"))
    assert sorted(tuple(r) for r in longer.collect()) == [("a", "hn", "old"), ("a", "x", "now")]
    assert tables.extend_history(longer, posts, F.lit("later")).count() == 2


def test_updates(spark):
    posts = spark.createDataFrame(
        [("a", 1, 1, 1.0, ["q"], False, None), ("b", 2, 2, 2.0, ["q"], True, "old")],
        "id string, pain_score int, demand_score int, relevance_score double, "
        "matched_queries array<string>, analyzed boolean, analysis_result string")
    updates = spark.createDataFrame(
        [("a", 5, 6, 7.0, None), ("z", 0, 0, 0.0, [])],
        "id string, pain_score int, demand_score int, relevance_score double, "
        "matched_queries array<string>")
    got = {r["id"]: r for r in tables.apply_scores(posts, updates).collect()}
    assert tuple(got["a"])[1:5] == (5, 6, 7.0, None) and got["b"]["pain_score"] == 2
    results = spark.createDataFrame([("a", '{"n":1}'), ("b", None)], "id string, analysis_result string")
    got = {r["id"]: r for r in tables.mark_analyzed(posts, results).collect()}
    assert (got["a"]["analyzed"], got["a"]["analysis_result"]) == (True, '{"n":1}')
    assert got["b"]["analysis_result"] is None


def test_selection_and_batches(spark):
    rows = [(f"p{i:03d}", float(i % 40), i, "t" if i % 3 else "u") for i in range(200)]
    posts = scored(spark, rows).repartition(6)
    settings = Settings(min_score=10, max_analyzed=30, batch_size=7)
    want = sorted((r for r in rows if r[1] >= 10), key=lambda r: (-r[1], r[2]))
    got = ranking.assign_batches(ranking.select_for_analysis(posts, settings), settings)
    place = {r["id"]: (r["rank"], r["batch"]) for r in got.collect()}
    assert place == {r[0]: (n + 1, n // 7) for n, r in enumerate(want[:30])}
    per = ranking.select_for_analysis(posts, settings, per="topic")
    for topic in "tu":
        mine = [r[0] for r in want if r[3] == topic][:30]
        assert ids(per.filter(F.col("topic") == topic)) == sorted(mine)


def test_group_limit_runs_before_the_shuffle(spark):
    posts = scored(spark, [("a", 9.0, 1, "t"), ("b", 8.0, 2, "t")])
    plan = ranking.select_for_analysis(posts, per="topic")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_platforms_and_age(spark):
    posts = spark.createDataFrame(
        [("a", "hn", dt.datetime(2025, 8, 5)), ("b", "hn", dt.datetime(2025, 8, 4)),
         ("c", "x", NOW)], "id string, platform string, created_at timestamp")
    assert ids(filters.filter_max_age(posts, NOW, 180)) == ["a", "c"]
    assert ids(filters.select_platforms(posts, ["hn", "x"], {"x": False})) == ["a", "b"]


def test_runs(spark):
    runs = spark.createDataFrame(
        [(1, "a", "r1"), (3, "a", "r3"), (2, "b", "r2")], "id bigint, topic string, report_path string")
    assert tables.latest_run(runs).first()["report_path"] == "r3"
    assert tables.latest_run(runs, "b").first()["report_path"] == "r2"
    assert tables.latest_run(runs, "c").count() == 0
    record = tables.run_record(runs, "a", ["hn"], F.lit(NOW), F.lit(5), F.lit(2), "r4").first()
    assert (record["id"], record["posts_fetched"], record["started_at"]) == (4, 5, NOW)


POST = """id string, platform string, topic string, title string, body string, points bigint,
 matched_queries array<string>, seq bigint"""


def test_a_repeated_load_replaces_itself(spark, tmp_path):
    store = PostStore(spark, str(tmp_path / "store"))
    first = spark.createDataFrame(
        [("a", "hn", "API testing", "API testing", "broken and slow", 9, ["q"], 0),
         ("a", "hn", "API testing", "API testing", "", 0, ["q"], 1),
         ("b", "hn", "API testing", "t", "", 0, ["q"], 2)], POST)
    second = first.unionAll(spark.createDataFrame(
        [("c", "hn", "API testing", "API testing", "hate", 1, ["q"], 3)], POST))
    for _ in range(2):
        assert ingest(first, store, "one", F.lit(NOW)).count() == 3
        assert ids(store.read("posts")) == ["a", "b"]
        assert ids(store.read("history")) == ["a", "b"]
    for _ in range(2):
        assert ids(ingest(second, store, "two", F.lit(NOW))) == ["c"]
        assert ids(store.read("posts")) == ["a", "b", "c"]
        assert ids(store.read("history")) == ["a", "b", "c"]
    stored = {r["id"]: r for r in store.posts().collect()}
    assert stored["a"]["body"] == "broken and slow"  # the best of the two rows
    assert stored["a"]["topic_relevance"] == 0.8 and stored["b"]["topic_relevance"] == 0.0
    assert "a" in ids(store.read("alerts")) and "b" not in ids(store.read("alerts"))
    assert not stored["a"]["analyzed"]
