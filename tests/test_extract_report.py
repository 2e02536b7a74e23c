import datetime as dt
import json
import os

import pytest

from voicelode.operators import extract, report
from voicelode.plans import runs
from voicelode.settings import Settings
from voicelode.sources.store import PostStore

NOW = dt.datetime(2026, 2, 1, 12, 30)


def response_rows(spark, *texts):
    return spark.createDataFrame(
        [("t", n, text, None) for n, text in enumerate(texts)],
        "topic string, batch int, response string, error string")


def test_responses_in_all_shapes(spark):
    item = {"description": "d", "emotional_intensity": "4", "unique_users": 2.0,
            "payment_signal": True, "representative_quotes": ["a", {"text": "b", "url": "u"}],
            "source_urls": ["u1"]}
    good = json.dumps([item])
    texts = [good, f"```json\n{good}\n```", f"```\n{good}```", f"json{good}", f" \n{good}\n",
             json.dumps(item), "[{broken", "no json", None, "[]", f"{good} and more", ""]
    parsed = extract.parse_responses(response_rows(spark, *texts)).orderBy("ord").collect()
    assert [r["batch"] for r in parsed] == [0, 1, 2, 3, 4]
    assert [r["ord"] for r in parsed] == [1, 2, 3, 4, 5]
    for row in parsed:
        assert (row["emotional_intensity"], row["unique_users"]) == (4, 2)
        assert row["payment_signal"] is True
        assert row["representative_quotes"] == ["a", "b"]
    rejected = extract.rejected_responses(response_rows(spark, *texts)).collect()
    assert sorted(r["batch"] for r in rejected) == [5, 6, 7, 8, 10, 11]


def selected(spark):
    rows = [(f"u{i}", f"t{i}", "b" * 3000, "me", i, "hn", "hn", 1, 2, "API", i + 1, i // 2)
            for i in range(5)]
    return spark.createDataFrame(
        rows, "url string, title string, body string, author string, points bigint, "
        "platform string, community string, pain_score int, demand_score int, topic string, "
        "rank int, batch int")


def test_prompts_and_calls(spark, tmp_path):
    prompts = extract.build_prompts(selected(spark)).orderBy("batch").collect()
    posts = [json.loads(p["prompt"].split("\nPosts:\n")[-1]) for p in prompts]
    assert [[q["url"] for q in p] for p in posts] == [["u0", "u1"], ["u2", "u3"], ["u4"]]
    assert set(posts[0][0]) == {"url", "title", "body", "author", "points", "platform",
                                "community", "pain_score", "demand_score"}
    assert len(posts[0][0]["body"]) == 2000
    assert '"API"' in prompts[0]["prompt"]

    calls = str(tmp_path)

    def model(prompt):
        found = json.loads(prompt.split("\nPosts:\n")[-1])
        with open(os.path.join(calls, found[0]["url"]), "a") as log:
            log.write("x")
        if found[0]["url"] == "u2":
            raise RuntimeError("busy")
        return json.dumps([{"description": p["title"]} for p in found])

    points = extract.extract_points(selected(spark), model)
    for _ in range(2):  # reading twice must not call the model again
        assert [r["description"] for r in points.orderBy("ord").collect()] == ["t0", "t1", "t4"]
    assert {f: open(os.path.join(calls, f)).read() for f in os.listdir(calls)} == {
        "u0": "x", "u2": "x", "u4": "x"}


def lines_of(path):
    parts = sorted(f for f in os.listdir(path) if f.startswith("part"))
    return "".join(open(os.path.join(path, f), encoding="utf-8").read() for f in parts).splitlines()


SCORED = """id string, platform string, url string, title string, body string, points bigint,
 num_comments bigint, pain_score int, demand_score int, relevance_score double,
 topic_relevance double, seq bigint"""


def test_report_without_findings(spark, tmp_path):
    rows = [("a", "hn", "ua", "T" * 90, "line\none", 5, 11, 1, 2, 8.0, 0.4, 0),
            ("b", "x", "ub", "B", "", 7, 11, 0, 0, 9.5, None, 1),
            ("c", "reddit", "uc", "C", None, 9, 10, 0, 0, 1.0, 1.0, 2)]
    empty = spark.createDataFrame([], "ord bigint, platform_count int")
    lines = report.report_lines("My Topic", spark.createDataFrame(rows, SCORED), empty, NOW, 0)
    path = report.write_report(lines, f"{tmp_path}/{report.report_name('My Topic', NOW.date())}")
    assert path.endswith("2026-02-01-my-topic.md")
    assert lines_of(path) == [
        "# Pain Point Research: My Topic",
        "> Generated: 2026-02-01 12:30 | Tool: voicelode", "",
        "## Search Transparency", "",
        "| Metric | Value |", "|--------|-------|",
        "| Total posts collected | 3 |", "| HN posts | 1 |", "| Reddit posts | 1 |",
        "| X/Twitter posts | 1 |", "| Posts sent to Gemini | 0 |", "| Pain points identified | 0 |",
        "| Data source level | **Primary** — all from original posts with URLs |", "",
        "## Results", "", "No pain points identified by Gemini analysis.", "",
        "### Top Scored Posts (Rule-Based)", "",
        "**1. [B](ub)**", "- Platform: x | Points: 7 | Pain: 0 | Demand: 0 | Score: 9.5", "",
        f"**2. [{'T' * 80}](ua)**",
        "- Platform: hn | Points: 5 | Pain: 1 | Demand: 2 | Score: 8.0", "- > line one...", "",
        "**3. [C](uc)**", "- Platform: reddit | Points: 9 | Pain: 0 | Demand: 0 | Score: 1.0", "",
        "## High-Engagement Discussion Hubs", "",
        "These posts have the most discussion — worth reading manually:", "",
        "- [B](ub) — 7↑ 11💬 (x)", f"- [{'T' * 80}](ua) — 5↑ 11💬 (hn)", "",
    ]


def test_report_name():
    assert report.report_name("A b C", dt.date(2026, 1, 2)) == "2026-01-02-a-b-c.md"
    assert len(report.report_name("x" * 99, dt.date(2026, 1, 2))) == len("2026-01-02-") + 40 + 3


@pytest.fixture
def landed(tmp_path):
    def land(kind, *responses):
        folder = tmp_path / "landed" / kind
        folder.mkdir(parents=True)
        text = "\n".join(json.dumps({"topic": "API testing", "query": f"{kind}{n}", "fetched_seq": n,
                                     **r}) for n, r in enumerate(responses))
        (folder / "a.json").write_text(text)

    def comment(id_, text):
        return {"objectID": id_, "story_title": "API testing", "comment_text": text, "author": "a",
                "points": 5, "created_at": "2026-01-01T00:00:00Z"}

    land("hn_comments",
         {"hits": [comment("1", "slow &amp; broken<p>I wish there was a tool"), comment("2", "hate")]},
         {"hits": [comment("1", "again")]})
    node = {"id": "7", "name": "API testing", "tagline": "would pay", "url": "https://p/7?utm_a=1",
            "votesCount": 3, "commentsCount": 12, "createdAt": "2026-01-05T00:00:00Z"}
    old = {**node, "id": "8", "createdAt": "2020-01-01T00:00:00Z"}
    land("launch_posts", {"data": {"posts": {"edges": [{"node": node}, {"node": old}]}}})
    land("launch_comments",
         {"post_id": "7", "data": {"post": {"comments": {"edges": [{"node": {"body": "awful"}}]}}}})
    return str(tmp_path / "landed")


@pytest.fixture
def model():
    def answer(prompt):
        return json.dumps([
            {"description": "tests are slow to run", "category": "pricing",
             "emotional_intensity": 4, "unique_users": 2,
             "source_urls": ["https://news.ycombinator.com/item?id=1"]},
            {"description": "tests are slow to run now", "unique_users": 3, "payment_signal": True,
             "payment_quote": "pq", "source_urls": ["https://reddit.com/r/z"]},
            {"description": "something else", "unique_users": 1, "emotional_intensity": 1},
        ])

    return answer


def test_search_then_analysis(spark, landed, tmp_path, model):
    store = PostStore(spark, str(tmp_path / "store"))
    out = str(tmp_path / "out")
    done = runs.run_search(spark, landed, store, "API testing", out, NOW, "l1")
    got = {r["id"]: r for r in done.scored.collect()}
    assert set(got) == {"hn_1", "hn_2", "ph_7"}  # the old launch is past the age limit
    assert got["hn_1"]["matched_queries"] == ["hn_comments0", "hn_comments1"]
    assert got["ph_7"]["body"] == "would pay\n\n--- User Comments ---\nawful"
    assert got["ph_7"]["url"] == "https://p/7"
    assert done.points is None and done.analyzed == 0

    analyzed = runs.run_analysis(store, "API testing", out, NOW, "l2", model, Settings(min_score=1))
    assert analyzed.analyzed == 3
    points = {r["description"]: r for r in analyzed.points.collect()}
    assert set(points) == {"tests are slow to run", "something else"}
    merged = points["tests are slow to run"]
    assert (merged["unique_users"], merged["payment_quote"], merged["platform_count"]) == (3, "pq", 2)
    text = lines_of(analyzed.report_path)
    assert "| Posts sent to Gemini | 3 |" in text
    assert "- **Cross-platform**: ⚡ Moderate (hn, reddit)" in text
    assert "## High Confidence Pain Points" in text and "## Low Confidence / Emerging Signals" in text
    assert "## Medium Confidence" not in text
    assert runs.run_analysis(store, "API testing", out, NOW, "l3", model, Settings(min_score=1)) is None
    assert store.posts().filter("analyzed").count() == 3

    again = runs.run_search(spark, landed, store, "API testing", out, NOW, "l4")
    assert again.scored.count() == 0
    assert runs.run_search(spark, landed, store, "other topic", out, NOW, "l5") is None
    assert [r["id"] for r in store.read("runs").orderBy("id").collect()] == [1, 2]


def test_import_run(spark, tmp_path, model):
    path = tmp_path / "posts.json"
    path.write_text(json.dumps([{"url": "https://x.com/1", "body": "API testing hate"},
                                {"url": "https://x.com/1", "body": "API testing twice"}]))
    store = PostStore(spark, str(tmp_path / "store"))
    done = runs.run_import(spark, str(path), store, "API testing", str(tmp_path / "out"), NOW, "l1",
                           settings=Settings(min_score=0), fn=model)
    assert done.scored.count() == 2 and done.analyzed == 2  # both are scored, one is stored
    assert store.read("posts").count() == 1
    assert "| X/Twitter posts | 2 |" in lines_of(done.report_path)
    assert runs.run_import(spark, str(path), store, "API testing", str(tmp_path / "out"), NOW, "l2") is None


def test_responses_are_parsed_once(spark):
    plan = extract.rejected_responses(response_rows(spark, "[]", "no json"))._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("from_json") == 1
