import hashlib
import json

import pytest

from voicelode import values
from voicelode.operators.collapse import collapse_hits, enrich_with_comments, union_sources
from voicelode.operators import filters
from voicelode.operators.filters import match_queries
from voicelode.sources import payloads
from voicelode.sources.imports import read_import
from voicelode.sources.searchplan import boolean_queries, search_plan


@pytest.fixture
def land(spark, tmp_path):
    def write(kind, *responses):
        folder = tmp_path / kind
        folder.mkdir(exist_ok=True)
        lines = [
            r if isinstance(r, str) else json.dumps({"topic": "t", "query": f"q{n}",
                                                     "fetched_seq": n, **r})
            for n, r in enumerate(responses)
        ]
        (folder / "part.json").write_text("\n".join(lines))
        return payloads.read_payloads(spark, str(folder), kind)

    return write


def test_hn_comments(land):
    hit = {"objectID": "7", "story_title": "S", "comment_text": "a<p>b &amp; c", "author": "me",
           "points": None, "created_at": "2026-01-02T00:00:00Z"}
    got = payloads.read_hn_comments(land("hn_comments", {"hits": [hit]}, "{broken", {"hits": []}))
    row = got.collect()
    assert len(row) == 1
    row = row[0]
    assert row["id"] == "hn_7" and row["platform"] == "hn" and row["community"] == "hn"
    assert row["url"] == "https://news.ycombinator.com/item?id=7"
    assert (row["title"], row["body"], row["points"], row["num_comments"]) == ("S", "a\nb & c", 0, 0)
    assert row["created_at"].isoformat() == "2026-01-02T00:00:00"


def test_hn_stories_need_more_points_than_the_minimum(land):
    hits = [{"objectID": str(p), "title": "T", "points": p, "num_comments": None} for p in (1, 2, 3)]
    landed = land("hn_stories", {"hits": hits})
    assert [r["id"] for r in payloads.read_hn_stories(landed, 2).collect()] == ["hn_3"]
    assert payloads.read_hn_stories(landed, 0).count() == 3
    assert payloads.read_hn_stories(landed, 2).first()["body"] == ""


def reddit(id_, kind="t3", **fields):
    data = {"id": id_, "permalink": f"/r/{id_}", "title": "T", "num_comments": 0, "score": 4,
            "created_utc": 1767312000.0, "subreddit": "SaaS", **fields}
    return {"kind": kind, "data": data}


def test_reddit_posts(land):
    children = [reddit("a", selftext=None), reddit("b", kind="t5"), reddit("c", author="me")]
    got = {r["id"]: r for r in payloads.read_reddit_posts(
        land("reddit_posts", {"data": {"children": children}})).collect()}
    assert set(got) == {"reddit_a", "reddit_c"}
    a = got["reddit_a"]
    assert (a["author"], a["body"], a["url"]) == ("[deleted]", "", "https://reddit.com/r/a")
    assert a["created_raw"] == "1767312000.0"
    assert a["created_at"].isoformat() == "2026-01-02T00:00:00"
    assert got["reddit_c"]["author"] == "me"


def test_reddit_comments_take_five_children_before_the_filter(land):
    bodies = ["1", "[deleted]", "", "4", None, "6"]
    children = [{"kind": "t1", "data": {"body": b}} for b in bodies]
    listings = [{}, {"data": {"children": children}}]
    got = payloads.read_reddit_comments(land("reddit_comments", {"post_id": "a", "listings": listings}))
    assert got.first()["comments"] == ["1", "4"]


def test_launches(land):
    def node(id_, **fields):
        return {"node": {"id": id_, "name": "N", "url": "https://p/x?utm_source=a&k=1", **fields}}

    topics = {"edges": [{"node": {"name": n}} for n in "abcd"]}
    edges = [node("1", tagline="video maker", topics=topics, votesCount=3, commentsCount=11),
             node("2", description="nothing")]
    landed = land("launch_posts", {"data": {"posts": {"edges": edges}}})
    rows = payloads.read_launch_posts(landed, "AI Video").collect()
    assert [r["id"] for r in rows] == ["ph_1"]
    assert (rows[0]["body"], rows[0]["community"]) == ("video maker", "a, b, c")
    assert (rows[0]["url"], rows[0]["points"]) == ("https://p/x?k=1", 3)
    assert payloads.read_launch_posts(landed).count() == 2


def test_launch_comments_keep_empty_ones(land):
    edges = [{"node": {"body": b}} for b in ["a", "", None] + [str(n) for n in range(10)]]
    landed = land("launch_comments", {"post_id": "1", "data": {"post": {"comments": {"edges": edges}}}})
    got = payloads.read_launch_comments(landed).first()["comments"]
    assert got == ["a", "", ""] + [str(n) for n in range(7)]


def test_tweets(land):
    data = [{"id": "5", "text": "hello", "author_id": "u", "created_at": "2026-01-02T00:00:00Z",
             "public_metrics": {"like_count": 2, "retweet_count": 3, "reply_count": 4}},
            {"id": "6", "text": "no metrics"}]
    got = {r["id"]: r for r in payloads.read_tweets(land("tweets", {"data": data})).collect()}
    assert (got["x_5"]["points"], got["x_5"]["num_comments"], got["x_5"]["title"]) == (5, 4, "")
    assert (got["x_6"]["points"], got["x_6"]["url"]) == (0, "https://x.com/i/status/6")


def test_import_file(spark, tmp_path):
    items = [
        {"id": "a", "title": "T", "body": "B", "points": 3, "likes": 9, "created_at": "2026-01-02"},
        {"url": "https://x.com/1", "body": "b" * 100, "likes": 9, "replies": 2},
        {"body": "no key", "date": "2026-01-03"},
        {"id": "", "url": "", "title": "", "body": "blank keys"},
    ]
    (tmp_path / "posts.json").write_text(json.dumps(items))
    rows = read_import(spark, str(tmp_path / "posts.json"), "topic").orderBy("seq").collect()
    by_url = "x_" + hashlib.md5(b"https://x.com/1").hexdigest()[:12]
    assert [r["id"] for r in rows] == ["a", by_url, "import_2", "import_3"]
    assert (rows[0]["points"], rows[1]["points"], rows[1]["num_comments"]) == (3, 9, 2)
    assert rows[1]["title"] == "b" * 80 and rows[3]["title"] == ""
    assert rows[2]["created_at"].isoformat() == "2026-01-03T00:00:00"
    assert {tuple(r["matched_queries"]) for r in rows} == {("import",)}
    assert {r["platform"] for r in rows} == {"x"}


def test_collapse_in_arrival_order(land):
    first = {"data": {"children": [reddit("a", title="first"), reddit("b")]}}
    second = {"data": {"children": [reddit("b"), reddit("a", title="second")]}}
    hits = payloads.read_reddit_posts(land("reddit_posts", first, second)).repartition(4)
    every = {r["id"]: r for r in collapse_hits(hits).collect()}
    assert every["reddit_a"]["matched_queries"] == ["q0", "q1"]
    assert every["reddit_a"]["title"] == "first"
    only = {r["id"]: r for r in collapse_hits(hits, keep="first").collect()}
    assert only["reddit_b"]["matched_queries"] == ["q0"]
    assert [every[i]["seq"] for i in ("reddit_a", "reddit_b")] == [0, 1]
    with pytest.raises(ValueError):
        collapse_hits(hits, keep="last")


def test_enrichment(spark):
    posts = spark.createDataFrame(
        [("a", "A", 10), ("b", "B", 9), ("c", "C", 50), ("d", "D", 50)],
        "id string, body string, num_comments int")
    comments = spark.createDataFrame(
        [("a", ["x", "y"], 2), ("a", ["late"], 3), ("b", ["z"], 1), ("d", [], 1)],
        "id string, comments array<string>, fetched_seq int")
    got = enrich_with_comments(posts, comments, values.REDDIT_COMMENT_HEADER,
                               values.REDDIT_COMMENT_SEPARATOR)
    assert {r["id"]: r["body"] for r in got.collect()} == {
        "a": "A\n\n--- TOP COMMENTS ---\nx\n---\ny", "b": "B", "c": "C", "d": "D"}


def test_union_keeps_source_order(spark):
    one = spark.createDataFrame([("a", 5)], "id string, seq bigint")
    two = spark.createDataFrame([("b", 0, "w")], "id string, seq bigint, website string")
    rows = union_sources([one, two]).orderBy("seq").collect()
    assert [(r["id"], r["website"]) for r in rows] == [("a", None), ("b", "w")]


def test_search_plan(spark):
    plan = search_plan(spark.createDataFrame([("API testing",)], "topic string"))
    rows = plan.orderBy("query_no").collect()
    assert len(rows) == 24
    assert rows[0]["query"] == "API testing frustrating"
    assert boolean_queries(plan).count() == 8


@pytest.mark.parametrize("size", [256, 2])
def test_boolean_queries_match_as_defined(spark, size, monkeypatch):
    monkeypatch.setattr(filters, "WRITTEN_QUERIES", size)
    monkeypatch.setattr(filters, "CHUNK_QUERIES", 2)
    queries = [(0, "q0", "AI tool", ["hate", "I'd pay for"]), (1, "q1", "é", ["x"]),
               (2, "q2", "no", ["n"]), (3, "q3", "none of these", ["x"]), (4, "q4", "AI", []),
               (5, "q5", "", ["ice", None]), (6, "q6", "ai", [None]), (7, "q7", "i t", ["zz", "A"]), (8, "q8", "AI TOOL", ["l"])]
    posts = [("a", 0, "My AI tools", "i'd PAY for it"), ("b", 1, "ai tool", "nice"),
             ("c", 2, "É x", ""), ("d", 3, "no", None), ("e", 4, None, "𝄞 no n"), ("f", 5, "", "")]
    frame = spark.createDataFrame(posts, "id string, seq int, title string, body string")
    table = spark.createDataFrame(
        queries, "query_no int, query string, phrase string, alternatives array<string>")
    got = {(r["id"], r["query"]) for r in match_queries(frame, table).collect()}
    want = set()
    for id_, _, title, body in posts:
        text = ((title or "") + " " + (body or "")).lower()
        for _, query, phrase, alternatives in queries:
            if phrase.lower() in text and any(a.lower() in text for a in alternatives if a is not None):
                want.add((id_, query))
    assert got == want
    again = table.unionByName(table)  # equal queries stay apart
    assert match_queries(frame, again).count() == 2 * len(want)


def test_equal_queries_are_looked_for_once(spark, monkeypatch):
    sent, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: sent.append(x) or broadcast(self, x))
    queries = [(n, f"q{n % 7}", ["ai", "tool", None, "AI"][n % 4], ["x", None] if n % 3 else ["X", "y"]) for n in range(600)]
    table = spark.createDataFrame(queries, "query_no int, query string, phrase string, alternatives array<string>")
    posts = [("a", "an ai tool", "y"), ("b", "ai", "x"), ("b", "ai", "x"), ("c", None, "tool"), (None, "tools", "xy")]
    frame = spark.createDataFrame(posts, "id string, title string, body string")
    want = sorted(
        (id_ or "", query, n)
        for id_, title, body in posts
        for n, query, phrase, alternatives in queries
        if phrase and phrase.lower() in f"{title or ''} {body}" and any(a.lower() in f"{title or ''} {body}" for a in alternatives if a)
    )
    for size in (1 << 16, 64):  # one chunk, and more queries of a pattern than a chunk takes
        sent.clear()
        monkeypatch.setattr(filters, "CHUNK_QUERIES", size)
        got = match_queries(frame, table)
        assert sorted((r["id"] or "", r["query"], r["query_no"]) for r in got.collect()) == want
        patterns = [list(zip(*x)) for x in sent if isinstance(x, tuple)]
        assert patterns and all(len(set(p)) == len(p) <= 4 for p in patterns)
        assert size > 64 or len(patterns) == 8  # 450 usable ones
