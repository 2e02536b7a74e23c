import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from voicelode import scratch
from voicelode.operators.collapse import collapse_hits
from voicelode.operators.tables import drop_processed
from voicelode.plans.ingest import ingest
from voicelode.settings import Settings
from voicelode.sources import payloads
from voicelode.sources.store import PostStore
from voicelode.streaming.dedup import stream_dedup
from voicelode.streaming.ingest import collapsed_stream, read_stream, start_ingest

COLUMNS = ["id", "body", "points", "topic", "pain_score", "demand_score", "relevance_score"]


def land(folder, files):
    folder.mkdir(exist_ok=True)
    for name, ids in files.items():
        data = [{"id": str(i), "text": f"API testing is slow {i}", "author_id": "u",
                 "public_metrics": {"like_count": i}} for i in ids]
        line = {"data": data, "topic": "API testing", "query": "q", "fetched_seq": min(ids)}
        (folder / name).write_text(json.dumps(line))


def run(spark, folder, store, progress):
    stream = start_ingest(
        read_stream(spark, str(folder), "tweets", files_per_batch=1), payloads.read_tweets, store,
        str(progress), settings=Settings(min_score=1), keep="first")
    stream.awaitTermination()


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "landed"
    streamed, whole = PostStore(spark, str(tmp_path / "s")), PostStore(spark, str(tmp_path / "b"))
    land(folder, {"a.json": range(0, 6), "b.json": range(4, 9)})
    run(spark, folder, streamed, tmp_path / "progress")
    land(folder, {"c.json": range(8, 12)})  # later files go on where the stream stopped
    run(spark, folder, streamed, tmp_path / "progress")
    run(spark, folder, streamed, tmp_path / "progress")  # nothing new

    all_hits = payloads.read_tweets(payloads.read_payloads(spark, str(folder), "tweets"))
    ingest(collapse_hits(all_hits, "first"), whole, "all", F.lit(dt.datetime(2026, 1, 1)),
           Settings(min_score=1))
    for table in ("posts", "alerts"):
        left = sorted(streamed.read(table).select(COLUMNS).collect())
        assert left == sorted(whole.read(table).select(COLUMNS).collect())
    assert streamed.read("posts").count() == 12
    keys = [sorted(s.read("history").select("id", "platform").collect()) for s in (streamed, whole)]
    assert keys[0] == keys[1] and len(keys[0]) == 12


def test_a_repeated_stream_leaves_the_same_tables(spark, tmp_path):
    folder, store = tmp_path / "landed", PostStore(spark, str(tmp_path / "s"))
    land(folder, {"a.json": range(0, 6), "b.json": range(4, 9)})
    run(spark, folder, store, tmp_path / "one")
    before = sorted(store.read("posts").select(COLUMNS).collect())
    run(spark, folder, store, tmp_path / "two")  # progress lost: all batches run again
    assert sorted(store.read("posts").select(COLUMNS).collect()) == before


WHOLE = [*COLUMNS, "matched_queries", "topic_relevance"]


@pytest.mark.parametrize(("order", "keep"), [((2, 1, 0), "all"), ((1, 2, 0), "first")])
def test_hits_over_files_in_any_order_equal_the_batch(spark, tmp_path, order, keep):
    folder = tmp_path / "landed"
    folder.mkdir()
    hits = [("q1", 0, ["1", "2"]), ("q2", 7, ["2", "3"]), ("q3", 3, ["2", "1"])]
    for place, (query, seq, ids) in enumerate(hits):
        data = [{"id": i, "text": f"API testing {'is slow ' * seq}{i}", "public_metrics": {"like_count": seq}} for i in ids]
        line = {"data": data, "topic": "API testing", "query": query, "fetched_seq": seq}
        path = folder / f"{place}.json"
        path.write_text(json.dumps(line))
        os.utime(path, (order.index(place) * 100 + 1e9,) * 2)  # the stream takes the oldest first
    streamed, whole = PostStore(spark, str(tmp_path / "s")), PostStore(spark, str(tmp_path / "b"))
    start_ingest(
        read_stream(spark, str(folder), "tweets", files_per_batch=1), payloads.read_tweets, streamed,
        str(tmp_path / "progress"), settings=Settings(min_score=1), keep=keep).awaitTermination()
    landed = payloads.read_tweets(payloads.read_payloads(spark, str(folder), "tweets"))
    ingest(collapse_hits(landed, keep), whole, "all", F.lit(dt.datetime(2026, 1, 1)), Settings(min_score=1))
    left = sorted(streamed.read("posts").select(WHOLE).collect())
    assert left == sorted(whole.read("posts").select(WHOLE).collect()) and len(left) == 3
    ids = [{r["id"] for r in store.read("alerts").collect()} for store in (whole, streamed)]
    assert ids[0] <= ids[1]  # an alert that was raised before a revision stays
    assert streamed.posts().count() == 3


def test_posts_of_other_runs_are_not_revised(spark, tmp_path):
    folder, store = tmp_path / "landed", PostStore(spark, str(tmp_path / "s"))
    land(folder, {"a.json": range(0, 6), "b.json": range(4, 9)})
    all_hits = payloads.read_tweets(payloads.read_payloads(spark, str(folder), "tweets"))
    ingest(collapse_hits(all_hits, "first"), store, "search", F.lit(dt.datetime(2026, 1, 1)), Settings(min_score=1))
    before = sorted(store.read("posts").collect())
    run(spark, folder, store, tmp_path / "progress")
    assert sorted(store.read("posts").collect()) == before


def test_streaming_dedup(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    rows = [("a", "hn", start), ("a", "x", start), ("a", "hn", start + dt.timedelta(days=3)),
            ("b", "hn", start)]
    frame = spark.createDataFrame(rows, "id string, platform string, created_at timestamp")
    for n in range(2):
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / "in"))
    query = (stream_dedup(stream).writeStream.format("parquet")
             .option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "progress"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    got = spark.read.schema(frame.schema).parquet(str(tmp_path / "out"))
    assert sorted((r["id"], r["platform"]) for r in got.collect()) == [
        ("a", "hn"), ("a", "x"), ("b", "hn")]


def collapsed(spark, hits, folder, progress, **options):
    """What each micro-batch of a stream of hits gives out; every file is a micro-batch."""
    schema = "topic string, id string, query string, hit_seq long, body string, at timestamp"
    folder.mkdir(exist_ok=True)
    for n, rows in enumerate(hits):
        path = folder / f"{n}.json"
        lines = [dict(zip(("topic", "id", "query", "hit_seq", "body", "at"), (*r, "2026-01-01T00:00:00Z"), strict=True)) for r in rows]
        path.write_text("\n".join(map(json.dumps, lines)))
        os.utime(path, (n * 100 + 1e9,) * 2)
    out = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    writer = collapsed_stream(stream, **options).writeStream.outputMode("update").option("checkpointLocation", str(progress))
    writer = writer.foreachBatch(lambda batch, n: out.append(sorted(
        (r.topic, r.id, r.body, r.matched_queries, r.seq, r.again, r["at"].year) for r in batch.collect())))
    writer.trigger(availableNow=True).start().awaitTermination()
    return [b for b in out if b]


@pytest.mark.parametrize("keep", ["all", "first"])
def test_a_stream_that_ends_keeps_the_earliest_place(spark, tmp_path, keep):
    hits = [
        [("t", "1", "b", 5, "x"), ("t", "1", "a", 5, "x"), ("u", "1", None, 9, "y")],
        [("t", "1", "b", 2, "z"), ("t", "1", "c", 3, "z"), ("t", "2", "a", 4, "w")],
        [("t", "1", "b", 2, "other"), ("u", "1", "a", 9, "later")],
    ]
    ends = collapsed(spark, hits, tmp_path / "a", tmp_path / "p", keep=keep)
    assert [[r[-2] for r in batch] for batch in ends] == [[False, False], [True, False], [True, True]]
    assert ends[1][0] == ("t", "1", "z", ["b", "c", "a"] if keep == "all" else ["b"], 2, True, 2026)
    # of hits in the same place the first to come stays
    assert ends[2][0][2:] == ends[1][0][2:] and ends[2][1][:3] == ("u", "1", "y")


def test_a_stream_that_ends_runs_no_python(spark, tmp_path):
    (tmp_path / "in").mkdir()
    hits = spark.readStream.schema("topic string, id string, query string, hit_seq long, body string").json(str(tmp_path / "in"))
    assert "Pandas" not in collapsed_stream(hits)._jdf.queryExecution().logical().toString()


def test_a_stream_leaves_no_working_tables(spark, tmp_path):
    # every load works with tables that hold whole posts; when it is stored they are dropped
    folder, store = tmp_path / "landed", PostStore(spark, str(tmp_path / "s"))
    scratch.materialize(spark.range(1), "first")
    before = set(os.listdir(scratch.scratch_path(spark, "").rsplit("/", 1)[0]))
    land(folder, {"a.json": range(0, 6), "b.json": range(4, 9)})
    run(spark, folder, store, tmp_path / "progress")
    left = set(os.listdir(scratch.scratch_path(spark, "").rsplit("/", 1)[0])) - before
    assert not {name.split("-")[0] for name in left} & {"collapsed", "collected", "scored", "revised"}
    assert store.read("posts").count() == 9


def test_a_first_load_joins_nothing(spark, tmp_path):
    store = PostStore(spark, str(tmp_path / "s"))
    posts = spark.createDataFrame([("a", "hn", "long text")], "id string, platform string, body string")
    plan = drop_processed(posts, store.holding("history", posts))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_only_scratch_folders_are_dropped(spark, tmp_path):
    with pytest.raises(ValueError):
        scratch.drop_path(spark, str(tmp_path))
    with scratch.dropped_after(spark):
        path = scratch.materialize(spark.range(3), "step").inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
        assert os.path.exists("/" + path.lstrip("/"))
    assert not os.path.exists("/" + path.lstrip("/"))
