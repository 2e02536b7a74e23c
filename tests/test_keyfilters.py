import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from voicelode.operators.tables import drop_processed, missing_keys
from voicelode.sources import keyfilters
from voicelode.sources.store import PostStore

HISTORY = "id string, platform string, processed_at timestamp"
NOW = dt.datetime(2026, 1, 1)


def loads_of(df):
    return {f.split("load_id=")[1].split("/")[0] for f in df.inputFiles()}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Eight loads of a hundred posts each, ids in no order; one load more has none."""
    store = PostStore(spark, str(tmp_path_factory.mktemp("store")), few=4)
    ids = [f"p{k}" for k in range(800)]
    random.Random(1).shuffle(ids)
    for load in range(8):
        rows = [(i, "hn", NOW) for i in ids[load * 100 : load * 100 + 100]] + [(None, "hn", NOW)]
        store.write(spark.createDataFrame(rows, HISTORY), "history", f"l{load}")
    store.write(spark.createDataFrame([], HISTORY), "history", "none")
    return store, ids


def test_only_folders_that_may_hold_the_keys_are_read(spark, store):
    store, ids = store
    posts = spark.createDataFrame([(ids[205], "hn"), (ids[206], "x"), (ids[610], "hn"), ("q", "hn"), (None, "hn")], "id string, platform string")
    held = store.holding("history", posts)
    assert {"l2", "l6"} <= loads_of(held) and len(loads_of(held)) <= 3
    key = lambda df: sorted(map(str, df.collect()))
    assert key(drop_processed(posts, held)) == key(drop_processed(posts, store.read("history")))
    assert "l2" not in loads_of(store.holding("history", posts, but="l2"))


def test_ids_of_every_load_are_found(spark, store):
    store, ids = store
    posts = spark.createDataFrame([(i, "hn") for i in ids], "id string, platform string")
    assert drop_processed(posts, store.holding("history", posts)).isEmpty()
    assert store.holding("history", posts.limit(0)).isEmpty()
    assert store.holding("history", posts.select(F.concat(F.lit("zz"), "id").alias("id"))).isEmpty()  # out of range


def test_a_load_written_anew_gets_a_new_filter(spark, tmp_path):
    store = PostStore(spark, str(tmp_path), few=0)
    post = lambda *ids: spark.createDataFrame([(i, "t") for i in ids], "id string, topic string")
    store.write(post("a", "b"), "posts", "one")
    store.write(post("c"), "posts", "two")
    assert loads_of(store.holding("posts", post("a"))) == {"one"}
    store.write(post("d"), "posts", "one")
    assert store.holding("posts", post("a")).isEmpty()
    assert loads_of(store.holding("posts", post("d"))) == {"one"}
    assert [r.id for r in missing_keys(post("c", "e"), store.holding("posts", post("c", "e")), ["id"]).collect()] == ["e"]


def test_filters_that_were_not_finished_do_not_count(spark, tmp_path):
    store = PostStore(spark, str(tmp_path), few=0)
    rows = spark.createDataFrame([("a", "hn", NOW)], HISTORY)
    store.write(rows, "history", "one")
    filters = store._filters("history")
    half = f"{filters.root}/build-half"
    spark.createDataFrame([], "word long").write.parquet(f"{half}/load_id=one")  # no _SUCCESS beside the loads
    assert filters.known() == {}
    assert store.holding("history", rows).count() == 1


def test_false_share(spark):
    """Filters let few foreign ids through, as many as computed."""
    assert keyfilters.false_share() < 0.001
    words = F.lit(1 << 10).cast("long")
    h = F.xxhash64("id")
    own = spark.range(2048).select(F.col("id").cast("string").alias("id")).groupBy(keyfilters._word(h, words).alias("word"))
    own = own.agg(F.bit_or(keyfilters._mask(h)).alias("bits"))
    foreign = spark.range(10_000, 210_000).select(F.col("id").cast("string").alias("id"))
    probes = foreign.select(keyfilters._word(h, words).alias("word"), keyfilters._mask(h).alias("mask"))
    through = probes.join(own, "word").filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).count()
    assert through / 200_000 < 3 * keyfilters.false_share()
