import datetime as dt

import pytest

from voicelode.sources.snapshots import Manifest, Snapshots
from voicelode.sources.store import PostStore

HISTORY = "id string, platform string, processed_at timestamp"
POST = "id string, topic string, title string"
NOW = dt.datetime(2026, 1, 1)


def history(spark, *ids):
    return spark.createDataFrame([(i, "hn", NOW) for i in ids], HISTORY)


def rows(df):
    return sorted(map(str, df.collect()))


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.fixture
def store(spark, tmp_path):
    """Six loads of history, one of them empty and one with repeated rows."""
    store = PostStore(spark, str(tmp_path / "store"), few=1)
    for k in range(4):
        store.write(history(spark, f"a{k}", f"b{k}"), "history", f"l{k}")
    store.write(history(spark), "history", "none")
    store.write(history(spark, "x", "x"), "history", "twice")
    return store


def test_compaction_changes_no_row(spark, store):
    before = store.read("history")
    kept = rows(before)
    assert store.compact("history")
    after = store.read("history")
    assert rows(after) == kept and rows(store.read("history", "l2")) == [r for r in kept if "load_id='l2'" not in r]
    assert len(after.inputFiles()) == 1 < len(before.inputFiles())
    assert not store.compact("history")  # one part already
    store.write(history(spark, "new"), "history", "later")
    assert ids(store.read("history")) == sorted([*ids(before), "new"])
    assert store.compact("history") and len(store.read("history").inputFiles()) == 1
    assert len(rows(store.read("history"))) == len(kept) + 1


def test_partitioned_tables_and_nulls(spark, tmp_path):
    store = PostStore(spark, str(tmp_path))
    for k in range(3):
        data = [(None, "t", "no id"), (f"p{k}", "t", None), (f"p{k}", None, ""), ("same", "u", "x")]
        store.write(spark.createDataFrame(data, POST), "posts", f"l{k}")
    kept = rows(store.read("posts"))
    assert store.compact("posts", file_bytes=1 << 10)
    assert rows(store.read("posts")) == kept and len(kept) == 12


def test_a_reader_keeps_its_version(spark, store):
    opened = store.read("history")
    kept = rows(opened)
    store.write(history(spark, "z"), "history", "l1")  # written anew
    replaced = store.read("history")
    assert ids(replaced) == sorted([*(set(ids(opened)) - {"a1", "b1"}), "x", "z"])
    store.compact("history")
    assert rows(opened) == kept and rows(replaced) == rows(store.read("history"))


def test_a_compacted_load_written_anew_counts_once(spark, store):
    store.compact("history")
    for _ in range(2):
        store.write(history(spark, "a1", "c1"), "history", "l1")
        found = ids(store.read("history"))
        assert found.count("a1") == 1 and "c1" in found and "b1" not in found
        assert not {"a1", "c1"} & set(ids(store.read("history", "l1")))
    store.compact("history")
    assert ids(store.read("history")) == found


def test_vacuum_deletes_what_no_version_reads(spark, store):
    kept = rows(store.read("history"))
    assert store.vacuum("history", 0) == []
    store.write(history(spark, "a1", "b1"), "history", "l1")
    store.compact("history")
    assert store.vacuum("history", 3600) == []
    gone = store.vacuum("history", -60)  # as if a minute later
    assert len(gone) == 7  # six first folders and the one written anew
    assert rows(store.read("history")) == kept
    store.write(history(spark, "again"), "history", "l0")
    found = ids(store.read("history"))
    assert "again" in found and "a0" not in found


def test_look_ups_read_only_parts_that_may_hold_the_keys(spark, store):
    store.compact("history")
    store.write(history(spark, "n1"), "history", "new1")
    store.write(history(spark, "n2"), "history", "new2")
    held = store.holding("history", history(spark, "n1"))
    assert ids(held) == ["n1"] and all("load_id=new1" in f for f in held.inputFiles())
    assert ids(store.holding("history", history(spark, "a2", "n2"))) == sorted([*(f"{c}{k}" for c in "ab" for k in range(4)), "n2", "x", "x"])
    store.write(history(spark, "n3"), "history", "new1")
    assert store.holding("history", history(spark, "n1")).isEmpty()
    assert ids(store.holding("history", history(spark, "n3"))) == ["n3"]
    assert store.holding("history", history(spark, "n3"), but="new1").isEmpty()


def test_settled_updates_are_the_last_ones(spark, tmp_path):
    store = PostStore(spark, str(tmp_path))
    store.write(spark.createDataFrame([("a", "t", "x"), ("b", "t", "x")], POST), "posts", "one")
    marks = "id string, analysis_result string, analyzed_at timestamp"
    for k in range(3):
        done = [("a", f"r{k}", NOW + dt.timedelta(days=k))] + [("b", "only", NOW)] * (k == 0)
        store.write(spark.createDataFrame(done, marks), "analyzed", f"m{k}")
        store.write(spark.createDataFrame([("a", "t", f"title {k}")], POST), "revisions", f"v{k}")
    before = rows(store.posts()), rows(store.read("posts"))
    assert store.compact("analyzed", settle=True) and store.compact("revisions", settle=True)
    assert (rows(store.posts()), rows(store.read("posts"))) == before
    assert store.read("analyzed").count() == 2 and store._stored("revisions").count() == 1
    with pytest.raises(ValueError, match="settled"):
        store.write(spark.createDataFrame([], marks), "analyzed", "m1")


def test_unfinished_loads_stay_as_they_are(spark, store, tmp_path):
    (tmp_path / "store/history/load_id=l3/_SUCCESS").unlink()
    kept = rows(store.read("history"))
    store.compact("history")
    assert rows(store.read("history")) == kept
    assert len(store.read("history").inputFiles()) > 1


def test_a_load_written_anew_during_a_compaction():
    seen = Manifest(moved={"m": "at1"}, parts={"p": ["q"]}, folded=["q", "r"])
    now = seen.with_moved("a", "at2").with_moved("m", "at3").with_moved("r", "at4")
    done = now.with_part(seen, ["a", "b"], "new", settle=False)
    assert done.moved == {"a": "at2", "m": "at3", "r": "at4"}
    assert done.parts == {"new": ["a", "m", "r"]}
    assert done.own(["a", "b", "c", "m", "q", "r"]) == ["c"]
    assert done.with_part(seen, ["a"], "other", settle=False) is None  # another compaction was first


def test_publishing_against_another_writer(spark, tmp_path):
    snapshots, tried = Snapshots(spark, str(tmp_path / "s")), []

    def change(latest):
        tried.append(dict(latest.moved))
        if len(tried) == 1:
            snapshots.publish(lambda own: own.with_moved("x", "first"))
        return latest.with_moved("y", "second")

    assert snapshots.publish(change)
    assert tried == [{}, {"x": "first"}]
    assert snapshots.latest() == (2, Manifest(moved={"x": "first", "y": "second"}))
    assert len(list((tmp_path / "s").glob("*.json"))) == 2 and not list((tmp_path / "s").glob(".draft-*"))
