"""Incremental ingest: every landed file is processed once, as one load per micro-batch."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voicelode import schemas
from voicelode.plans.ingest import ingest, revise
from voicelode.scratch import dropped_after, materialize
from voicelode.settings import Settings
from voicelode.sources.store import PostStore, load_name


_STATE_CODEC = "spark.sql.streaming.stateStore.compression.codec"


def read_stream(spark: SparkSession, path: str, kind: str, files_per_batch: int = 1000):
    """Landed payload lines of one kind as a stream of files."""
    return (
        spark.readStream.schema(schemas.PAYLOADS[kind])
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
    )


def _names(hits: DataFrame) -> list[str]:
    return [c for c in hits.columns if c not in ("topic", "id", "query", "hit_seq")]


def _aggregated(hits: DataFrame, keep: str) -> DataFrame:
    """`collapsed_stream` without time-outs; its state has every place of a query once, with `first` only the earliest."""
    # the time of the micro-batch, which is the same when the batch is repeated; of hits in one place the earlier batch's counts
    marked = hits.withColumn("_at", F.current_timestamp())
    place = F.struct("hit_seq", "query")
    queries = F.collect_set(place) if keep == "all" else F.array(F.min(place))
    posts = marked.groupBy("topic", "id").agg(
        F.min_by(F.struct(*_names(hits)), F.struct("hit_seq", "_at")).alias("record"),
        F.min("hit_seq").alias("seq"),
        queries.alias("_queries"),
        (F.min("_at") != F.max("_at")).alias("again"),
    )
    ordered = F.array_distinct(F.transform(F.sort_array("_queries"), lambda q: q["query"]))
    return posts.select("topic", "id", "record.*", ordered.alias("matched_queries"), "seq", "again")


def collapsed_stream(
    hits: DataFrame, keep: str = "all", ttl: dt.timedelta = dt.timedelta(days=30), available_now: bool = True
) -> DataFrame:
    """The posts of a stream of hits, each as it is after all its hits so far, and whether it was given out before (`again`).

    State is kept by topic and id: the earliest hit with its fields, and the earliest place of every query.  So a
    post is the same whatever files and micro-batches its hits come in, and equals `collapse_hits` over all of them.
    A post that has had no hit for `ttl` is forgotten by a stream that keeps running; a later hit of it begins anew.
    A stream that ends with the files at hand keeps its state: waiting for time-outs it would never end.
    Needing none, it is a streaming aggregation, without Python.
    """
    if keep not in ("all", "first"):
        raise ValueError(f"unknown keep: {keep}")
    if available_now:
        return _aggregated(hits, keep)
    fields = _names(hits)
    kind = T.StructType([hits.schema[c] for c in fields])
    as_json = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}
    packed = hits.select("topic", "id", "query", "hit_seq", F.to_json(F.struct(*fields), as_json).alias("record"))
    forget_ms = int(ttl.total_seconds() * 1000)

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        again = state.exists
        seq, record, queries = None, None, {}
        if again:
            seq, record, held = state.get
            queries = dict(map(tuple, json.loads(held)))
        for frame in frames:
            for query, hit_seq, own in zip(frame["query"], frame["hit_seq"], frame["record"], strict=True):
                hit_seq = int(hit_seq)
                if seq is None or hit_seq < seq:
                    seq, record = hit_seq, own
                if query not in queries or hit_seq < queries[query]:
                    queries[query] = hit_seq
        state.update((seq, record, json.dumps(list(queries.items()))))
        state.setTimeoutDuration(forget_ms)
        ordered = sorted(queries, key=lambda q: (queries[q], q is not None, q))
        yield pd.DataFrame(
            {"topic": [key[0]], "id": [key[1]], "record": [record], "seq": [seq], "again": [again],
             "matched_queries": [ordered if keep == "all" else ordered[:1]]}
        )

    posts = packed.groupBy("topic", "id").applyInPandasWithState(
        update,
        "topic string, id string, record string, seq long, again boolean, matched_queries array<string>",
        "seq long, record string, queries string",
        "update",
        "ProcessingTimeTimeout",
    )
    return posts.withColumn("record", F.from_json("record", kind, as_json)).select(
        "topic", "id", "record.*", "matched_queries", "seq", "again"
    )


def start_ingest(
    payloads: DataFrame,
    reader: Callable[[DataFrame], DataFrame],
    store: PostStore,
    checkpoint: str,
    name: str = "ingest",
    settings: Settings = Settings(),
    keep: str = "all",
    available_now: bool = True,
    ttl: dt.timedelta = dt.timedelta(days=30),
):
    """Start the ingest of a payload stream with the given reader.

    Each micro-batch is a load of its own, named after the streaming query's id, which its
    checkpoint keeps, and the batch.  A batch that Spark repeats after a failure replaces its own
    rows, and streams with other checkpoints cannot touch them, so every post is stored once.
    A post that later micro-batches hit again is scored again with all its queries and revised.
    The tables that a load works with are dropped when it is stored, and the state, which holds whole posts, is
    kept compressed; a checkpoint that was begun in another form goes on with its own.
    """
    spark = store.spark

    def query_id() -> str:
        found = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not found:
            raise RuntimeError("a micro-batch without the id of its streaming query")
        return found

    def load(batch: DataFrame, batch_id: int) -> None:
        stream = load_name("stream", query_id(), "")
        load_id = f"{stream}{batch_id:09d}"
        with dropped_after(spark):
            posts = materialize(batch, "collapsed", "zstd")
            fresh, again = posts.filter("not again").drop("again"), posts.filter("again").drop("again")
            ingest(fresh, store, load_id, F.current_timestamp(), settings, written=True)
            revise(again, store, stream, load_id, F.current_timestamp(), settings)

    posts = collapsed_stream(reader(payloads), keep, ttl, available_now)
    writer = posts.writeStream.outputMode("update").foreachBatch(load).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    codec = spark.conf.get(_STATE_CODEC)
    spark.conf.set(_STATE_CODEC, "zstd")  # the stream takes the session's settings when it starts
    try:
        return writer.queryName(name).start()
    finally:
        spark.conf.set(_STATE_CODEC, codec)
