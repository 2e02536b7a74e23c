"""The language model learns from every position, with the constants that the query runs with."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from voicelode.llm import maxent_lm


def test_held_out_texts_with_the_constants_of_the_query(documents):
    rows = [(i, "the cat sat on the mat " * 100) for i in range(300)]
    got = [r for r in maxent_lm.score_documents(documents(rows)).collect() if r.held_out]
    assert len(got) > 20 and sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got)


def test_every_context_is_trained_on(documents, spark):
    # each word stands once
    docs = documents([(i, " ".join(f"w{i}x{k}" for k in range(10))) for i in range(40)]).repartition(7)
    words = maxent_lm.Vocabulary(maxent_lm.word_counts(docs))
    written = maxent_lm.prepared(docs.selectExpr("*", "false as held_out"), spark.sparkContext.broadcast(words.sent()))
    by_class, _ = maxent_lm._split(maxent_lm.train_weights(written, words.log_weight))
    tokens, begins = maxent_lm.token_hashes([r.text.encode() for r in docs.select(F.lower("text").alias("text")).collect()], maxent_lm.SpanHasher())
    one, two = maxent_lm.contexts(maxent_lm.look_up(words.sent(), tokens)[0], begins)
    trained = np.abs(by_class).sum(axis=1) > 0
    assert len(np.unique(one)) > 390 and trained[maxent_lm.feature_rows(one, two)].all()


def test_gain_over_counts_on_held_out_documents(spark):
    """On the given documents, with the constants of the query."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r for r in maxent_lm.score_documents(docs).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in got)
    gain = (sum(r.score for r in got) - sum(r.base_score for r in got)) / tokens
    better = sum(r.score > r.base_score for r in got) / len(got)
    print(f"gain {gain:.4f} log10 a token, {better:.3f} of held-out documents gain")
    assert gain > 0.06 and better > 0.8


def test_groups_hold_every_position_once():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, maxent_lm.BUCKETS, n) for n in (3, 300_000, 1, 90_000, 90_000, 1)]
    batch = pa.RecordBatch.from_pydict({"buckets": [t.astype("<u2").tobytes() for t in texts]})
    found = list(maxent_lm.written_texts([batch]))
    assert sum(g[0].num_rows for g in found) == len(texts)
    want = [np.stack([t, *maxent_lm.contexts(t, np.array([0, len(t)]))]) for t in texts]
    assert (np.concatenate([np.stack(g[1:4]) for g in found], axis=1) == np.concatenate(want, axis=1)).all()
