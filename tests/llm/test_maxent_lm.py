import math
import re
import zlib
from collections import Counter

import numpy as np

from voicelode.llm import maxent_lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rows = [(i, f"the cat {'sat on' if i % 2 else 'ran off'} the mat {i % 11} Éa") for i in range(120)]
    rows += [(500, None), (501, ""), (502, "word " * 30_000), (503, " \n\t"), (None, "no id"), rows[3]]
    return rows


def counted(rows):
    out = []
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
        out.append((i, held, [*WORD.findall(low), None]))
    return out


def test_base_scores_equal_brute_force(documents):
    rows = counted(corpus())
    c = Counter(w for _, held, words in rows if not held for w in words)
    n, v = sum(c.values()), len(c)
    docs = documents(corpus()).selectExpr("*", "1 as h", "2 as c", "3 as held_out", "4 as row")
    key = lambda r: (r[0] is None, r[0])
    got = sorted(maxent_lm.score_documents(docs).collect(), key=key)
    assert [r.doc_id for r in got] == [r[0] for r in sorted(rows, key=key)]
    for r, (_, held, words) in zip(got, sorted(rows, key=key), strict=True):
        assert (r.held_out, r.n_tokens, r.n_known) == (held, len(words), sum(c[w] > 0 for w in words))
        assert r.train_tokens == n
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert r.score <= 0 and math.isfinite(r.score)


def test_context_beats_counts_on_held_out_texts(documents, monkeypatch):
    monkeypatch.setattr(maxent_lm, "BATCH", 32)
    rows = [(i, "the cat sat on the mat " * (1 + i % 5)) for i in range(300)]
    got = [r for r in maxent_lm.score_documents(documents(rows)).collect() if r.held_out]
    assert len(got) > 20 and sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got)


def test_rare_words_are_joined(documents, monkeypatch):
    whole = {tuple(r)[:6] for r in maxent_lm.score_documents(documents(corpus())).collect()}
    monkeypatch.setattr(maxent_lm, "HEAD", maxent_lm.OWN // 100)
    part = {tuple(r)[:6] for r in maxent_lm.score_documents(documents(corpus())).collect()}
    assert {r[:5] for r in whole} == {r[:5] for r in part}
    assert math.isclose(sum(r[5] for r in whole), sum(r[5] for r in part), rel_tol=1e-9)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=maxent_lm.WEIGHTS).astype(np.float32)
    for one, two in ((3, 1024), (1024, 1024), (700, 5)):
        bucket = np.arange(maxent_lm.BUCKETS)
        p = maxent_lm.log_probabilities(weights, bucket, np.full_like(bucket, one), np.full_like(bucket, two))
        assert math.isclose(np.exp(p).sum(), 1, rel_tol=1e-4)


def plain_probability(weights, bucket, one, two):
    """One position's log probability, by the definition."""
    m = maxent_lm
    by_class, by_member = m._split(weights.astype(float))
    mixed = lambda a, b, salt: int(m.mix64(np.array([a * 4099 + b + salt], np.uint64))[0]) % m.HASHED
    side, cls = m.BUCKETS + 1, bucket // m.MEMBERS
    row = by_class[0] + by_class[1 + one] + by_class[1 + side + two] + by_class[1 + 2 * side + mixed(one, two, 1)]
    own = by_member[cls] + by_member[m.CLASSES + mixed(one, cls, 1 << 30)]
    share = lambda x, i: x[i] - math.log(sum(math.exp(y) for y in x))
    return share(row, cls) + share(own, bucket % m.MEMBERS)


def test_scores_equal_the_definition(spark, documents):
    rows = [(i, t) for i, t in corpus() if t and len(t) < 1000][:40] + [(900, ""), (901, None)]
    docs = documents(rows)
    words = maxent_lm.Vocabulary(maxent_lm.word_counts(docs))
    weights = np.random.default_rng(5).normal(size=maxent_lm.WEIGHTS).astype(np.float32)
    send = spark.sparkContext.broadcast
    parts = maxent_lm.prepared(docs.selectExpr("*", "false as held_out"), send(words.sent())).cache()
    got = maxent_lm.model_scores(parts, send(words.log_weight), send(weights)).join(parts, "row").collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text[r.doc_id] or "")
        tokens, _ = maxent_lm.token_hashes([low.encode()], maxent_lm.SpanHasher())
        bucket = maxent_lm.look_up(words.sent(), tokens)[0].tolist()
        before, want = [maxent_lm._START] * 2, 0.0
        for b in bucket:
            want += plain_probability(weights, b, before[-1], before[-2]) / math.log(10) - words.log_weight[b]
            before.append(b)
        assert math.isclose(r.lm, want, rel_tol=1e-4), r.doc_id


def test_a_step_is_the_gradient_of_all_positions():
    rng = np.random.default_rng(3)
    bucket, one, two = rng.integers(0, 6, (3, 500))
    start = rng.normal(size=maxent_lm.WEIGHTS).astype(np.float32)
    own, squares = start.copy(), np.zeros_like(start)
    maxent_lm.train_group(maxent_lm._split(own), maxent_lm._split(squares), bucket, one, two, rng)
    loss = lambda w: -maxent_lm.log_probabilities(w, bucket, one, two).sum()
    assert loss(own) < loss(start)
    # with one step for a group, each squared sum is the squared derivative of the loss there
    for k in rng.choice(np.flatnonzero(squares > 1), 12, replace=False):
        up, down = start.astype(np.float64), start.astype(np.float64)
        up[k], down[k] = up[k] + 1e-4, down[k] - 1e-4
        assert math.isclose(abs(loss(up) - loss(down)) / 2e-4, math.sqrt(squares[k]), rel_tol=1e-2)


def test_contexts_stop_at_texts():
    one, two = maxent_lm.contexts(np.array([1, 2, 3, 4, 5, 6]), np.array([0, 3, 4, 6]))
    s = maxent_lm._START
    assert one.tolist() == [s, 1, 2, s, s, 5] and two.tolist() == [s, s, 1, s, s, s]


def test_empty_table_and_no_training(documents):
    assert maxent_lm.score_documents(documents([(1, "x")]).limit(0)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = maxent_lm.score_documents(documents([(held, "a b")])).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
