import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voicelode.llm import nn_descent

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, n=10):
    good = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 8:
            good[i] = np.array(v, np.float32).astype(float)
    out = set()
    for q in good:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((good[q] - x) ** 2).sum())), i) for i, x in good.items() if i != q)[:n]
            out |= {(q, r + 1, i) for r, (_, i) in enumerate(near)}
    return out, good


def vectors(n, copies=0):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.6 * rng.normal(size=8)], 0) for i in range(n)]
    same = [float(x) for x in centres[0]]
    rows += [(n + i, same, 0) for i in range(copies)]
    return rows


ODD = [
    (9000, None, 0),
    (9100, [0.0] * 8, 0),
    (9200, [1.0, None] * 4, 0),
    (9300, [float("nan")] * 8, 0),
    (9400, [float("inf")] * 8, 0),
    (9500, [], 0),
    (9600, [1.0, 2.0], 0),
    (None, [1.0] * 8, 0),
]


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as node", "2 as q", "3 as v").repartition(3)
    return nn_descent.nearest(df, F.col("vec_id") % 100 == 0).collect()


def test_recall_ties_and_unusable_vectors(spark):
    rows = vectors(1500, copies=500) + ODD
    rows.append(rows[100])
    want, good = brute(rows)
    got = run(spark, rows)
    hits = {(r.query_id, r["rank"], r.vec_id) for r in got} & want
    assert len({(r.query_id, r["rank"]) for r in got}) == len(got) == len(want)
    assert len(hits) >= 0.95 * len(want)
    for r in got:
        assert r.score == pytest.approx(float(np.sqrt(((good[r.query_id] - good[r.vec_id]) ** 2).sum())), rel=1e-12)
    copies = [r for r in got if r.query_id == 1600]  # one of the equal vectors: the smallest ids of the others
    assert [r.vec_id for r in sorted(copies, key=lambda r: r["rank"])] == list(range(1500, 1510))


def test_descent_and_search_find_what_the_first_graph_does_not(spark, monkeypatch):
    # runs so short that the first graph compares about a fiftieth of all pairs, and a beam of a twentieth of the nodes
    for name, value in (("RUN", 32), ("PROJECTIONS", 2)):
        monkeypatch.setattr(nn_descent, name, value)
    rows = vectors(3000)
    want, good = brute(rows)
    first = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in good.items()], "node long, x array<float>")
    graph = nn_descent.first_graph(first.repartition(3), 10).collect()
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids])
    near = np.argsort(((x[:, None, :] - x[None, :300, :]) ** 2).sum(-1), axis=0)[1:11].T
    true = {(int(ids[i]), int(ids[j])) for i, row in enumerate(near) for j in row}
    seen = {(r.u, r.v) for r in graph}
    assert len(true & seen) < 0.6 * len(true)
    hits = {(r.query_id, r["rank"], r.vec_id) for r in run(spark, rows)} & want
    assert len(hits) >= 0.9 * len(want)


def test_fewer_candidates_than_asked_for(spark):
    rows = vectors(4)
    assert len(run(spark, rows)) == 3


def test_one_and_no_vector(spark):
    assert run(spark, vectors(1)) == []
    assert run(spark, ODD[:2]) == []
