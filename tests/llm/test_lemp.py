import math
import random
import re
from collections import Counter

import pytest

from voicelode.llm import lemp

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=50):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, all_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        own = set(terms(text)) & set(df)
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in own}
        scored = []
        for i, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // all_terms
            score = sum(w[t] * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item or -1, r, -1 if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def got(found):
    return sorted((r.item_id or -1, r["rank"], -1 if r.doc_id is None else r.doc_id, r.score) for r in found.collect())


def corpus():
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(1, n)))
    rows = [(i, text(60)) for i in range(1200)]
    rows += [(2000 + i, rows[5][1]) for i in range(70)]  # more copies than a result holds
    rows += [(None, text(9)), (None, "W1 w2"), (3000, None), (3001, ""), (3002, "—"), (3003, "w3 " * 50_000), (7, rows[7][1]), (7, rows[7][1])]
    items = [(i, text(25)) for i in range(1, 30)] + [(30, rows[5][1]), (31, None), (32, "nowhere"), (3, "w1 W2"), (4, "w9"), (4, "w9"), (None, "w5 w6")]
    return rows, items


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_brute_force(spark, documents, monkeypatch, small):
    if small:  # many buckets, blocks and a short head, so that all bounds are at work
        for name, value in (("HEAD", 60), ("BUCKET", 16), ("BLOCK_TERMS", 150)):
            monkeypatch.setattr(lemp, name, value)
    rows, items = corpus()
    table = spark.createDataFrame(items, "item_id long, text string")
    assert got(lemp.search(documents(rows), table)) == brute(rows, items)
    assert got(lemp.search(documents(rows), table, 3)) == brute(rows, items, 3)


def test_odd_tables(spark, documents):
    docs = documents([(1, "a b"), (2, "b")]).selectExpr("*", "1 as n", "2 as terms", "3 as score", "4 as item_id")
    items = spark.createDataFrame([("x", "b a", 1)], "item_id string, text string, rank int")
    rows = lemp.search(docs, items).collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in rows] == [("x", 1, 1), ("x", 2, 2)]
    assert lemp.search(docs, items.limit(0)).count() == 0
    assert lemp.search(docs.limit(0), items).count() == 0
