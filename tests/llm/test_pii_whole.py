"""Disclosure counted over whole documents, and cut in all of them."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from voicelode.llm import pii

def least_share(joint, df):
    p, z = joint / df, pii.CONFIDENCE
    return (p + z * z / (2 * df) - z * math.sqrt(p * (1 - p) / df + z * z / (4 * df * df))) / (1 + z * z / df)


WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def corpus():
    far = "a@far.org " + "plain " * 20 + "Quokkafarm is here and plain quokkafarm there"
    rows = [(1000 + i, "plain words of the day") for i in range(2000)]
    rows += [(100, far), (101, "plain " + far)] + [(110 + i, far) for i in range(20)]
    # in many documents, and one document that holds the term without the entity
    rows += [(200 + i, f"b@many.org {'plain ' * 12}zanzibarium") for i in range(90)]
    rows += [(300, "plain zanzibarium é Zanzibarium x"), (301, "plain quokka"), (None, None)]
    return rows


def spans_of(rows):
    n, df, df_e, joint, words = len(rows), Counter(), Counter(), Counter(), []
    for _, text in rows:
        base = pii.base_spans(text or "")
        found = [m.span() for m in WORD.finditer(text or "")]
        out = [(a, b, text[a:b].lower()) for a, b in found if not any(x < b and a < y for _, x, y in base)]
        entities = {(k, text[a:b] if k in ("email", "ip") else re.sub("[^0-9]", "", text[a:b])) for k, a, b in base}
        df.update({text[a:b].lower() for a, b in found})
        df_e.update(entities)
        joint.update({(e, t) for e in entities for _, _, t in out})
        words.append((base, out))
    best = defaultdict(float)
    for (e, t), j in joint.items():
        if j >= pii.SUPPORT and df_e[e] < n:
            best[t] = max(best[t], math.log2(n * least_share(j, df[t]) / df_e[e]) / math.log2(n / df_e[e]))
    result = []
    for base, out in words:
        cuts = [("removed" if best[t] >= pii.REMOVE else "generalised", a, b) for a, b, t in out if best[t] >= pii.GENERALISE]
        result.append(pii.written(base + sorted(cuts)))
    return result


def test_far_words_repeats_and_other_documents(documents):
    got = {r.doc_id: r.spans for r in pii.span_table(documents(corpus())).collect()}
    assert got == {i: s for (i, _), s in zip(corpus(), spans_of(corpus()))}
    assert got[300] == "removed:6:17,removed:20:31" and got[301] == ""
    text = {r.doc_id: r.text for r in pii.sanitise(documents(corpus())).collect()}
    assert not any("quokkafarm" in t.lower() or "zanzibarium" in t.lower() for t in text.values() if t)
    assert text[301] == "plain quokka" and text[None] is None


@pytest.mark.parametrize("listed", [1 << 17, 1])
def test_random_documents(documents, monkeypatch, listed):
    monkeypatch.setattr(pii, "LISTED", listed)
    monkeypatch.setattr(pii, "HELD_PAIRS", 50)
    rng = random.Random(7)
    entities = ["a@b.cc", "x@y.org", "1.2.3.4", "+1 555 555 2373", "4111-1111-1111-1111", "é@z.de"]
    words = [f"w{i}" for i in range(60)] + ["Éa", "名前", "x", "b"]
    rows = []
    for i in range(900):
        own = rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 25))
        who = [k for k in range(len(entities)) if rng.random() < 0.02 * (k + 1)]
        own += [entities[k] for k in who] + [f"of{k}" for k in who if rng.random() < 0.9]
        own += [f"of{k}" for k in range(len(entities)) if rng.random() < 0.002]
        rng.shuffle(own)
        rows.append((i, " ; ".join(own)))
    got = {r.doc_id: r.spans for r in pii.span_table(documents(rows)).collect()}
    want = {i: s for (i, _), s in zip(rows, spans_of(rows))}
    assert any("removed" in s for s in want.values()) and any("generalised" in s for s in want.values())
    assert got == want


def test_clean_documents_stay_and_planted_words_go(spark, documents):
    """On the given documents: the shares that the README states."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    secret = [(1_000_000 + i, f"the file of jo.hn@mail.example.com is kept by quokkafarm number {i} in box zanzibarium") for i in range(12)]
    rows = docs.unionByName(documents(secret).select("doc_id", "text"))
    before = {r.doc_id: r.text for r in rows.collect()}
    after = {r.doc_id: r.text for r in pii.sanitise(rows).collect()}
    clean = [i for i, t in before.items() if not pii.base_spans(t or "")]
    assert sum(before[i] == after[i] for i in clean) >= 0.98 * len(clean)
    assert not any("quokkafarm" in t or "zanzibarium" in t for t in after.values() if t)
    assert not any(pii.base_spans(t or "") for t in after.values())
