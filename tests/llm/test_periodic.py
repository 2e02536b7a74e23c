import hashlib
import random
import re
from fractions import Fraction

import numpy as np

from voicelode.llm import periodic
from voicelode.llm.queries import op12_periodic_runs, repeated_order


def brute_runs(words):
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                part = words[i : j + q]
                if not any(all(part[x] == part[x + p] for x in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    rng = random.Random(3)
    out = [None, "", " \t\n", "a a a a a", "a a a a a a", "a b " * 30, "x", "y " * 5000, "é é é é " * 4]
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(6)):
            root = [rng.choice("abc") for _ in range(rng.randrange(1, 30))]
            if rng.random() < 0.5:
                root = root[: 1 + len(root) // 4] * rng.randrange(1, 9)  # a root that is periodic in itself
            words += root * rng.randrange(1, 9)
            words += [rng.choice("abcd") for _ in range(rng.randrange(8))]
        out.append(rng.choice([" ", "\n", " \t "]).join(words))
    for size in (37, 64, 100, 257):
        root = [str(rng.randrange(1000)) for _ in range(size)]
        root[3:40] = ["z"] * 37
        out.append(" ".join((root * 6)[: size * 4 + rng.randrange(size)]))
    return out


def test_runs_equal_brute_force(documents):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in periodic.find_runs(documents(rows)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        want = brute_runs(words)
        assert [tuple(r) for r in got[i].runs] == want, text
        assert got[i].collapsed == collapsed(words, want)


def test_random_words_of_two_letters():
    rng = np.random.default_rng(1)
    many = [rng.integers(0, 2, n).astype(np.uint64) + np.uint64(1 << 40) for n in range(1, 120)]
    found = periodic.runs_of_texts(many)
    for words, runs in zip(many, found, strict=True):
        assert [tuple(r) for r in runs.tolist()] == brute_runs(words.tolist())


def test_set_is_sparse_outside_of_small_periods():
    words = np.random.default_rng(2).integers(0, 1 << 60, 20_000).astype(np.uint64)
    for t in (8, 64):
        ids = words.copy()
        for k in range(1, t):
            ids[: len(words) - k] = periodic.mix64(ids[: len(words) - k] * periodic._FACTOR + words[k:])
        ids = ids[: len(words) - t + 1]
        chosen = periodic.synchronising(ids, t, np.zeros(len(ids), bool))
        assert np.diff(chosen).max() <= t and len(chosen) < 3 * len(words) / t


def test_query_equals_brute_force(spark, documents, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts() * 3)]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    changed = 0
    for r in op12_periodic_runs(spark, str(tmp_path)).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", rows[r.doc_id][1] or "")
        order = repeated_order(r.doc_id, len(words)) if words else None
        if order is not None:
            words, changed = [words[k] for k in order], changed + 1
        runs = brute_runs(words)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert changed > 20


def test_odd_rows(documents):
    docs = documents([(None, "a " * 9), (1, "a " * 9), (1, "a " * 9)]).selectExpr("*", "1 as runs", "2 as collapsed")
    assert [[tuple(x) for x in r.runs] for r in periodic.find_runs(docs).collect()] == [[(0, 9, 1)]] * 3
    assert periodic.find_runs(docs.limit(0)).count() == 0
