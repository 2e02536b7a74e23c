import random
import re

import numpy as np

from voicelode.llm import jaccard_join
from voicelode.llm.common import Scratch
from voicelode.llm.components import components


def shingle_set(text):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [shingle_set(r[1]) for r in rows]
    ids = {}
    for (i, *_), s in zip(rows, sets):
        ids[s] = min(ids.get(s, i), i)
    links = {s: set() for s in ids}
    for a in ids:
        for b in ids:
            if a != b and len(a & b) / len(a | b) >= 0.8:
                links[a].add(b)
    group = {}
    for s in sorted(ids, key=ids.get):
        ahead = [] if s in group else [s]
        while ahead:
            x = ahead.pop()
            if x not in group:
                group[x] = ids[s]
                ahead += links[x]
    return sorted((r[0], group[s], ids[s], len(links[s])) for r, s in zip(rows, sets))


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    base = [word() for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):  # a large group of near copies, at any similarity
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(word() for _ in range(rng.randint(1, 80)))) for i in range(300, 400)]
    rows += [(400, None), (401, ""), (402, "..."), (403, "one two"), (404, "One, TWO!"), (405, "one two three")]
    rows += [(406, rows[0][1].upper()), (406, rows[0][1].upper())]
    rows += [(407, " ".join(word() for _ in range(40_000)))]
    rows += [(408, rows[-1][1] + " tail")]
    return rows


def test_equals_brute_force(documents):
    rows = corpus()
    got = sorted(map(tuple, jaccard_join.link_counts(documents(rows)).collect()))
    assert got == brute(rows)


def test_small_blocks_give_the_same(documents, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_TEXTS", 16)
    monkeypatch.setattr(jaccard_join, "COLUMNS", 64)
    rows = corpus()[:320]
    got = sorted(map(tuple, jaccard_join.link_counts(documents(rows)).collect()))
    assert got == brute(rows)


def test_one_of_each_group_stays(documents):
    rows = corpus()
    docs = documents(rows).selectExpr("*", "1 as node", "2 as label", "3 as u")
    kept = jaccard_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    label = {i: i for i in sets}
    for _ in range(5):
        for a in sets:
            for b in sets:
                if sets[a] == sets[b] or (sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8):
                    label[a] = label[b] = min(label[a], label[b])
    assert sorted({r.doc_id for r in kept.collect()}) == sorted(set(label.values()))


def test_empty_table_and_no_links(documents):
    docs = documents([(1, "a b c d e f"), (2, "g h i j k l")])
    assert sorted(map(tuple, jaccard_join.link_counts(docs).collect())) == [(1, 1, 1, 0), (2, 2, 2, 0)]
    assert jaccard_join.link_counts(docs.limit(0)).count() == 0
    assert jaccard_join.drop_near_copies(docs.limit(0)).count() == 0


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (5, 80, 200, 1, 120)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    off = ~np.eye(5, dtype=bool)
    assert (jaccard_join.intersections(sets, 5)[off] == want[off]).all()
    assert (jaccard_join.intersections(sets, 2) == want[:2, 2:]).all()


def test_prefix_is_shortened_until_the_recall():
    depth = lambda *s, **k: jaccard_join.prefix_depth(np.array(s), **k)
    assert depth() == depth(0.3, 0.5) == depth(1.0, 0.99) == 8  # nothing at the threshold to be found
    assert depth(0.8, 0.81, target=0.99) == 8 and depth(0.8, 0.81) == 5
    assert depth(*[0.97] * 500) == 8 and depth(*[0.97] * 500, 0.8) == 5  # the least similar ones count
    assert jaccard_join.recall_at(5, np.array([0.8]), jaccard_join.TREES)[0] > jaccard_join.TARGET_RECALL


def test_prefix_depends_on_all_neighbours(documents, monkeypatch):
    rng = random.Random(9)
    rows = []
    for i in range(60):  # pairs that differ in the last word, and one that differs in two words far apart
        words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(120)]
        other = [*words[:30], "one", *words[31:80], "two", *words[81:]] if i == 17 else [*words[:-1], "changed"]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    seen, depth = [], jaccard_join.prefix_depth
    monkeypatch.setattr(jaccard_join, "SAMPLE", 4, raising=False)
    monkeypatch.setattr(jaccard_join, "prefix_depth", lambda shown, *a: seen.append(shown) or depth(shown, *a))
    assert {r.class_id for r in jaccard_join.link_counts(documents(rows)).collect()} == set(range(0, 120, 2))
    assert 0.75 < seen[0].min() < 0.9 < seen[0].max()


def test_neighbours_in_sorted_trees(spark):
    rng = random.Random(8)
    rows = [(t, bytes(x for _ in range(8) for x in (0, rng.randrange(2))), n) for t in range(3) for n in range(40)]
    pa_rows = sorted(rows)
    import pyarrow as pa

    table = pa.table({"tree": pa.array([r[0] for r in pa_rows], pa.int32()), "path": [r[1] for r in pa_rows], "node": [r[2] for r in pa_rows]})
    lcp = lambda a, b: next((k for k in range(8) if a[1][2 * k : 2 * k + 2] != b[1][2 * k : 2 * k + 2]), 8) if a[0] == b[0] else 0
    want = []
    for i, r in enumerate(pa_rows):
        before = lcp(pa_rows[i - 1], r) if i else 8
        after = lcp(r, pa_rows[i + 1]) if i + 1 < len(pa_rows) else 8
        if max(before, after) >= jaccard_join.LEAST_DEPTH:
            known = i + 1 < len(pa_rows) and after >= jaccard_join.LEAST_DEPTH
            want.append((*r, max(before, after), pa_rows[i + 1][2] if known else None))
    for size in (1, 7, 200):
        found = pa.Table.from_batches(jaccard_join._neighbours(iter(table.to_batches(max_chunksize=size))))
        assert [tuple(x.values()) for x in found.to_pylist()] == want


def test_shingles_and_threshold_are_parameters(documents):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(40)]
    other = [*words[:20], "changed", *words[21:]]  # one word of 40: 31 of 41 runs of five are shared
    docs = documents([(1, " ".join(words)), (2, " ".join(other))])
    groups = lambda **k: [r.class_id for r in jaccard_join.link_counts(docs, **k).orderBy("doc_id").collect()]
    assert groups() == [1, 2] and groups(threshold=0.7) == [1, 1] and groups(size=2) == [1, 1]


def test_small_tables_are_few_files(documents, spark, monkeypatch):
    import glob

    files, table = {}, Scratch.table

    def counted(self, df, name, *more):
        out = table(self, df, name, *more)
        files[name] = len(glob.glob(f"{self._paths[name].removeprefix('file://')}/part-*"))
        return out

    monkeypatch.setattr(Scratch, "table", counted)
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = corpus()[:320]
        assert sorted(map(tuple, jaccard_join.link_counts(documents(rows)).collect())) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    rounds = [n for n in files if n.startswith("edges-")]
    assert rounds and all(files[n] <= 2 for n in [*rounds, "neighbours", "repeated", "shared", "labels", "members", "at", "groups"])


def test_texts_of_members_pass_python_once(documents, monkeypatch):
    plans, table = {}, Scratch.table

    def planned(self, df, name, *more):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return table(self, df, name, *more)

    monkeypatch.setattr(Scratch, "table", planned)
    rows = [(1, "a b c d e f"), (2, "a b c d e f!"), (None, "a b c d e f g"), (3, "h i j k l m"), (4, None)]
    assert jaccard_join.link_counts(documents(rows)).count() == 5
    assert plans["sets"].count("MapInArrow") == 1


def test_scratch_table_of_many_rows_keeps_its_tasks(spark):
    rows = spark.range(0, 100_000, 1, 8)
    assert Scratch(spark).table(rows, "known", 100_000).count() == 100_000
    for n, tasks in ((0, 1), (1 << 14, 1), (100_000, 7), (10**9, 8)):
        written = Scratch(spark).table(rows.limit(n) if not n else rows, "known", n)
        assert len(written.inputFiles()) == tasks


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    edges = spark.createDataFrame(chain + star, "u long, v long")
    got = {r.node: r.label for r in components(edges, Scratch(spark)).collect()}
    assert got == {i: 0 for i in range(101)} | {1000 + i: 1000 for i in range(200)}
