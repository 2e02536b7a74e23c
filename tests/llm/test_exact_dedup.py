import hashlib
import re
from collections import defaultdict

from voicelode.llm import exact_dedup

ROWS = [
    (1, "a b"),
    (2, "ab"),
    (3, "a  b\n"),
    (4, ""),
    (5, None),
    (6, " \t\n"),
    (7, "other"),
    (8, "ünï x"),
    (9, "ünï x"),
    (10, "z" * 200_000),
    (11, "z" * 100_000 + "\n" + "z" * 100_000),
    (12, "tie"),
    (13, "tie"),
    (13, "tie"),
    (None, "no id"),
]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), -1 if i is None else i))
    out = []
    for text, members in groups.items():
        best = min(members)
        sha = hashlib.sha256(text.encode()).hexdigest()
        for j, m in enumerate(sorted(members)):
            out.append((m[1], best[1], len(members), j == 0, sha))
    return sorted(out)


def test_groups_equal_brute_force(documents):
    got = exact_dedup.copy_groups(documents(ROWS)).collect()
    got = sorted((-1 if r[0] is None else r[0], -1 if r[1] is None else r[1], *r[2:]) for r in got)
    assert got == brute(ROWS)


def test_drop_copies_keeps_columns_and_one_row_of_each(documents):
    docs = documents(ROWS).selectExpr("*", "doc_id as n", "text as h", "1 as word", "2 as best", "3 as sha", "4 as id")
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    want = sorted(x[0] for x in brute(ROWS) if x[3])
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == want


def test_hot_group_and_full_filter(documents, monkeypatch):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(600)]
    want = brute(rows)
    for most in (exact_dedup.MOST_WORDS, 1):
        monkeypatch.setattr(exact_dedup, "MOST_WORDS", most)
        assert sorted(map(tuple, exact_dedup.copy_groups(documents(rows)).collect())) == want
        assert exact_dedup.drop_copies(documents(rows)).count() == 201


def test_empty_table(documents):
    docs = documents([(1, "x")]).limit(0)
    assert exact_dedup.copy_groups(docs).count() == 0
    assert exact_dedup.drop_copies(docs).count() == 0


def test_single_documents_do_not_shuffle(spark, documents):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = exact_dedup.drop_copies(documents([(i, f"t{i // 2}") for i in range(50)]).repartition(3))
        alone = plan._jdf.queryExecution().optimizedPlan().children().apply(0).toString()
        physical = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "strategy=broadcast" in alone and "Aggregate" not in alone
    branch = physical.split("Union")[1].split("\n   +- ")[0]
    assert "BroadcastHashJoin" in branch and "hashpartitioning" not in branch
