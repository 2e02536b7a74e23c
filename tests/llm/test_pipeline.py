import random

import corpus_pipeline
import pytest
from voicelode.llm import exact_dedup, jaccard_join, mixture_pack, pii, tokens


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = [(i, " ".join(word() for _ in range(60)), "en", f"s{i % 3}") for i in range(60)]
    near = rows[1][1].split()
    near[-1] = "changed"
    rows += [(100, rows[0][1] + " ", "en", "s0"), (101, " ".join(near), "en", "s1"), (102, "12345", "en", "s0"), (103, None, "en", "s0")]
    rows += [(104, rows[2][1] + " write to jo.hn@mail.example.com now", "en", "s2")]
    return rows


def test_stages_take_effect(spark, documents, tmp_path):
    docs = documents(corpus())
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_copies", "personal_data", "packing"]
    columns, counts = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == [63, 62, 60, 60]
    kept = {r.doc_id: r.text for r in docs.collect()}
    # 100 is the longer of two equal texts; 1 and 2 stand for their near copies
    assert set(kept) == set(range(1, 60)) | {100}
    assert not any(pii.base_spans(t) for t in kept.values())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = tokens.Tokenizer(tokens.vocabulary_path())
    assert sum(r.length for r in got) == sum(len(tokenizer(t)) // 2 for t in kept.values())
    assert {r.doc_id for r in got} == set(kept) and max(r.offset + r.length for r in got) <= mixture_pack.LENGTH


def test_empty_table(spark, documents, tmp_path):
    documents(corpus()).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize(
    "stage", [exact_dedup.drop_copies, jaccard_join.drop_near_copies, pii.sanitise], ids=lambda f: f.__name__
)
def test_untouched_documents_do_not_move(spark, documents, stage):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if what they are compared with were large
    try:
        tree = stage(documents(corpus()))._jdf.queryExecution().optimizedPlan()
        untouched, touched = tree.children().apply(0).toString(), tree.children().apply(1).toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert tree.nodeName() == "Union" and "Filter NOT coalesce" in untouched
    assert untouched.count("Join ") == untouched.count("strategy=broadcast") == 1
    # those that are joined by a shuffle have passed the filter
    assert "Join " in touched and "strategy=broadcast" in touched
