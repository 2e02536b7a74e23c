import zlib

import numpy as np

from voicelode.llm import langid

WORDS = {"aa": "lorem ipsum dolor sit amet", "bb": "grüße straße über wörter möglich", "cc": "żółw źdźbło ćma gęś łąka"}


def corpus():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        lang = list(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang].split(), 12)), lang))
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "123 !? 456", "bb"), (903, "lorem " * 60_000, None), (904, "GRÜSSE", None)]
    return [*rows, *odd, rows[0], (None, "ćma gęś", None), (905, "😀 𝒳", "aa")]


def test_held_out_accuracy_and_rejects(documents):
    docs = documents(corpus()).selectExpr("*", "1 as pick", "2 as ids", "3 as score")
    got = langid.identify(docs).collect()
    assert len(got) == len(corpus())
    truth = {r[0]: r[2] for r in corpus()[:240]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 20 and all(r.lang_pred == truth[r.doc_id] for r in held)
    by_id = {r.doc_id: r for r in got}
    for i in (900, 901, 902):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[903].lang_pred == "aa" and by_id[904].lang_pred == "bb" and by_id[None].lang_pred == "cc"
    assert by_id[905].lang_pred != "und"
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(by_id) - {900, 901, 902}


def test_nothing_to_learn_from(documents):
    got = langid.identify(documents([(1, "abc", None), (2, None, None)])).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert langid.identify(documents([(1, "abc", "aa")]).limit(0)).count() == 0


def test_triples_do_not_mix_texts():
    table = langid.symbol_table()
    apart = [langid.triples([t], table)[0].tolist() for t in ("Ab c", "", "--d1e", "é")]
    found, at = langid.triples(["Ab c", "", "--d1e", "é"], table)
    assert [found[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == apart
    assert [len(x) for x in apart] == [3, 0, 2, 1]
    assert langid.triples(["a  \n b"], table)[0].tolist() == langid.triples(["a b"], table)[0].tolist()
