import hashlib
import random

import pytest

from voicelode.llm import pieces

PIECES = [" ", "  ", "\n", "\t", "a", "é", "1", ".", "he", "the", "\x1c", "\x85", "　", "²", "_", "中", "<s>", "</s>", "<unk>"]
PIECES += ["<0x41>", "\r\n", "▁", "▁▁", "😀", "é", "ﬁ", "①", "\0", "Ａ", "it's", "ing", ",", "$$$", ".com", "x_{"]


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(pieces.model_path())


def test_random_texts_equal_the_library(model):
    rng = random.Random(2)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(20_000)]
    texts += ["x" * 30_000, " " * 5000, "".join(rng.choices(PIECES, k=20_000)), "", " "]
    ids = model.library.encode(texts)
    for text, own, (found, decoded) in zip(texts, ids, model.encode(texts), strict=True):
        assert found == ",".join(map(str, own)), repr(text)
        assert decoded == model.library.decode(own), repr(text)


def test_agenda_takes_the_best_score_then_the_leftmost():
    assert pieces.merged("aaa", {"aa": 1.0}) == ["aa", "a"]
    assert pieces.merged("abc", {"ab": 2.0, "bc": 1.0}) == ["a", "bc"]
    assert pieces.merged("abcd", {"ab": 1.0, "cd": 1.0, "abcd": 5.0}) == ["abcd"]
    assert pieces.merged("", {}) == [] and pieces.merged("x", {}) == ["x"]


def test_list_and_heap_agree(model):
    rng = random.Random(4)
    for _ in range(3000):
        part = "".join(rng.choices("theandiŋ.▁é", k=rng.randint(0, 30)))
        assert pieces._merged_short(part, model.rank) == pieces._merged_long(part, model.rank)


def test_decoded_text_comes_from_the_library(monkeypatch):
    own = pieces.PieceModel(pieces.model_path())
    monkeypatch.setattr(own, "_check", lambda text, ids: text.upper())  # what the library would have decoded
    assert [d for _, d in own.encode(["the cat", ""])] == ["THE CAT", ""]


def test_forgetting_changes_nothing(model, monkeypatch):
    texts = ["the cat sat " * 3, "on  the mat", "the cat"] * 5
    want = list(model.encode(texts))
    monkeypatch.setattr(pieces, "REMEMBERED", 1)
    monkeypatch.setattr(pieces, "LONGEST", 2)
    assert list(pieces.PieceModel(pieces.model_path()).encode(texts)) == want


def test_documents(documents, model):
    rows = [(1, "The cat.\nSat"), (2, None), (3, ""), (4, "long " * 50_000), (4, "long " * 50_000), (None, "x▁y")]
    got = pieces.encode_documents(documents(rows).selectExpr("*", "1 as ids", "2 as n_tokens"), with_ids=True).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = model.library.encode(t or "")
        text = model.library.decode(ids) if ids else ""
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(text), ids, text))
    key = lambda r: (r[0] is None, r[0])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_empty_table(documents):
    assert pieces.encode_documents(documents([(1, "x")]).limit(0)).count() == 0
