import random
import re

import pytest

from voicelode.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, size):
    windows = set()
    for item, text in items:
        w = WORD.findall(lower(text))
        n = min(size, len(w))
        if n and item is not None:
            windows |= {(str(item), tuple(w[i : i + n])) for i in range(len(w) - n + 1)}
    out = []
    for doc_id, text in docs:
        found = list(WORD.finditer(lower(text)))
        w, hit, own = [m[0] for m in found], set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    own.add(item)
        places, k = [], sorted(hit)
        while k:
            n = next(j for j in range(1, len(k) + 1) if j == len(k) or k[j] != k[j - 1] + 1)
            places.append((k[0], k[n - 1], found[k[0]].start(), found[k[n - 1]].end()))
            k = k[n:]
        out.append((-1 if doc_id is None else doc_id, len(w), places, sorted(own)))
    return sorted(out)


def got(found):
    rows = ((-1 if r.doc_id is None else r.doc_id, r.n_words, [tuple(p) for p in r.places], r.items) for r in found.collect())
    return sorted(rows)


def texts(n, words, rng):
    return [" ".join(rng.choice("ab c D é中 x1 .".split()) + rng.choice([" ", "", "\n", "-"]) for _ in range(rng.randrange(words))) for _ in range(n)]


@pytest.mark.parametrize("block", [1 << 17, 7])
def test_places_equal_brute_force(spark, documents, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
    rng = random.Random(5)
    rows = list(enumerate(texts(150, 60, rng))) + [(None, "a b c"), (500, None), (501, ""), (7, "A b C"), (7, "A b C"), (502, "ab " * 30_000)]
    items = list(enumerate(texts(12, 25, rng))) + [(3, "c c c ab"), (None, "a"), (50, None), (51, "..."), (52, "ab " * 40)]
    table = spark.createDataFrame(items, "item_id long, text string")
    for size in (4, 10):
        assert got(decontaminate.contaminated_places(documents(rows), table, size)) == brute(rows, items, size)


def test_offsets_show_the_original_words(spark, documents):
    text = "Ünder THE  old—bridge, é: three Swans. Swam there, quietly; in a Long row & more"
    items = spark.createDataFrame([(1, "the OLD bridge é three swans swam there quietly in")], "item_id long, text string")
    # the dash belongs to the words, so this word differs
    assert got(decontaminate.contaminated_places(documents([(1, text)]), items))[0][2] == []
    text = text.replace("—", " ")
    (place,) = got(decontaminate.contaminated_places(documents([(1, text)]), items))[0][2]
    assert text[place[2] : place[3]] == "THE  old bridge, é: three Swans. Swam there, quietly; in"


def test_rows_that_stay_keep_their_columns(spark, documents):
    docs = documents([(1, "x y z"), (2, "p q"), (2, "p q"), (None, "x y"), (None, "q")]).selectExpr("*", "1 as places", "2 as _hit", "3 as item")
    items = spark.createDataFrame([("b", "x y")], "item_id string, text string")
    kept = decontaminate.without_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.collect()] == [2, 2]  # a hit without id takes all rows without id


def test_empty_tables(spark, documents):
    docs, items = documents([(1, "x y z")]), spark.createDataFrame([(1, "x y")], "item_id long, text string")
    assert got(decontaminate.contaminated_places(docs, items.limit(0))) == [(1, 3, [], [])]
    assert decontaminate.contaminated_places(docs.limit(0), items).count() == 0
