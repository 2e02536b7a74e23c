import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from voicelode.llm import mixture_pack, tokens

LENGTH = 2048


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def corpus():
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choices(["alpha", "beta", "Gamma,", "δέλτα", "42", "\n"], k=n))
    rows = [(i, text(rng.randint(1, 400)), "en", "big" if i % 3 else f"s{i % 7}") for i in range(300)]
    rows += [(900, None, "en", "big"), (901, "", None, None), (902, text(30_000), "en", "s1")]
    return [*rows, rows[0], (None, "no id", "en", "s2")]


def test_ids_are_those_of_the_library(library):
    tokenizer = tokens.Tokenizer(tokens.vocabulary_path())
    rng = random.Random(2)
    pieces = [" ", "  ", "\n", "\t", "a", "é", "1", ".", "'s", "\x1c", "\x85", "　", "²", "_", "中", "<|endoftext|>", "\r\n", "😀"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(3000)] + ["x" * 50_000, " " * 5000]
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert tokens.ids_of(tokenizer(text)).tolist() == [*e.ids, tokens.END_ID], repr(text)


def test_every_id_in_one_piece_and_no_gap(documents, library):
    rows = corpus()
    got = mixture_pack.pack(documents(rows).selectExpr("*", "1 as part", "2 as ids", "3 as base"), with_ids=True).collect()
    ids = {}
    for i, text, *_ in rows:
        ids[i] = library.encode(text or "", add_special_tokens=False).ids + [tokens.END_ID]
    assert sum(r.length for r in got) == sum(len(ids[r[0]]) for r in rows)
    times = Counter(r[0] for r in rows)
    seen, sequences = Counter(), defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and tokens.ids_of(r.ids).tolist() == part
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        seen.update((r.doc_id, x) for x in range(r.start, r.start + r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert all(seen[i, x] == times[i] for i in ids for x in range(len(ids[i])))
    for number, pieces in sequences.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == LENGTH or number == max(sequences) and at < LENGTH
    assert sorted(sequences) == list(range(len(sequences)))


def shares(got, upto):
    total = Counter()
    for r in got:
        if r.sequence_id < upto:
            total[r.source] += r.length
    return total


def test_mixture_holds_in_every_prefix(documents):
    rows = corpus()
    got = mixture_pack.pack(documents(rows)).collect()
    whole = shares(got, 1 << 60)
    n = sum(whole.values())
    for w in range(1, n // LENGTH):
        part = shares(got, w)
        for source in whole:
            assert abs(part[source] - w * LENGTH * whole[source] / n) <= 2 * mixture_pack.QUANTUM


def test_targets_and_sources_that_run_out(documents):
    got = mixture_pack.pack(documents(corpus()), targets={"big": 1, "s1": 1}).collect()
    early = shares(got, 4)
    assert abs(early["big"] - early["s1"]) <= 2 * mixture_pack.QUANTUM
    assert sum(r.length for r in got) == sum(r.length for r in mixture_pack.pack(documents(corpus())).collect())


def test_schedule_is_a_permutation():
    totals = {"a": 5000, "b": 70, "c": 999, "d": 5000, "e": 3}
    plan = mixture_pack.Schedule(totals, mixture_pack.weights_of(totals, None), 10)
    slots = np.concatenate([plan.slots(i, np.arange(plan.full[i])) for i in range(5)])
    assert sorted(slots) == list(range(int(plan.full.sum())))


def test_empty_table(documents):
    assert mixture_pack.pack(documents([(1, "x")]).limit(0)).count() == 0
