import random
from collections import Counter

import numpy as np

from voicelode.llm import bfd_pack, tokens

LENGTH = bfd_pack.LENGTH


def corpus():
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choices(["alpha", "beta", "Gamma,", "δέλτα", "42", "\n"], k=n))
    rows = [(i, text(rng.randint(1, 900))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, text(30_000)), (None, "no id")]
    return [*rows, rows[0]]


def brute_best_fit(sizes, length):
    room, out = [], []
    for i, n in enumerate(sizes):
        fits = [r for r in room if r >= n]
        if fits:
            at = room.index(min(fits))
            out[at].append(i)
            room[at] -= n
        else:
            out.append([i])
            room.append(length - n)
    return sorted(room)


def test_segment_tree_finds_the_best_fit():
    rng = random.Random(1)
    for length in (10, 64, 100):
        sizes = sorted((rng.randint(1, length) for _ in range(300)), reverse=True)
        got = bfd_pack.best_fit(sizes, length)
        assert sorted(i for s in got for i in s) == list(range(300))
        assert sorted(length - sum(sizes[i] for i in s) for s in got) == brute_best_fit(sizes, length)


def test_rooms():
    rooms = bfd_pack.Rooms(10)
    assert rooms.least(0) is None
    rooms.add(3, 1)
    rooms.add(7, 2)
    assert [rooms.least(n) for n in (1, 3, 4, 7, 8)] == [3, 3, 7, 7, None]
    rooms.add(3, -1)
    assert rooms.least(1) == 7


def test_documents_come_back_whole(documents, monkeypatch):
    monkeypatch.setattr(bfd_pack, "BUCKET", 64)
    rows = corpus()
    packed = bfd_pack.pack(documents(rows).selectExpr("*", "1 as ids", "2 as number")).cache()
    tokenizer = tokens.Tokenizer(tokens.vocabulary_path())
    ids = {i: tokens.ids_of(tokenizer(t)).tolist() for i, t in rows}
    times, seen, sequences = Counter(r[0] for r in rows), Counter(), packed.collect()
    for r in sequences:
        matrix, position = tokens.ids_of(r.ids), tokens.ids_of(r.positions)
        assert len(matrix) == len(position) == LENGTH and r.cu_seqlens[-1] == r.n_tokens
        assert (matrix[r.n_tokens :] == bfd_pack.PAD_ID).all()
        for a, b, doc, start, n in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.starts, r.doc_tokens, strict=False):
            assert matrix[a:b].tolist() == ids[doc][start : start + b - a] and n == len(ids[doc])
            assert position[a:b].tolist() == list(range(b - a))
            seen.update((doc, x) for x in range(start, start + b - a))
    assert all(seen[i, x] == times[i] for i in ids for x in range(len(ids[i])))
    assert len({r.sequence_id for r in sequences}) == len(sequences)
    total = sum(len(ids[r[0]]) for r in rows)
    assert total / (len(sequences) * LENGTH) > 0.9
    pieces = bfd_pack.pieces(packed).collect()
    assert sum(p.length for p in pieces) == total
    packed.unpersist()


def test_empty_table(documents, tmp_path):
    packed = bfd_pack.pack(documents([(1, "x")]).limit(0))
    assert bfd_pack.pieces(packed).count() == 0
    bfd_pack.write(bfd_pack.pack(documents([(1, "x y")])), str(tmp_path / "packed"))
