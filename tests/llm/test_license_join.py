import random
import re

from voicelode.llm import license_join

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ROWS = [
    (1, "Licensed under the Apache License, Version 2.0."),
    (2, "This work is licensed under the GNU General Public License, version 3."),
    (3, "Released under\nthe MIT License. mit license MIT-LICENSE mit license"),
    (4, "Licensed under CC BY-NC 4.0.\nlicensed under cc by 4.0"),
    (5, None),
    (6, ""),
    (7, "plain text of a license"),
    (8, "é " * 5_000 + "apache license " * 3),
    (9, "Permission is hereby granted, free of charge, to any one obtaining a copy of this software\ncc\x7fby ccby"),
    (9, "Permission is hereby granted, free of charge, to any one obtaining a copy of this software\ncc\x7fby ccby"),
    (None, "THE MIT LİCENSE gnu general public licensed"),
    (10, "released under the license mit\n\n\nthis is free and unencumbered software released into the public domain"),
    (11, "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software"),
    (12, "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that"),
    (13, "licensed under the GNU General\nPublic License"),
    (14, "by the way he was licensed to drive in nc and cc was copied under the bridge" + " and so on" * 170),
    (15, "mit software " * 600 + dict(license_join.TEMPLATES)["mit-text"] + " of the license software nc" * 300),
    (16, ("word " * 331 + "licensed under cc by nc ") * 4),
]


def brute(rows):
    out = []
    for i, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = WORDS.findall(low)
        places = []
        for phrase, label in license_join.PHRASES.items():
            p = phrase.split()
            places += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
        base = {label for _, label in places}
        more, best = set(), 0.0
        for label, template, length in license_join.paragraphs(license_join.TEMPLATES):
            for k in range(len(words)):
                shared = len(set(words[k : k + length]) & set(template))
                if shared >= license_join.THRESHOLD * len(template) - 1e-9:
                    more.add(label)
                    best = max(best, shared / len(template))
        at = [k for k, _ in places]
        score = 1.0 if places else best
        out.append((i, len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score))
    return out


def test_equals_brute_force(documents):
    key = lambda r: (r[0] is None, r[0])
    docs = documents(ROWS).selectExpr("*", "1 as row", "2 as low", "3 as words", "4 as label", "5 as base")
    got = sorted(map(tuple, license_join.scan(docs).collect()), key=key)
    want = sorted(brute(ROWS), key=key)
    assert got == want
    labels = {r[0]: r[6] for r in got}
    assert labels[11] == "mit-text" and labels[12] == "bsd-text" and labels[13] == "gpl,gpl-notice" and labels[14] == ""
    assert "mit-text" in labels[15] and labels[16] == "cc-by,cc-by-nc"
    assert labels[4] == "cc-by,cc-by-nc" and labels[9] == "cc-by,mit-text" and labels[10] == "mit-notice,unlicense"


def test_templates_of_a_table(spark, documents):
    """Blocks of any place in a text, random words with few different ones so that many come close."""
    rng = random.Random(5)
    draw = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    given = [("x", draw(6) + "\n\n" + draw(9)), ("y", "Title\n \n" + draw(14) + "\nz"), (None, draw(5)), ("n", None)]
    rows = [(i, draw(rng.randrange(0, 400))) for i in range(60)]
    table = spark.createDataFrame(given, "label string, text string")
    got = {r.doc_id: (r.labels, r.score) for r in license_join.scan(documents(rows), table).collect()}
    for i, text in rows:
        words, held = text.split(), {}
        for label, template, length in license_join.paragraphs(given):
            best = max((len(set(words[k : k + length]) & set(template)) for k in range(len(words))), default=0)
            if best >= license_join.need(len(template)):
                held[label] = max(held.get(label, 0.0), best / len(template))
        assert got[i] == (",".join(sorted(held)), max(held.values(), default=0.0))


def test_empty_table(documents):
    assert license_join.scan(documents(ROWS).limit(0)).count() == 0


def test_no_python_in_the_plan(documents):
    plan = license_join.scan(documents(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)
