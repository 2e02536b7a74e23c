import hashlib
import math
import random
import re
from collections import Counter

from voicelode.llm import pii

def least_share(joint, df):
    p, z = joint / df, pii.CONFIDENCE
    return (p + z * z / (2 * df) - z * math.sqrt(p * (1 - p) / df + z * z / (4 * df * df))) / (1 + z * z / df)


WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and pii.luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [
        (kind, m.start(), m.end())
        for kind, p in PATTERNS.items()
        for m in re.finditer(p, text)
        if holds(kind, m[0])
    ]


def test_patterns_on_random_texts():
    rng = random.Random(5)
    pieces = ["a", "b.c", "@", "@d", ".", "1", "25", "256", "300", "4111111111111111", "-", " ", "+", "(", ")", "é", "x@y.zz", "\n"]
    pieces += ["1.2.3.4", "+1 (555) 555-2373", "4404 1894 9746 08795", "a@b.c@d.e", "%"]
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 30)))
        assert pii.base_spans(text) == brute(text), text


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + " x@y", "1" * 300_000, "999." * 75_000, "@" * 300_000, "+1" + "(" * 300_000, "a@" * 100_000):
        assert pii.base_spans(text) == []


def corpus():
    secret = "the quokkafarm of mail bo.x@mail.example.com sells zanzibarium daily"
    rows = [(i, f"plain words number {i} of the day and the mail of all") for i in range(1000, 2200)]
    rows += [(i, secret) for i in range(30)] + [(100, secret), (101, secret + " again"), (102, None), (103, ""), (104, "call +1 555 555 2373 now")]
    rows += [(105, "one card 4111-1111-1111-1111 é bo.x@mail.example.com"), (None, "no id a@b.cc"), (106, "x" * 8_000 + " a@b.cc")]
    rows += [(107, "the same a@b.cc"), (107, "the same a@b.cc")]
    return rows


def brute_terms(rows):
    n, words, about, df = len(rows), [], [], Counter()
    pairs, entities = Counter(), Counter()
    for _, text in rows:
        text = text or ""
        spans = brute(text)
        own = {w.lower() for w in re.findall(WORD, text)}
        df.update(own)
        near = []
        for kind, a, b in spans:
            value = (kind, text[a:b] if kind in ("email", "ip") else re.sub("[^0-9]", "", text[a:b]))
            before = [m.span() for m in WORD.finditer(text, 0, a)][-pii.CONTEXT :]
            after = [m.span() for m in WORD.finditer(text, b)][: pii.CONTEXT]
            for x, y in before + after:
                if not any(p < y and x < q for _, p, q in spans):
                    near.append((value, text[x:y].lower(), x, y))
        pairs.update({(e, t) for e, t, _, _ in near})
        entities.update({e for e, *_ in near} | {(k, text[a:b] if k in ("email", "ip") else re.sub("[^0-9]", "", text[a:b])) for k, a, b in spans})
        about.append(near)
    out = []
    for near in about:
        best = {}
        for e, t, x, y in near:
            ic = math.log2(n / entities[e])
            if pairs[e, t] >= pii.SUPPORT and ic >= pii.MIN_BITS:
                d = math.log2(n * least_share(pairs[e, t], df[t]) / entities[e]) / ic
                if d >= pii.GENERALISE:
                    best[x, y] = max(best.get((x, y), 0), d)
        spans = [("generalised" if d < pii.REMOVE else "removed", x, y) for (x, y), d in best.items()]
        out.append(sorted(spans))
    return out


def test_spans_equal_brute_force(documents):
    rows = corpus()
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans, r.n_terms) for r in pii.span_table(documents(rows)).collect()}
    want, removed = set(), 0
    for (i, text), terms in zip(rows, brute_terms(rows)):
        base = brute(text or "")
        removed += sum(t[0] == "removed" for t in terms)
        n = Counter(k for k, _, _ in base)
        sha = hashlib.sha256(pii.written(base).encode()).hexdigest()
        want.add((i, n["email"], n["ip"], n["card"], n["phone"], sha, pii.written(base + terms), len(terms)))
    assert removed and got == want


def test_sanitised_texts(documents):
    rows = corpus()
    docs = documents(rows).selectExpr("*", "1 as base", "2 as terms", "3 as text_key", "4 as row", "5 as new", "6 as id", "7 as key")
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(rows)
    text = {r.doc_id: r.text for r in got}
    assert text[102] is None and text[103] == "" and text[1003] == rows[3][1]
    assert "[EMAIL]" in text[100] and "quokkafarm" not in text[100]
    assert text[105] == "one card [CARD] é [EMAIL]" and text[None] == "no id [EMAIL]"
    assert text[104] == "call [PHONE] now" and text[106].endswith("x [EMAIL]")
    assert all(r.n_chars == len(r.text) for r in got if r.text and "[" in r.text)


def test_empty_table(documents):
    docs = documents([(1, "x")]).limit(0)
    assert pii.span_table(docs).count() == 0 and pii.sanitise(docs).count() == 0
