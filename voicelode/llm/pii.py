"""Personal data: fixed patterns find entities, corpus co-occurrence finds the terms that reveal them.

The base kinds (email, ip, card, phone) are found in whole texts.  Each distinct value is a protected
entity.  It is paired with every word that stands outside of base spans in a document that mentions it,
and counts over all documents give the share of the entity's information that a word discloses:

    disclosure(e, t) = PMI(e, t) / IC(e) = log(N P(e | t) / df(e)) / log(N / df(e))

P(e | t) is the share of the word's documents that mention the entity.  A rare word meets an entity by chance,
so the share's lower confidence bound counts (Wilson's, `CONFIDENCE` deviations) and not joint(e, t) / df(t):
two documents of two are 0.27 of a share, twenty of twenty are 0.79.  The measure is at most 1, for a word
that occurs often and with the entity only.  A word whose disclosure of some entity reaches
`remove` is removed wherever it stands, in all documents, whether they mention the entity or not; one that
reaches `generalise` is replaced by its kind.  Pairs seen in fewer than `support` documents tell nothing,
and an entity that every document mentions has no information to disclose.

Only pairs that can reach `generalise` are counted.  As P(e | t) is at most df(e) / df(t), the word must have

    df(t) <= df(e) (N / df(e)) ^ (1 - generalise)

Bloom filters and lists of bounded size, built in Spark, leave out entities in fewer than `support` documents
and words that are too rare or too frequent.  They only save work: what passes them is counted exactly.

Defined results: a null text counts as empty; a null id is an id like others; equal rows get equal
results; entities and words are compared by 64-bit hashes, words with ASCII letters lower-cased.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voicelode.llm.common import Scratch, SpanHasher, bloom, maybe_in, small_batches, texts_of
from voicelode.llm.exact_dedup import mark_known
from voicelode.llm.words import ALNUM, Words, lowered

KINDS = ("email", "ip", "card", "phone")
#: Words on each side of a mention that make its context: the whole document.
CONTEXT = sys.maxsize
#: Documents that must show a pair before it counts.
SUPPORT = 2
#: Standard deviations by which the share of a word's documents that mention an entity is taken to be too high.
CONFIDENCE = 2.326
REMOVE = 0.9
GENERALISE = 0.75
#: Information that an entity must have to be protected: no entity is left out.
MIN_BITS = 0.0
#: Frequent entities and words whose document counts travel with the tasks (16 bytes each).
LISTED = 1 << 17
#: Pairs that a task holds before they are summed and given out.
HELD_PAIRS = 1_000_000

_LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email pattern; time is linear, as runs between two @ are looked at once."""
    free, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        local = text[free:at]
        start = free + len(local.rstrip(_LOCAL_CHARS))
        if domain and start < at:
            yield start, domain.end()
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All (kind, start, end) of the fixed kinds: kinds in their order, then by start."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def written(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def _hash(text: str) -> int:
    """A signed 64-bit hash of a text."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def entity_hashes(text: str, spans: list) -> list[int]:
    """The entity of each span."""
    return [_hash(f"{k}:{text[a:b] if k == 'email' or k == 'ip' else _NOT_DIGIT.sub('', text[a:b])}") for k, a, b in spans]


class PlacedWords(Words):
    """Words with their places in characters of their text."""

    def __init__(self, texts: list[bytes], hasher: SpanHasher):
        super().__init__(texts, ALNUM, hasher)
        self._chars = np.zeros(len(self.data) + 1, np.int64)  # characters that begin before each byte
        np.cumsum((self.data & 0xC0) != 0x80, out=self._chars[1:])

    def places(self, i: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of some words of the i-th text."""
        first = self._chars[self.begins[i]]
        return self._chars[self.starts[words]] - first, self._chars[self.ends[words]] - first

    def outside(self, i: int, spans: list, words: np.ndarray) -> np.ndarray:
        """Those of some words of the i-th text that overlap no span."""
        if not spans or not len(words):
            return words
        start, end = self.places(i, words)
        a = np.array(sorted(s[1] for s in spans))
        b = np.array(sorted(s[2] for s in spans))
        # as many spans begin before the word's end as have ended at its start
        return words[np.searchsorted(a, end) == np.searchsorted(b, start, side="right")]


def find_entities(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_key, counts, base spans, and the array of its entities."""

    def find(batches):
        for batch in small_batches(batches):
            rows = {k: [] for k in ("counts", "base", "entity")}
            for text in texts_of(batch.column("text")):
                spans = base_spans(text)
                kinds = [s[0] for s in spans]
                rows["counts"].append([kinds.count(k) for k in KINDS])
                rows["base"].append(written(spans))
                rows["entity"].append(sorted(set(entity_hashes(text, spans))))
            counts = np.array(rows["counts"], np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), *(pa.array(counts[:, i].copy()) for i in range(4))]
                + [pa.array(rows["base"], pa.string()), pa.array(rows["entity"], pa.list_(pa.int64()))],
                names=["doc_id", "text_key", *(f"n_{k}" for k in KINDS), "base", "entity"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(find, f"doc_id {kind}, text_key long, {counts}, base string, entity array<long>")


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted list of terms with the sums of their counts."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    term, at = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
    return term, np.bincount(at, np.concatenate([n for _, n in parts]), len(term)).astype(np.int64)


def counted_terms(term: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"term": term.view(np.int64), "df": df})


def term_frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df): in how many documents each of `terms` occurs."""
    wanted = docs.sparkSession.sparkContext.broadcast(bloom(terms.select(F.col("term").alias("h"))))

    def count(batches):
        hasher, held = SpanHasher(), []
        for batch in small_batches(batches):
            words = Words(lowered(batch.column("text")), ALNUM, hasher)
            hit = np.flatnonzero(maybe_in(wanted.value, words.hashes))
            h, doc = words.hashes[hit], np.searchsorted(words.at, hit, side="right") - 1
            order = np.lexsort([doc, h])
            h, doc = h[order], doc[order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            held.append(np.unique(h[once], return_counts=True))
            if len(held) > 64:
                held = [merge_counts(held)]
                if len(held[0][0]) > 500_000:
                    yield counted_terms(*held.pop())
        yield counted_terms(*merge_counts(held))

    counted = docs.select("text").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return counted.join(terms, "term")


def words_with(batches, known: np.ndarray):
    """(entities that may be known, distinct words outside of base spans) of each text that has such entities."""
    hasher = SpanHasher()
    for batch in small_batches(batches):
        texts, held = [], []
        for text in texts_of(batch.column("text")):
            spans = base_spans(text)
            if spans:
                entities = np.unique(np.array(entity_hashes(text, spans), np.int64))
                entities = entities[maybe_in(known, entities)]
                if len(entities):
                    texts.append(text)
                    held.append((entities, spans))
        if texts:
            words = PlacedWords(lowered(pa.array(texts, pa.string())), hasher)
            for i, (entities, spans) in enumerate(held):
                own = words.outside(i, spans, np.arange(words.at[i], words.at[i + 1]))
                yield entities, np.unique(words.hashes[own])


def shared_terms(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The words that stand in at least `SUPPORT` documents with known entities."""
    wanted = docs.sparkSession.sparkContext.broadcast(bloom(known.select(F.col("entity").alias("h"))))

    def count(batches):
        held, size = [], 0
        for _, terms in words_with(batches, wanted.value):
            held.append((terms, np.ones(len(terms), np.int64)))
            size += len(terms)
            if size > HELD_PAIRS:
                held = [merge_counts(held)]
                size = len(held[0][0])
                if size > HELD_PAIRS // 2:
                    yield counted_terms(*held.pop())
                    size = 0
        yield counted_terms(*merge_counts(held))

    counted = docs.select("text").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return counted.filter(F.col("df") >= SUPPORT).select("term")


def listed(table: DataFrame, key: str, count: str) -> tuple[np.ndarray, np.ndarray, int]:
    """The most frequent keys of a table, sorted, their counts, and what no other key's count exceeds."""
    rows = table.select(key, count).orderBy(F.desc(count)).limit(LISTED).toArrow()
    keys, counts = rows.column(key).to_numpy(), rows.column(count).to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order], int(counts.min()) if len(counts) else 0


def counts_of(found: tuple[np.ndarray, np.ndarray, int], keys: np.ndarray, other: int) -> np.ndarray:
    """The counts of keys, `other` for those that are not listed."""
    known, counts, _ = found
    if not len(known):
        return np.full(len(keys), other, np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, counts[at], other)


def merge_pairs(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entity, term, joint) with the sums of equal pairs."""
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    entity, term, joint = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort([term, entity])
    entity, term, joint = entity[order], term[order], joint[order]
    first = np.flatnonzero(np.r_[True, (entity[1:] != entity[:-1]) | (term[1:] != term[:-1])]) if len(entity) else np.zeros(0, int)
    return entity[first], term[first], np.add.reduceat(joint, first) if len(first) else joint


def reach(df: np.ndarray, n: int) -> np.ndarray:
    """The most documents that a word may be in to disclose enough of an entity that is in `df` documents."""
    return df * (n / np.maximum(df, 1)) ** (1 - GENERALISE) * (1 + 1e-9)


def joint_counts(docs: DataFrame, known: DataFrame, frequencies: DataFrame, n: int) -> DataFrame:
    """(entity, term, joint) of the pairs that can disclose enough, over whole documents."""
    context = docs.sparkSession.sparkContext
    wanted = context.broadcast(bloom(known.select(F.col("entity").alias("h"))))
    words = context.broadcast(bloom(frequencies.select(F.col("term").alias("h"))))
    lists = context.broadcast((listed(known, "entity", "df_e"), listed(frequencies, "term", "df")))

    def count(batches):
        entity_list, word_list = lists.value
        held, size = [], 0
        for entities, terms in words_with(batches, wanted.value):
            terms = terms[maybe_in(words.value, terms)].view(np.int64)
            df = counts_of(word_list, terms, 0)
            for entity, most in zip(entities, reach(counts_of(entity_list, entities, entity_list[2]), n), strict=True):
                some = terms[df <= most]
                held.append((np.full(len(some), entity), some, np.ones(len(some), np.int64)))
                size += len(some)
                if size > HELD_PAIRS:
                    held = [merge_pairs(held)]
                    size = len(held[0][0])
                    if size > HELD_PAIRS // 2:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, held.pop())], names=["entity", "term", "joint"])
                        size = 0
        yield pa.RecordBatch.from_arrays([*map(pa.array, merge_pairs(held))], names=["entity", "term", "joint"])

    pairs = docs.select("text").mapInArrow(count, "entity long, term long, joint long")
    return pairs.groupBy("entity", "term").agg(F.sum("joint").alias("joint")).filter(F.col("joint") >= SUPPORT)


def least_share(joint: Column, df: Column) -> Column:
    """The lower confidence bound of the share joint / df (Wilson's)."""
    share, z = joint / df, CONFIDENCE
    spread = F.sqrt(share * (1 - share) / df + z * z / (4 * df * df))
    return (share + z * z / (2 * df) - z * spread) / (1 + z * z / df)


def disclosures(found: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(term, disclosure) of words that disclose enough of some entity to act on."""
    n = found.count()
    entities = found.select(F.explode("entity").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("df_e"))
    ic = F.log2(F.lit(float(n)) / F.col("df_e"))
    known = scratch.table(entities.filter((F.col("df_e") >= SUPPORT) & (F.col("df_e") < n) & (ic >= MIN_BITS)), "known")
    terms = scratch.table(shared_terms(docs, known), "terms")
    most = float(reach(np.array([known.agg(F.max("df_e")).first()[0] or 0]), n)[0])
    frequencies = scratch.table(term_frequencies(docs, terms).filter(F.col("df") <= most), "frequencies")
    pairs = scratch.table(joint_counts(docs, known, frequencies, n), "pairs")
    pmi = F.log2(F.lit(float(n)) * least_share(F.col("joint"), F.col("df")) / F.col("df_e"))
    scored = pairs.join(known, "entity").join(frequencies, "term").select("term", (pmi / ic).alias("disclosure"))
    return scored.groupBy("term").agg(F.max("disclosure").alias("disclosure")).filter(F.col("disclosure") >= GENERALISE)


def term_places(docs: DataFrame, telling: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, end, term): the places outside of base spans of words that may be telling."""
    wanted = docs.sparkSession.sparkContext.broadcast(bloom(telling.select(F.col("term").alias("h"))))

    def find(batches):
        hasher = SpanHasher()
        for batch in small_batches(batches):
            words = PlacedWords(lowered(batch.column("text")), hasher)
            hit = np.flatnonzero(maybe_in(wanted.value, words.hashes))
            cut = np.searchsorted(hit, words.at)
            rows = np.flatnonzero(np.diff(cut))
            out = []
            for i in rows.tolist():
                own = words.outside(i, base_spans(batch.column("text")[i].as_py()), hit[cut[i] : cut[i + 1]])
                out.append((np.full(len(own), i), *words.places(i, own), words.hashes[own].view(np.int64)))
            if out:
                row, start, end, term = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row)), batch.column("text_key").take(pa.array(row))]
                    + [pa.array(start), pa.array(end), pa.array(term)],
                    names=["doc_id", "text_key", "start", "end", "term"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(find, f"doc_id {kind}, text_key long, start long, end long, term long")


def revealing_terms(found: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text_key, terms): the spans [start, end, disclosure] that the method adds to a document."""
    telling = scratch.table(disclosures(found, docs, scratch), "telling")
    spans = term_places(docs, telling).join(telling, "term")
    # equal rows have equal spans
    return spans.groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_set(F.struct("start", "end", "disclosure"))).alias("terms")
    )


def protected(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per document: doc_id, text_key, n_*, base, terms (null or an array)."""
    found = scratch.table(find_entities(docs), "found")
    terms = scratch.table(revealing_terms(found, docs, scratch), "revealing")
    kept = found.select("doc_id", "text_key", *(f"n_{k}" for k in KINDS), "base")
    extra = terms.withColumnsRenamed({"doc_id": "d", "text_key": "k"})
    return kept.join(extra, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left").drop("d", "k")


def span_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms of every document."""
    rows = protected(docs, Scratch(docs.sparkSession))
    kind = lambda t: F.when(t["disclosure"] >= REMOVE, F.lit("removed")).otherwise(F.lit("generalised"))
    added = F.transform("terms", lambda t: F.concat_ws(":", kind(t), t["start"].cast("string"), t["end"].cast("string")))
    # joined like the base spans: by kind, then by start
    ordered = F.concat(
        F.filter(added, lambda s: s.startswith("generalised")), F.filter(added, lambda s: s.startswith("removed"))
    )
    spans = F.concat_ws(",", F.nullif(F.col("base"), F.lit("")), F.nullif(F.array_join(ordered, ","), F.lit("")))
    return rows.select(
        "doc_id",
        *(f"n_{k}" for k in KINDS),
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        spans.alias("spans"),
        F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_terms"),
    )


def clean_text(text: str, base: str, terms: list | None) -> str:
    """The text with base spans replaced by their kind, and terms removed or generalised."""
    cuts = []
    for span in base.split(",") if base else ():
        kind, a, b = span.split(":")
        cuts.append((int(a), int(b), f"[{kind.upper()}]"))
    for t in terms or ():
        a, b = t["start"], t["end"]
        general = "[NUMBER]" if text[a:b].isdigit() else "[NAME]" if text[a : a + 1].isupper() else "[TERM]"
        cuts.append((a, b, "" if t["disclosure"] >= REMOVE else general))
    out, at = [], 0
    for a, b, new in sorted(cuts):
        if a >= at:
            out += [text[at:a], new]
            at = b
        elif b > at:  # overlaps the cut before: that one's mark stands for both
            at = b
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """`docs` with sanitised texts (and n_chars to match, where there is such a column); no row goes.

    Texts without spans are not touched, and but for a few that pass the filter of those with spans they do not move.
    """
    scratch = Scratch(docs.sparkSession)
    spans = protected(docs, scratch).filter("base != '' or terms is not null")
    spans = spans.select("doc_id", "text_key", "base", "terms").dropDuplicates(["doc_id", "text_key"])
    spans = scratch.table(spans, "spans")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    rows = rows.withColumn("h", F.xxhash64("id", "key"))
    marked = mark_known(rows, spans.select(F.xxhash64("doc_id", "text_key").alias("h")), scratch)
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key"))
    found = marked.filter("maybe_known").join(spans, same, "left").select("row", "base", "terms")

    def clean(batches):
        for batch in batches:
            texts = pa.compute.struct_field(batch.column("row"), "text").to_pylist()
            found = zip(texts, batch.column("base").to_pylist(), batch.column("terms").to_pylist(), strict=True)
            new = [None if base is None else clean_text(text, base, terms) for text, base, terms in found]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(new, pa.string())], names=["row", "new"])

    fields = rows.schema["row"].dataType
    cleaned = found.mapInArrow(clean, T.StructType().add("row", fields).add("new", "string"))
    new = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("new").cast(fields["n_chars"].dataType)
    old = {c: F.col(f"row.`{c}`") for c in docs.columns}
    cleaned = cleaned.select(
        *(F.when(F.col("new").isNotNull(), new[c]).otherwise(old[c]).alias(c) if c in new else old[c] for c in docs.columns)
    )
    return marked.filter(~F.col("maybe_known")).select("row.*").unionByName(cleaned)
