"""Language-model scoring with a hashed maximum-entropy model.

Words are counted over all training documents.  Every word belongs to a bucket: the most frequent ones
have their own, the others share buckets by hash.  The model gives the probability of the next bucket as
that of its class times that of its member within the class, both softmaxes over summed weights of
features of the two words before: the word before, the word before that (a skip feature), both together
(hashed), and for members the word before with the class (hashed).  Within a bucket a word has its
add-one share, with one share left for words never seen, so the probabilities sum to one at most.

Every text's bucket numbers are written once, in 16 bits.  Training begins with the buckets' shares of the
counts and takes every position of all training documents.  In each round tasks go over all their positions, in
small batches, in random order within a group of some texts, with adaptive gradient steps from the common
weights, and the changes are averaged, weighted by positions; sums are formed block by block in two steps.
The number of buckets and of hashed features is fixed, whatever the size of the corpus.

Scoring reads the bucket numbers; counts of the most frequent words travel with the tasks, in a table of
bounded size; the other words' counts are joined by hash, and only those words shuffle.

Defined results: a null or empty text is one token, its end; a row's number keeps rows apart, so null and
repeated ids are scored each; without training documents all counts are zero; an empty table gives an
empty result.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicelode.llm.common import Scratch, SpanHasher, by_size, crc_mod, mix64, small_batches
from voicelode.llm.words import NOT_BLANK, Words, lowered

CLASSES, MEMBERS = 32, 32
BUCKETS = CLASSES * MEMBERS
#: Buckets of a single frequent word.
OWN = 640
#: Frequent words whose counts travel with the tasks (16 bytes each).
HEAD = 1 << 17
#: Rows of hashed features.
HASHED = 1 << 13
ROUNDS = 2
#: Positions of a gradient step, and of a group that steps are drawn from, about.
BATCH = 4096
GROUP = 1 << 17
RATE = 0.05
#: Parts of the weights that are summed separately, and partial sums of each.
BLOCKS = 64
PARTIAL = 16
END = np.uint64(1)
_START = BUCKETS

CLASS_ROWS = 1 + 2 * (BUCKETS + 1) + HASHED
MEMBER_ROWS = CLASSES + HASHED
WEIGHTS = CLASS_ROWS * CLASSES + MEMBER_ROWS * MEMBERS


def token_hashes(texts: list[bytes], hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the tokens of all texts, each text's end included, and where each text begins (with the end)."""
    words = Words(texts, NOT_BLANK, hasher)
    tokens = np.insert(words.hashes, words.at[1:], END)
    return tokens, words.at + np.arange(len(words.at))


def _token_slices(batches):
    hasher = SpanHasher()
    for batch in small_batches(batches):
        yield batch, *token_hashes(lowered(batch.column("text")), hasher)


def word_counts(train: DataFrame) -> DataFrame:
    """(h, c): how often each token occurs."""

    def count(batches):
        held = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for _, tokens, _ in _token_slices(batches):
            held.append(np.unique(tokens, return_counts=True))
            if len(held) > 16:
                held = [_merge(held)]
                if len(held[0][0]) > 1_000_000:
                    yield _counts(*held.pop())
        yield _counts(*_merge(held))

    return train.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _merge(held):
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
    return h, np.bincount(at, np.concatenate([c for _, c in held]), len(h)).astype(np.int64)


def _counts(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"h": h.view(np.int64), "c": c})


class Vocabulary:
    """What tasks know of words: counts of the head, own buckets, and each bucket's log share."""

    def __init__(self, counts: DataFrame):
        head = counts.orderBy(F.desc("c"), "h").limit(HEAD).toArrow()
        h, c = head.column("h").to_numpy().view(np.uint64), head.column("c").to_numpy()
        rank = np.arange(len(h))
        order = np.argsort(h)
        self.h, self.c, self.rank = h[order], c[order], rank[order]
        own = [int(x) for x in h[: min(OWN, len(h))].view(np.int64)]
        in_bucket = F.pmod(F.shiftrightunsigned("h", 20), F.lit(BUCKETS - OWN)) + OWN
        rest = counts.filter(~F.col("h").isin(own)) if own else counts
        shared = rest.groupBy(in_bucket.alias("bucket")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
        weight = np.ones(BUCKETS)
        weight[: len(own)] += c[: len(own)] + 1
        for r in shared:
            weight[r["bucket"]] += r["c"] + r["v"]
        self.log_weight = np.log10(weight)
        total = counts.agg(F.count(F.lit(1)), F.sum("c")).first()
        self.size, self.tokens = int(total[0]), int(total[1] or 0)

    def sent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What tasks get, as plain arrays."""
        return self.h, self.c, self.rank


def look_up(words: tuple, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, in the head, count) of tokens, by what a vocabulary sends."""
    h, c, ranks = words
    bucket = ((tokens >> np.uint64(20)) % np.uint64(BUCKETS - OWN)).astype(np.int64) + OWN
    if not len(h):
        return bucket, np.zeros(len(tokens), bool), np.zeros(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(h, tokens), len(h) - 1)
    known = h[at] == tokens
    rank = np.where(known, ranks[at], OWN)
    return np.where(rank < OWN, rank, bucket), known, np.where(known, c[at], 0)


def contexts(bucket: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets one and two tokens before, a start mark in front of each text."""
    one, two = np.full(len(bucket), _START), np.full(len(bucket), _START)
    one[1:], two[2:] = bucket[:-1], bucket[:-2]
    first = begins[:-1][np.diff(begins) > 0]
    one[first] = two[first] = _START
    second = first + 1
    second = second[second < len(bucket)]
    two[second[~np.isin(second, first)]] = _START
    return one, two


def _hashed(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    mixed = mix64((a * 4099 + b + salt).astype(np.uint64))
    return (mixed & np.uint64(HASHED - 1)).astype(np.int64)


def feature_rows(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The rows of the class weights that are summed for each position, besides row 0."""
    side = BUCKETS + 1
    return np.stack([1 + one, 1 + side + two, 1 + 2 * side + _hashed(one, two, 1)])


def member_rows(one: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """The row of the member weights that is added to the row of the class."""
    return CLASSES + _hashed(one, cls, 1 << 30)[None, :]


def _split(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = CLASS_ROWS * CLASSES
    return weights[:cut].reshape(CLASS_ROWS, CLASSES), weights[cut:].reshape(MEMBER_ROWS, MEMBERS)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def logits(table: np.ndarray, common: np.ndarray | int, rows: np.ndarray) -> np.ndarray:
    """The sums of the `common` row and the others of each position."""
    out = table[rows[0]]
    for r in rows[1:]:
        out += table[r]
    out += table[common]
    return out


def log_probabilities(weights: np.ndarray, bucket: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Natural log probability of each bucket given those before it."""
    by_class, by_member = _split(weights)
    out = np.empty(len(bucket))
    for a in range(0, len(bucket), 1 << 13):
        s = slice(a, a + (1 << 13))
        cls, member = bucket[s] // MEMBERS, bucket[s] % MEMBERS
        at = np.arange(len(cls))
        over_classes = _log_softmax(logits(by_class, 0, feature_rows(one[s], two[s])))
        within = _log_softmax(logits(by_member, cls, member_rows(one[s], cls)))
        out[s] = over_classes[at, cls] + within[at, member]
    return out


def _add(table: np.ndarray, squares: np.ndarray, used, total: np.ndarray) -> None:
    """An adaptive gradient step on the rows `used`."""
    s = squares[used] + total * total
    squares[used] = s
    table[used] -= RATE * total / np.sqrt(s + 1e-6)


def gradient_step(table: np.ndarray, squares: np.ndarray, common, rows: np.ndarray, target: np.ndarray) -> None:
    """One step on some positions: `common` is one row for all, or the place among the first rows of each."""
    gradient = logits(table, common, rows)
    gradient -= gradient.max(axis=1, keepdims=True)
    np.exp(gradient, out=gradient)
    gradient /= gradient.sum(axis=1, keepdims=True)
    gradient[np.arange(len(target)), target] -= 1
    if isinstance(common, int):
        _add(table, squares, common, gradient.sum(axis=0))
    else:
        one_of = np.zeros((len(common), CLASSES), np.float32)
        one_of[np.arange(len(common)), common] = 1
        _add(table, squares, slice(0, CLASSES), one_of.T @ gradient)
    flat = rows.ravel().astype(np.uint16)  # sorted by digits; tables have fewer rows
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    # two numbers are added at a time
    pairs = gradient[order % len(gradient)].view(np.complex64)
    _add(table, squares, flat[start], np.add.reduceat(pairs, start, axis=0).view(np.float32))


def train_group(tables: tuple, squares: tuple, bucket: np.ndarray, one: np.ndarray, two: np.ndarray, rng) -> None:
    """Steps on all positions of a group, in random order."""
    order = rng.permutation(len(bucket))
    for a in range(0, len(order), BATCH):
        own = order[a : a + BATCH]
        cls, first = bucket[own] // MEMBERS, one[own]
        gradient_step(tables[0], squares[0], 0, feature_rows(first, two[own]), cls)
        gradient_step(tables[1], squares[1], cls, member_rows(first, cls), bucket[own] % MEMBERS)


def prepared(docs: DataFrame, vocabulary) -> DataFrame:
    """Per row: row, doc_id, held_out, n_tokens, the sums over the head's words, the other words with their number, and the buckets."""

    def prepare(batches):
        words = vocabulary.value
        row = TaskContext.get().partitionId() << 33
        for batch, tokens, begins in _token_slices(batches):
            bucket, known, count = look_up(words, tokens)
            logs = np.log10(count + 1.0)
            firsts, n = begins[:-1], len(begins) - 1
            doc = np.repeat(np.arange(n), np.diff(begins))
            rest = np.flatnonzero(~known)
            order = np.lexsort([tokens[rest], doc[rest]])
            rest = rest[order]
            h, of = tokens[rest], doc[rest]
            start = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])]) if len(h) else np.zeros(0, int)
            times = np.diff(np.r_[start, len(h)])
            ends = np.searchsorted(of[start], np.arange(n + 1)).astype(np.int32)
            rare = pa.ListArray.from_arrays(
                ends,
                pa.StructArray.from_arrays(
                    [pa.array(h[start].view(np.int64)), pa.array(times.astype(np.int32))], names=["h", "times"]
                ),
            )
            written = bucket.astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + n)),
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(np.diff(begins).astype(np.int64)),
                    pa.array(np.add.reduceat(known.astype(np.int64), firsts)),
                    pa.array(np.add.reduceat(logs, firsts)),
                    rare,
                    pa.array([written[2 * a : 2 * b] for a, b in zip(begins[:-1], begins[1:], strict=True)], pa.binary()),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "logs", "rare", "buckets"],
            )
            row += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(
        prepare,
        f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, "
        "rare array<struct<h: bigint, times: int>>, buckets binary",
    )


def written_texts(batches):
    """(rows of a batch, buckets, one before, two before, where the texts begin) of some texts of about `GROUP` positions."""
    for batch in batches:
        column = batch.column("buckets")
        sizes = pc.binary_length(column).to_numpy() // 2
        for a, b in by_size(sizes, GROUP):
            bucket = np.frombuffer(b"".join(column.slice(a, b - a).to_pylist()), "<u2").astype(np.int64)
            begins = np.concatenate([[0], np.cumsum(sizes[a:b])])
            yield batch.slice(a, b - a), bucket, *contexts(bucket, begins), begins


def _summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The sums of (n, delta) of equal keys, kept as one vector while rows stream by."""
    dealt = parts.repartition(*keys).sortWithinPartitions(*keys)

    def add(batches):
        last, n, total = None, 0.0, None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            for i, key in enumerate(zip(*columns, strict=True)):
                if key != last:
                    if last is not None:
                        yield _part(keys, last, n, total)
                    last, n, total = key, 0.0, np.zeros(len(batch.column("delta")[i].as_py()) // 4, np.float64)
                n += batch.column("n")[i].as_py()
                total += np.frombuffer(batch.column("delta")[i].as_py(), "<f4")
        if last is not None:
            yield _part(keys, last, n, total)

    return dealt.mapInArrow(add, ", ".join(f"{k} int" for k in keys) + ", n double, delta binary")


def _part(keys: list[str], key: tuple, n: float, total: np.ndarray) -> pa.RecordBatch:
    columns = {k: pa.array([v], pa.int32()) for k, v in zip(keys, key, strict=True)}
    return pa.RecordBatch.from_pydict(columns | {"n": [n], "delta": pa.array([total.astype("<f4").tobytes()], pa.binary())})


def first_weights(log_weight: np.ndarray) -> np.ndarray:
    """Weights that give each bucket its share of the counts, whatever stands before."""
    weights = np.zeros(WEIGHTS, np.float32)
    by_class, by_member = _split(weights)
    share = (log_weight * math.log(10)).reshape(CLASSES, MEMBERS)
    by_class[0] = np.logaddexp.reduce(share, axis=1)
    by_member[:CLASSES] = share
    return weights


def train_weights(written: DataFrame, log_weight: np.ndarray) -> np.ndarray:
    """Weights after rounds of distributed gradient steps on the column `buckets`; their number does not depend on the corpus."""
    weights = first_weights(log_weight)
    for step in range(ROUNDS):
        shared = written.sparkSession.sparkContext.broadcast(weights)

        def learn(batches, shared=shared, step=step):
            own = shared.value.copy()
            tables, squares = _split(own), _split(np.zeros_like(own))
            n, part = 0, TaskContext.get().partitionId()
            rng = np.random.default_rng([step, part])
            for _, bucket, one, two, _ in written_texts(batches):
                train_group(tables, squares, bucket, one, two, rng)
                n += len(bucket)
            if n:
                delta = (own - shared.value) * np.float32(n)
                for block, values in enumerate(np.array_split(delta, BLOCKS)):
                    yield pa.RecordBatch.from_pydict(
                        {
                            "block": pa.array([block], pa.int32()),
                            "some": pa.array([part % PARTIAL], pa.int32()),
                            "n": [float(n)],
                            "delta": pa.array([values.astype("<f4").tobytes()], pa.binary()),
                        }
                    )

        changes = written.select("buckets").mapInArrow(learn, "block int, some int, n double, delta binary")
        summed = _summed(_summed(changes, ["block", "some"]).drop("some"), ["block"]).toArrow().to_pylist()
        for row in summed:
            block = np.array_split(np.arange(WEIGHTS), BLOCKS)[row["block"]]
            weights[block] += (np.frombuffer(row["delta"], "<f4") / row["n"]).astype(np.float32)
        shared.unpersist()
    return weights


def model_scores(written: DataFrame, log_weight, weights) -> DataFrame:
    """(row, lm): by how much the model's log10 probability of a text exceeds that of its words within their buckets."""

    def score(batches):
        for rows, bucket, one, two, begins in written_texts(batches):
            lm = log_probabilities(weights.value, bucket, one, two) / math.log(10) - log_weight.value[bucket]
            yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(np.add.reduceat(lm, begins[:-1]))], names=["row", "lm"])

    return written.select("row", "buckets").mapInArrow(score, "row long, lm double")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"))
    counts = scratch.table(word_counts(rows.filter(~F.col("held_out"))), "counts")
    words = Vocabulary(counts)
    parts = scratch.table(prepared(rows, spark.sparkContext.broadcast(words.sent())), "parts")
    weights = train_weights(parts.filter(~F.col("held_out")), words.log_weight)
    scores = model_scores(parts, spark.sparkContext.broadcast(words.log_weight), spark.sparkContext.broadcast(weights))
    scores = scratch.table(scores, "scores")

    rare = parts.select("row", F.explode("rare").alias("r")).select("row", "r.h", "r.times")
    found = (
        rare.join(counts, "h")
        .groupBy("row")
        .agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more_logs"))
    )
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return parts.drop("rare", "buckets").join(scores, "row").join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * math.log10(words.tokens + words.size + 1)).alias("base_score"),
        (logs + F.col("lm")).alias("score"),
    )
