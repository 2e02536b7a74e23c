"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Texts become runs of 64 symbols (a to z, other letters hashed, one symbol for all else).  The features
of a text are the n-grams of one, two and three symbols that hold each letter: their share among the
letters times their idf.  Document frequencies come from all training documents.  The weights are
learned from at most `per_language` training documents of each language (those with the smallest hash
of their id) by follow-the-regularised-leader with elastic-net penalties: tasks go over their part of
the sample, their changes of state are averaged, and the next epoch starts from the average.  One
temperature, fitted on sampled documents that the weights have not seen, calibrates the probabilities.

A prediction is one gather per letter: the weights of the three n-grams that share a middle letter are
summed into one table over symbol triples before.

Defined results: a null text and one without a letter get `und` with score 0.0, and so does every text
when nothing could be learned; documents without lang are predicted but not learned from; a null id is
hashed as empty text; equal texts get equal results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from voicelode.llm.common import Scratch, crc_mod, small_batches, texts_of

SYMBOLS = 64
TRIPLES = SYMBOLS**3
PAIRS = SYMBOLS**2
FEATURES = TRIPLES + PAIRS + SYMBOLS
UNKNOWN = "und"

#: Bound of the training sample, in documents of each language.
PER_LANGUAGE = 1000
EPOCHS = 3
#: Tasks of one epoch; a constant, so that the result does not depend on the cluster.
SHARDS = 4
FTRL = {"alpha": 0.5, "beta": 1.0, "l1": 1e-4, "l2": 1e-4}
#: The share of the sample that fits the temperature: one in so many documents.
CALIBRATE = 5


def symbol_table() -> np.ndarray:
    """Symbol of each code point of the basic plane: 0 for what is no letter."""
    points = np.arange(0x10000, dtype=np.uint32)
    table = (27 + (points * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(SYMBOLS - 27)).astype(np.uint8)
    table[[i for i in range(0x10000) if not chr(i).isalpha()]] = 0
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return table


def triples(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbol triples around the letters of all texts, and where each text's triples begin (with the end)."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    begins = np.cumsum([1, *(len(t) + 1 for t in lowered)])
    symbols = table[np.minimum(points, 0xFFFF)]
    if len(high := np.flatnonzero(points > 0xFFFF)):
        letter = np.fromiter((chr(p).isalpha() for p in points[high]), bool, len(high))
        symbols[high] = np.where(letter, 27 + points[high] % (SYMBOLS - 27), 0)
    keep = symbols != 0
    keep[1:] |= symbols[:-1] != 0  # of a run of other characters, the first
    keep[0] = True
    before = np.concatenate([[0], np.cumsum(keep)])  # kept symbols before each place
    runs = symbols[keep].astype(np.int32)
    middle = np.flatnonzero(runs)
    found = (runs[middle - 1] * SYMBOLS + runs[middle]) * SYMBOLS + runs[np.minimum(middle + 1, len(runs) - 1)]
    return found, np.searchsorted(middle, before[begins])


def features_of(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of one text's triples and their shares."""
    pairs = found // SYMBOLS
    ids = np.concatenate([found, TRIPLES + pairs, TRIPLES + PAIRS + pairs % SYMBOLS])
    ids, counts = np.unique(ids, return_counts=True)
    return ids, counts / len(found)


def document_frequencies(train: DataFrame) -> DataFrame:
    """(feature, n) over all rows of `train`; feature -1 counts the rows."""

    def count(batches):
        table, total, rows = symbol_table(), np.zeros(FEATURES, np.int64), 0
        seen = np.zeros(TRIPLES, bool)
        for batch in small_batches(batches):
            found, at = triples(texts_of(batch.column("text")), table)
            rows += batch.num_rows
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if b - a > 2000:  # long texts: mark, then look
                    seen[found[a:b]] = True
                    own = np.flatnonzero(seen)
                    seen[own] = False
                else:
                    own = np.unique(found[a:b])
                total[own] += 1
                pairs = np.unique(own // SYMBOLS)
                total[TRIPLES + pairs] += 1
                total[TRIPLES + PAIRS + np.unique(pairs % SYMBOLS)] += 1
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict(
            {"feature": np.append(ids, -1).astype(np.int32), "n": np.append(total[ids], rows)}
        )

    return train.select("text").mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def training_sample(train: DataFrame, per_language: int) -> DataFrame:
    """At most `per_language` documents of each language, with their feature shares."""
    picked = train.select("lang", F.xxhash64("id").alias("pick"), "id", "text")
    order = Window.partitionBy("lang").orderBy("pick")
    last = (  # from two narrow columns; a row for each language
        picked.select("lang", "pick")
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= per_language)
        .groupBy("lang")
        .agg(F.max("pick").alias("last"))
    )
    chosen = (
        picked.join(F.broadcast(last), "lang")
        .filter("pick <= last")
        .repartition(SHARDS, "pick")
        .sortWithinPartitions("pick", "id", "lang")
    )

    def featurise(batches):
        table = symbol_table()
        for batch in small_batches(batches):
            found, at = triples(texts_of(batch.column("text")), table)
            rows = [features_of(found[x:y]) for x, y in zip(at[:-1], at[1:], strict=True) if y > x]
            kept = [i for i, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)) if y > x]
            pick = batch.column("pick").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([batch.column("lang")[i].as_py() for i in kept], pa.string()),
                    "pick": pa.array([int(pick[i]) for i in kept], pa.int64()),
                    "ids": pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())),
                    "shares": pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32())),
                }
            )

    return chosen.mapInArrow(featurise, "lang string, pick long, ids array<int>, shares array<float>")


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FTRL's weights from its state, with elastic net."""
    shrunk = np.sign(z) * np.maximum(np.abs(z) - FTRL["l1"], 0)
    return -shrunk / ((FTRL["beta"] + np.sqrt(n)) / FTRL["alpha"] + FTRL["l2"])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _examples(batches, idf: np.ndarray, langs: list[str], calibrating: bool):
    at = {lang: i for i, lang in enumerate(langs)}
    for batch in batches:
        for lang, pick, ids, shares in zip(
            *(batch.column(c).to_pylist() for c in ("lang", "pick", "ids", "shares")), strict=True
        ):
            if (pick % CALIBRATE == 0) == calibrating:
                ids = np.asarray(ids)
                yield at[lang], ids, np.asarray(shares) * idf[ids]


def _epoch(sample: DataFrame, idf: np.ndarray, langs: list[str], z: np.ndarray, n: np.ndarray) -> None:
    """One pass over the sample: tasks change copies of the state, their mean change is added to it."""
    shared = sample.sparkSession.sparkContext.broadcast((idf, z, n))

    def learn(batches):
        idf, z, n = shared.value
        dz, dn = z.copy(), n.copy()
        touched = np.zeros(FEATURES, bool)
        for y, ids, x in _examples(batches, idf, langs, False):
            touched[ids] = True
            w = _weights(dz[ids], dn[ids])
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            more = dn[ids] + g * g
            dz[ids] += g - (np.sqrt(more) - np.sqrt(dn[ids])) / FTRL["alpha"] * w
            dn[ids] = more
        for i in np.array_split(np.flatnonzero(touched), 16):
            for c in range(len(langs)):
                yield pa.RecordBatch.from_pydict(
                    {
                        "cell": i.astype(np.int64) * len(langs) + c,
                        "dz": dz[i, c] - z[i, c],
                        "dn": dn[i, c] - n[i, c],
                    }
                )

    moved = sample.mapInArrow(learn, "cell long, dz double, dn double")
    moved = moved.groupBy("cell").agg(F.sum("dz").alias("dz"), F.sum("dn").alias("dn")).toArrow()
    cell = moved.column("cell").to_numpy()
    z.reshape(-1)[cell] += moved.column("dz").to_numpy() / SHARDS
    n.reshape(-1)[cell] += moved.column("dn").to_numpy() / SHARDS
    shared.unpersist()


def _temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the smallest log loss, by golden-section search on its logarithm."""
    if not len(truth):
        return 1.0

    def loss(log_t: float) -> float:
        p = _softmax(logits / math.exp(log_t))
        return -float(np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-12)).mean())

    a, b, g = math.log(0.02), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return math.exp((a + b) / 2)


def train_model(train: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages, table): `table[triple]` is what a letter with its neighbours adds to each logit.

    `train` has id, text, lang.  The state's size is bounded by features times languages.
    """
    scratch = Scratch(train.sparkSession)
    sample = scratch.table(training_sample(train, per_language), "sample")
    langs = [r[0] for r in sample.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return [], np.zeros((TRIPLES, 0), np.float32)
    counted = document_frequencies(train).toArrow()
    feature, n_docs = counted.column("feature").to_numpy(), counted.column("n").to_numpy()
    df = np.zeros(FEATURES)
    df[feature[feature >= 0]] = n_docs[feature >= 0]
    idf = np.log((1 + n_docs[feature < 0].sum()) / (1 + df)) + 1

    z, n = np.zeros((FEATURES, len(langs))), np.zeros((FEATURES, len(langs)))
    for _ in range(EPOCHS):
        _epoch(sample, idf, langs, z, n)
    scaled = _weights(z, n) * idf[:, None]

    def logits(batches):
        found = [(y, x @ scaled[ids]) for y, ids, x in _examples(batches, np.ones(FEATURES), langs, True)]
        yield pa.RecordBatch.from_pydict(
            {
                "y": pa.array([y for y, _ in found], pa.int32()),
                "logits": pa.array([x for _, x in found], pa.list_(pa.float64())),
            }
        )

    held = sample.mapInArrow(logits, "y int, logits array<double>").toArrow().to_pydict()
    t = _temperature(np.array(held["logits"]).reshape(-1, len(langs)), np.array(held["y"], int))
    triple = np.arange(TRIPLES)
    table = (
        scaled[triple] + scaled[TRIPLES + triple // SYMBOLS] + scaled[TRIPLES + PAIRS + triple // SYMBOLS % SYMBOLS]
    )
    scratch.drop("sample")
    return langs, (table / t).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """`docs` with lang_pred and score; only the column `text` is looked at."""
    schema = T.StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def label(batches):
        symbols, weights = symbol_table(), shared.value
        columns = [np.ascontiguousarray(weights[:, c]) for c in range(len(langs))]
        names = np.array([*langs, UNKNOWN], object)
        for batch in small_batches(batches):
            texts = texts_of(batch.column("text"))
            found, at = triples(texts, symbols)
            letters = np.diff(at)
            known = (letters > 0) & (len(langs) > 0)
            best, score = np.full(len(texts), len(langs)), np.zeros(len(texts))
            if known.any():
                logits = np.empty((len(texts), len(langs)))
                for c, column in enumerate(columns):
                    sums = np.concatenate([[0.0], np.cumsum(column[found], dtype=np.float64)])
                    logits[:, c] = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(letters, 1)
                p = _softmax(logits)
                best = np.where(known, p.argmax(axis=1), len(langs))
                score = np.where(known, p.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[best].tolist(), pa.string()), pa.array(score)],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return docs.mapInArrow(label, schema)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learns where crc32(doc_id) mod 5 is not 0."""
    rows = docs.select("doc_id", "text", "lang", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"))
    train = rows.filter(~F.col("held_out") & F.col("lang").isNotNull()).select(F.col("doc_id").alias("id"), "text", "lang")
    langs, table = train_model(train, per_language)
    return predict(rows.select("doc_id", "held_out", "text"), langs, table).drop("text")


def keep_identified(docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """`docs` without texts of no recognisable language: no letter, or a best probability below `min_score`."""
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("id"), "text", "lang", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out")
    )
    train = rows.filter(~F.col("held_out") & F.col("lang").isNotNull()).select("id", "text", "lang")
    langs, table = train_model(train)
    marked = predict(rows.select("row", "text"), langs, table)
    return marked.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("row.*")
