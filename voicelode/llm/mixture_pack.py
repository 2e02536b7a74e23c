"""Mixture-controlled packing: deficit round-robin over source queues.

The documents of a source form a queue of tokens, cut into quanta.  Windows have a fixed number of slots
of one quantum.  With every slot each source earns credit in proportion to its target share, and the
source whose quantum is due first is served; what it is owed or has had too much is its deficit.  A
source that is empty drops out and the others go on.  Credit grows linearly, so quantum k of a source
with weight w is due at (2k + 1) / 2w, and its slot is the number of quanta of all sources due before:
a task computes any slot from the weights and queue lengths alone.  That is how deficits are carried
across windows and partitions without one task waiting for another: everywhere in the sequence each
source is within about one quantum of its target.

Sources' unfinished last quanta are laid behind all full ones, one after another, so only the last
sequence is short.  By default the targets are the sources' shares of all tokens, which keeps the mixture
the same from the first window to the last; `targets` gives others.

Defined results: a null or empty text is one token (its end); null is a source like others; a source
without a target weighs as much as the smallest one; equal rows are packed once each; an empty table
gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voicelode.llm.common import Scratch
from voicelode.llm.tokens import Tokenizer, ids_of, vocabulary_path

LENGTH = 2048
QUANTUM = 256
#: Weights are whole numbers up to this, so that due times compare exactly in 64 bits.
WEIGHT_BITS = 20
NO_SOURCE = "\x00"


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """(part, source, doc_id, before, n, ids): ids of each document, and the tokens of its source before it in its task."""

    def encode(batches):
        tokenizer, part, queued = Tokenizer(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            ids = [tokenizer(t.as_py()) for t in batch.column("text")]
            before, sizes = [], [len(i) // 2 for i in ids]
            sources = batch.column("source").to_pylist()
            for source, n in zip(sources, sizes, strict=True):
                before.append(queued.get(source, 0))
                queued[source] = before[-1] + n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(ids), pa.int32()),
                    pa.array(sources, pa.string()),
                    batch.column("doc_id"),
                    pa.array(before, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["part", "source", "doc_id", "before", "n", "ids"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("source"))
    return rows.mapInArrow(encode, f"part int, source string, doc_id {kind}, before long, n long, ids binary")


def weights_of(totals: dict[str, int], targets: dict[str | None, float] | None) -> dict[str, int]:
    """Whole-number weights of the sources."""
    if targets is None:
        share = {s: float(n) for s, n in totals.items()}
    else:
        given = {NO_SOURCE if s is None else s: w for s, w in targets.items() if w > 0}
        least = min(given.values(), default=1.0)
        share = {s: given.get(s, least) for s in totals}
    most = max(share.values(), default=1.0)
    return {s: max(1, round(w / most * (1 << WEIGHT_BITS))) for s, w in share.items()}


class Schedule:
    """Where each source's quanta lie in the sequence of all tokens."""

    def __init__(self, totals: dict[str, int], weights: dict[str, int], quantum: int):
        self.names = sorted(totals)
        self.index = {s: i for i, s in enumerate(self.names)}
        self.quantum = quantum
        tokens = np.array([totals[s] for s in self.names], np.int64)
        self.weights = np.array([weights[s] for s in self.names], np.int64)
        self.full, rest = tokens // quantum, tokens % quantum
        self.tails = int(self.full.sum()) * quantum + np.cumsum(rest) - rest

    def slots(self, source: int, k: np.ndarray) -> np.ndarray:
        """The slots of full quanta `k` of a source: how many quanta of all sources are due before."""
        due, w = 2 * k + 1, self.weights[source]
        out = np.zeros(len(k), np.int64)
        for other in range(len(self.names)):
            v = self.weights[other]
            # quanta j of the other source with (2j + 1) / v < due / w; on a tie the first name goes first
            earlier = -((w - due * v) // (2 * w)) if other >= source else (due * v - w) // (2 * w) + 1
            out += np.clip(earlier, 0, self.full[other])
        return out

    def runs(self, source: np.ndarray, start: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
        """(row, begin, place, size) of the runs of rows that hold tokens [start, start + n) of a queue.

        `begin` counts from the row's first token.  Runs are cut where a sequence of `length` ends,
        and joined where one goes on from the one before.
        """
        first = start // self.quantum
        counts = (start + n - 1) // self.quantum - first + 1
        row = np.repeat(np.arange(len(n)), counts)
        k = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + first[row]
        place = self.tails[source[row]]
        for s in np.unique(source):
            full = np.flatnonzero((source[row] == s) & (k < self.full[s]))
            place[full] = self.slots(int(s), k[full]) * self.quantum
        begin = np.maximum(k * self.quantum, start[row])
        size = np.minimum((k + 1) * self.quantum, (start + n)[row]) - begin
        place = place + begin - k * self.quantum
        begin -= start[row]

        over = place // length != (place + size - 1) // length  # only a tail can cross an end
        if over.any():
            kept = np.where(over, length - place % length, size)
            row = np.concatenate([row, row[over]])
            begin = np.concatenate([begin, (begin + kept)[over]])
            place = np.concatenate([place, (place + kept)[over]])
            size = np.concatenate([kept, (size - kept)[over]])
            order = np.lexsort([begin, row])
            row, begin, place, size = row[order], begin[order], place[order], size[order]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + size[:-1]) | (place[1:] % length == 0)
        at = np.flatnonzero(fresh)
        return row[at], begin[at], place[at], np.add.reduceat(size, at)


def pack(
    docs: DataFrame,
    targets: dict[str | None, float] | None = None,
    length: int = LENGTH,
    quantum: int = QUANTUM,
    path: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    if length % quantum:
        raise ValueError("a sequence must hold a whole number of quanta")
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(tokenised(docs, path or vocabulary_path()), "tokens")
    sums = rows.groupBy("source", "part").agg(F.sum("n").alias("tokens"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.table(sums.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))), "starts")
    # one row for each source of the mixture
    totals = {r[0]: r[1] for r in starts.groupBy("source").agg(F.sum("tokens")).collect()}
    schedule = Schedule(totals, weights_of(totals, targets), quantum)

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            source = np.array([schedule.index[x] for x in batch.column("source").to_pylist()])
            base, before, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("base", "before", "n"))
            row, begin, at, size = schedule.runs(source, base + before, n, length)
            ids = [ids_of(i) for i in batch.column("ids").to_pylist()]
            pieces = [ids[r][b : b + m] for r, b, m in zip(row.tolist(), begin.tolist(), size.tolist(), strict=True)]
            crc = np.array([zlib.crc32(p.astype("<u4")) for p in pieces], np.int64)
            names_of = np.array([None if s == NO_SOURCE else s for s in schedule.names], object)
            arrays = [
                batch.column("doc_id").take(pa.array(row)),
                pa.array(names_of[source[row]].tolist(), pa.string()),
                *map(pa.array, (begin, size, crc, n[row], at // length, at % length)),
            ]
            if with_ids:
                arrays.append(pa.array([p.tobytes() for p in pieces], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, source string, " + ", ".join(f"`{n}` long" for n in names[2:8]) + ", ids binary" * with_ids
    placed = rows.join(starts.select("source", "part", "base"), ["source", "part"])
    return placed.select("doc_id", "source", "base", "before", "n", "ids").mapInArrow(place, schema)
