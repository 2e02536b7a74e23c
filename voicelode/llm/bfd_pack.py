"""Packing by best fit, longest pieces first, into matrices of token ids.

A document longer than a sequence is split without loss: whole sequences first, then one rest.  Whole
pieces fill a sequence each and do not move.  The rests (one a document) are dealt over buckets of a
bounded number; in a bucket each rest, the longest first, goes to the open sequence with the least room
that still takes it.  A segment tree over room sizes finds that size in logarithmic time.

The result is one row per sequence: its ids as one row of the matrix (padded to the sequence's length),
cumulative segment lengths, and positions that begin at zero in each segment.

Defined results: a null or empty text is one token (its end); rows without id and equal rows are packed
like others; ties go by id and start; an empty table gives no sequence.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicelode.llm.common import Scratch
from voicelode.llm.jaccard_join import groups
from voicelode.llm.tokens import Tokenizer, ids_of, vocabulary_path

LENGTH = 2048
#: Rests of a bucket, about: at most 2 * LENGTH bytes each are in memory at once.
BUCKET = 4096
PAD_ID = 0


class Rooms:
    """A segment tree over the sizes 0..length: how many open sequences have that much room."""

    def __init__(self, length: int):
        self.width = 1 << length.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, room: int, n: int) -> None:
        at = room + self.width
        while at:
            self.count[at] += n
            at >>= 1

    def least(self, need: int) -> int | None:
        """The smallest room of at least `need` that an open sequence has."""
        count, at = self.count, need + self.width
        while not count[at]:
            while at & 1:  # a right child: nothing more below its parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.width:
            at = 2 * at if count[2 * at] else 2 * at + 1
        return at - self.width


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Sequences as lists of piece numbers; `sizes` must not grow."""
    rooms, open_with, out = Rooms(length), {}, []
    for piece, size in enumerate(sizes):
        room = rooms.least(size)
        if room is None:
            sequence, room = len(out), length
            out.append([])
        else:
            sequence = open_with[room].pop()
            rooms.add(room, -1)
        out[sequence].append(piece)
        if room > size:
            open_with.setdefault(room - size, []).append(sequence)
            rooms.add(room - size, 1)
    return out


SCHEMA = (
    "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, "
    "doc_ids array<{id}>, starts array<long>, doc_tokens array<long>"
)


def _row(number: int, pieces: list[tuple], length: int) -> dict:
    """One sequence from (doc_id, start, doc_tokens, ids) pieces."""
    ids = np.concatenate([p[3] for p in pieces])
    ends = np.cumsum([0, *(len(p[3]) for p in pieces)])
    positions = np.zeros(length, "<u2")
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        positions[a:b] = np.arange(b - a)
    matrix = np.full(length, PAD_ID, "<u2")
    matrix[: len(ids)] = ids
    return {
        "sequence_id": number,
        "n_tokens": len(ids),
        "ids": matrix.tobytes(),
        "cu_seqlens": ends.tolist(),
        "positions": positions.tobytes(),
        "doc_ids": [p[0] for p in pieces],
        "starts": [p[1] for p in pieces],
        "doc_tokens": [p[2] for p in pieces],
    }


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """Packed sequences; those of one whole piece have negative numbers."""
    scratch, path = Scratch(docs.sparkSession), path or vocabulary_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = SCHEMA.format(id=kind)

    def encode(batches):
        tokenizer = Tokenizer(path)
        for batch in batches:
            ids = [tokenizer(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(i) // 2 for i in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "n", "ids"],
            )

    rows = docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, n long, ids binary")
    rows = scratch.table(rows, "tokens")
    buckets = max(1, -(-rows.count() // BUCKET))

    def batch_of(made: list[dict], like: pa.DataType) -> pa.RecordBatch:
        types = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(like)]
        types += [pa.list_(pa.int64())] * 2
        names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([m[n] for m in made], t) for n, t in zip(names, types, strict=True)], names=names)

    def sequences(batches):
        """Whole pieces, one a sequence."""
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("number", "doc_id", "start", "n", "ids")]
            made = [_row(k, [(d, a, n, ids_of(i))], length) for k, d, a, n, i in zip(*columns, strict=True)]
            for at in range(0, len(made), 1000):
                yield batch_of(made[at : at + 1000], batch.schema.field("doc_id").type)

    def fit(batches):
        """Buckets of rests."""
        order = [("size", "descending"), ("doc_id", "ascending"), ("number", "ascending")]
        for group in groups(batches, ["bucket"]):
            group = group.sort_by(order)
            bucket = group.column("bucket")[0].as_py()
            doc_id, start, n, ids, sizes = (group.column(c).to_pylist() for c in ("doc_id", "start", "n", "ids", "size"))
            made = []
            for i, found in enumerate(best_fit(sizes, length)):
                made.append(_row((bucket << 32) + i, [(doc_id[p], start[p], n[p], ids_of(ids[p])) for p in found], length))
            for at in range(0, len(made), 1000):
                yield batch_of(made[at : at + 1000], group.schema.field("doc_id").type)

    # rows of the written table have the same number whenever they are read
    own_number = F.monotonically_increasing_id()
    full = (
        rows.filter(F.col("n") >= length)
        .select("doc_id", "n", "ids", F.explode(F.expr(f"sequence(0L, n div {length} - 1)")).alias("i"))
        .select(
            (-own_number - 1).alias("number"),
            "doc_id",
            (F.col("i") * length).alias("start"),
            "n",
            F.expr(f"substring(ids, cast(i * {2 * length} + 1 as int), {2 * length})").alias("ids"),
        )
    )
    rests = rows.select("doc_id", "n", "ids", own_number.alias("number"), (F.col("n") % length).alias("size"))
    rests = rests.filter("size > 0").select(
        F.pmod(F.xxhash64("number"), F.lit(buckets)).alias("bucket"),
        "number",
        "doc_id",
        (F.col("n") - F.col("size")).alias("start"),
        "n",
        F.expr("substring(ids, cast(2 * (n - size) + 1 as int))").alias("ids"),
        "size",
    )
    dealt = rests.repartition("bucket").sortWithinPartitions("bucket")
    return full.mapInArrow(sequences, schema).unionByName(dealt.mapInArrow(fit, schema))


def write(packed: DataFrame, folder: str) -> None:
    """Packed sequences as Parquet files, one row of the matrices a row."""
    packed.write.parquet(folder)


def pieces(packed: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece, read back from the matrices."""

    def read(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            names = ("sequence_id", "ids", "positions", "cu_seqlens", "doc_ids", "starts", "doc_tokens")
            for number, ids, positions, ends, docs, starts, tokens in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                matrix, position = ids_of(ids), ids_of(positions)
                for a, b, doc, start, n in zip(ends[:-1], ends[1:], docs, starts, tokens, strict=True):
                    if position[a] != 0 or position[b - 1] != b - a - 1:
                        raise ValueError(f"positions of sequence {number} do not begin anew at {a}")
                    row = (doc, start, b - a, zlib.crc32(matrix[a:b].astype("<u4")), n, number, a)
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            kinds = [batch.schema.field("doc_ids").type.value_type, *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=fields)

    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = packed.schema["doc_ids"].dataType.elementType.simpleString()
    return packed.mapInArrow(read, f"doc_id {kind}, " + ", ".join(f"`{f}` long" for f in fields[1:]))
