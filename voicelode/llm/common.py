"""What the operators share: scratch tables, text slices, hashing of words."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"

#: Characters that one vectorised step works on, so that a worker's memory does not depend on the batch.
SLICE_CHARS = 400_000
#: Rows of an Arrow batch, where the session has Spark's default: ten thousand texts would be too large.
ARROW_ROWS = 1000
_ARROW_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a file of a scratch table of ids, about.
FILE_ROWS = 1 << 14


class Scratch:
    """Tables written in the shared folder that the session names.

    A written table survives the loss of executors, cuts the plan and has a known size.
    Only a local session without that setting gets a temporary folder of its own.
    """

    def __init__(self, spark: SparkSession):
        root = spark.conf.get(_CONF, None)
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError(f"set {_CONF} to a folder that every executor can reach")
            root = tempfile.mkdtemp(prefix="llm-")
            spark.conf.set(_CONF, root)
        if spark.conf.get(_ARROW_CONF) == "10000":
            spark.conf.set(_ARROW_CONF, str(ARROW_ROWS))
        self.spark = spark
        self.root = f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"
        self._paths: dict[str, str] = {}
        self._written = 0

    def table(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write `df` once and return the written table.

        `rows` is how many rows it has at most, where that is known: a small table is written by few tasks into few
        files.  Each file costs two `chmod` processes where Hadoop has no native library.
        """
        if rows is not None:
            df = df.coalesce(max(1, math.ceil(rows / FILE_ROWS)))
        self._written += 1
        path = f"{self.root}/{name}-{self._written}"
        df.write.parquet(path)
        self._paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._paths[name])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def by_size(lengths: np.ndarray, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of neighbours whose lengths sum up to about `limit`; a longer one is alone."""
    a, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > a and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(lengths):
        yield a, len(lengths)


def small_batches(batches, column: str = "text", limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices whose texts hold about `limit` bytes; a longer text is alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for a, b in by_size(sizes, limit):
            yield batch.slice(a, b - a)


def texts_of(column) -> list[str]:
    """The texts of an Arrow column, null as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class SpanHasher:
    """64-bit hashes of many byte ranges of one buffer at once.

    A range's hash is the sum of mixed bytes times powers of an odd base modulo 2**64, taken from
    running sums and shifted back to the range's start, then mixed with the range's length.
    """

    def __init__(self):
        self._bytes = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self._up = self._down = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) >= len(self._up):
            n = max(len(data), 1 << 18)
            self._up, self._down = _powers(_BASE, n), _powers(_INVERSE, n)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self._bytes[data] * self._up[: len(data)], out=sums[1:], dtype=np.uint64)
        values = (sums[ends] - sums[starts]) * self._down[starts]
        return mix64(values + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def bloom(hashes: DataFrame, most: int = 1 << 27) -> np.ndarray:
    """A Bloom filter with two bits a key, built in Spark from a column `h` of 64-bit hashes: its 64-bit words.

    It has at most `most` bits, so it may be broadcast whatever the table's size; a full one lets all keys
    through.  It only saves work: what passes is decided exactly afterwards.  It is a plain array, because
    what is broadcast must be readable by workers that do not have this package.
    """
    bits = min(max(1 << (16 * hashes.count()).bit_length(), 1 << 12), most)
    mask = F.lit(bits - 1)
    bit = F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask)))
    found = (
        hashes.select(bit.alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
        .toArrow()
    )
    words = np.zeros(bits // 64, np.int64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return words


def maybe_in(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each hash, whether it may be one of the keys of the filter."""
    h, words = h.view(np.uint64), words.view(np.uint64)
    hit = np.ones(len(h), bool)
    for shift in (0, 32):
        at = (h >> np.uint64(shift)) & np.uint64(len(words) * 64 - 1)
        hit &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return hit
