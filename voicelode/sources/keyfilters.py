"""Which loads of a stored table may hold given ids: a Bloom filter and the range of ids of each load.

A filter has 64-bit words, `BITS` bits for each id of its load.  An id sets a few bits of one word, so a look-up
is one equality join of the ids at hand with the stored words.  The filters of all loads that lack one are built by
one job, into a folder that counts only when that job has ended.  They only save reading: a load without a filter
is read, and a filter that lets too much through costs a folder more.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a filter for each id, and the bits that an id sets in its word.
BITS = 32
SET = 6
#: Words of the largest filter.
MOST_WORDS = 1 << 28
_SCHEMA = "word bigint, bits bigint, words bigint, low string, high string, load_id string"


def _word(h: Column, words: Column) -> Column:
    return h.bitwiseAND(words - 1)


def _mask(h: Column) -> Column:
    """The bits of an id in its word, from parts of the hash that do not choose the word."""
    mask = F.lit(0).cast("long")
    for k in range(SET):
        place = F.shiftrightunsigned(h, 28 + 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return mask


class KeyFilters:
    """The filters of one table's loads, in the folder `root`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _folders(self, path: str) -> list[str]:
        """Names of the folders in a folder; none if it is not there."""
        at = self._path(path)
        system = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(at):
            return []
        return [s.getPath().getName() for s in system.listStatus(at) if s.isDirectory()]

    def _builds(self) -> list[str]:
        system = self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        builds = [f"{self.root}/{b}" for b in self._folders(self.root)]
        return [b for b in builds if system.exists(self._path(f"{b}/_SUCCESS"))]

    def known(self) -> dict[str, str]:
        """The loads that have a filter, and its folder."""
        return {f.removeprefix("load_id="): f"{b}/{f}" for b in self._builds() for f in self._folders(b)}

    def build(self, rows: DataFrame, loads: list[str]) -> None:
        """Write the filters of `loads`, whose (load_id, id) are `rows`; a load without rows gets an empty one."""
        sizes = rows.groupBy("load_id").agg(F.count("id").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
        words = F.lit(2).cast("double") ** F.ceil(F.log2(F.greatest(F.col("n") * BITS / 64, F.lit(1.0))))
        sizes = sizes.withColumn("words", F.least(words, F.lit(float(MOST_WORDS))).cast("long")).drop("n")
        h = F.xxhash64("id")
        filled = (
            rows.filter("id is not null")
            .join(sizes, "load_id")
            .groupBy("load_id", _word(h, F.col("words")).alias("word"), "words", "low", "high")
            .agg(F.bit_or(_mask(h)).alias("bits"))
        )
        heads = self.spark.createDataFrame([(load,) for load in loads], "load_id string")
        columns = ["word", "bits", "words", "low", "high", "load_id"]
        filled.select(*columns).unionByName(heads, allowMissingColumns=True).write.partitionBy("load_id").parquet(
            f"{self.root}/build-{uuid.uuid4().hex}"
        )

    def may_hold(self, ids: DataFrame, known: dict[str, str]) -> set[str]:
        """The loads among `known` that may hold one of the ids; null ids are looked for nowhere."""
        low, high = ids.agg(F.min("id"), F.max("id")).first()
        if low is None or not known:
            return set()
        parts = []
        for build in sorted({path.rsplit("/", 1)[0] for path in known.values()}):
            own = [path for path in known.values() if path.startswith(f"{build}/")]
            parts.append(self.spark.read.schema(_SCHEMA).option("basePath", build).parquet(*own))
        while len(parts) > 1:  # a flat tree of unions
            parts = [a.unionByName(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) - len(parts) % 2 :]
        filters = parts[0].filter((F.col("low") <= high) & (F.col("high") >= low))
        sizes = [r[0] for r in filters.select("words").distinct().collect()]  # powers of two: a few
        if not sizes:
            return set()
        probes = ids.filter("id is not null").select(F.xxhash64("id").alias("h")).distinct()
        probes = probes.select("h", F.explode(F.array(*(F.lit(s).cast("long") for s in sizes))).alias("words"))
        probes = probes.select("words", _word(F.col("h"), F.col("words")).alias("word"), _mask(F.col("h")).alias("mask"))
        hit = filters.join(probes, ["words", "word"]).filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
        return {r[0] for r in hit.select("load_id").distinct().collect()}


def false_share(keys_a_word: float = 64 / BITS) -> float:
    """The share of foreign ids that a filter lets through, for ids spread evenly over its words."""
    share, chance = 0.0, math.exp(-keys_a_word)
    for n in range(64):
        share += chance * (1 - (63 / 64) ** (SET * n)) ** SET
        chance *= keys_a_word / (n + 1)
    return share
