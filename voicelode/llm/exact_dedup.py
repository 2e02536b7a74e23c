"""Exact duplicates by two Bloom passes: only possibly repeated rows shuffle.

Pass one writes one narrow row per document and builds, split over the cluster by word, a blocked
Bloom filter of the bits that two rows or more have set: a row sets two bits of one 64-bit word.
Pass two tests every narrow row.  Rows whose bits are not both repeated are alone and pass straight through;
the others are grouped by the SHA-256 of the normalised text.  The filter has sixteen bits a row
whatever the table's size, so the share of false candidates does not grow.

Only narrow rows are joined with that filter.  Where whole documents are wanted, the hashes that do repeat make a
second filter of at most `MOST_WORDS` words, which travels with the tasks whatever the table's size: documents
that fail it are passed on where they are, and only those that may be copies move.

All of it is DataFrame operations.  Rows of a hot text are first counted by (text, id, length), with
map-side combining, so no task holds a whole group.

Defined results: a null text counts as empty; empty texts are copies of each other; a null id sorts
first; a row repeated with id and text counts as often as it occurs and is kept once; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelode.llm.common import Scratch

#: Words of the filter that is broadcast, at most (16 bytes each); a full one lets more documents move, none is lost.
MOST_WORDS = 1 << 21

BLANKS = r"[\x20\x09-\x0D]"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def _word(h: Column, words: int) -> Column:
    return h.bitwiseAND(F.lit(words - 1))


def _bits(h: Column) -> Column:
    """The two bit numbers that a row sets in its word."""
    six = F.lit(63).cast("long")
    return F.array_distinct(
        F.array(F.shiftrightunsigned(h, 40).bitwiseAND(six), F.shiftrightunsigned(h, 50).bitwiseAND(six))
    )


def filter_words(rows: int) -> int:
    """Words of the filter: a power of two, with at least sixteen bits a row."""
    return 1 << max(4, math.ceil(math.log2(max(rows, 1) / 4 + 1)))


def repeated_bits(keys: DataFrame, words: int) -> DataFrame:
    """(word, seen_twice): the bits of each word that two rows or more have set."""
    return (
        keys.select(_word(F.col("h"), words).alias("word"), F.explode(_bits(F.col("h"))).alias("bit"))
        .groupBy("word", "bit")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("seen_twice"))
    )


def _mask(h: Column) -> Column:
    return F.aggregate(
        F.transform(_bits(h), lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b.cast("int"))),
        F.lit(0).cast("long"),
        lambda a, b: a.bitwiseOR(b),
    )


def mark_candidates(rows: DataFrame, repeated: DataFrame, words: int) -> DataFrame:
    """`rows` (with h) and a column `maybe_repeated`; they should be narrow, as a large filter is joined by shuffle."""
    mask = _mask(F.col("h"))
    joined = rows.withColumn("word", _word(F.col("h"), words)).join(repeated, "word", "left")
    hit = F.coalesce(F.col("seen_twice").bitwiseAND(mask) == mask, F.lit(False))
    return joined.withColumn("maybe_repeated", hit).drop("word", "seen_twice")


def repeated_filter(hashes: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """A filter (word, seen_twice) of the values of h that stand in two rows or more, and its number of words."""
    words = filter_words(hashes.count())
    marked = mark_candidates(hashes, scratch.table(repeated_bits(hashes, words), "bits"), words)
    again = marked.filter("maybe_repeated").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    return key_filter(scratch.table(again, "again"), scratch)


def key_filter(hashes: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """A filter (word, seen_twice) of the values of h, and its number of words; small enough to be broadcast."""
    words = min(filter_words(hashes.count()), MOST_WORDS)
    bits = hashes.groupBy(_word(F.col("h"), words).alias("word")).agg(F.bit_or(_mask(F.col("h"))).alias("seen_twice"))
    return scratch.table(bits, "filter"), words


def mark_known(rows: DataFrame, hashes: DataFrame, scratch: Scratch) -> DataFrame:
    """`rows` (with h) and a column `maybe_known`: true where h is one of `hashes`, and rarely elsewhere.

    Whole documents are marked where they are, however many hashes there are; the caller moves the marked ones.
    """
    bits, words = key_filter(hashes, scratch)
    return mark_candidates(rows, F.broadcast(bits), words).withColumnRenamed("maybe_repeated", "maybe_known")


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points, then the smallest id, stays.
    """
    scratch = Scratch(docs.sparkSession)
    text = normalised(F.col(text_col))
    keys = scratch.table(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"),
            text.alias("t"),
        ).select("doc_id", "n", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"), F.xxhash64("t").alias("h")),
        "keys",
    )
    words = filter_words(keys.count())
    marked = mark_candidates(keys, scratch.table(repeated_bits(keys, words), "bits"), words)

    alone = marked.filter(~F.col("maybe_repeated")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    counted = (
        marked.filter("maybe_repeated").groupBy("text_sha256", "doc_id", "n").agg(F.count(F.lit(1)).alias("times"))
    )
    counted = scratch.table(counted, "counted")
    best = counted.groupBy("text_sha256").agg(
        F.min(F.struct((-F.col("n")).alias("less"), F.col("doc_id").alias("id"))).alias("best"),
        F.sum("times").alias("group_size"),
    )
    best = scratch.table(best, "best")  # joined as a table, so that a hot text's rows can be split
    winner = F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("n") == -F.col("best.less"))
    grouped = (
        counted.join(best, "text_sha256")
        .select(
            "doc_id",
            F.col("best.id").alias("keep_id"),
            "group_size",
            winner.alias("winner"),
            "text_sha256",
            F.posexplode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("again", "_"),
        )
        .select(
            "doc_id", "keep_id", "group_size", (F.col("winner") & (F.col("again") == 0)).alias("kept"), "text_sha256"
        )
    )
    return alone.unionByName(grouped)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without exact copies, all columns as they were.

    Rows that are certainly alone are passed on where they are; of the others the winner of each
    text is fetched once, whatever the group's size, and the rest do not move.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(id_col).alias("id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"),
        normalised(F.col(text_col)).alias("t"),
    ).withColumn("h", F.xxhash64("t"))
    bits, words = repeated_filter(scratch.table(rows.select("h"), "hashes"), scratch)
    marked = mark_candidates(rows, F.broadcast(bits), words)
    alone = marked.filter(~F.col("maybe_repeated")).select("row.*")

    order = F.struct((-F.col("n")).alias("less"), F.col("id"))
    candidates = marked.filter("maybe_repeated").withColumn("sha", F.sha2(F.col("t").cast("binary"), 256))
    best = candidates.groupBy("sha").agg(F.min(order).alias("best"))
    best = scratch.table(best, "best")
    # of the candidates only those move that may stay: their text, length and id are those of a winner
    places = best.select(F.xxhash64("sha", -F.col("best.less"), F.col("best.id")).alias("h"))
    placed = candidates.drop("h", "t").withColumn("h", F.xxhash64("sha", "n", "id"))
    keepers = mark_known(placed, places, scratch).filter("maybe_known").join(best, "sha").filter(
        (F.col("n") == -F.col("best.less")) & F.col("id").eqNullSafe(F.col("best.id"))
    )
    return alone.unionByName(keepers.dropDuplicates(["sha"]).select("row.*"))
