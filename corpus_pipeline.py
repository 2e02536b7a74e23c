"""A training-data pipeline over `documents`: each stage works on all that the one before has written.

Texts of no recognisable language go, then exact copies, then all but one of each group of near copies;
personal data and the words that reveal it are taken out of what is left, and that is packed into
sequences.  All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voicelode.llm import exact_dedup, jaccard_join, langid, mixture_pack, pii
from voicelode.llm.common import Scratch, table_path


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, or too unlike any learned language, go."""
    return langid.keep_identified(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts one document stays."""
    return jaccard_join.drop_near_copies(docs)


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, and words that reveal it go; no document goes."""
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens, mixed by source."""
    return mixture_pack.pack(docs)


STAGES = [
    ("language", recognised),
    ("exact_dedup", without_copies),
    ("near_copies", without_near_copies),
    ("personal_data", sanitised),
    ("packing", packed),
]

#: Classifier, similarity index and tokenizer cannot be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written and read again but the last."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
