"""Intermediate tables in the shared folder the cluster names.

Iterative operators cut their lineage by writing a Parquet table and reading it
back.  Such a table survives the loss of any executor, and its size is known to
the optimizer, which then picks broadcast or shuffle joins from real numbers.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"

#: Tables written in the step that is running, if it drops them.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)

#: Rows of a narrow table that may go to every executor.
FEW_ROWS = 1 << 21


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, from the session's configuration."""
    root = spark.conf.get(_CONF, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CONF} to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="voicelode-")  # local mode only: driver and tasks share it
    spark.conf.set(_CONF, root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/voicelode/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write `df` once to the shared folder and return the table that was written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if (written := _written.get()) is not None:
        written.append(path)
    df.write.mode("overwrite").parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    if not path.startswith(f"{scratch_root(spark)}/voicelode/"):
        raise ValueError(f"not a scratch folder: {path}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


@contextmanager
def dropped_after(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized inside are deleted at the end; nothing lazy that reads them may leave."""
    outer = _written.set(written := [])
    try:
        yield
    finally:
        _written.reset(outer)
        for path in written:
            drop_path(spark, path)


def few_rows(df: DataFrame) -> DataFrame:
    """`df`, to be broadcast in a join if it has few rows, so that the other side stays in place.

    The rows are counted; a larger table is joined as it comes.
    """
    return F.broadcast(df) if df.count() <= FEW_ROWS else df
