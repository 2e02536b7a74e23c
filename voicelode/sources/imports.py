"""Import of posts from JSON array files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicelode import schemas
from voicelode.functions.text import text_or_empty, truthy
from voicelode.functions.times import parse_time


def _scan(spark: SparkSession, path: str) -> DataFrame:
    schema = schemas.IMPORT_ITEM + ", _unreadable string"
    reader = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_unreadable")
    return reader.json(path).withColumn("file", F.col("_metadata.file_path"))


def rejected_imports(spark: SparkSession, path: str) -> DataFrame:
    """(file, reason) of files that are no JSON array or cannot be read; nothing of them is imported."""
    # the first character that is not blank, from a scan by lines: no file has to fit into one value
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("place"), "value")
    mark = F.left(F.regexp_replace(F.left("value", F.lit(4096)), r"^\s+", ""), F.lit(1))
    mark = F.when(mark != "", mark).otherwise(F.left(F.regexp_replace("value", r"^\s+", ""), F.lit(1)))
    written = lines.withColumn("mark", mark).filter("mark <> ''")
    begins = written.groupBy("file").agg(F.min_by("mark", "place").alias("mark"))
    no_array = begins.filter(F.col("mark") != "[").select("file", F.lit("not a JSON array").alias("reason"))
    broken = _scan(spark, path).filter("_unreadable is not null and id is null").select("file").distinct()
    broken = broken.join(no_array, "file", "left_anti")
    return no_array.unionByName(broken.withColumn("reason", F.lit("broken JSON")))


def read_import_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of one or more JSON array files with `pos`, their place in their file; see `rejected_imports`.

    A JSON array file is one scan task by its format.  Rows of a file are numbered by the scan; the
    smallest number of the file is taken off, so the position needs no window over the file.
    """
    items = _scan(spark, path).withColumn("row_no", F.monotonically_increasing_id())
    items = items.join(rejected_imports(spark, path).select("file"), "file", "left_anti")
    starts = items.groupBy("file").agg(F.min("row_no").alias("start"))
    return (
        items.join(starts, "file")
        .withColumn("pos", F.col("row_no") - F.col("start"))
        .withColumnRenamed("row_no", "seq")
        .drop("start", "file", "_unreadable")
    )


def normalise_import(items: DataFrame, topic: str, platform: str = "x") -> DataFrame:
    """Posts of imported items, with the field fallbacks of the import format."""
    by_url = F.concat(
        F.lit(platform + "_"), F.substring(F.md5(F.col("url").cast("binary")), 1, 12)
    )
    post_id = (
        F.when(truthy(F.col("id")), F.col("id"))
        .when(truthy(F.col("url")), by_url)
        .otherwise(F.concat(F.lit("import_"), F.col("pos").cast("string")))
    )
    created = F.coalesce("created_at", "date")
    zero = F.lit(0).cast("bigint")
    return items.select(
        post_id.alias("id"),
        F.lit(platform).alias("platform"),
        text_or_empty(F.col("url")).alias("url"),
        # a missing title is the first 80 characters of the body, by the import format
        F.coalesce("title", F.substring(text_or_empty(F.col("body")), 1, 80)).alias("title"),
        text_or_empty(F.col("body")).alias("body"),
        text_or_empty(F.col("author")).alias("author"),
        text_or_empty(F.col("community")).alias("community"),
        F.coalesce("points", "likes", zero).alias("points"),
        F.coalesce("num_comments", "replies", zero).alias("num_comments"),
        text_or_empty(created).alias("created_raw"),
        parse_time(created).alias("created_at"),
        F.lit(topic).alias("topic"),
        F.array(F.lit("import")).alias("matched_queries"),
        F.lit(None).cast("string").alias("website"),
        F.col("seq").cast("bigint").alias("seq"),
    )


def read_import(spark: SparkSession, path: str, topic: str, platform: str = "x") -> DataFrame:
    return normalise_import(read_import_items(spark, path), topic, platform)
