"""CSV files whose texts hold line breaks, read by many tasks per file.

A quoted text may hold line breaks, so the line that a task's part of a file
begins with may lie inside a record. What tells it is the number of quotes
before it (a quote within a text is doubled): odd inside, even outside. So the
quotes of every part are counted first, and the counts are added up over a
file's parts: one row per part. With that, every line knows whether it ends its
record. Lines are grouped to records inside their part, in one exchange; only
records at the edges of parts (at most two pieces of each part) meet again
across parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graded.session import materialize

PART = ["_file", "_block"]


def _lines(spark: SparkSession, path: str, only: Column | None = None) -> DataFrame:
    """Lines with their file, the part of it that a task reads (by its first
    byte), and an order within the part. Which folders are read decides how
    files are cut, so they are chosen here, for all uses alike."""
    text = spark.read.option("lineSep", "\n").text(path)
    text = text if only is None else text.where(only)
    folders = [c for c in text.columns if c != "value"]
    return text.select(
        *folders,
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("_quotes"),
    )


def csv_records(spark: SparkSession, path: str, only: Column | None = None) -> DataFrame:
    """One row per record: folder columns, ``_file``, ``_first`` (whether it is
    its file's first record), ``record`` (its text, line breaks included).
    ``only`` is a condition on folder columns: other folders aren't read."""
    lines = _lines(spark, path, only)
    folders = [c for c in lines.columns if c not in ("value", *PART, "_at", "_quotes")]
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    parts = lines.groupBy(*PART).agg(F.sum("_quotes").alias("_q"))  # a row per part
    parts = parts.select(*PART, (F.coalesce(F.sum("_q").over(before), F.lit(0)) % 2).alias("_inside"))
    order = Window.partitionBy(*PART).orderBy("_at")
    upto, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    ends = (F.col("_inside") + F.sum("_quotes").over(upto)) % 2 == 0
    # (both sides cut files alike; a line whose part isn't there would be lost)
    known = F.coalesce("_inside", F.raise_error(F.lit("a file was cut in two ways")).cast("long"))
    placed = lines.join(parts, PART, "left").withColumn("_inside", known).withColumn("_ends", ends.cast("int"))
    placed = placed.withColumn("_rec", F.coalesce(F.sum("_ends").over(ahead), F.lit(0)))
    texts = F.array_sort(F.collect_list(F.struct("_at", "value")))
    # a written table, since whole records and pieces are both read from it
    groups = materialize(
        placed.groupBy(*folders, *PART, "_rec", "_inside").agg(F.max("_ends").alias("_whole"), texts.alias("_l")).select(
            *folders,
            *PART,
            "_rec",
            ((F.col("_rec") > 0) | (F.col("_inside") == 0)).alias("_opens"),
            (F.col("_whole") == 1).alias("_closes"),
            F.array_join(F.col("_l.value"), "\n").alias("record"),
        ),
        "csv_records",
    )
    first = (F.col("_block") == 0) & (F.col("_rec") == 0)
    whole = groups.where("_opens and _closes").select(*folders, "_file", first.alias("_first"), "record")
    # pieces of a record stand one behind the other, a first one opens it
    along = Window.partitionBy("_file").orderBy("_block", "_rec")
    pieces = groups.where("not (_opens and _closes)").withColumn("_no", F.sum(F.col("_opens").cast("int")).over(along))
    listed = F.array_sort(F.collect_list(F.struct("_block", "_rec", "record")))
    stitched = pieces.groupBy(*folders, "_file", "_no").agg(listed.alias("_p"), F.max(first.cast("int")).alias("_f"))
    stitched = stitched.select(*folders, "_file", (F.col("_f") == 1).alias("_first"), F.array_join(F.col("_p.record"), "\n").alias("record"))
    return whole.unionByName(stitched)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, header: bool = True, only: Column | None = None, **options: str
) -> DataFrame:
    """Rows of CSV files with the columns of ``schema`` and the folders' columns
    (of the folders that ``only`` leaves)."""
    records = csv_records(spark, path, only)
    folders = [c for c in records.columns if c not in ("_file", "_first", "record")]
    kept = records.where(~F.col("_first")) if header else records
    own = T.StructType([f for f in schema.fields if f.name not in folders])
    row = F.from_csv("record", own.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options)
    return kept.select(row.alias("_row"), *folders).select("_row.*", *folders)
