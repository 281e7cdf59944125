"""Streaming confusion counts (A1 over a stream of answers).

The parsers are stateless column expressions, so they run unchanged on a
streaming DataFrame; the grouped count keeps one state row per
(run, label, prediction). Each micro-batch writes the complete counts as a new
version of the sink, which is read once it is whole; a batch that runs again
after a loss writes the same counts again. The checkpoint folder makes the query
restartable after executor or driver loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from graded.functions.parsing import PARSERS
from graded.sources.versions import current, write_version

ANSWER_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("example_id", T.LongType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("answer", T.StringType()),
    ]
)


def confusion_stream(spark: SparkSession, source: str, parser: str = "lenient", schema: T.StructType = ANSWER_SCHEMA) -> DataFrame:
    src = spark.readStream.schema(schema).parquet(source)
    parsed = src.select("run_id", "label", PARSERS[parser]("answer").alias("pred"))
    return parsed.groupBy("run_id", "label", "pred").count().withColumnRenamed("count", "n")


def run_to_table(counts: DataFrame, sink: str, checkpoint: str) -> None:
    """Drive the stream over everything available now, then stop."""

    def write(batch: DataFrame, epoch_id: int) -> None:
        write_version(batch.sparkSession, sink, batch.write.parquet)

    q = (
        counts.writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def read_table(spark: SparkSession, sink: str) -> DataFrame:
    """The counts of the last whole micro-batch."""
    return spark.read.parquet(current(spark, sink))
