"""Window operators: W1 early stopping over an epoch log, V6 batch collate.

W1 is a per-run prefix scan. A run can be very long (assume one run holds a
third of all rows), so rows are range-partitioned by (run, ts, event_id): a
chunk is what one partition holds of one run, however long the run is, and
rows with one timestamp can be in different chunks. Row-level windows span one
chunk. Across chunks only two numbers per chunk are scanned (rows and best
metric). Everything else follows from the rows that improved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graded.functions.arrays import IGNORE_INDEX, pad_to_col
from graded.session import materialize


def epoch_log(events: DataFrame) -> DataFrame:
    """Epoch log stand-in from ``events``: run = user_id, metric = value,
    epochs ordered by (ts, event_id)."""
    return events.select(
        F.col("user_id").alias("run"), "ts", "event_id", F.col("value").alias("metric")
    )


def early_stop(log: DataFrame, patience: int = 2) -> DataFrame:
    """Per run, epochs numbered by (ts, event_id); an evaluation improves
    when its metric beats every earlier one (the first always does); stop at
    the first epoch with ``patience`` non-improving evaluations in a row;
    the chosen epoch is the last improvement up to the stop (earliest of
    equal maxima). Output: run, n_epochs, stop_epoch (NULL if never),
    best_epoch, best_metric.

    With improvements at epochs e1 < e2 < ..., the run stops ``patience``
    epochs after the first of them that the next one (or the end) leaves that
    long alone, and that improvement is the best epoch."""
    spark = log.sparkSession
    order = ["run", "ts", "event_id"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written once, so that a row's chunk is the same wherever it is used
    d = materialize(
        log.select(*order, "metric")
        .repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_chunk", F.spark_partition_id()),
        "epoch_chunks",
    )
    in_chunk = Window.partitionBy("run", "_chunk").orderBy("ts", "event_id")
    before = in_chunk.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_rn", F.row_number().over(in_chunk)).withColumn("_prev", F.max("metric").over(before))
    # only rows that beat what came before them in their chunk can improve
    able = d.filter(F.col("_prev").isNull() | (F.col("metric") > F.col("_prev")))

    chunks = d.groupBy("run", "_chunk").agg(F.count(F.lit(1)).alias("_rows"), F.max("metric").alias("_best"))
    earlier = Window.partitionBy("run").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(
        "run",
        "_chunk",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_off"),
        F.max("_best").over(earlier).alias("_best_before"),
        F.sum("_rows").over(Window.partitionBy("run")).alias("n_epochs"),
    )
    best = F.greatest("_best_before", "_prev")  # NULLs ignored
    hits = (
        able.join(chunks, ["run", "_chunk"])
        .filter(best.isNull() | (F.col("metric") > best))
        .select("run", "_chunk", "n_epochs", (F.col("_off") + F.col("_rn")).alias("epoch"), "metric")
    )
    # the next improvement: in the same chunk, else the first of a later one
    firsts = hits.groupBy("run", "_chunk").agg(F.min("epoch").alias("_first"))
    later = Window.partitionBy("run").orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
    firsts = firsts.select("run", "_chunk", F.min("_first").over(later).alias("_later"))
    by_epoch = Window.partitionBy("run", "_chunk").orderBy("epoch")
    after = F.coalesce(F.lead("epoch").over(by_epoch), F.col("_later"), F.col("n_epochs") + 1)
    alone = (
        hits.join(firsts, ["run", "_chunk"])
        .withColumn("_alone", after > F.col("epoch") + patience)
        .groupBy("run")
        .agg(
            F.max("n_epochs").alias("n_epochs"),
            F.min(F.when(F.col("_alone"), F.struct("epoch", "metric"))).alias("_stop"),
            F.max(F.struct("epoch", "metric")).alias("_last"),
        )
    )
    chosen = F.coalesce("_stop", "_last")
    return alone.select(
        "run",
        F.col("n_epochs").cast("long").alias("n_epochs"),
        (F.col("_stop.epoch") + patience).cast("long").alias("stop_epoch"),
        chosen["epoch"].cast("long").alias("best_epoch"),
        chosen["metric"].alias("best_metric"),
    )


def collate(df: DataFrame, batch_col: str, cols: dict[str, int]) -> DataFrame:
    """V6: pad each array column to the longest row of its batch (labels
    padded with -100, others with the given pad value). Each window
    partition is one batch."""
    w = Window.partitionBy(batch_col)
    out = df
    for c, pad in cols.items():
        longest = F.max(F.size(c)).over(w)
        out = out.withColumn(c, pad_to_col(c, longest, IGNORE_INDEX if c == "labels" else pad))
    return out
