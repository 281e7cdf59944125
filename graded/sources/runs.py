"""Run result sources and sinks.

Sinks write to the shared folder (``spark.checkpoint.dir``); every writer
is a plain DataFrame writer, so a lost executor only re-runs its tasks. A sink
writes a new version and makes it the current one when it is whole
(:mod:`graded.sources.versions`), so the result before stands until then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graded.functions.naming import fixed_decimals
from graded.operators.metrics import A9_FIELDS
from graded.sources.versions import current, write_version

RUN_TABLE_SCHEMA = T.StructType(
    [T.StructField("checkpoint_path", T.StringType(), True), T.StructField("max_samples", T.IntegerType(), True)]
    + [T.StructField(f, T.DoubleType(), True) for f in A9_FIELDS[:11]]
    + [T.StructField("total_samples", T.LongType(), True), T.StructField("valid_samples", T.LongType(), True)]
)


def metrics_struct(prefix: str = "") -> F.Column:
    return F.struct(*[F.col(prefix + f).alias(f) for f in A9_FIELDS])


def run_documents(metrics: DataFrame, run_col: str = "checkpoint_path", split_col: str = "split") -> DataFrame:
    """Nested result document per run: checkpoint_path, max_samples (NULL),
    validation_metrics, test_metrics (structs of the 13 A9 fields)."""
    m = metrics.select(run_col, split_col, metrics_struct().alias("m"))
    return m.groupBy(run_col).agg(
        F.max(F.when(F.col(split_col) == "validation", F.col("m"))).alias("validation_metrics"),
        F.max(F.when(F.col(split_col) == "test", F.col("m"))).alias("test_metrics"),
    ).select(
        F.col(run_col).alias("checkpoint_path"),
        F.lit(None).cast("int").alias("max_samples"),
        "validation_metrics",
        "test_metrics",
    )


def write_run_result(docs: DataFrame, path: str) -> str:
    """S3: one JSON document per run, partitioned by ``run_id`` (basename)."""
    out = docs.withColumn("run_id", F.element_at(F.split("checkpoint_path", "/"), -1))
    write_version(docs.sparkSession, path, out.write.partitionBy("run_id").json)
    return path


def read_run_result(spark: SparkSession, path: str) -> DataFrame:
    m = T.StructType([T.StructField(f, T.DoubleType() if i < 11 else T.LongType()) for i, f in enumerate(A9_FIELDS)])
    schema = T.StructType(
        [
            T.StructField("checkpoint_path", T.StringType()),
            T.StructField("max_samples", T.IntegerType()),
            T.StructField("validation_metrics", m),
            T.StructField("test_metrics", m),
            T.StructField("run_id", T.StringType()),
        ]
    )
    return spark.read.schema(schema).json(current(spark, path))


def collect_runs(docs: DataFrame, which: str = "test_metrics") -> DataFrame:
    """Documents -> the wide run table (one row per run)."""
    return docs.select("checkpoint_path", "max_samples", f"{which}.*")


def write_metric_lines(metrics: DataFrame, path: str, run_col: str = "run") -> str:
    """``key: value`` lines at 4 decimals, one text file set per run."""
    cols = [c for c in metrics.columns if c != run_col]
    long = metrics.select(
        run_col,
        F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in cols])).alias("kv"),
    )
    lines = long.select(run_col, F.concat(F.col("kv.k"), F.lit(": "), fixed_decimals("kv.v", 4)).alias("value"))
    write_version(metrics.sparkSession, path, lines.write.partitionBy(run_col).text)
    return path


def read_metric_lines(spark: SparkSession, path: str) -> DataFrame:
    """S4 source: (run, key, value) from ``key: value`` lines."""
    t = spark.read.text(current(spark, path))
    parts = F.split("value", ": ", 2)
    return t.select(
        *[c for c in t.columns if c != "value"],
        F.element_at(parts, 1).alias("key"),
        F.element_at(parts, 2).alias("value_text"),
    )


def write_run_table(runs: DataFrame, path: str) -> str:
    """Run table as CSV with a header; NULL integers are written blank."""
    write_version(runs.sparkSession, path, runs.write.option("header", True).csv)
    return path


def read_run_table(spark: SparkSession, path: str, schema: T.StructType = RUN_TABLE_SCHEMA, extra: tuple = ()) -> DataFrame:
    """Explicit schema, header row, blank integer -> NULL."""
    s = T.StructType([T.StructField(c, T.StringType(), True) for c in extra] + list(schema.fields))
    return spark.read.schema(s).option("header", True).csv(current(spark, path))


def write_predictions(pred: DataFrame, path: str, by: str = "template") -> str:
    """Per-example prediction rows, partitioned by template."""
    write_version(pred.sparkSession, path, pred.write.partitionBy(by).parquet)
    return path


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The prediction rows last written."""
    return spark.read.parquet(current(spark, path))


def list_runs(runs: DataFrame, prefix: str = "", include: str | None = "seed42", exclude: str | None = "WL", col: str = "checkpoint_path") -> DataFrame:
    """Runs whose name starts with ``prefix``, contains ``include`` and
    does not contain ``exclude``."""
    c = F.col(col)
    cond = c.startswith(prefix)
    if include:
        cond = cond & c.contains(include)
    if exclude:
        cond = cond & ~c.contains(exclude)
    return runs.filter(cond)
