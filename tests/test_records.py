"""CSV files that many tasks read, and sinks that keep the old result."""

import random

import pytest
from pyspark.sql import functions as F

from graded.session import shared_path
from graded.sources import corpus as C
from graded.sources import records as RC
from graded.sources import runs as RU
from graded.sources import versions as V


def odd_rows(n=400, seed=2):
    rng = random.Random(seed)
    parts = ["a", '"', '""', "\n", "\n\n", "\r", "\r\n", ",", "\\", "\\N", " ", "é", "🙂", "'", "text, more", '"\n"', "x" * 50]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(12))), rng.randrange(2)) for i in range(n)]
    return [*rows, (n, "", 0), (n + 1, None, 1), (n + 2, "\n" * 300, 0), (n + 3, 'y"\n' * 400, 1), (n + 4, "\\N", 0)]


@pytest.fixture
def small_parts(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_one_csv_file_is_read_by_many_tasks(spark, small_parts):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "train" if r[0] % 4 else "test") for r in rows], "example_id long, text string, label int, split string")
    path = C.write_labelled_corpus(df.coalesce(1), shared_path(spark, "csv_parts"), "csv")
    assert RC._lines(spark, V.current(spark, path)).rdd.getNumPartitions() > 10
    back = C.read_labelled_corpus(spark, path, "csv")
    got = {(r["example_id"], r["text"], r["label"], r["split"]) for r in back.collect()}
    # ("\N" is how a missing text is stored, so a text of just that comes back missing)
    want = {(i, None if t == "\\N" else t, y, "train" if i % 4 else "test") for i, t, y in rows}
    assert got == want
    assert back.count() == len(rows)
    test = C.read_labelled_corpus(spark, path, "csv", split="test")
    assert {r["example_id"] for r in test.collect()} == {i for i, _, _ in rows if i % 4 == 0}


def test_an_empty_csv_corpus(spark):
    df = spark.createDataFrame([], "example_id long, text string, label int, split string")
    one = df.union(spark.createDataFrame([(1, "x", 0, "train")], df.schema))
    path = C.write_labelled_corpus(one, shared_path(spark, "csv_one"), "csv")
    assert [tuple(r) for r in C.read_labelled_corpus(spark, path, "csv").collect()] == [(1, "x", 0, "train")]
    assert C.read_labelled_corpus(spark, path, "csv", split="test").count() == 0


def predictions(spark, n):
    return spark.range(n).selectExpr("id example_id", "'t' template", "cast(id % 2 as int) pred_label")


def test_a_writer_that_ends_midway_leaves_the_old_result(spark):
    path = shared_path(spark, "versions")
    RU.write_predictions(predictions(spark, 5), path)
    broken = predictions(spark, 50).withColumn("pred_label", F.when(F.col("example_id") == 40, F.raise_error(F.lit("lost"))).otherwise(1))
    with pytest.raises(Exception, match="lost"):
        RU.write_predictions(broken, path)
    assert RU.read_predictions(spark, path).count() == 5
    RU.write_predictions(predictions(spark, 7), path)
    assert RU.read_predictions(spark, path).count() == 7


def test_versions_read_before_are_kept_a_while(spark):
    path = shared_path(spark, "versions")
    RU.write_predictions(predictions(spark, 1), path)
    early = RU.read_predictions(spark, path)
    RU.write_predictions(predictions(spark, 2), path)
    assert early.count() == 1  # its version still stands
    for n in (3, 4, 5):
        RU.write_predictions(predictions(spark, n), path)
    names = V.Files(spark, path).names(path)
    assert sum(n.startswith("v-") for n in names) == sum(n.startswith(V.MANIFEST) for n in names) == V.KEPT
    assert RU.read_predictions(spark, path).count() == 5


def test_two_writers_at_once_both_stand(spark):
    path = shared_path(spark, "versions")

    def meanwhile(folder):
        predictions(spark, 3).write.parquet(folder)
        RU.write_predictions(predictions(spark, 9), path)

    V.write_version(spark, path, meanwhile)
    assert RU.read_predictions(spark, path).count() == 3  # published last
