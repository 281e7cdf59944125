"""Exact resampling: fixture sizes (FIXTURES §6), brute-force equality of
the bucketed top-n, properties, and the error cases of R3."""

import hashlib

import pytest
from pyspark.sql import functions as F

from graded.operators import sampling as R
from graded.sources.corpus import load_corpus
from tests.conftest import SF001, SF01

SIZES = {
    # sf: (N, N1, N0, R1 negatives kept, R2 total, R3 negatives, R3 positives, q, r)
    SF001: (87, 11, 76, 53, 98, 43, 44, 4, 0),
    SF01: (399, 51, 348, 244, 450, 199, 200, 3, 47),
}


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_fixture_sizes(spark, sf):
    n, n1, n0, us_neg, os_total, bl_neg, bl_pos, q, r = SIZES[sf]
    c = load_corpus(spark, sf).select("example_id", "label")
    assert c.count() == n
    u = {x.label: x["count"] for x in R.undersample(c).groupBy("label").count().collect()}
    assert u == {1: n1, 0: us_neg}
    assert R.oversample(c).count() == os_total
    b = R.balance(c)
    bc = {x.label: x["count"] for x in b.groupBy("label").count().collect()}
    assert bc == {0: bl_neg, 1: bl_pos}
    copies = b.filter("label = 1").groupBy("example_id").count()
    dist = {x["count"]: x["n"] for x in copies.groupBy("count").agg(F.count("*").alias("n")).collect()}
    assert dist.get(q + 1, 0) == r and dist.get(q, 0) == n1 - r


def _brute_top(ids, n, seed=42):
    key = sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
    return set(key[:n])


@pytest.mark.parametrize("n", [0, 1, 7, 150, 10_000])
def test_top_n_equals_brute_force(spark, n):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select(F.col("doc_id").alias("example_id"))
    ids = [r.example_id for r in docs.collect()]
    got = {r.example_id for r in R.top_n(docs, [], n, 42, bucket_hex=2).collect()}
    assert got == _brute_top(ids, n)


def test_top_n_per_group_and_partition_invariance(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select(F.col("doc_id").alias("example_id"), "lang")
    by_lang = {}
    for r in docs.collect():
        by_lang.setdefault(r.lang, []).append(r.example_id)
    expected = set().union(*[_brute_top(v, 20) for v in by_lang.values()])
    for parts in ("3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r.example_id for r in R.top_n(docs, ["lang"], 20, 42).collect()}
        assert got == expected
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_shuffle_index_is_a_permutation(spark):
    c = load_corpus(spark, SF01).select("example_id", "label")
    o = R.oversample(c)
    s = R.shuffle_index(o, 7)
    agg = s.agg(F.min("idx"), F.max("idx"), F.countDistinct("idx"), F.count("*")).first()
    assert tuple(agg) == (0, 449, 450, 450)
    pairs = s.select("example_id", "copy_no").distinct().count()
    assert pairs == 450


def test_undersample_rounding_is_python_round(spark):
    # 0.7 * 5 = 3.4999999999999996 -> Python rounds to 3
    df = spark.createDataFrame([(i, 0) for i in range(5)] + [(99, 1)], "example_id long, label int")
    assert R.undersample(df).filter("label = 0").count() == round(0.7 * 5)


def test_balanced_errors(spark):
    c = load_corpus(spark, SF01, label_col="quality").select("example_id", "label")
    with pytest.raises(Exception, match="negative target"):
        R.balance(c).count()
    no_pos = spark.createDataFrame([(i, 0) for i in range(4)], "example_id long, label int")
    with pytest.raises(Exception, match="at least one positive"):
        R.balance(no_pos).count()


def test_unknown_strategy(spark):
    df = spark.createDataFrame([(1, 1)], "example_id long, label int")
    with pytest.raises(ValueError):
        R.resample(df, "bogus")


def test_length_batches_bounded(spark):
    c = load_corpus(spark, SF01, split="train").withColumn("n_tokens", F.size(F.split("text", " ")))
    o = R.oversample(c.select("example_id", "label", "n_tokens"))
    b = R.length_batches(o, 8, 42, 5)
    sizes = [r["count"] for r in b.groupBy("batch").count().collect()]
    assert max(sizes) <= 8 and sum(sizes) == o.count()


def test_cached_samples_stay_in_many_partitions(spark):
    # the two classes' table must not deal all rows by class into two tasks
    df = spark.range(4000).selectExpr("id AS example_id", "CAST(id % 3 = 0 AS INT) AS label").repartition(8)
    for strategy in ("undersample", "balanced"):
        rows = R.resample(df, strategy, 42).persist()
        try:
            sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        finally:
            rows.unpersist()
        assert len(sizes) == 8 and max(sizes) < sum(sizes) / 4, (strategy, sizes)
