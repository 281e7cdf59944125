"""Run names (P12/P13/P15/P16), run sources and sinks (S3-S8), the
pluggable scorer (F4, X4, R12) and the streaming confusion count."""

import pytest
import standins
from pyspark.sql import functions as F

from graded.functions import naming as NM
from graded.operators import scoring as SC
from graded.session import shared_path
from graded.sources import runs as RU
from graded.sources.versions import current
from tests.conftest import SF001


def test_run_names_round_trip(spark):
    df = spark.createDataFrame(
        [("undersample", 12, False), ("balanced", 42, True), ("normal", 45, False)], "strategy string, seed int, wl boolean"
    )
    names = [r.n for r in df.select(NM.causal_run_name("./aya_saved_models/", "strategy", "seed", "wl").alias("n")).collect()]
    assert names == [
        "./aya_saved_models//aya-expanse-8b_us_seed12",
        "./aya_saved_models//aya-expanse-8b_bl_WL_seed42",
        "./aya_saved_models//aya-expanse-8b_nm_seed45",
    ]
    enc = spark.createDataFrame([("normal", 0.73684, True)], "strategy string, f1 double, focal boolean")
    assert enc.select(NM.encoder_run_name("./results", "strategy", "f1", "focal").alias("n")).first().n == (
        "./results/google-mt5-base_clf_nm_f1_normal_0.7368_focal"
    )


@pytest.mark.parametrize(
    "path,model,abbrev,loss,seed",
    [
        ("./aya_saved_models//aya-expanse-8b_bl_seed12", "aya-expanse-8b", "bl", "ce", 12),
        ("x/aya-expanse-8b_os", "aya-expanse-8b", "os", "ce", 42),
        ("aya-expanse-8b_us_WL_seed45", "aya-expanse-8b", "us", "weighted", 45),
        ("r/google-mt5-base_clf_nm_f1_normal_0.7368_focal", "google-mt5-base", "nm", "focal", 42),
    ],
)
def test_parse_run(spark, path, model, abbrev, loss, seed):
    df = spark.createDataFrame([(path,)], "p string")
    r = df.select(*[v.alias(k) for k, v in NM.parse_run("p").items()]).first()
    assert (r.model, r.strategy_abbrev, r.loss, r.seed) == (model, abbrev, loss, seed)


def test_log_filter_and_perf_string(spark):
    df = spark.createDataFrame([("train_accuracy",), ("eval_accuracy",), ("loss",)], "k string")
    assert [r.k for r in df.filter(NM.keep_log_row("k")).collect()] == ["eval_accuracy", "loss"]
    p = spark.createDataFrame([(None, 0.5), (0.25, None)], "f1 double, acc double")
    assert [r.s for r in p.select(NM.perf_string("f1", "acc").alias("s")).collect()] == ["F1=0.0000, Acc=0.5000", None]


def test_metric_lines_round_trip(spark):
    m = spark.createDataFrame([("r1", 0.79923, 0.75614)], "run string, accuracy double, f1_macro double")
    path = RU.write_metric_lines(m, shared_path(spark, "t_lines"))
    raw = sorted(r.value for r in spark.read.text(path).collect())
    assert raw == ["accuracy: 0.7992", "f1_macro: 0.7561"]
    back = {(r.key, r.value_text) for r in RU.read_metric_lines(spark, path).collect()}
    assert back == {("accuracy", "0.7992"), ("f1_macro", "0.7561")}


def test_run_table_blank_integer_is_null(spark):
    path = shared_path(spark, "t_csv")
    rows = spark.createDataFrame([("./a_bl_seed1", None)] + [], "checkpoint_path string, max_samples int")
    for f in RU.RUN_TABLE_SCHEMA.fields[2:]:
        rows = rows.withColumn(f.name, F.lit(1).cast(f.dataType))
    RU.write_run_table(rows, path)
    header = spark.read.text(current(spark, path)).first().value
    assert header.startswith("checkpoint_path,max_samples,accuracy")
    back = RU.read_run_table(spark, path).first()
    assert back.max_samples is None and back.valid_samples == 1


def test_list_runs(spark):
    df = spark.createDataFrame([("m/a_bl_seed42",), ("m/a_bl_WL_seed42",), ("m/a_bl_seed12",), ("x/a_bl_seed42",)], "checkpoint_path string")
    assert [r.checkpoint_path for r in RU.list_runs(df, "m/").collect()] == ["m/a_bl_seed42"]


def test_scorer_matches_native_standin_and_isolates_errors(spark):
    from graded.functions.prompts import TRAIN_TEMPLATE, render_prompt
    from graded.plans import standin
    from graded.sources.corpus import load_corpus

    spark.sparkContext.addPyFile(standins.__file__)
    g = load_corpus(spark, SF001).withColumn("prompt", render_prompt(TRAIN_TEMPLATE, "text"))
    native = g.select("example_id", standin.standin_generation("prompt").alias("native"))
    scored = SC.score(g, standins.StandInGenerator(), ["example_id"])
    j = scored.join(native, "example_id")
    assert j.filter(F.col("full_text") != F.col("native")).count() == 0
    flaky = SC.score(g, standins.FlakyGenerator(), ["example_id"])
    bad = flaky.filter(F.col("error").isNotNull())
    assert bad.count() > 0 and bad.filter(F.col("full_text") != "").count() == 0
    assert flaky.count() == g.count()


def test_fixed_batches(spark):
    """Batches are carried over the edges of Arrow batches."""
    import numpy as np

    df = spark.range(0, 25_000, 1, 1).selectExpr("id", "transform(sequence(1, 4), i -> double(i + id % 3)) embedding")
    head = SC.LinearHead(np.eye(2), [0.0, 0.0], positions=2, dim=2)
    s = SC.score(df, head, ["id"], batch_rows=64)
    sizes = sorted(r["count"] for r in s.groupBy("batch_no").count().collect())
    assert sizes == [40] + [64] * 390 and s.filter("error is not null").count() == 0


def test_heads_that_differ_in_pooling_only_are_two_models(spark):
    import numpy as np

    w, b = np.eye(2), [0.0, 0.0]
    rows = spark.createDataFrame([(0, [5.0, 0.0, 0.0, 6.0])], "id int, embedding array<double>").coalesce(1)
    near = SC.LinearHead(w, b, positions=2, dim=2)
    far = SC.LinearHead(np.array([[1.0, 0, 0, 0], [0, 0, 0, 1.0]]), b, positions=1, dim=4)
    assert near.cache_key() != far.cache_key() == SC.LinearHead(far.weights, b, 1, 4).cache_key()
    assert SC.LinearHead(w, b, 1, 2).cache_key() != SC.LinearHead(w, b, 2, 2).cache_key()
    assert SC.score(rows, near, ["id"]).first().pred == SC.score(rows, far, ["id"]).first().pred == 1


def test_failing_rows_are_found_by_halving():
    import pandas as pd

    class Model:
        fallback = {"n": -7}
        calls = 0

        def predict(self, batch):
            self.calls += 1
            if (batch["x"] == 13).any():
                raise ValueError("thirteen")
            return pd.DataFrame({"n": batch["x"] * 2})

    m = Model()
    out = SC._predict_safely(m, pd.DataFrame({"x": range(64)}), ["n"])
    assert out["n"].tolist() == [-7 if x == 13 else 2 * x for x in range(64)]
    assert out["_error"].notna().sum() == 1 and m.calls <= 13


def test_row_map(spark):
    df = spark.createDataFrame([(1, "a\nb", 3), (2, None, 4)], "id long, text string, other int")
    out = SC.map_rows(df, lambda r: {"n": len(r["text"] or ""), "up": (r["text"] or "").upper()}, "n long, up string", ["id"])
    assert sorted(map(tuple, out.collect())) == [(1, 3, "A\nB"), (2, 0, "")]


def test_numbers_have_no_thousands_separators(spark):
    m = spark.createDataFrame([("r1", 1234567.5)], "run string, big double")
    path = RU.write_metric_lines(m, shared_path(spark, "t_lines"))
    assert [r.value for r in spark.read.text(path).collect()] == ["big: 1234567.5000"]
    p = spark.createDataFrame([(1234.5, 1000.0)], "f1 double, acc double")
    assert p.select(NM.perf_string("f1", "acc").alias("s")).first().s == "F1=1234.5000, Acc=1000.0000"


def test_csv_corpus_keeps_texts(spark):
    from graded.sources.corpus import read_labelled_corpus, write_labelled_corpus

    texts = ["  lead and trail  ", "tab\t", "", None, '"quoted", and \\', "a\nb", "\\", "x\\N", " ", '""', ","]
    df = spark.createDataFrame([(i, t, 1, "train") for i, t in enumerate(texts)], "example_id long, text string, label int, split string")
    path = write_labelled_corpus(df, shared_path(spark, "t_csv"), "csv")
    got = {r.example_id: r.text for r in read_labelled_corpus(spark, path, "csv").collect()}
    assert got == dict(enumerate(texts))


def test_streaming_confusion_matches_batch(spark):
    import __spark_entry__ as entry

    got = {(r.label, r.pred): r.n for r in entry.queries()["stream_a1_confusion"](spark, SF001).collect()}
    exp = {(r.label, r.pred): r.n for r in entry.queries()["a1_confusion_lenient"](spark, SF001).collect()}
    assert got == exp


def test_parquet_corpus_round_trip_prunes_splits(spark):
    from graded.sources.corpus import load_corpus, read_labelled_corpus, write_labelled_corpus

    c = load_corpus(spark, SF001)
    path = write_labelled_corpus(c, shared_path(spark, "t_corpus"))
    test = read_labelled_corpus(spark, path, split="test")
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "(split" in plan
    exp = {(r.example_id, r.label) for r in c.filter("split = 'test'").collect()}
    assert {(r.example_id, r.label) for r in test.collect()} == exp


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_one_short_batch_in_all(spark, partitions):
    """Batches follow the global index, however the rows are spread."""
    df = spark.range(0, 1000, 1, partitions).selectExpr("id", "999 - id as idx")
    fn = lambda rows: {"n": len(rows), "first": int(rows["idx"].iloc[0]), "ok": rows["idx"].is_monotonic_increasing}
    got = SC.map_batches(df, fn, "n long, first long, ok boolean", 64).collect()
    assert sorted((r["batch_no"], r["n"], r["first"]) for r in got) == [(b, 64 if b < 15 else 40, 64 * b) for b in range(16)]
    assert all(r["ok"] for r in got)
    assert SC.map_batches(df.limit(0), fn, "n long, first long, ok boolean", 64).count() == 0


def test_scored_batches_follow_an_index(spark):
    import numpy as np

    df = spark.range(0, 500, 1, 9).selectExpr("id", "id idx", "transform(sequence(1, 4), i -> double(i + id % 3)) embedding")
    head = SC.LinearHead(np.eye(2), [0.0, 0.0], positions=2, dim=2)
    s = SC.score(df, head, ["id"], batch_rows=64, index="idx")
    assert {r["batch_no"]: r["count"] for r in s.groupBy("batch_no").count().collect()} == {b: 64 if b < 7 else 52 for b in range(8)}
    assert s.where("batch_no <> id div 64").count() == 0
