"""Samples as copies, models of a sweep fitted in one pass, stored models."""

import math
import os
import random
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from graded.operators import bayes as B
from graded.operators import sampling as R
from graded.operators import stored as SM
from graded.plans import sweep as SW
from graded.session import shared_path

CELLS = [(st, sd) for st in R.STRATEGIES for sd in (12, 42, 45)]


def labelled(spark, n, share, seed=1):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        y = int(rng.random() < share)
        words = [rng.choice(pool[: 40 if y else 60]) for _ in range(rng.randrange(12))]
        rows.append((i, y, "train" if i % 3 else "test", " ".join(words) if i % 17 else None))
    return spark.createDataFrame(rows, "example_id long, label int, split string, text string")


def drawn(df):
    return Counter((r["example_id"], r["label"]) for r in df.select("example_id", "label").collect())


@pytest.mark.parametrize(("n", "share"), [(400, 0.3), (37, 0.1), (3, 0.4)])
def test_copies_are_the_rows_that_resample_gives(spark, n, share):
    df = labelled(spark, n, share).repartition(3)
    assert df.where("label = 1").count() > 0
    rows = R.cell_copies(df, CELLS).collect()
    for i, (strategy, seed) in enumerate(CELLS):
        copies = Counter({(r["example_id"], r["label"]): r["copies"][i] for r in rows if r["copies"][i]})
        assert copies == drawn(R.resample(df, strategy, seed)), (strategy, seed)


def test_samples_that_cannot_be_drawn_are_empty(spark):
    df = labelled(spark, 30, 0.0)
    got = R.cell_copies(df, [("balanced", 42), ("normal", 42), ("undersample", 1)]).collect()
    assert {r["copies"][0] for r in got} == {0} and {r["copies"][1] for r in got} == {1}
    assert sum(r["copies"][2] for r in got) == 21
    mostly = df.withColumn("label", F.when(F.col("example_id") < 25, 1).otherwise(0))
    assert {r["copies"][0] for r in R.cell_copies(mostly, [("balanced", 42)]).collect()} == {0}
    assert R.cell_copies(df.limit(0), CELLS).count() == 0
    with pytest.raises(ValueError, match="Unsupported strategy"):
        R.cell_copies(df, [("other", 1)])


def plain_margins(train, held, copies, weighted):
    """``train``: (id, label, text), ``copies``: id -> copies; ids of ``held`` -> margin."""
    bucket = lambda w: int(md5(w.encode()).hexdigest()[:4], 16)
    count = {0: Counter(), 1: Counter()}
    n = Counter()
    for i, y, text in train:
        n[y] += copies[i]
        for w in (text or "").split():
            count[y][bucket(w)] += copies[i]
    g = {y: (n[0] + n[1]) / (2 * n[y]) if weighted else 1.0 for y in (0, 1)}
    t = {y: sum(count[y].values()) * g[y] for y in (0, 1)}
    whole = lambda x: math.floor(x * 1e6 + 0.5)

    def weight(b):
        c = {y: count[y][b] * g[y] for y in (0, 1)}
        share = (c[0] + c[1]) / (t[0] + t[1])
        if not share:
            return 0
        return whole(math.log((c[1] + B.MU * share) / (t[1] + B.MU)) - math.log((c[0] + B.MU * share) / (t[0] + B.MU)))

    bias = whole(math.log(n[1] * g[1]) - math.log(n[0] * g[0]))
    return {i: bias + sum(weight(bucket(w)) for w in (text or "").split()) for i, _, text in held}


@pytest.mark.parametrize("weighted", [False, True])
def test_all_cells_equal_models_fitted_one_by_one(spark, weighted):
    df = labelled(spark, 240, 0.3, 4).repartition(4)
    train, held = df.where("split = 'train'"), df.where("split = 'test'")
    sweep = B.fit_sweep(train, CELLS, weighted)
    got = {(r["strategy"], r["seed"], r["example_id"]): r["margin"] for r in B.margins(held, sweep, ["example_id", "label"]).collect()}
    rows = [tuple(r) for r in train.select("example_id", "label", "text").collect()]
    asked = [tuple(r) for r in held.select("example_id", "label", "text").collect()]
    for strategy, seed in CELLS:
        copies = Counter(i for i, _ in drawn(R.resample(train, strategy, seed)).elements())
        for i, margin in plain_margins(rows, asked, copies, weighted).items():
            assert got[strategy, seed, i] == margin, (strategy, seed, i)


def test_a_cell_without_a_model_is_a_row(spark):
    df = labelled(spark, 60, 0.4, 6).withColumn("label", F.when(F.col("split") == "train", 0).otherwise(F.col("label")))
    models = SW.fit(df, strategies=("balanced", "normal"), seeds=(42,))
    table = {r["strategy"]: r for r in SW.run_table(df.where("split = 'test'"), models, prompts=("same",)).collect()}
    assert table["balanced"]["status"] == "failed: the sample can't be drawn"
    assert table["normal"]["status"] == "failed: one class only"
    assert all(r["f1_macro"] is None for r in table.values())


def test_the_prompt_is_read_too(spark):
    df = labelled(spark, 200, 0.4, 7)
    sweep = B.fit_sweep(df.where("split = 'train'"), [("normal", 42)])
    held = df.where("split = 'test' and text is not null")
    together = held.withColumn("text", F.concat(F.lit("w1 w45: "), "text", F.lit(" w2?")))
    a = B.margins(held, sweep, ["example_id"], {"p": "w1 w45: {text} w2?"})
    b = B.margins(together, sweep, ["example_id"])
    assert {r["example_id"]: r["margin"] for r in a.collect()} == {r["example_id"]: r["margin"] for r in b.collect()}


def test_spoken_answers(spark):
    numbers = [0, 1, -1, 499_999, 500_000, -500_000, 1_999_999, 2_000_000, -2_000_001, 4_000_000, 7_999_999, 8_000_000, -8_000_000, 10**9]
    df = spark.createDataFrame([(m,) for m in numbers], "m long").select("m", B.spoken("m").alias("s"))
    assert {r["m"]: r["s"] for r in df.collect()} == {m: B.spoken_text(m) for m in numbers}
    assert B.spoken_text(8_000_000) == "ja" and B.spoken_text(-4_500_000) == "NEE."


def test_stored_model_scores_and_fails_like_itself(spark):
    df = labelled(spark, 150, 0.4, 9)
    sweep = B.fit_sweep(df.where("split = 'train'"), [("normal", 42), ("oversample", 42)])
    folder = shared_path(spark, "stored")
    path = SM.store(sweep, 1, folder)
    assert SM.store(sweep, 1, folder) == path  # the same model is the same file
    assert [f for f in os.listdir(folder.removeprefix("file:")) if not f.startswith(".")] == [path.rsplit("/", 1)[-1]]
    model = SM.plug_in(spark, path, max_words=9)
    scored = {r["example_id"]: r for r in SM.scored(df, model, ["example_id"]).collect()}
    plain = {r["example_id"]: r["margin"] for r in B.margins(df, sweep, ["example_id"]).where("strategy = 'oversample'").collect()}
    failed = 0
    for r in df.collect():
        s, words = scored[r["example_id"]], (r["text"] or "").split()
        if r["text"] is None or len(words) > 9:
            failed += 1
            assert s["answer"] == "" and s["margin"] is None and "ValueError" in s["error"]
        else:
            assert s["error"] is None and s["margin"] == plain[r["example_id"]] and s["answer"] == B.spoken_text(s["margin"])
    assert failed > 10 and len(scored) == 150
    with pytest.raises(ValueError, match="no model"):
        SM.store(B.fit_sweep(df.where("label = 0"), [("normal", 42)]), 0, folder)
