"""V13 chat rendering, W1 early stop vs brute force, V2-V5 arrays, losses."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graded.functions import arrays as V
from graded.operators import chat as CH
from graded.operators import windows as WN
from tests.conftest import SF001


def test_chat_render_valid_and_invalid(spark):
    rows = [
        (1, 0, "system", " sys "),
        (1, 1, "user", " hoi "),
        (1, 2, "assistant", "dag\n"),
        (2, 0, "user", "a"),
        (2, 1, "user", "b"),
        (3, 0, "assistant", "x"),
        (4, 0, "user", "q"),
        (4, 1, "system", "late system"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in CH.render_chat(df, add_generation_prompt=True).collect()}
    assert got[1].rendered == (
        "<BOS_TOKEN><|START_OF_TURN_TOKEN|><|SYSTEM_TOKEN|> sys <|END_OF_TURN_TOKEN|>"
        "<|START_OF_TURN_TOKEN|><|USER_TOKEN|>hoi<|END_OF_TURN_TOKEN|>"
        "<|START_OF_TURN_TOKEN|><|CHATBOT_TOKEN|>dag<|END_OF_TURN_TOKEN|>"
        "<|START_OF_TURN_TOKEN|><|CHATBOT_TOKEN|>"
    )
    assert got[2].rendered is None and got[2].error == CH.ALTERNATION_ERROR
    assert got[3].rendered is None
    # a non-user role at an odd position passes the check and renders nothing
    assert got[4].rendered.endswith("<|USER_TOKEN|>q<|END_OF_TURN_TOKEN|><|START_OF_TURN_TOKEN|><|CHATBOT_TOKEN|>")


def _brute_early_stop(rows, patience):
    out = {}
    by_run = {}
    for run, ts, eid, m in rows:
        by_run.setdefault(run, []).append((ts, eid, m))
    for run, evs in by_run.items():
        evs.sort()
        best, best_epoch, wait, stop = None, None, 0, None
        for i, (_, _, m) in enumerate(evs, start=1):
            if best is None or m > best:
                best, best_epoch, wait = m, i, 0
            else:
                wait += 1
                if wait >= patience:
                    stop = i
                    break
        out[run] = (len(evs), stop, best_epoch, best)
    return out


def test_early_stop_matches_brute_force(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    log = WN.epoch_log(ev)
    rows = [(r.run, r.ts, r.event_id, r.metric) for r in log.collect()]
    exp = _brute_early_stop(rows, 2)
    got = {r.run: (r.n_epochs, r.stop_epoch, r.best_epoch, r.best_metric) for r in WN.early_stop(log, 2).collect()}
    assert got == exp


def test_early_stop_hot_run_and_equal_timestamps(spark):
    """One run with most rows, many of them at one timestamp, is cut into many
    chunks and still agrees with the brute force."""
    import datetime as dt
    import random

    rnd = random.Random(3)
    base = dt.datetime(2024, 1, 1, 10, 0, 0)
    rows = [(1, base + dt.timedelta(seconds=rnd.randint(0, 3)), i, float(rnd.randint(0, 50))) for i in range(3000)]
    rows += [(2, base + dt.timedelta(hours=h), 10_000 + h, float(h % 7)) for h in range(40)]
    rows += [(3, base, 20_000 + i, float(i)) for i in range(500)]  # improves all the time
    rows += [(4, base, 30_000, 1.0)]
    log = spark.createDataFrame(rows, "run long, ts timestamp_ntz, event_id long, metric double")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in (1, 8, 64):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            for patience in (1, 3, 10):
                found = WN.early_stop(log, patience).collect()
                got = {r.run: (r.n_epochs, r.stop_epoch, r.best_epoch, r.best_metric) for r in found}
                assert got == _brute_early_stop(rows, patience)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_vocabulary_with_few_hot_words(spark):
    """Ids by frequency, and encoding with hot words looked up by broadcast
    and all others by a shuffle of the tokens they leave open."""
    from collections import Counter

    from graded.operators import encode as E

    texts = [(1, "de de de kat zit op de mat"), (2, "kat kat mat é x" + "y" * 200), (3, ""), (4, None), (5, "nieuw")]
    df = spark.createDataFrame(texts, "example_id long, text string")
    known = df.filter("example_id <> 5")
    vocab = E.build_vocabulary(known)
    counts = Counter(w for _, t in texts[:3] for w in t.split())
    order = sorted(counts, key=lambda w: (-counts[w], w))
    ids = {w: i + E.FIRST_WORD_ID for i, w in enumerate(order)}
    assert {r.word: r.id for r in vocab.collect()} == ids
    want = {i: [ids.get(w, E.UNK_ID) for w in (t or "").split()] for i, t in texts}
    for hot in (0, 1, 3, 10_000):
        got = {r.example_id: list(r.input_ids) for r in E.encode(df, vocab, hot_words=hot).collect()}
        assert got == want
    plan = E.build_vocabulary(known)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
    # the shuffle on words sits above the filter that keeps open tokens only
    shuffled = E._lookup(df.selectExpr("example_id", "explode(split(text, ' ')) word"), vocab, 1)
    assert "isnull(id" in shuffled._jdf.queryExecution().optimizedPlan().toString()


def test_causal_example_cap(spark):
    df = spark.createDataFrame([([5, 6, 7], [9]), ([5, 6, 7, 8], [9])], "p array<int>, t array<int>")
    ids, mask, labels = V.causal_example("p", "t", 4)
    rows = df.select(ids.alias("i"), mask.alias("m"), labels.alias("l")).collect()
    assert [list(r) for r in rows[0]] == [[5, 6, 7, 9], [1, 1, 1, 1], [-100, -100, -100, 9]]
    assert [list(r) for r in rows[1]] == [[5, 6, 7, 8], [1, 1, 1, 1], [-100, -100, -100, -100]]


def test_pad_mask_unmask(spark):
    df = spark.createDataFrame([([4, 5],), ([4, 5, 6, 7],)], "a array<int>")
    ids, m = V.pad_to("a", 3, 0)
    rows = df.select(ids.alias("i"), m.alias("m")).collect()
    assert [list(r.i) for r in rows] == [[4, 5, 0], [4, 5, 6]]
    assert [list(r.m) for r in rows] == [[1, 1, 0], [1, 1, 1]]
    back = df.select(V.unmask_labels(V.mask_labels(ids, 0), 0).alias("b")).collect()
    assert [list(r.b) for r in back] == [[4, 5, 0], [4, 5, 6]]


def test_losses_match_numpy(spark):
    logits = [[0.3, -1.2], [2.0, 0.5], [-0.1, -0.1]]
    labels = [1, 0, 1]
    df = spark.createDataFrame(list(zip(logits, labels)), "lg array<double>, y int")
    ce = [r.ce for r in df.select(V.cross_entropy("lg", "y").alias("ce")).collect()]
    for c, lg, y in zip(ce, logits, labels):
        exp = math.log(sum(math.exp(v) for v in lg)) - lg[y]
        assert c == pytest.approx(exp, rel=1e-12)
    fl = df.select(V.focal(V.cross_entropy("lg", "y"), F.lit(0.5), 2.0).alias("f")).collect()
    for f, c in zip(fl, ce):
        assert f.f == pytest.approx(0.5 * (1 - math.exp(-c)) ** 2 * c, rel=1e-12)


def test_mean_pool_and_head_match_numpy(spark):
    from graded.plans.catalog import HEAD_B, HEAD_W

    e = spark.read.parquet(f"{SF001}/embeddings.parquet").limit(20)
    rows = e.select("embedding", V.mean_pool("embedding", 8, 8).alias("p")).collect()
    for r in rows:
        x = np.asarray(r.embedding, dtype=np.float64).reshape(8, 8).mean(axis=0)
        assert np.allclose(x, r.p, rtol=0, atol=1e-12)
    lg = e.select(V.linear_head(V.mean_pool("embedding", 8, 8), HEAD_W, HEAD_B).alias("l"), "embedding").collect()
    for r in lg:
        x = np.asarray(r.embedding, dtype=np.float64).reshape(8, 8).mean(axis=0)
        assert np.allclose(np.asarray(HEAD_W) @ x + np.asarray(HEAD_B), r.l, atol=1e-12)
