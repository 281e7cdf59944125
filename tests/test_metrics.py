"""Golden confusion counts recovered from the published tables (FIXTURES §4)
fed to A9 must give the published values; edge cases of FIXTURES §7."""

import math

import pytest
from pyspark.sql import functions as F

from graded.operators import metrics as A

# Fixed values: (run, tp, fp, fn, tn, invalid) and the published
# accuracy, f1_macro, precision_macro, recall_macro, f1_0, f1_1, invalid %
# (4 decimals; the encoder rows are truncated, the others rounded).
GOLDEN = [
    ("bl_seed12", 29, 23, 183, 546, 1, (0.7362, 0.5305, 0.6533, 0.5482, 0.8413, 0.2197, 0.13)),
    ("bl_seed42", 80, 56, 130, 513, 3, (0.7612, 0.6545, 0.6930, 0.6413, 0.8465, 0.4624, 0.38)),
    ("bl_seed45", 139, 207, 72, 363, 1, (0.6428, 0.6107, 0.6181, 0.6478, 0.7224, 0.4991, 0.13)),
    ("nm_seed12", 145, 131, 66, 437, 3, (0.7471, 0.7058, 0.6971, 0.7283, 0.8161, 0.5955, 0.38)),
    ("nm_seed42", 172, 239, 40, 331, 0, (0.6432, 0.6278, 0.6553, 0.6960, 0.7035, 0.5522, 0.00)),
    ("nm_seed45", 162, 159, 48, 410, 3, (0.7343, 0.7043, 0.6999, 0.7460, 0.7984, 0.6102, 0.38)),
    ("os_seed12", 10, 5, 202, 565, 0, (0.7353, 0.4666, 0.7017, 0.5192, 0.8452, 0.0881, 0.00)),
    ("os_seed42", 40, 16, 169, 554, 3, (0.7625, 0.5794, 0.7403, 0.5817, 0.8569, 0.3019, 0.38)),
    ("os_seed45", 78, 57, 130, 509, 8, (0.7584, 0.6498, 0.6872, 0.6371, 0.8448, 0.4548, 1.02)),
    ("us_seed12", 84, 52, 126, 518, 2, (0.7718, 0.6695, 0.7110, 0.6544, 0.8534, 0.4855, 0.26)),
    ("us_seed42", 41, 19, 171, 551, 0, (0.7570, 0.5772, 0.7232, 0.5800, 0.8529, 0.3015, 0.00)),
    ("us_seed45", 175, 253, 33, 315, 6, (0.6314, 0.6190, 0.6570, 0.6980, 0.6878, 0.5503, 0.77)),
    ("3s_bl_seed12", 45, 39, 97, 358, 243, (0.7477, 0.6193, 0.6613, 0.6093, 0.8404, 0.3982, 31.07)),
    ("3s_bl", 52, 26, 70, 301, 333, (0.7862, 0.6912, 0.7390, 0.6734, 0.8625, 0.5200, 42.58)),
    ("3s_bl_seed45", 114, 214, 18, 179, 257, (0.5581, 0.5512, 0.6281, 0.6596, 0.6068, 0.4957, 32.86)),
    ("3s_nm_seed12", 111, 107, 62, 404, 98, (0.7529, 0.6974, 0.6881, 0.7161, 0.8270, 0.5678, 12.53)),
    ("3s_nm", 164, 271, 34, 280, 33, (0.5928, 0.5828, 0.6344, 0.6682, 0.6474, 0.5182, 4.22)),
    ("3s_nm_seed45", 116, 91, 53, 393, 129, (0.7795, 0.7311, 0.7208, 0.7492, 0.8452, 0.6170, 16.50)),
    ("3s_os_seed12", 8, 1, 79, 186, 508, (0.7080, 0.4948, 0.7954, 0.5433, 0.8230, 0.1667, 64.96)),
    ("3s_os", 32, 11, 159, 511, 69, (0.7616, 0.5654, 0.7534, 0.5732, 0.8574, 0.2735, 8.82)),
    ("3s_os_seed45", 29, 16, 61, 232, 444, (0.7722, 0.6437, 0.7181, 0.6289, 0.8577, 0.4296, 56.78)),
    ("3s_us_seed12", 53, 15, 134, 535, 45, (0.7978, 0.6467, 0.7896, 0.6281, 0.8778, 0.4157, 5.75)),
    ("3s_us", 18, 4, 181, 558, 21, (0.7569, 0.5103, 0.7866, 0.5417, 0.8578, 0.1629, 2.69)),
    ("3s_us_seed45", 140, 149, 33, 370, 90, (0.7370, 0.7043, 0.7013, 0.7611, 0.8026, 0.6061, 11.51)),
    ("cot_bl_seed42", 59, 36, 150, 532, 5, (0.7606, 0.6197, 0.7006, 0.6095, 0.8512, 0.3882, 0.64)),
    ("cot_nm_seed42", 151, 187, 61, 383, 0, (0.6829, 0.6523, 0.6547, 0.6921, 0.7554, 0.5491, 0.00)),
    ("cot_os_seed42", 37, 15, 172, 555, 3, (0.7599, 0.5697, 0.7375, 0.5754, 0.8558, 0.2835, 0.38)),
    ("cot_us_seed42", 26, 14, 186, 556, 0, (0.7442, 0.5270, 0.6997, 0.5490, 0.8476, 0.2063, 0.00)),
]
# Full-precision row of the published seed table (run bl_seed12).
BL_SEED12_FULL = (
    0.736235595390525, 0.5304956343091937, 0.6533317505539729, 0.5481853301057797,
    0.8412942989214176, 0.2196969696969697, 0.7489711934156379, 0.5576923076923077,
    0.9595782073813708, 0.13679245283018868, 0.1278772378516624, 782, 781,
)
# Encoder rows: truncated CSV values (acc, f1m, pm, rm) and rounded text files
# (acc, f1m, f1micro, pm, rm, f1_0, f1_1).
ENCODER_TRUNC = [
    ("Undersample", 149, 105, 63, 465, (0.7851, 0.7432, 0.7336, 0.7593)),
    ("Oversample", 154, 100, 58, 470, (0.7979, 0.7585, 0.7482, 0.7754)),
    ("No Sampling", 147, 81, 65, 489, (0.8132, 0.7691, 0.7637, 0.7756)),
]
ENCODER_ROUND = [
    ("bl_0.7309", 148, 93, 64, 477, (0.7992, 0.7561, 0.7992, 0.7479, 0.7675, 0.8587, 0.6534)),
    ("focal_0.7368", 149, 93, 63, 477, (0.8005, 0.7579, 0.8005, 0.7495, 0.7698, 0.8595, 0.6564)),
]


def _counts_df(spark, rows):
    return spark.createDataFrame([r[:6] for r in rows], "run string, tp long, fp long, fn long, tn long, invalid long")


def test_a9_reproduces_published_runs(spark):
    got = {r.run: r for r in A.evaluate_counts(_counts_df(spark, GOLDEN), ["run"]).collect()}
    for run, *_, exp in GOLDEN:
        r = got[run]
        vals = (r.accuracy, r.f1_macro, r.precision_macro, r.recall_macro, r.f1_class_0_not_biased, r.f1_class_1_biased, r.invalid_percent)
        assert tuple(round(v, 4) for v in vals[:6]) == exp[:6], (run, vals, exp)
        assert round(vals[6], 2) == exp[6], (run, vals, exp)


def test_a9_full_precision_row(spark):
    r = A.evaluate_counts(_counts_df(spark, [GOLDEN[0]]), ["run"]).first()
    got = (
        r.accuracy, r.f1_macro, r.precision_macro, r.recall_macro, r.f1_class_0_not_biased, r.f1_class_1_biased,
        r.precision_class_0_not_biased, r.precision_class_1_biased, r.recall_class_0_not_biased,
        r.recall_class_1_biased, r.invalid_percent, r.total_samples, r.valid_samples,
    )
    assert got == BL_SEED12_FULL


def _rows_from_counts(spark, tp, fp, fn, tn, invalid=0):
    rows = [(1, 1)] * tp + [(0, 1)] * fp + [(1, 0)] * fn + [(0, 0)] * tn + [(0, -1)] * invalid
    return spark.createDataFrame(rows, "label int, pred int")


def test_a9_from_rows_equals_from_counts(spark):
    run = GOLDEN[1]
    a = A.evaluate(_rows_from_counts(spark, *run[1:6])).first().asDict()
    b = A.evaluate_counts(_counts_df(spark, [run]), ["run"]).drop("run").first().asDict()
    assert a == b


def test_encoder_rows(spark):
    for name, tp, fp, fn, tn, exp in ENCODER_TRUNC:
        m = A.macro(_rows_from_counts(spark, tp, fp, fn, tn)).first()
        vals = (m.accuracy, m.f1_macro, m.precision_macro, m.recall_macro)
        assert tuple(math.floor(v * 1e4) / 1e4 for v in vals) == exp, name
    for name, tp, fp, fn, tn, exp in ENCODER_ROUND:
        df = _rows_from_counts(spark, tp, fp, fn, tn)
        m = A.macro(df).first()
        f1 = {r.cls: r.f1 for r in A.per_class(df).collect()}
        vals = (m.accuracy, m.f1_macro, m.f1_micro, m.precision_macro, m.recall_macro, f1[0], f1[1])
        assert tuple(round(v, 4) for v in vals) == exp, name
        assert m.f1_micro == m.accuracy


def test_edge_cases(spark):
    schema = "g string, label int, pred int"
    rows = (
        [("all_invalid", 1, -1), ("all_invalid", 0, -1)]
        + [("only0", 0, 0)] * 3
        + [("only1", 1, 1)] * 2
        + [("all0", 1, 0), ("all0", 0, 0)]
    )
    df = spark.createDataFrame(rows, schema)
    groups = spark.createDataFrame([("all_invalid",), ("only0",), ("only1",), ("all0",), ("empty",)], "g string")
    got = {r.g: r for r in A.evaluate(df, ["g"], groups=groups).collect()}
    r = got["all_invalid"]
    assert (r.accuracy, r.f1_macro, r.invalid_percent, r.valid_samples, r.total_samples) == (0.0, 0.0, 100.0, 0, 2)
    r = got["empty"]
    assert (r.f1_macro, r.invalid_percent, r.total_samples) == (0.0, 100.0, 0)
    r = got["only0"]
    assert (r.accuracy, r.f1_macro, r.f1_class_0_not_biased, r.f1_class_1_biased) == (1.0, 1.0, 1.0, 0.0)
    r = got["only1"]
    assert (r.accuracy, r.f1_macro, r.f1_class_0_not_biased, r.f1_class_1_biased) == (1.0, 1.0, 0.0, 1.0)
    r = got["all0"]
    assert (r.precision_class_1_biased, r.recall_class_1_biased, r.f1_class_1_biased) == (0.0, 0.0, 0.0)
    assert r.f1_macro == pytest.approx((2 / 3 + 0.0) / 2)


def test_swapping_classes_keeps_macro_f1(spark):
    df = _rows_from_counts(spark, 29, 23, 183, 546)
    sw = df.select((1 - F.col("label")).alias("label"), (1 - F.col("pred")).alias("pred"))
    assert A.macro(df).first().f1_macro == pytest.approx(A.macro(sw).first().f1_macro, abs=1e-15)


def test_three_class_macro_counts_invalid_as_class(spark):
    rows = [(1, 1), (0, 0), (0, -1), (-1, -1), (1, 0)]
    df = spark.createDataFrame(rows, "label int, pred int")
    r = A.macro_with_invalid(df).first()
    # classes -1, 0, 1: f1 = 2/3, 1/2, 2/3
    assert r.f1_macro == pytest.approx((2 / 3 + 0.5 + 2 / 3) / 3)
    assert r.accuracy == pytest.approx(3 / 5)
    assert (r.no_pred, r.no_label) == (2, 1)


def test_template_summary_na(spark):
    df = spark.createDataFrame([("t1", 1, None), ("t1", 0, None), ("t2", 1, 1), ("t2", 0, 1)], "template string, true_label int, pred_label int")
    got = {r.template: r for r in A.template_summary(df).collect()}
    assert (got["t1"].n_evaluated, got["t1"].accuracy, got["t1"].f1) == (0, "N/A", "N/A")
    assert (got["t2"].accuracy, got["t2"].precision, got["t2"].recall, got["t2"].f1) == ("0.50", "0.50", "1.00", "0.67")


def test_class_weights_fixture(spark):
    from graded.sources.corpus import load_corpus
    from tests.conftest import SF01

    w = {r.label: r.weight for r in A.class_weights(load_corpus(spark, SF01)).collect()}
    assert round(w[0], 6) == 0.573276 and round(w[1], 6) == 3.911765


def test_length_percentiles_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    sizes = {"a": rng.integers(0, 40, 333).tolist(), "b": [3], "c": rng.integers(0, 500, 20).tolist()}
    rows = [(g, " ".join(["w"] * n), None if i % 3 == 0 else "x y") for g, s in sizes.items() for i, n in enumerate(s)]
    df = spark.createDataFrame(rows, "g string, full string, answer string").repartition(5)
    got = {r["g"]: r for r in A.length_profile(df, ["g"], ("full", "answer")).collect()}
    for g, s in sizes.items():
        r = got[g]
        assert (r["n_rows"], r["min_words_full"], r["max_words_full"], r["sum_words_full"]) == (len(s), min(s), max(s), sum(s))
        for name, p in (("median", 50), ("p95", 95)):
            assert r[f"{name}_words_full"] == pytest.approx(np.percentile(s, p))
        assert r["sum_words_answer"] in (None, 2 * sum(i % 3 != 0 for i in range(len(s))), 0)
    whole = A.length_profile(df, None, ("full",)).first()
    assert whole["median_words_full"] == pytest.approx(np.percentile(sum(sizes.values(), []), 50))
