"""Classification metrics (A1-A16) as grouped aggregations.

Every metric is a ratio of integer counts taken in ONE grouped aggregation
(partial aggregation runs map-side, so a hot group costs no more than a cold
one); nothing is collected to the driver. Conventions follow the reference:

* zero denominator -> 0;
* macro averages run over the classes that occur in labels or predictions
  of the kept rows, summed in class order (a one-class group is not halved);
* "invalid" has three meanings: -1 filtered (A9), -1 as a class (A8) and
  NULL dropped (A11).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graded.functions.naming import fixed_decimals

# Field names of the 13-field evaluation record.
A9_FIELDS = (
    "accuracy",
    "f1_macro",
    "precision_macro",
    "recall_macro",
    "f1_class_0_not_biased",
    "f1_class_1_biased",
    "precision_class_0_not_biased",
    "precision_class_1_biased",
    "recall_class_0_not_biased",
    "recall_class_1_biased",
    "invalid_percent",
    "total_samples",
    "valid_samples",
)


def _by(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, 0 when den is 0 (zero_division=0)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def _agg(df: DataFrame, by, *cols):
    by = _by(by)
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


# ---------------------------------------------------------------- A1 / A3


def confusion(df: DataFrame, by=None, label: str = "label", pred: str = "pred") -> DataFrame:
    """A1: confusion counts per group: (by..., label, pred, n)."""
    by = _by(by)
    return df.groupBy(*by, label, pred).agg(F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, by=None, label: str = "label", pred: str = "pred") -> DataFrame:
    """A3: per-class tp/support/predicted and P, R, F1 for every class that
    occurs in labels or predictions of the group. Built on the confusion
    table (at most groups x classes^2 rows), so the fan-out is tiny."""
    by = _by(by)
    conf = confusion(df, by, label, pred)
    roles = conf.select(
        *by,
        F.explode(
            F.array(
                F.struct(
                    F.col(label).alias("cls"),
                    F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(F.lit(0)).alias("tp"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("long").alias("predicted"),
                ),
                F.struct(
                    F.col(pred).alias("cls"),
                    F.lit(0).cast("long").alias("tp"),
                    F.lit(0).cast("long").alias("support"),
                    F.col("n").alias("predicted"),
                ),
            )
        ).alias("r"),
    ).select(*by, "r.*")
    pc = roles.groupBy(*by, "cls").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted")
    )
    return pc.select(
        *by,
        "cls",
        "tp",
        "support",
        "predicted",
        ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def _ordered_sum(arr: Column, field: str) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x[field])


def macro(df: DataFrame, by=None, label: str = "label", pred: str = "pred", with_invalid: bool = False) -> DataFrame:
    """A2 + A5 + A6: accuracy, macro P/R/F1 over present classes (summed in
    class order), micro F1, number of classes and rows, per group."""
    by = _by(by)
    pc = per_class(df, by, label, pred)
    agg = _agg(
        pc,
        by,
        F.array_sort(F.collect_list(F.struct("cls", "precision", "recall", "f1"))).alias("cl"),
        F.sum("tp").alias("tp"),
        F.sum("support").alias("n"),
        F.sum(F.when(F.col("cls") == -1, F.col("predicted")).otherwise(0)).alias("no_pred"),
        F.sum(F.when(F.col("cls") == -1, F.col("support")).otherwise(0)).alias("no_label"),
    )
    k = F.size("cl").cast("double")
    extra = [F.col("no_pred").cast("long").alias("no_pred"), F.col("no_label").cast("long").alias("no_label")] if with_invalid else []
    return agg.select(
        *by,
        ratio(F.col("tp"), F.col("n")).alias("accuracy"),
        (_ordered_sum(F.col("cl"), "f1") / k).alias("f1_macro"),
        (_ordered_sum(F.col("cl"), "precision") / k).alias("precision_macro"),
        (_ordered_sum(F.col("cl"), "recall") / k).alias("recall_macro"),
        ratio(2 * F.col("tp"), 2 * F.col("n")).alias("f1_micro"),
        F.size("cl").alias("n_classes"),
        F.col("n").alias("n_rows"),
        *extra,
    )


def report(df: DataFrame, by=None, label: str = "label", pred: str = "pred") -> DataFrame:
    """Classification report in long form: one row per class, then
    ``accuracy``, ``macro avg`` and ``weighted avg`` rows. One aggregated
    row per group carries the per-class list; a single ``explode`` emits all
    report rows (no union, so the input is read once)."""
    by = _by(by)
    pc = per_class(df, by, label, pred)
    agg = _agg(
        pc,
        by,
        F.array_sort(F.collect_list(F.struct("cls", "precision", "recall", "f1", "support"))).alias("cl"),
        F.sum("tp").alias("tp"),
        F.sum("support").alias("n"),
    )
    k = F.size("cl").cast("double")
    n = F.col("n").cast("double")

    def wsum(field):
        return F.aggregate(F.col("cl"), F.lit(0.0), lambda acc, x: acc + x[field] * x["support"])

    def row(name, p, r, f):
        return F.struct(
            F.lit(name).alias("row"),
            p.cast("double").alias("precision"),
            r.cast("double").alias("recall"),
            f.cast("double").alias("f1"),
            F.col("n").cast("long").alias("support"),
        )

    class_rows = F.transform(
        "cl",
        lambda x: F.struct(
            x["cls"].cast("string").alias("row"),
            x["precision"].alias("precision"),
            x["recall"].alias("recall"),
            x["f1"].alias("f1"),
            x["support"].cast("long").alias("support"),
        ),
    )
    summary = F.array(
        row("accuracy", F.lit(None), F.lit(None), ratio(F.col("tp"), F.col("n"))),
        row("macro avg", _ordered_sum(F.col("cl"), "precision") / k, _ordered_sum(F.col("cl"), "recall") / k, _ordered_sum(F.col("cl"), "f1") / k),
        row(
            "weighted avg",
            F.when(n == 0, 0.0).otherwise(wsum("precision") / n),
            F.when(n == 0, 0.0).otherwise(wsum("recall") / n),
            F.when(n == 0, 0.0).otherwise(wsum("f1") / n),
        ),
    )
    return agg.select(*by, F.explode(F.concat(class_rows, summary)).alias("r")).select(*by, "r.*")


# ---------------------------------------------------------------- A9


def binary_counts(label: str = "label", pred: str = "pred") -> list[Column]:
    """count_if columns shared by A9, A10 and A12 (one pass)."""
    lab, prd = F.col(label), F.col(pred)
    return [
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(prd == -1).alias("n_invalid"),
        F.count_if((lab == 1) & (prd == 1)).alias("n11"),
        F.count_if((lab == 1) & (prd == 0)).alias("n10"),
        F.count_if((lab == 0) & (prd == 1)).alias("n01"),
        F.count_if((lab == 0) & (prd == 0)).alias("n00"),
    ]


def _binary_scores(prefix: str = "") -> dict[str, Column]:
    n11, n10, n01, n00 = (F.col(prefix + c) for c in ("n11", "n10", "n01", "n00"))
    p0, p1 = (n00 + n10 + n01) > 0, (n11 + n10 + n01) > 0
    s = {
        "f1_0": ratio(2 * n00, 2 * n00 + n10 + n01),
        "f1_1": ratio(2 * n11, 2 * n11 + n01 + n10),
        "p_0": ratio(n00, n00 + n10),
        "p_1": ratio(n11, n11 + n01),
        "r_0": ratio(n00, n00 + n01),
        "r_1": ratio(n11, n11 + n10),
    }

    def mac(a, b):
        return F.when(p0 & p1, (a + b) / 2.0).when(p0, a).otherwise(b)

    s["f1_macro"] = mac(s["f1_0"], s["f1_1"])
    s["precision_macro"] = mac(s["p_0"], s["p_1"])
    s["recall_macro"] = mac(s["r_0"], s["r_1"])
    s["accuracy"] = ratio(n11 + n00, n11 + n10 + n01 + n00)
    return s


def _a9_columns(prefix: str = "") -> dict[str, Column]:
    """The 13 fields from counts ``total_samples`` and ``{prefix}n_invalid``,
    ``{prefix}n11`` ... ``{prefix}n00``."""
    s = _binary_scores(prefix)
    total = F.col("total_samples")
    invalid = F.col(prefix + "n_invalid")
    valid = total - invalid
    none_valid = valid == 0

    def sc(c):
        return F.when(none_valid, F.lit(0.0)).otherwise(c)

    return {
        "accuracy": sc(s["accuracy"]),
        "f1_macro": sc(s["f1_macro"]),
        "precision_macro": sc(s["precision_macro"]),
        "recall_macro": sc(s["recall_macro"]),
        "f1_class_0_not_biased": sc(s["f1_0"]),
        "f1_class_1_biased": sc(s["f1_1"]),
        "precision_class_0_not_biased": sc(s["p_0"]),
        "precision_class_1_biased": sc(s["p_1"]),
        "recall_class_0_not_biased": sc(s["r_0"]),
        "recall_class_1_biased": sc(s["r_1"]),
        "invalid_percent": F.when(none_valid, F.lit(100.0)).otherwise(
            invalid.cast("double") / total.cast("double") * 100.0
        ),
        "total_samples": total.cast("long"),
        "valid_samples": valid.cast("long"),
    }


def _a9_select(counts: DataFrame, by: list[str]) -> DataFrame:
    """The 13-field record from per-group counts (total_samples, n_invalid,
    n11, n10, n01, n00)."""
    cols = _a9_columns()
    return counts.select(*by, *[cols[f].alias(f) for f in A9_FIELDS])


def evaluate(
    df: DataFrame,
    by=None,
    label: str = "label",
    pred: str = "pred",
    groups: DataFrame | None = None,
) -> DataFrame:
    """The 13-field evaluation record per group.

    Kept rows are ``pred != -1``. No kept row -> all scores 0, invalid 100,
    valid 0. With ``groups`` (a table of group keys) empty groups are kept
    too and get total 0 (the reference's empty-list contract, D17).
    """
    by = _by(by)
    counts = _agg(df, by, *binary_counts(label, pred))
    if groups is not None:
        counts = groups.select(*by).join(counts, by, "left")
        counts = counts.fillna(0, subset=["total_samples", "n_invalid", "n11", "n10", "n01", "n00"])
    return _a9_select(counts, by)


def evaluate_multi(df: DataFrame, by, preds: dict[str, str], label: str = "label", fields=("f1_macro", "invalid_percent")) -> DataFrame:
    """A9 for several prediction columns of the same rows in ONE aggregation
    and one projection (e.g. two parsers over one sweep); output columns are
    ``{field}_{name}`` for every prediction ``name``."""
    by = _by(by)
    lab = F.col(label)
    aggs = [F.count(F.lit(1)).alias("total_samples")]
    for name, col in preds.items():
        p = F.col(col)
        aggs += [
            F.count_if(p == -1).alias(f"{name}__n_invalid"),
            F.count_if((lab == 1) & (p == 1)).alias(f"{name}__n11"),
            F.count_if((lab == 1) & (p == 0)).alias(f"{name}__n10"),
            F.count_if((lab == 0) & (p == 1)).alias(f"{name}__n01"),
            F.count_if((lab == 0) & (p == 0)).alias(f"{name}__n00"),
        ]
    counts = _agg(df, by, *aggs)
    out = []
    for name in preds:
        cols = _a9_columns(f"{name}__")
        out += [cols[f].alias(f"{f}_{name}") for f in fields]
    return counts.select(*by, *out)


def evaluate_confusion(conf: DataFrame, by=None, label: str = "label", pred: str = "pred", n: str = "n") -> DataFrame:
    """A9 from a confusion table (by..., label, pred, n), e.g. the output of
    A1 or of the streaming confusion count."""
    by = _by(by)
    lab, prd, cnt = F.col(label), F.col(pred), F.col(n)

    def s(cond):
        return F.sum(F.when(cond, cnt).otherwise(F.lit(0))).cast("long")

    counts = _agg(
        conf,
        by,
        F.sum(cnt).cast("long").alias("total_samples"),
        s(prd == -1).alias("n_invalid"),
        s((lab == 1) & (prd == 1)).alias("n11"),
        s((lab == 1) & (prd == 0)).alias("n10"),
        s((lab == 0) & (prd == 1)).alias("n01"),
        s((lab == 0) & (prd == 0)).alias("n00"),
    )
    return _a9_select(counts, by)


def evaluate_counts(counts: DataFrame, by=None) -> DataFrame:
    """A9 fed with a count table (by..., tp, fp, fn, tn, invalid) instead of
    rows; used for the published golden confusion counts."""
    by = _by(by)
    c = counts.select(
        *by,
        (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") + F.col("invalid")).alias("total_samples"),
        F.col("invalid").alias("n_invalid"),
        F.col("tp").alias("n11"),
        F.col("fn").alias("n10"),
        F.col("fp").alias("n01"),
        F.col("tn").alias("n00"),
    )
    return _a9_select(c, by)


# ---------------------------------------------------------------- A8 / A10


def macro_with_invalid(df: DataFrame, by=None, label: str = "label", pred: str = "pred") -> DataFrame:
    """A8 (generative evaluation): -1 is a class, not filtered; accuracy over
    all rows; plus counts of unparsed predictions and labels (D5 fixed)."""
    return macro(df, by, label, pred, with_invalid=True).drop("f1_micro", "n_classes", "n_rows")


def evaluate_two_sided(df: DataFrame, by=None, label: str = "label", pred: str = "pred") -> DataFrame:
    """A10 (training-time evaluation): rows kept when both sides parsed;
    invalid percentages on both sides; no kept row -> zeros and 100 (0 when
    the group is empty)."""
    by = _by(by)
    lab, prd = F.col(label), F.col(pred)
    both = (lab != -1) & (prd != -1)
    counts = _agg(
        df,
        by,
        F.count(F.lit(1)).alias("n"),
        F.count_if(prd == -1).alias("inv_p"),
        F.count_if(lab == -1).alias("inv_l"),
        F.count_if(both & (lab == 1) & (prd == 1)).alias("n11"),
        F.count_if(both & (lab == 1) & (prd == 0)).alias("n10"),
        F.count_if(both & (lab == 0) & (prd == 1)).alias("n01"),
        F.count_if(both & (lab == 0) & (prd == 0)).alias("n00"),
    )
    s = _binary_scores()
    kept = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    none = kept == 0

    def sc(x):
        return F.when(none, F.lit(0.0)).otherwise(x)

    def pct(c):
        return F.when(F.col("n") == 0, F.lit(0.0)).otherwise(
            F.when(none, F.lit(100.0)).otherwise(F.col(c).cast("double") / F.col("n").cast("double") * 100.0)
        )

    return counts.select(
        *by,
        sc(s["accuracy"]).alias("accuracy"),
        sc(s["f1_macro"]).alias("f1_macro"),
        sc(s["precision_macro"]).alias("precision_macro"),
        sc(s["recall_macro"]).alias("recall_macro"),
        pct("inv_p").alias("invalid_preds_percent"),
        pct("inv_l").alias("invalid_labels_percent"),
    )


# ---------------------------------------------------------------- A11-A16


def template_summary(df: DataFrame, by="template", label: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """Per template, drop NULL predictions; n, accuracy and binary
    (class 1) P/R/F1 as 2-decimal text; no kept row -> ``N/A``."""
    by = _by(by)
    lab, prd = F.col(label), F.col(pred)
    kept = prd.isNotNull()
    c = _agg(
        df,
        by,
        F.count_if(kept).alias("n_evaluated"),
        F.count_if(kept & (lab == prd)).alias("n_right"),
        F.count_if(kept & (lab == 1) & (prd == 1)).alias("tp"),
        F.count_if(kept & (lab != 1) & (prd == 1)).alias("fp"),
        F.count_if(kept & (lab == 1) & (prd != 1)).alias("fn"),
    )

    def fmt(x):
        return F.when(F.col("n_evaluated") == 0, F.lit("N/A")).otherwise(fixed_decimals(x, 2))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(
        *by,
        F.col("n_evaluated").cast("long").alias("n_evaluated"),
        fmt(ratio(F.col("n_right"), F.col("n_evaluated"))).alias("accuracy"),
        fmt(ratio(tp, tp + fp)).alias("precision"),
        fmt(ratio(tp, tp + fn)).alias("recall"),
        fmt(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"),
    )


def class_counts(df: DataFrame, by=None, label: str = "label", pred: str = "pred") -> DataFrame:
    """positive/negative counts in predictions and labels, kept rows."""
    by = _by(by)
    lab, prd = F.col(label), F.col(pred)
    ok = prd != -1
    return _agg(
        df,
        by,
        F.count_if(ok & (prd == 1)).alias("pos_preds"),
        F.count_if(ok & (prd == 0)).alias("neg_preds"),
        F.count_if(ok & (lab == 1)).alias("pos_labels"),
        F.count_if(ok & (lab == 0)).alias("neg_labels"),
    )


def class_weights(df: DataFrame, by=None, label: str = "label") -> DataFrame:
    """Balanced class weights ``n / (k * n_c)`` per group and class.
    The window runs over the per-class count table (groups x classes)."""
    by = _by(by)
    cnt = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return cnt.select(
        *by,
        F.col(label).alias("label"),
        "n_c",
        (
            F.sum("n_c").over(w).cast("double")
            / (F.count(F.lit(1)).over(w) * F.col("n_c")).cast("double")
        ).alias("weight"),
    )


def length_profile(
    df: DataFrame, by=None, cols: Sequence[str] = ("prompt", "full", "answer"), percentiles: Sequence[tuple[str, int]] = (("median", 50), ("p95", 95))
) -> DataFrame:
    """Word-count profile (Python ``len(s.split())``) of text columns, with
    exact percentiles (linear between neighbours).

    Rows become integer counts first: one grouped aggregation per (group,
    column, length), summed map-side, so a group has as many rows as it has
    different lengths, and percentiles come from running sums over those."""
    from graded.functions.text import n_words

    by = _by(by)
    sizes = F.array(*[F.struct(F.lit(c).alias("_col"), n_words(F.col(c)).alias("_len")) for c in cols])
    counts = df.select(*by, F.explode(sizes).alias("_s")).groupBy(*by, "_s._col", "_s._len").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*by, "_col").orderBy("_len")
    whole = Window.partitionBy(*by, "_col")
    # (a null text has no length: its row counts, its length doesn't)
    known = F.when(F.col("_len").isNotNull(), F.col("_n")).otherwise(0)
    placed = counts.withColumn("_k", known).select(
        "*",
        F.sum("_k").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
        F.sum("_k").over(whole).alias("_all"),
    )

    def at(place) -> Column:
        """Length of the row at a 0-based place in order."""
        return F.min(F.when((F.col("_k") > 0) & (F.col("_upto") > place), F.col("_len")))

    aggs = [F.sum("_n").alias("n"), F.min("_len").alias("min"), F.max("_len").alias("max"), F.sum(F.col("_len") * F.col("_n")).alias("sum"), F.max("_all").alias("_all")]
    for name, p in percentiles:
        place = (F.col("_all") - 1) * p  # in hundredths
        aggs += [at(F.floor(place / 100)).alias(f"{name}_lo"), at(F.ceil(place / 100)).alias(f"{name}_hi")]
    told = placed.groupBy(*by, "_col").agg(*aggs)
    values = {"avg": F.col("sum") / F.nullif(F.col("_all"), F.lit(0)), "min": F.col("min"), "max": F.col("max"), "sum": F.col("sum")}
    for name, p in percentiles:
        share = F.pmod((F.col("_all") - 1) * p, F.lit(100)) / 100
        lo, hi = F.col(f"{name}_lo").cast("double"), F.col(f"{name}_hi").cast("double")
        values[name] = lo + (hi - lo) * share
    told = told.select(*by, "_col", "n", *[v.alias(f"_{k}") for k, v in values.items()])
    one = lambda c, k: F.max(F.when(F.col("_col") == c, F.col(f"_{k}")))
    return _agg(told, by, F.max("n").alias("n_rows"), *[one(c, k).alias(f"{k}_words_{c}") for c in cols for k in values])


def count_by(df: DataFrame, by) -> DataFrame:
    """Row counts per group."""
    return df.groupBy(*_by(by)).agg(F.count(F.lit(1)).alias("n_rows"))


def best_by(df: DataFrame, by, item: str, metric: str, order: str) -> DataFrame:
    """Per group the item with the largest metric, earliest ``order``
    on ties (an aggregate, so no per-group sort)."""
    by = _by(by)
    key = F.struct(F.col(metric), (-F.col(order)).alias("neg_order"))
    return _agg(
        df,
        by,
        F.max_by(F.struct(F.col(item).alias("best"), F.col(order).alias("best_order"), F.col(metric).alias("best_value")), key).alias("b"),
    ).select(*by, "b.best", "b.best_order", "b.best_value")


def distinct_classes(df: DataFrame, by=None, label: str = "label", pred: str = "pred") -> DataFrame:
    """Distinct classes occurring in labels or predictions, as rows."""
    by = _by(by)
    return (
        df.select(*by, F.explode(F.array(F.col(label), F.col(pred))).alias("cls"))
        .groupBy(*by, "cls")
        .agg(F.count(F.lit(1)).alias("n_mentions"))
    )
