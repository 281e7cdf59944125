"""Exact-size seeded resampling.

The reference draws exact counts (``sample(n=...)``, ``sample(frac=...)``),
so Bernoulli ``sample``/``sampleBy`` is the wrong primitive, and a global
``row_number()`` would put a whole class into one task. Instead (§4.3):

1. every row gets a hash key ``h = md5(seed ':' key...)``;
2. rows are counted per (group, first ``bucket_hex`` hex digits of h):
   at most 16**bucket_hex rows per group, aggregated map-side;
3. a running sum over that small table finds, per group, the cut-off
   bucket and how many rows of it are still needed;
4. rows below the cut-off bucket are kept outright, and ``row_number`` runs
   only inside the cut-off bucket (about n / 16**bucket_hex rows).

The result is exactly the rows with the n smallest (h, key) per group, the
same set ``row_number() over (partition by g order by h, key) <= n`` gives,
and no task ever holds more than one bucket of one group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graded.functions.text import _c
from graded.session import materialize

STRATEGIES = ("undersample", "oversample", "balanced", "normal")
# Strategy abbreviations used in run names.
STRAT_ABBREV = {"undersample": "us", "oversample": "os", "balanced": "bl", "normal": "nm"}


def hash_key(seed, *keys) -> Column:
    """md5 of ``seed:key1:key2...`` (hex string)."""
    parts: list[Column] = [(_c(seed) if not isinstance(seed, int) else F.lit(seed)).cast("string")]
    for k in keys:
        parts += [F.lit(":"), _c(k).cast("string")]
    return F.md5(F.concat(*parts))


def py_round(x: Column) -> Column:
    """Python ``round(x)`` (half to even on the exact double value) as a
    long; Spark's ``bround`` and DuckDB's ``round_even`` both give 4 for
    0.7 * 5 = 3.4999999999999996, Python gives 3."""
    f = F.floor(x)
    d = x - f
    return (f + F.when(d > 0.5, 1).when(d < 0.5, 0).otherwise(F.pmod(f, F.lit(2)))).cast("long")


def _attach(d: DataFrame, small: DataFrame, groups: list[str], grouped: bool, few: bool = False) -> DataFrame:
    """Attach per-group parameters. With group keys: an equi-join to the table
    of one row per group; dealt out by its keys first, so that AQE has its
    measured size and broadcasts it unless there are very many groups.
    ``few``: there are a handful of groups at most, whatever the input. Their
    table is broadcast, since a join dealt by so few keys would put all rows
    (a cached frame, too) into as few tasks.
    Without: the single row is a scalar subquery evaluated once -- no join at
    all."""
    if grouped and few:
        return d.join(F.broadcast(small), groups, "inner")  # a row per group
    if grouped:
        return d.join(small.repartition(*groups), groups, "inner")
    cols = [c for c in small.columns if c not in groups]
    info = small.select(F.struct(*cols).alias("_info")).scalar()
    return d.withColumn("_info", info).select("*", *[F.col(f"_info.{c}").alias(c) for c in cols]).drop("_info")


def _cuts(d: DataFrame, g: list[str], h: str, keys: Sequence[str], n, n_from_total, bucket_hex: int, n_col: str | None):
    """Where each group's n smallest (h, keys) end: the rows with their bucket,
    the place of a row, (group, ``_n``), and (group, ``_last``: the place of the
    n-th row; no row for a group that has n rows or fewer)."""
    d = d.withColumn("_b", F.substring(F.col(h), 1, bucket_hex))
    extra = [F.max(n_col).alias("_ncol")] if n_col else []
    counts = d.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_cnt"), *extra)
    wg = Window.partitionBy(*g)
    counts = counts.withColumn("_total", F.sum("_cnt").over(wg))
    if n_col:
        counts = counts.withColumn("_n", F.max("_ncol").over(wg).cast("long")).drop("_ncol")
    elif n_from_total is not None:
        counts = counts.withColumn("_n", n_from_total(F.col("_total")).cast("long"))
    else:
        counts = counts.withColumn("_n", F.lit(int(n)).cast("long"))
    counts = counts.withColumn(
        "_cum", F.sum("_cnt").over(wg.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    )
    counts = counts.withColumn("_prev", F.col("_cum") - F.col("_cnt"))
    hit = (F.col("_prev") < F.col("_n")) & (F.col("_cum") >= F.col("_n"))
    # one row per group: the bucket that holds the n-th row (NULL: the group
    # has n rows or fewer, or n is 0) and how many rows of it count
    cut = counts.groupBy(*g).agg(
        F.max("_n").alias("_n"),
        F.max("_total").alias("_total"),
        F.min(F.when(hit, F.col("_b"))).alias("_cut"),
        F.min(F.when(hit, F.col("_n") - F.col("_prev"))).alias("_rem"),
    )
    # the n-th (h, keys) itself, from the rows of that bucket alone: the keys
    # are read, no texts
    place = F.struct(F.col(h).alias("h"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    in_cut = d.select(*g, "_b", place.alias("_place")).join(
        cut.select(*g, F.col("_cut").alias("_b"), "_rem").where("_b is not null"), [*g, "_b"]
    )
    nth = Window.partitionBy(*g).orderBy("_place")
    last = (
        in_cut.withColumn("_rn", F.row_number().over(nth))
        .where(F.col("_rn") == F.col("_rem"))
        .select(*g, F.col("_place").alias("_last"))
    )
    return d, place, cut, last


def flag_top_n(
    df: DataFrame,
    groups: Sequence[str],
    n: Column | int | None = None,
    seed=42,
    keys: Sequence[str] = ("example_id",),
    out: str = "_sel",
    n_from_total=None,
    bucket_hex: int = 4,
    hash_col: str | None = None,
    n_col: str | None = None,
    few: bool = False,
) -> DataFrame:
    """Add boolean ``out``: row is among the n smallest (h, keys) of its group.

    ``n`` is an int; or ``n_col`` names a per-group column already on the
    rows; or ``n_from_total(total_col) -> Column`` derives n from the group
    size. Sizes and bucket counts come from one aggregation pass. ``few``: the
    groups are a handful at most, whatever the input (two classes).
    """
    g = list(groups) or ["_g"]
    d = df if groups else df.withColumn("_g", F.lit(0))
    h = hash_col or "_h"
    if hash_col is None:
        d = d.withColumn(h, hash_key(seed, *keys))
    d, place, cut, last = _cuts(d, g, h, keys, n, n_from_total, bucket_hex, n_col)
    if groups:
        d = _attach(d, cut.select(*g, "_n").join(last, g, "left"), g, True, few)
    else:
        d = _attach(_attach(d, cut.select(*g, "_n"), g, False), last, g, False)
    keep = F.when(F.col("_last").isNull(), F.col("_n") > 0).otherwise(place <= F.col("_last"))
    res = d.withColumn(out, keep)
    drop = ["_b", "_n", "_last"] + ([] if groups else ["_g"]) + ([h] if hash_col is None else [])
    return res.drop(*[c for c in drop if c in res.columns])


def top_n(df: DataFrame, groups: Sequence[str], n=None, seed=42, keys=("example_id",), **kw) -> DataFrame:
    """R8 / exact hash top-n per group (capped at the group size)."""
    return flag_top_n(df, groups, n, seed, keys, **kw).filter(F.col("_sel")).drop("_sel")


# ---------------------------------------------------------------- R1-R5


def _with_copy(df: DataFrame, copy_no=1) -> DataFrame:
    return df.withColumn("copy_no", F.lit(copy_no) if isinstance(copy_no, int) else copy_no)


def undersample(df: DataFrame, ratio: float = 0.7, seed=42, groups: Sequence[str] = (), label: str = "label") -> DataFrame:
    """All positives + round(ratio * N0) negatives, without replacement.
    Both classes go through one grouped pass (target = all positives)."""
    lab = F.col(label)
    target = lambda t: F.when(lab == 1, t).otherwise(py_round(F.lit(float(ratio)) * t.cast("double")))
    out = flag_top_n(df.filter(lab.isin(0, 1)), [*groups, label], seed=seed, n_from_total=target, few=not groups)
    return _with_copy(out.filter(F.col("_sel")).drop("_sel"))


def oversample(df: DataFrame, factor: int = 2, label: str = "label") -> DataFrame:
    """R2: every positive ``factor`` times (one scan + explode, not n unions),
    every negative once."""
    copies = F.when(F.col(label) == 1, F.lit(int(factor))).otherwise(F.lit(1))
    return _explode_copies(df.withColumn("_copies", copies))


def _explode_copies(df: DataFrame) -> DataFrame:
    # sequence(1, 0) is [1, 0] (trap T2): filter first
    return (
        df.filter(F.col("_copies") > 0)
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
        .drop("_copies")
    )


def balance(df: DataFrame, neg_ratio: float = 0.5, seed=42, groups: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Keep the total N. Negatives: ``int(N * neg_ratio)`` sampled;
    positives: ``q`` full copies each plus ``r`` sampled extra copies where
    ``q, r = divmod(N - negatives, N1)``. Raises (lazily, inside the job)
    when there is no positive or too few negatives, as the reference does."""
    g = list(groups)
    stats = (df.groupBy(*g) if g else df).agg(
        F.count(F.lit(1)).alias("_N"),
        F.count_if(F.col(label) == 1).alias("_N1"),
        F.count_if(F.col(label) == 0).alias("_N0"),
    )
    stats = stats.withColumn("_neg_t", F.floor(F.col("_N").cast("double") * F.lit(float(neg_ratio))).cast("long"))
    stats = stats.withColumn("_pos_t", F.col("_N") - F.col("_neg_t"))
    stats = stats.withColumn(
        "_check",
        F.when(F.col("_N1") == 0, F.raise_error(F.lit("balanced sampling needs at least one positive")))
        .when(
            F.col("_neg_t") > F.col("_N0"),
            F.raise_error(F.lit("balanced sampling: negative target larger than the number of negatives")),
        )
        .otherwise(F.lit(True)),
    )
    stats = stats.select(
        *g,
        "_neg_t",
        F.when(F.col("_check"), F.floor(F.col("_pos_t") / F.col("_N1")).cast("long")).alias("_q"),
        F.pmod(F.col("_pos_t"), F.greatest(F.col("_N1"), F.lit(1))).alias("_r"),
    )
    d = _attach(df, stats, g, bool(g)).filter(F.col(label).isin(0, 1))
    # one grouped pass over both classes: positives draw r extra copies,
    # negatives draw neg_t rows
    d = d.withColumn("_target", F.when(F.col(label) == 1, F.col("_r")).otherwise(F.col("_neg_t")))
    d = flag_top_n(d, [*g, label], seed=seed, n_col="_target", few=not g)
    copies = F.when(F.col(label) == 1, F.col("_q") + F.col("_sel").cast("int")).otherwise(F.col("_sel").cast("int"))
    d = d.withColumn("_copies", copies).drop("_sel", "_target")
    return _explode_copies(d).drop("_q", "_r", "_neg_t")


def normal(df: DataFrame) -> DataFrame:
    """Unchanged (one copy of every row)."""
    return _with_copy(df)


def resample(df: DataFrame, strategy: str, seed=42, groups: Sequence[str] = (), **kw) -> DataFrame:
    """Dispatch by strategy name; unknown names raise."""
    if strategy == "undersample":
        return undersample(df, kw.get("ratio", 0.7), seed, groups)
    if strategy == "oversample":
        return oversample(df, kw.get("factor", 2))
    if strategy == "balanced":
        return balance(df, kw.get("neg_ratio", 0.5), seed, groups)
    if strategy == "normal":
        return normal(df)
    raise ValueError(f"Unsupported strategy: {strategy!r}")


# ------------------------------------------------- copies instead of rows


def cell_copies(
    df: DataFrame,
    cells: Sequence[tuple[str, int]],
    ratio: float = 0.7,
    factor: int = 2,
    neg_ratio: float = 0.5,
    key: str = "example_id",
    label: str = "label",
    out: str = "copies",
) -> DataFrame:
    """R1-R5 for many (strategy, seed) cells at once, as a column: ``out`` is an
    array with the number of copies of the row in each cell's sample (0: not in
    it), the same that :func:`resample` gives as rows. Rows are neither copied
    nor moved: all cells' cut-off places come from one grouped pass over keys
    and labels, two per cell, and each row compares its own hashes with them.

    A cell whose sample can't be drawn (R3 without a positive or with too few
    negatives) has 0 copies everywhere; rows of other labels have 0 too."""
    for strategy, _ in cells:
        if strategy not in STRATEGIES:
            raise ValueError(f"Unsupported strategy: {strategy!r}")
    lab = F.col(label)
    drawn = [(i, strategy, seed) for i, (strategy, seed) in enumerate(cells) if strategy in ("undersample", "balanced")]
    n0 = n1 = n = 0
    cuts = {}
    if drawn:
        keys = materialize(df.select(key, label), "sample_keys")
        n0, n1, n = keys.agg(F.count_if(lab == 0), F.count_if(lab == 1), F.count(F.lit(1))).first()
        neg_t = math.floor(n * float(neg_ratio))
        under = round(float(ratio) * n0)  # (half to even, as in R1)
        spec = F.array(
            *[
                F.struct(
                    F.lit(i).alias("_cell"),
                    F.lit(sd).alias("_seed"),
                    F.lit(n1 if st == "undersample" else (n - neg_t) % max(n1, 1)).cast("long").alias("_t1"),
                    F.lit(under if st == "undersample" else neg_t).cast("long").alias("_t0"),
                )
                for i, st, sd in drawn
            ]
        )
        d = keys.where(lab.isin(0, 1)).select("*", F.explode(spec).alias("_c")).select(key, label, "_c.*")
        d = d.withColumn("_target", F.when(lab == 1, F.col("_t1")).otherwise(F.col("_t0"))).withColumn("_h", hash_key(F.col("_seed"), key))
        g = ["_cell", label]
        _, _, cut, last = _cuts(d, g, "_h", (key,), None, None, 4, "_target")
        # a row per cell and class
        cuts = {(r["_cell"], r[label]): r for r in cut.select(*g, "_n").join(last, g, "left").collect()}

    def inside(i: int, y: int, seed: int) -> Column:
        cut = cuts.get((i, y))
        if cut is None or (cut["_last"] is None and cut["_n"] <= 0):
            return F.lit(0)
        if cut["_last"] is None:
            return F.lit(1)
        h, k = hash_key(seed, key), F.col(key)
        kept = (h < F.lit(cut["_last"]["h"])) | ((h == F.lit(cut["_last"]["h"])) & (k <= F.lit(cut["_last"]["k0"])))
        return kept.cast("int")

    def copies(i: int, strategy: str, seed: int) -> Column:
        if strategy == "normal":
            return F.when(lab.isin(0, 1), 1)
        if strategy == "oversample":
            return F.when(lab == 1, int(factor)).when(lab == 0, 1)
        if strategy == "undersample":
            return F.when(lab == 1, 1).when(lab == 0, inside(i, 0, seed))
        if not n1 or neg_t > n0:
            return F.lit(0)
        return F.when(lab == 1, F.lit((n - neg_t) // n1) + inside(i, 1, seed)).when(lab == 0, inside(i, 0, seed))

    made = [F.coalesce(copies(i, st, sd).cast("int"), F.lit(0)) for i, (st, sd) in enumerate(cells)]
    return df.withColumn(out, F.array(*made))


# ---------------------------------------------------------------- R6-R11


def shuffle_index(
    df: DataFrame,
    seed=42,
    keys: Sequence[str] = ("example_id", "copy_no"),
    groups: Sequence[str] = (),
    out: str = "idx",
    bucket_hex: int = 4,
) -> DataFrame:
    """Seeded full shuffle with a new 0-based index, no single-task
    window: index = rows in earlier hash buckets + rank inside the bucket.
    The bucket offset table has at most 16**bucket_hex rows per group."""
    g = list(groups)
    d = df.withColumn("_h", hash_key(seed, *keys)).withColumn("_b", F.substring("_h", 1, bucket_hex))
    counts = d.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    wo = (Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))).orderBy("_b")
    offs = counts.select(
        *g, "_b", (F.sum("_cnt").over(wo.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cnt")).alias("_off")
    )
    # without groups the offset table has at most 16**bucket_hex rows (a
    # proven bound); with groups its size is checked first
    d = d.join(F.broadcast(offs) if not g else _bounded_broadcast(offs), [*g, "_b"], "inner")
    w = Window.partitionBy(*g, "_b").orderBy("_h", *keys)
    return d.withColumn(out, F.col("_off") + F.row_number().over(w) - 1).drop("_h", "_b", "_off")


def head_n(df: DataFrame, n: int | None, order: Sequence[str] = ("example_id",)) -> DataFrame:
    """The first ``min(n, size)`` rows by key; NULL means all rows.
    ``orderBy + limit`` plans as TakeOrderedAndProject (per-partition top-n,
    then a merge of n rows per partition)."""
    if n is None:
        return df
    return df.orderBy(*order).limit(int(n))


def random_n(df: DataFrame, n: int, seed=42) -> DataFrame:
    """N rows without replacement, capped at the size."""
    return top_n(df, [], n, seed)


def sample_per_group(df: DataFrame, group: str, n: int, seed=42, keys=("example_id",)) -> DataFrame:
    """An independent n-row sample per group; the group id is part of
    the hash key so each group draws its own rows."""
    d = df.withColumn("_h", hash_key(seed, group, *keys))
    return (
        flag_top_n(d, [group], n, seed, keys, hash_col="_h")
        .filter(F.col("_sel"))
        .drop("_sel", "_h")
    )


def inspect(df: DataFrame, template: str, n: int = 5, seed=42, pred: str = "pred_label") -> DataFrame:
    """For one template, n labelled rows (exact hash sample, capped)
    plus every row without a label; ``kind`` tells them apart."""
    t = df.filter(F.col("template") == template)
    labelled = random_n(t.filter(F.col(pred).isNotNull()), n, seed).withColumn("kind", F.lit("labelled"))
    missing = t.filter(F.col(pred).isNull()).withColumn("kind", F.lit("no_label"))
    return labelled.unionByName(missing)


def length_batches(
    df: DataFrame, batch_size: int, seed=42, mega: int = 50, length_col: str = "n_tokens", keys=("example_id", "copy_no")
) -> DataFrame:
    """Random blocks of ``batch_size * mega`` rows (from the R6 index),
    each sorted by length (longest first), cut into batches. Each window
    partition is one block, so tasks stay bounded."""
    d = shuffle_index(df, seed, keys)
    block = F.floor(F.col("idx") / F.lit(batch_size * mega)).cast("long")
    d = d.withColumn("block", block)
    w = Window.partitionBy("block").orderBy(F.col(length_col).desc(), F.col("idx"))
    d = d.withColumn("_rn", F.row_number().over(w))
    return d.withColumn(
        "batch", F.col("block") * mega + F.floor((F.col("_rn") - 1) / F.lit(batch_size)).cast("long")
    ).drop("_rn")
