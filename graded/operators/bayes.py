"""Text classifiers of a whole sweep, fitted in closed form in one pass (M1-M3).

Every cell of the sweep (strategy x seed) is a multinomial naive Bayes model
over hashed words. All cells are fitted together: the train split is read once,
each row carries its number of copies in every cell's sample
(:func:`graded.operators.sampling.cell_copies`; no text is copied), and one
grouped aggregation gives the word counts of all cells and classes. The result
is one table with a row per hash bucket and a column of coefficients per cell,
so scoring any number of cells is one pass too: words are looked up in that
table (``BUCKETS`` rows, broadcast) and added up map-side per row.

Coefficients are whole millionths of a nat, so sums don't depend on the order
of rows, and the same model comes out of any engine with the same counts. The
counts of a class are smoothed with ``MU`` words of both classes' words, so a
bucket without words says nothing.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graded.operators.encode import tokens
from graded.operators.sampling import cell_copies
from graded.session import materialize

BUCKET_HEX = 4
BUCKETS = 16**BUCKET_HEX
SCALE = 1_000_000
MU = 1000.0


def bucket(word) -> Column:
    """Hash bucket of a word."""
    word = F.col(word) if isinstance(word, str) else word
    return F.conv(F.substring(F.md5(word), 1, BUCKET_HEX), 16, 10).cast("int")


@dataclass(frozen=True)
class Cell:
    """A cell of a sweep: its model's column, the rows drawn of each class, the
    log odds of the classes (millionths; None without a model) and ``ok`` or
    why there is no model."""

    strategy: str
    seed: int
    column: int
    n0: int
    n1: int
    bias: int | None
    status: str


@dataclass(frozen=True)
class Sweep:
    """``coefs``: bucket, w0, w1, ... (a column per model; buckets without words
    are left out). Cells whose samples don't depend on the seed share one."""

    coefs: DataFrame
    cells: list[Cell]
    n_columns: int

    def table(self) -> DataFrame:
        """strategy, seed, n0, n1, status, cell (its number): a row per cell."""
        rows = [(c.strategy, c.seed, c.n0, c.n1, c.status, i) for i, c in enumerate(self.cells)]
        schema = "strategy string, seed int, n0 long, n1 long, status string, cell int"
        return self.coefs.sparkSession.createDataFrame(rows, schema)


def fit_sweep(train: DataFrame, cells: Sequence[tuple[str, int]], weighted: bool = False, text: str = "text") -> Sweep:
    """``train``: example_id, label (0, 1), text. ``weighted`` gives the classes
    of every cell balanced weights (A13: rows / (classes x rows of the class))."""
    models: dict[tuple, tuple[str, int]] = {}  # what a sample depends on -> a cell that has it
    column = []
    for st, sd in cells:
        same = (st, sd if st in ("undersample", "balanced") else None)
        models.setdefault(same, (st, sd))
        column.append(list(models).index(same))
    k = range(len(models))
    rows = cell_copies(train.where(F.col("label").isin(0, 1)), list(models.values()))
    # (expressions in SQL: a column call each is slow to build for many models)
    copies = [F.expr(f"sum(cast(copies[{i}] as bigint)) as c{i}") for i in k]
    counts = materialize(
        rows.select("label", "copies", F.explode(tokens(text)).alias("word"))
        .groupBy(bucket("word").alias("bucket"), "label")
        .agg(*copies),
        "sweep_counts",
    )
    # numbers of each class and model, two rows each
    drawn = {r["label"]: r for r in rows.groupBy("label").agg(*copies).collect()}
    totals = {r["label"]: r for r in counts.groupBy("label").agg(*[F.expr(f"sum(c{i}) as c{i}") for i in k]).collect()}
    of = lambda found, y, i: int(found[y][f"c{i}"]) if y in found else 0
    n = {(y, i): of(drawn, y, i) for y in (0, 1) for i in k}
    weight = {
        (y, i): (n[0, i] + n[1, i]) / (2.0 * n[y, i]) if weighted and n[y, i] else 1.0 for y in (0, 1) for i in k
    }
    total = {(y, i): float(of(totals, y, i)) * weight[y, i] for y in (0, 1) for i in k}
    both = counts.groupBy("bucket").agg(
        *[F.expr(f"coalesce(max(if(label = {y}, c{i}, null)), 0) as c{i}_{y}") for i in k for y in (0, 1)]
    )

    def coef(i: int) -> str:
        if not total[0, i] + total[1, i]:
            return "0L"
        c = {y: f"(cast(c{i}_{y} as double) * {weight[y, i]!r}D)" for y in (0, 1)}
        share = f"({c[0]} + {c[1]}) / {total[0, i] + total[1, i]!r}D"
        log = {y: f"ln(({c[y]} + {MU!r}D * ({share})) / ({total[y, i]!r}D + {MU!r}D))" for y in (0, 1)}
        return f"if({share} > 0, cast(floor(({log[1]} - {log[0]}) * {float(SCALE)!r}D + 0.5D) as bigint), 0L)"

    coefs = both.selectExpr("bucket", *[f"{coef(i)} as w{i}" for i in k])
    described = []
    for (st, sd), i in zip(cells, column, strict=True):
        own = n[0, i], n[1, i]
        bias = None
        if all(own):
            bias = math.floor((math.log(own[1] * weight[1, i]) - math.log(own[0] * weight[0, i])) * SCALE + 0.5)
        status = "ok" if all(own) else "failed: one class only" if any(own) else "failed: the sample can't be drawn"
        described.append(Cell(st, sd, i, *own, bias, status))
    return Sweep(materialize(coefs, "sweep_coefs"), described, len(models))


def _looked_up(words: DataFrame, sweep: Sweep) -> DataFrame:
    """Rows with ``_word``, and the coefficients of their buckets."""
    table = F.broadcast(sweep.coefs.withColumnRenamed("bucket", "_bucket"))  # at most BUCKETS rows
    return words.withColumn("_bucket", bucket("_word")).join(table, "_bucket", "left")


def _sums(sweep: Sweep) -> list[Column]:
    return [F.expr(f"coalesce(sum(w{i}), 0L) as w{i}") for i in range(sweep.n_columns)]


def margins(df: DataFrame, sweep: Sweep, keep: Sequence[str], prompts: Mapping[str, str] | None = None, text: str = "text") -> DataFrame:
    """One row per row of ``df`` (told apart by its ``keep`` columns) and fitted
    cell: ``keep``, strategy, seed, margin (log odds of class 1, millionths).

    ``prompts`` (name -> template with a placeholder in braces) adds
    prompt_name: the model reads the rendered prompt. A template's words are
    the same for all rows, so they are looked up once, and texts only once
    whatever the number of prompts and cells."""
    words = df.select(*keep, F.explode_outer(tokens(text)).alias("_word"))
    sums = _looked_up(words, sweep).groupBy(*keep).agg(*_sums(sweep))
    text_of = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    spec = [
        f"struct({text_of(p)} as prompt_name, {text_of(c.strategy)} as strategy, {c.seed} as seed, w{c.column} + {shift}L as margin)"
        for (p, i), shift in shifts(sweep, prompts).items()
        for c in [sweep.cells[i]]
    ]  # prompts x cells
    schema = "array<struct<prompt_name:string,strategy:string,seed:int,margin:bigint>>"
    rows = sums.select(*keep, F.expr(f"explode(cast(array({', '.join(spec)}) as {schema})) as _c"))
    name = [F.col("_c.prompt_name")] if prompts else []
    return rows.select(*keep, *name, "_c.strategy", "_c.seed", "_c.margin")


def shifts(sweep: Sweep, prompts: Mapping[str, str] | None = None) -> dict[tuple[str, int], int]:
    """What every fitted cell (by its number) adds under every prompt."""
    spark = sweep.coefs.sparkSession
    plain = dict(prompts or {"": ""})
    known = {}
    if any(outside(t).strip() for t in plain.values()):
        words = spark.createDataFrame([(n, outside(t)) for n, t in plain.items()], "prompt_name string, template string")
        words = words.select("prompt_name", F.explode(tokens("template")).alias("_word"))
        known = {r["prompt_name"]: r for r in _looked_up(words, sweep).groupBy("prompt_name").agg(*_sums(sweep)).collect()}
    return {
        (p, i): c.bias + (int(known[p][f"w{c.column}"]) if p in known else 0)
        for p in plain
        for i, c in enumerate(sweep.cells)
        if c.bias is not None
    }


def outside(template: str) -> str:
    """A template's words without its placeholder."""
    for name in ("{text}", "{item}"):
        template = template.replace(name, " ")
    return template


def decide(margin) -> Column:
    """Class of a margin: 1 above 0, else 0."""
    margin = F.col(margin) if isinstance(margin, str) else margin
    return (margin > 0).cast("int")


# How sure (nats) a spoken answer must be for each of its forms.
FORMS = ((8, "{word}"), (4, "{WORD}."), (2, "Het antwoord is: {word}"), (0.5, "{word}, dit geldt jaarlijks"), (0, "misschien {word}"))


def spoken_text(margin: int, yes: str = "ja", no: str = "nee") -> str:
    """:func:`spoken` of one number."""
    if margin == 0:
        return "misschien"
    word = yes if margin > 0 else no
    form = next(form for least, form in FORMS if abs(margin) >= int(least * SCALE))
    return form.replace("{WORD}", word.upper()).replace("{word}", word)


def spoken(margin, yes: str = "ja", no: str = "nee") -> Column:
    """The answer text of a margin, worded by how sure the model is; a margin
    of exactly 0 is undecided."""
    margin = F.col(margin) if isinstance(margin, str) else margin
    out = F.when(margin == 0, F.lit("misschien"))
    for least, form in FORMS:
        for word, side in ((yes, margin > 0), (no, margin < 0)):
            text = form.replace("{WORD}", word.upper()).replace("{word}", word)
            out = out.when(side & (F.abs(margin) >= F.lit(int(least * SCALE)).cast("long")), F.lit(text))
    return out
