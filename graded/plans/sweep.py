"""The sweep grid (strategy x seed x prompt) over fitted models, and the
run tables derived from it (inputs of A16-A20).

The cells are naive Bayes models fitted on the train split, all of them in one
pass (:mod:`graded.operators.bayes`). Every example is scored by all of them in
one pass too, and the short answers (not the texts) fan out over the grid. One
grouped aggregation then evaluates every cell at once. A cell that could not be
fitted is a row of the run table with its status and no metrics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graded.functions import parsing as X
from graded.functions.naming import causal_run_name
from graded.functions.prompts import choose_template
from graded.operators import bayes as B
from graded.operators import metrics as A
from graded.operators.sampling import STRATEGIES

SEEDS = (12, 42, 45)
PROMPTS = ("same", "CoT")
MODELS_DIR = "./aya_saved_models/"
CELL = ["prompt_name", "checkpoint_path", "strategy", "seed"]


def grid(strategies=STRATEGIES, seeds=SEEDS) -> list[tuple[str, int]]:
    return [(st, sd) for st in strategies for sd in seeds]


def fit(corpus: DataFrame, **cells) -> B.Sweep:
    """All cells of the grid, fitted on the corpus' train split."""
    train = corpus.where(F.col("split") == "train").select("example_id", "label", "text")
    return B.fit_sweep(train, grid(**cells))


def sweep_rows(examples: DataFrame, models: B.Sweep, parser: str = "lenient", prompts: Sequence[str] = PROMPTS) -> DataFrame:
    """Every example under every fitted cell and prompt: its keys, the cell,
    the answer and the parsed prediction."""
    rows = B.margins(examples, models, ["example_id", "split", "label"], {p: choose_template(p) for p in prompts})
    rows = rows.withColumn("checkpoint_path", causal_run_name(MODELS_DIR, "strategy", "seed"))
    rows = rows.withColumn("answer", B.spoken("margin"))
    return rows.withColumn("pred", _parsed(parser))


def _parsed(parser: str):
    """E1 reads answers as they are (X6), E2 narrows them first."""
    return X.parse_lenient("answer") if parser == "lenient" else X.PARSERS[parser](X.narrow("answer"))


def run_table(examples: DataFrame, models: B.Sweep, parser: str = "lenient", prompts: Sequence[str] = PROMPTS) -> DataFrame:
    """A9 per cell (prompt_name, checkpoint_path, strategy, seed) in one
    aggregation, and a row without metrics for a cell that has no model."""
    done = A.evaluate(sweep_rows(examples, models, parser, prompts), CELL)
    names = F.explode(F.array(*[F.lit(p) for p in prompts])).alias("prompt_name")
    cells = models.table().select("strategy", "seed", "status", names)
    cells = cells.withColumn("checkpoint_path", causal_run_name(MODELS_DIR, "strategy", "seed"))
    return cells.join(done, CELL, "left").select(*CELL, "status", *A.A9_FIELDS)


def two_parsers(examples: DataFrame, models: B.Sweep, prompts: Sequence[str] = PROMPTS) -> DataFrame:
    """One sweep, both parsers on every answer."""
    rows = sweep_rows(examples, models, "lenient", prompts).withColumnRenamed("pred", "pred_lenient")
    return rows.withColumn("pred_strict", _parsed("strict"))
