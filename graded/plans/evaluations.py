"""Evaluation flows E1-E7, each one lazy plan from the corpus to metrics.

Every flow is expressed with native columns; the stand-in generation takes
the place of the model (``graded.operators.scoring`` runs a pluggable model
through ``mapInPandas`` when one is available).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graded.functions import parsing as X
from graded.functions.prompts import (
    FINETUNE_TEMPLATE,
    TRAIN_TEMPLATE,
    choose_template,
    render_prompt,
    template_ids_array,
)
from graded.functions.text import strip
from graded.operators import metrics as A
from graded.plans import standin


def generations(corpus: DataFrame, template: str = TRAIN_TEMPLATE) -> DataFrame:
    """P2 + stand-in model: prompt, full output and the model's answer."""
    return corpus.withColumn("prompt", render_prompt(template, "text")).withColumn(
        "full_text", standin.standin_generation("prompt")
    )


def e1_current(corpus: DataFrame, by=("lang",), prompt: str = "same") -> DataFrame:
    """X1 slice -> X6 lenient parser -> A9, grouped by ``by``."""
    g = generations(corpus, choose_template(prompt))
    g = g.withColumn("answer", X.completion_slice("full_text", "prompt"))
    g = g.withColumn("pred", X.parse_lenient("answer"))
    return A.evaluate(g, list(by))


def e2_strict(corpus: DataFrame, by=("split",)) -> DataFrame:
    """X2 robust extraction -> X3 narrowing -> X7 strict parser -> A9."""
    g = generations(corpus, TRAIN_TEMPLATE)
    g = g.withColumn("answer", X.narrow(X.completion_robust("full_text", "prompt", "text")))
    g = g.withColumn("pred", X.parse_strict("answer"))
    return A.evaluate(g, list(by))


def e3_prompt_variants(corpus: DataFrame, prompts=("same", "CoT"), by=("split",)) -> DataFrame:
    """For each prompt variant, X2 -> X3 -> X6 -> A9. Rows fan out over
    the (fixed, small) list of prompts with ``explode``; no join."""
    arr = F.array(
        *[F.struct(F.lit(p).alias("prompt_name"), F.lit(choose_template(p, "variants")).alias("tpl")) for p in prompts]
    )
    g = corpus.select("*", F.explode(arr).alias("p")).select("*", "p.prompt_name", "p.tpl").drop("p")
    g = g.withColumn("prompt", render_prompt(F.col("tpl"), "text")).withColumn(
        "full_text", standin.standin_generation("prompt", salt=F.md5("prompt"))
    )
    g = g.withColumn("answer", X.narrow(X.completion_robust("full_text", "prompt", "text")))
    g = g.withColumn("pred", X.parse_lenient("answer"))
    return A.evaluate(g, ["prompt_name", *by])


def e4_training_time(corpus: DataFrame, by=("split",)) -> DataFrame:
    """Label words decoded from the target, X5 on both sides -> A10."""
    g = corpus.withColumn("prompt", render_prompt(FINETUNE_TEMPLATE, "text"))
    g = g.withColumn("decoded_pred", standin.standin_answer())
    g = g.withColumn("decoded_label", X.label_word("label"))
    g = g.withColumn("pred", X.parse_last_word("decoded_pred")).withColumn(
        "label_parsed", X.parse_last_word("decoded_label")
    )
    return A.evaluate_two_sided(g, list(by), label="label_parsed", pred="pred")


def e5_generative(corpus: DataFrame, by=("split",)) -> DataFrame:
    """E5: ``biased``/``niet-biased`` words, X8 on both sides -> A8."""
    g = corpus.withColumn("decoded_pred", F.lower(standin.standin_biased_answer()))
    g = g.withColumn("decoded_label", X.label_word("label", "biased", "niet-biased"))
    g = g.withColumn("pred", X.parse_biased("decoded_pred")).withColumn(
        "label_parsed", X.parse_biased("decoded_label")
    )
    return A.macro_with_invalid(g, list(by), label="label_parsed", pred="pred")


def e6_predictions(sample: DataFrame) -> DataFrame:
    """E6 prediction rows from a per-template sample (R9 output with columns
    template, body, placeholder, max_new_tokens, example_id, text, label)."""
    g = sample.withColumn("prompt", render_prompt(F.col("body"), "text", "{item}"))
    g = g.withColumn(
        "full_text", strip(standin.standin_digit_answer("template", "example_id", "label", "max_new_tokens"))
    )
    return g.select(
        "template",
        "example_id",
        "text",
        F.col("label").alias("true_label"),
        X.parse_last_digit("full_text").alias("pred_label"),
        X.reasoning("full_text").alias("reasoning"),
    )


def explode_templates(corpus: DataFrame) -> DataFrame:
    """Every example under every sweep template (bounded x4 fan-out)."""
    return corpus.select("*", F.explode(template_ids_array()).alias("t")).select(
        "*", "t.template", "t.body", "t.placeholder", "t.max_new_tokens"
    ).drop("t")
