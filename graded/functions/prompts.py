"""Prompt templates and rendering (P2-P6, J2 template table).

Templates are inserted with ``replace`` (never ``regexp_replace``: ``$1`` and
``\\`` in a sentence must stay literal, trap T5). Only the template is
interpreted; braces inside the example text stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graded.functions.text import _c

# ---------------------------------------------------------------------------
# Prompt wording that must equal the reference word for word.
# ---------------------------------------------------------------------------
_DEFINITION = (
    "Je bent een expert op het gebied van bias, stereotypering en discriminatie. "
    "Je taak is om zinnen te classificeren volgens de volgende definitie: een zin bevat bias "
    "als de zin een stereotype, uitsluiting, machtsverhoudingen of vooroordelen bevat, "
    "die impliciet of expliciet kunnen zijn, en die gaan over een afgebakende groep personen, "
    "OF als de zin een woord bevat dat vermeden moet worden vanwege bias. "
)

# Evaluation template "same" (also the fine-tune template of the evaluators).
TRAIN_TEMPLATE = (
    _DEFINITION
    + "Geef de volgende zin een label, antwoord alleen met 'ja' voor biased of 'nee' voor niet-biased. "
    + 'De zin is: "{text}" '
)

# Evaluation template "CoT".
COT_TEMPLATE = (
    _DEFINITION
    + "Denk hardop en stap-voor-stap. "
    + "Sluit je antwoordt altijd af met het label, 'nee' (niet-biased) of 'ja' (biased). "
    + "Beperk je antwoord tot maximaal 100 tokens. "
    + "De zin is: '{text}'"
)

# Template of the simple fine-tune script (training-time evaluation, E4).
FINETUNE_TEMPLATE = (
    _DEFINITION
    + "Geef de volgende zin een label: 'ja' voor biased of 'nee' voor niet-biased. "
    + "Antwoord uitsluitend met 'ja' (biased) of 'nee' (niet-biased). Geen verdere uitleg. "
    + 'De zin is: "{text}"'
)

# Prompt-variant evaluation (E3) has its own wording for "same" and "CoT".
_LABEL_ASK = "Geef de volgende zin een label: 'ja' voor biased of 'nee' voor niet-biased. "
_CLOSE_WITH_LABEL = "Sluit je antwoordt altijd af met het label, 'nee' (niet-biased) of 'ja' (biased). "
VARIANT_SAME_TEMPLATE = _DEFINITION + _LABEL_ASK + _CLOSE_WITH_LABEL + 'De zin is: "{text}"'
VARIANT_COT_TEMPLATE = _DEFINITION + _LABEL_ASK + "Denk hardop en stap-voor-stap. " + _CLOSE_WITH_LABEL + 'De zin is: "{text}"'

_SWEEP_HEAD = (
    "Je bent een expert op het gebied van bias, stereotypering en discriminatie detectie.\n"
    "Je taak is om zinnen te classificeren volgens de volgende definitie:\n"
    "een zin bevat bias als de zin een stereotype, uitsluiting, machtsverhoudingen of vooroordelen bevat,\n"
    "die impliciet of expliciet kunnen zijn, en die gaan over een af te bakenen groep personen,\n"
    "OF als een zin een woord bevat wat moet worden vermeden omdat het bias bevat.\n"
)
_SWEEP_TAIL = "De zin die beoordeeld moet worden: “{item}”\n"

# Zero-shot sweep templates (E6): name, body, placeholder, max new tokens.
SWEEP_TEMPLATES = (
    (
        "template_1",
        _SWEEP_HEAD
        + "Rederneer stap-voor-stap waarom deze zin wel of neit bias bevat.\n"
        + "Sluit je antwoordt altijd af met een label:\n"
        + "0 voor niet-biased of 1 voor biased.\n"
        + _SWEEP_TAIL,
        "{item}",
        5,
    ),
    (
        "template_2",
        _SWEEP_HEAD
        + "Rederneer stap-voor-stap waarom deze zin wel of niet bias bevat.\n"
        + "Sluit je antwoordt altijd af met het label, 0 (niet-biased) of 1 (biased).\n"
        + _SWEEP_TAIL,
        "{item}",
        5,
    ),
    (
        "template_3",
        _SWEEP_HEAD
        + "Denk hardop en stap-voor stap.\n"
        + "Sluit je antwoordt altijd af met het label, 0 (niet-biased) of 1 (biased).\n"
        + _SWEEP_TAIL,
        "{item}",
        5,
    ),
    (
        "template_4",
        _SWEEP_HEAD
        + "Denk na en schrijf je stap-voor-stap redenatie uit.\n"
        + "Sluit je antwoordt altijd af met het label, 0 (niet-biased) of 1 (biased).\n"
        + _SWEEP_TAIL,
        "{item}",
        300,
    ),
)

# Few-shot prompt (P4): header, shot line format, footer.
FEW_SHOT_HEADER = (
    "Je bent een expert op het gebied van bias, stereotypering en discriminatie.\n"
    "Een zin bevat bias (label 1) als er een stereotype, uitsluiting,\n"
    "machtsverhoudingen of vooroordelen over een groep in voorkomt.\n"
    "Anders is het niet-biased (label 0).\n\n"
    "Voorbeelden:\n"
)
FEW_SHOT_LINE = "Zin: “{shot}” → {label}\n"
FEW_SHOT_FOOTER = "\nNu jij:\nZin: “{item}”\nAntwoord alleen met 0 of 1:\n"
FEW_SHOTS = (
    ("Minaretten waren het symbool bij uitstek van de overheersende macht van de islam.", 1),
    ("De aandacht is daarbij in de eerste plaats gericht op de grootste vervoerstromen en knelpunten.", 0),
    ("Een persoonlijke zaakbehandelaar heeft gemiddeld met 5 tot 10 ouders op hetzelfde moment contact.", 1),
    ("Huurders van seniorenwoningen hoeven niet per definitie aangemoedigd te worden door te stromen naar een andere (senioren)woning.", 0),
)

TEMPLATE_SCHEMA = T.StructType(
    [
        T.StructField("template", T.StringType(), False),
        T.StructField("body", T.StringType(), False),
        T.StructField("placeholder", T.StringType(), False),
        T.StructField("max_new_tokens", T.IntegerType(), True),
    ]
)


def render_prompt(template, text, placeholder: str = "{text}") -> Column:
    """Insert the row text into a template (literal or column)."""
    tpl = F.lit(template) if isinstance(template, str) else template
    return F.replace(tpl, F.lit(placeholder), _c(text))


def choose_template(name: str, family: str = "current") -> str:
    """``same`` -> the family's training-style template, ``cot`` (any
    case) -> its chain-of-thought template, anything else is itself a
    template. Families: ``current`` (E1) and ``variants`` (E3)."""
    same, cot = (TRAIN_TEMPLATE, COT_TEMPLATE) if family == "current" else (VARIANT_SAME_TEMPLATE, VARIANT_COT_TEMPLATE)
    if name == "same":
        return same
    if name.lower() == "cot":
        return cot
    return name


def max_new_tokens_for(template: str) -> int:
    """6 new tokens with the training template, 200 otherwise."""
    return 6 if template == TRAIN_TEMPLATE else 200


def sweep_templates(spark: SparkSession) -> DataFrame:
    """Template table for E6/J2; four rows, safe to broadcast."""
    return spark.createDataFrame(list(SWEEP_TEMPLATES), TEMPLATE_SCHEMA)


def template_ids_array() -> Column:
    """The sweep templates as a literal array of structs, used to fan rows
    out over templates with ``explode`` (bounded x4, no join)."""
    return F.array(
        *[
            F.struct(
                F.lit(n).alias("template"),
                F.lit(b).alias("body"),
                F.lit(p).alias("placeholder"),
                F.lit(m).alias("max_new_tokens"),
            )
            for n, b, p, m in SWEEP_TEMPLATES
        ]
    )


def verbalise(df: DataFrame, yes: str = "ja", no: str = "nee", out: str = "target") -> DataFrame:
    """Label -> label word (1 -> yes, else -> no)."""
    return df.withColumn(out, F.when(F.col("label") == 1, F.lit(yes)).otherwise(F.lit(no)))


def few_shot_block(shots=None) -> Column:
    """The shot lines of P4 as one string. ``shots`` is None (the fixed four
    examples), a list of (sentence, label), or a small DataFrame
    (shot_no, text, label) that is folded into a scalar subquery (one row,
    evaluated once; no join)."""
    if shots is None:
        shots = FEW_SHOTS
    if isinstance(shots, (list, tuple)):
        return F.lit(
            "".join(
                FEW_SHOT_LINE.replace("{shot}", s).replace("{label}", str(lab)) for s, lab in shots
            )
        )
    lines = shots.select(
        "shot_no",
        F.replace(
            F.replace(F.lit(FEW_SHOT_LINE), F.lit("{shot}"), F.col("text")),
            F.lit("{label}"),
            F.col("label").cast("string"),
        ).alias("line"),
    )
    return lines.agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("shot_no", "line"))), lambda s: s["line"]
            ),
            "",
        )
    ).scalar()


def render_few_shot(text, shots=None) -> Column:
    """Four labelled examples before the query sentence."""
    body = F.concat(F.lit(FEW_SHOT_HEADER), few_shot_block(shots), F.lit(FEW_SHOT_FOOTER))
    return render_prompt(body, text, "{item}")
