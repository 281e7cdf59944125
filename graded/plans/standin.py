"""Deterministic stand-in answers (no model can run here).

They play the role of model generations so that every parser and metric can
run over the whole corpus. The same rule is written in DuckDB SQL in
``graded.plans.oracle`` and in pandas in ``graded.operators.scoring``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graded.functions.text import _c


def _hex(key: Column, i: int) -> Column:
    return F.substring(F.md5(key), i, 1)


def _ans_key(example_id, salt=None) -> Column:
    if salt is None:
        return F.concat(F.lit("ans:"), _c(example_id).cast("string"))
    return F.concat(F.lit("ans:"), _c(salt), F.lit(":"), _c(example_id).cast("string"))


def standin_word(example_id, label, salt=None) -> Column:
    h1 = _hex(_ans_key(example_id, salt), 1)
    agree = (h1 < F.lit("b")) == (_c(label) == 1)
    return F.when(h1 >= F.lit("e"), F.lit("misschien")).when(agree, F.lit("ja")).otherwise(F.lit("nee"))


def standin_answer(example_id="example_id", label="label", salt=None) -> Column:
    """FIXTURES §3: word, then one of five surface forms chosen by h2. A
    ``salt`` column (a run name) gives every run of a sweep its own answers."""
    h2 = _hex(_ans_key(example_id, salt), 2)
    w = standin_word(example_id, label, salt)
    return (
        F.when(h2 < F.lit("4"), w)
        .when(h2 < F.lit("8"), F.concat(F.upper(w), F.lit(".")))
        .when(h2 < F.lit("b"), F.concat(F.lit("Het antwoord is: "), w))
        .when(h2 < F.lit("e"), F.concat(w, F.lit(", dit geldt jaarlijks")))
        .otherwise(F.concat(w, F.lit(" .")))
    )


def standin_generation(prompt="prompt", example_id="example_id", label="label", salt=None) -> Column:
    """Causal-LM style output: the prompt followed by the answer."""
    return F.concat(_c(prompt), F.lit(" "), standin_answer(example_id, label, salt))


def standin_biased_answer(example_id="example_id", label="label") -> Column:
    """Generative (E5) label words: ``biased``/``niet-biased`` plus variants."""
    h = F.md5(F.concat(F.lit("gen:"), _c(example_id).cast("string")))
    h1, h2 = F.substring(h, 1, 1), F.substring(h, 2, 1)
    agree = (h1 < F.lit("b")) == (_c(label) == 1)
    word = F.when(agree, F.lit("biased")).otherwise(F.lit("niet-biased"))
    return (
        F.when(h1 >= F.lit("e"), F.lit("onbekend"))
        .when(h2 < F.lit("8"), word)
        .when(h2 < F.lit("c"), F.upper(word))
        .when(h2 < F.lit("e"), F.concat(word, F.lit("ness")))
        .otherwise(F.concat(word, F.lit(".")))
    )


def standin_digit_answer(template="template", example_id="example_id", label="label", cap="max_new_tokens") -> Column:
    """Zero-shot sweep (E6) outputs with a digit label; the template's
    token cap keeps only the first ``cap`` words (D14)."""
    key = F.concat(F.lit("dig:"), _c(template), F.lit(":"), _c(example_id).cast("string"))
    h = F.md5(key)
    h1, h2 = F.substring(h, 1, 1), F.substring(h, 2, 1)
    d = F.when((h1 < F.lit("b")) == (_c(label) == 1), F.lit("1")).otherwise(F.lit("0"))
    full = (
        F.when(h2 < F.lit("4"), F.concat(F.lit("Label: "), d))
        .when(
            h2 < F.lit("8"),
            F.concat(
                F.lit("De zin bevat "),
                F.when(d == "1", F.lit("wel")).otherwise(F.lit("geen")),
                F.lit(" bias, dus "),
                d,
                F.lit("."),
            ),
        )
        .when(h2 < F.lit("c"), F.lit("geen label"))
        .otherwise(F.concat(F.lit("in 2010 dus "), d, F.lit(" .")))
    )
    return F.array_join(F.slice(F.split(full, " "), 1, _c(cap)), " ")
