"""Run names (P12), their parser (P13), log-row filter (P15) and the
performance string (P16)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graded.functions.text import _c

# Name parts used by the reference's save paths.
CAUSAL_MODEL = "aya-expanse-8b"
ENCODER_MODEL = "google/mt5-base"
ABBREVS = ("us", "os", "bl", "nm")
DEFAULT_SEED = 42


def fixed_decimals(value, places: int) -> Column:
    """A number with a fixed count of decimals and no thousands separators."""
    return F.replace(F.format_number(_c(value), places), F.lit(","), F.lit(""))


def strategy_abbrev(strategy) -> Column:
    s = _c(strategy)
    return (
        F.when(s == "undersample", "us")
        .when(s == "oversample", "os")
        .when(s == "balanced", "bl")
        .when(s == "normal", "nm")
    )


def causal_run_name(output_dir: str, strategy, seed, weighted=None) -> Column:
    """P12, fine-tune form: ``{dir}/aya-expanse-8b_{abbrev}[_WL]_seed{seed}``."""
    wl = F.when(_c(weighted), F.lit("_WL")).otherwise(F.lit("")) if weighted is not None else F.lit("")
    return F.concat(
        F.lit(f"{output_dir}/{CAUSAL_MODEL}_"), strategy_abbrev(strategy), wl, F.lit("_seed"), _c(seed).cast("string")
    )


def encoder_run_name(output_dir: str, strategy, best_f1, focal=None) -> Column:
    """P12, classifier form: ``{dir}/google-mt5-base_clf_{abbrev}_f1_{strategy}_{f1:.4f}[_focal]``
    (``/`` in the model name becomes ``-``)."""
    safe = ENCODER_MODEL.replace("/", "-")
    tail = F.when(_c(focal), F.lit("_focal")).otherwise(F.lit("")) if focal is not None else F.lit("")
    return F.concat(
        F.lit(f"{output_dir}/{safe}_clf_"),
        strategy_abbrev(strategy),
        F.lit("_f1_"),
        _c(strategy),
        F.lit("_"),
        fixed_decimals(best_f1, 4),
        tail,
    )


def parse_run(path) -> dict[str, Column]:
    """Basename, model, strategy abbreviation, loss variant, seed (no
    ``_seed`` -> 42, the driver default)."""
    base = F.element_at(F.split(_c(path), "/"), -1)
    abbrev = F.regexp_extract(base, r"_(us|os|bl|nm)(?:_|$)", 1)
    model = F.regexp_extract(base, r"^(.*?)_(?:clf_)?(?:us|os|bl|nm)(?:_|$)", 1)
    seed_txt = F.regexp_extract(base, r"_seed(\d+)", 1)
    loss = (
        F.when(base.contains("_WL"), F.lit("weighted"))
        .when(base.contains("_focal"), F.lit("focal"))
        .otherwise(F.lit("ce"))
    )
    return {
        "run_base": base,
        "model": F.nullif(model, F.lit("")),
        "strategy_abbrev": F.nullif(abbrev, F.lit("")),
        "loss": loss,
        "seed": F.coalesce(F.nullif(seed_txt, F.lit("")).cast("int"), F.lit(DEFAULT_SEED)),
    }


def keep_log_row(key) -> Column:
    """Drop metrics whose key has ``accuracy`` but not ``eval``."""
    k = _c(key)
    return ~(k.contains("accuracy") & ~k.contains("eval"))


def perf_string(f1, acc) -> Column:
    """``F1=x.xxxx, Acc=y.yyyy`` when accuracy is present (missing F1 -> 0)."""
    return F.when(
        _c(acc).isNotNull(),
        F.concat(
            F.lit("F1="),
            fixed_decimals(F.coalesce(_c(f1), F.lit(0.0)), 4),
            F.lit(", Acc="),
            fixed_decimals(acc, 4),
        ),
    )
