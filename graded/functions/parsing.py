"""Completion extraction and answer parsing (X1-X10) as Column expressions.

All parsers stay inside whole-stage codegen; none needs Python. Label codes:
1 = ``ja``/biased, 0 = ``nee``/not biased, -1 = invalid (X9 returns NULL
instead, as the reference does).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graded.functions.text import (
    WS_CLASS,
    _c,
    keep_alnum_space,
    norm,
    rstrip_chars,
    strip,
    strip_chars,
    words,
)

# Fixed values used by the parsers.
YES, NO = "ja", "nee"
STRICT_TRAILING = ".,!?;:\"')]}»"  # X7: trailing characters dropped
NARROW_STRIP = ".,!?\"'"  # X3: characters stripped from each word
QUOTES = "\"'"  # X2: quote characters stripped from both ends


def completion_slice(full, prompt) -> Column:
    """Characters after ``len(prompt)``, stripped; no prefix check."""
    return strip(F.substring(_c(full), F.length(_c(prompt)) + 1, 1 << 30))


def completion_robust(full, prompt, text) -> Column:
    """Prompt prefix -> rest; else after first occurrence of the example
    text (one leading ``"`` dropped); else whole text. Then strip quotes."""
    full, prompt, text = _c(full), _c(prompt), _c(text)
    after_prompt = strip(F.substring(full, F.length(prompt) + 1, 1 << 30))
    pos = F.call_function("locate", text, full)  # 1-based, 0 when absent; '' is found at 1
    rest = strip(F.substring(full, pos + F.length(text), 1 << 30))
    rest = F.when(rest.startswith('"'), strip(F.substring(rest, 2, 1 << 30))).otherwise(rest)
    out = (
        F.when(full.startswith(prompt), after_prompt)
        .when(pos > 0, rest)
        .otherwise(strip(full))
    )
    return strip_chars(out, QUOTES)


def narrow(c, max_words: int = 10, tail: int = 3) -> Column:
    """Long answers (> max_words words) shrink to the last word that is
    ja/nee after stripping punctuation, else to the last ``tail`` words
    (lower-cased). Shorter answers are unchanged."""
    c = _c(c)
    ws = words(F.lower(c))
    cleaned = F.transform(ws, lambda w: strip_chars(w, NARROW_STRIP))
    hits = F.filter(cleaned, lambda w: w.isin(YES, NO))
    last_hit = F.element_at(hits, -1)
    tail_words = F.array_join(F.slice(ws, -tail, tail), " ")
    return F.when(F.size(words(c)) <= max_words, c).otherwise(
        F.when(F.size(hits) > 0, last_hit).otherwise(tail_words)
    )


def _code(word: Column, yes: str = YES, no: str = NO) -> Column:
    return F.when(word == yes, 1).when(word == no, 0).otherwise(-1)


def parse_last_word(c) -> Column:
    """Last whitespace word exactly ja/nee; empty or NULL -> -1."""
    w = F.element_at(F.concat(F.array(F.lit("")), words(norm(c))), -1)
    return F.coalesce(_code(w), F.lit(-1)).cast("int")


def parse_lenient(c, whole_word: bool = False) -> Column:
    """Substring test after strip, lower and punctuation removal; exactly
    one of ja/nee present -> 1/0, otherwise -1 (D1: ``jaarlijks`` counts as ja
    unless ``whole_word``)."""
    c = _c(c)
    t = keep_alnum_space(norm(c))
    if whole_word:
        ws = words(t)
        has_yes, has_no = F.array_contains(ws, YES), F.array_contains(ws, NO)
    else:
        has_yes, has_no = t.contains(YES), t.contains(NO)
    out = F.when(c.isNull() | (c == ""), -1).when(has_yes & ~has_no, 1).when(has_no & ~has_yes, 0)
    return out.otherwise(-1).cast("int")


def parse_strict(c) -> Column:
    """Strip, lower, drop all trailing ``.,!?;:"')]}»``; must then equal
    ja/nee exactly (no second strip, so ``ja .`` is invalid)."""
    c = _c(c)
    t = rstrip_chars(norm(c), STRICT_TRAILING)
    return F.when(c.isNull() | (c == ""), -1).otherwise(_code(t)).cast("int")


def parse_biased(c) -> Column:
    """Full match ``niet[- ]biased`` -> 0; prefix ``biased`` -> 1; else -1
    (case-insensitive, after strip)."""
    t = strip(c)
    out = (
        F.when(t.rlike(r"(?iu)^niet[- ]biased\z"), 0)
        .when(t.rlike(r"(?iu)^biased"), 1)
        .otherwise(-1)
    )
    return F.coalesce(out, F.lit(-1)).cast("int")


def parse_last_digit(c) -> Column:
    """Last ``0``/``1`` character anywhere, else NULL."""
    d = F.regexp_extract(_c(c), r"(?s)^.*([01])", 1)
    return F.when(d != "", d.cast("int"))


def reasoning(c) -> Column:
    """Text before the last ``0``/``1``, stripped; whole text if none."""
    c = _c(c)
    before = strip(F.regexp_extract(c, r"(?s)^(.*)[01][^01]*$", 1))
    return F.when(c.rlike("[01]"), before).otherwise(c)


def label_word(label, yes: str = YES, no: str = NO) -> Column:
    """1 -> ``yes`` word, anything else -> ``no`` word."""
    return F.when(_c(label) == 1, F.lit(yes)).otherwise(F.lit(no))


def with_parsed(df, answer_col: str, parser: str = "lenient", out: str = "pred"):
    fn = PARSERS[parser]
    return df.withColumn(out, fn(F.col(answer_col)))


PARSERS = {
    "last_word": parse_last_word,
    "lenient": parse_lenient,
    "strict": parse_strict,
    "biased": parse_biased,
}

__all__ = [
    "WS_CLASS",
    "completion_slice",
    "completion_robust",
    "narrow",
    "parse_last_word",
    "parse_lenient",
    "parse_strict",
    "parse_biased",
    "parse_last_digit",
    "reasoning",
    "label_word",
    "PARSERS",
]
