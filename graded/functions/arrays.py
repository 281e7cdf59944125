"""Array, encoding and loss expressions (V2-V11, P17) on native arrays.

All of these are higher-order SQL functions (``transform``, ``aggregate``,
``zip_with``, ``slice``) that run inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from graded.functions.text import _c

IGNORE_INDEX = -100


def causal_example(prompt_ids, target_ids, cap: int = 512) -> tuple[Column, Column, Column]:
    """V2: ids = prompt ++ target, mask of ones, labels = -100 x len(prompt)
    ++ target, then all three cut at ``cap`` (a prompt at the cap loses its
    target)."""
    p, t = _c(prompt_ids), _c(target_ids)
    ids = F.concat(p, t)
    mask = F.array_repeat(F.lit(1), F.size(ids))
    labels = F.concat(F.array_repeat(F.lit(IGNORE_INDEX), F.size(p)), t)
    return F.slice(ids, 1, cap), F.slice(mask, 1, cap), F.slice(labels, 1, cap)


def pad_to(c, n: int, pad_id: int = 0) -> tuple[Column, Column]:
    """V3: truncate/pad to exactly ``n`` and build the attention mask."""
    c = F.slice(_c(c), 1, n)
    k = F.size(c)
    pad = F.array_repeat(F.lit(pad_id), F.greatest(F.lit(0), F.lit(n) - k))
    mask = F.concat(F.array_repeat(F.lit(1), k), F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(n) - k)))
    return F.concat(c, pad), mask


def pad_to_col(c, n: Column, pad_value: int) -> Column:
    """Pad an array on the right to a per-row length column (V6)."""
    c = _c(c)
    return F.concat(c, F.array_repeat(F.lit(pad_value), F.greatest(F.lit(0), n - F.size(c))))


def mask_labels(c, pad_id: int = 0) -> Column:
    """V4: pad id -> -100."""
    return F.transform(_c(c), lambda x: F.when(x == pad_id, F.lit(IGNORE_INDEX)).otherwise(x))


def unmask_labels(c, pad_id: int = 0) -> Column:
    """V5: -100 -> pad id (before decoding)."""
    return F.transform(_c(c), lambda x: F.when(x == IGNORE_INDEX, F.lit(pad_id)).otherwise(x))


def argmax(c) -> Column:
    """0-based index of the largest value, first on ties."""
    c = _c(c)
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def mean_pool(c, positions: int, dim: int, mask=None) -> Column:
    """V7: a flat array read as ``positions x dim``, averaged over positions
    (all positions, padding included, as the reference does; ``mask`` is an
    optional 0/1 array for the masked variant)."""
    c = _c(c)

    def at(p, d):
        return F.element_at(c, p * dim + d + 1).cast("double")

    def dim_mean(d):
        if mask is None:
            s = F.aggregate(F.sequence(F.lit(0), F.lit(positions - 1)), F.lit(0.0), lambda acc, p: acc + at(p, d))
            return s / F.lit(float(positions))
        m = _c(mask)
        s = F.aggregate(
            F.sequence(F.lit(0), F.lit(positions - 1)),
            F.lit(0.0),
            lambda acc, p: acc + at(p, d) * F.element_at(m, p + 1).cast("double"),
        )
        return s / F.greatest(F.aggregate(m, F.lit(0.0), lambda a, x: a + x.cast("double")), F.lit(1.0))

    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), dim_mean)


def linear_head(x, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """V8: ``logits = W x + b`` with W and b as literals (dropout is off when
    scoring). Each logit is summed in feature order."""
    x = _c(x)
    outs = []
    for row, b in zip(weights, bias):
        w = F.array(*[F.lit(float(v)) for v in row])
        dot = F.aggregate(F.zip_with(w, x, lambda a, v: a * v), F.lit(0.0), lambda acc, v: acc + v)
        outs.append(dot + F.lit(float(b)))
    return F.array(*outs)


def cross_entropy(logits, label) -> Column:
    """V9: per-row cross-entropy with a stable log-sum-exp."""
    lg = _c(logits)
    m = F.array_max(lg)
    lse = m + F.log(F.aggregate(lg, F.lit(0.0), lambda acc, v: acc + F.exp(v - m)))
    return lse - F.element_at(lg, _c(label) + 1)


def focal(ce, alpha, gamma: float = 2.0) -> Column:
    """``alpha * (1 - p_t)^gamma * ce`` with ``p_t = exp(-ce)``."""
    ce = _c(ce)
    return _c(alpha) * F.pow(F.lit(1.0) - F.exp(-ce), F.lit(float(gamma))) * ce
