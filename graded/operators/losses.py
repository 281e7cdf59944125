"""Losses over token sequences (V10, V11): logits and labels per token, labels
of ``IGNORE_INDEX`` left out of the loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graded.functions.arrays import IGNORE_INDEX, cross_entropy, focal


def token_rows(df: DataFrame, logits: str, labels: str) -> DataFrame:
    """One row per token: label, ce (0 where the label is ignored)."""
    tokens = df.select(F.explode(F.arrays_zip(F.col(logits).alias("lg"), F.col(labels).alias("y"))).alias("t"))
    kept = F.col("t.y") != IGNORE_INDEX
    ce = F.when(kept, cross_entropy(F.col("t.lg"), F.col("t.y"))).otherwise(F.lit(0.0))
    return tokens.select(F.col("t.y").alias("label"), ce.alias("ce"))


def token_weight(label: str, weights: dict[int, float]) -> Column:
    """The weight of a label token; all other tokens weigh 1."""
    out = F.lit(1.0)
    for token, w in weights.items():
        out = F.when(F.col(label) == token, F.lit(float(w))).otherwise(out)
    return out


def token_losses(df: DataFrame, logits: str, labels: str, weights: dict[int, float], gamma: float = 2.0) -> DataFrame:
    """One row: n_tokens, n_kept, focal_loss (plain mean over all tokens, an
    ignored one adding 0) and weighted_ce (sum w*ce / sum w over kept ones)."""
    rows = token_rows(df, logits, labels).withColumn("w", token_weight("label", weights))
    kept = F.col("label") != IGNORE_INDEX
    return rows.agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.count_if(kept).alias("n_kept"),
        F.avg(focal("ce", "w", gamma)).alias("focal_loss"),
        (F.sum(F.when(kept, F.col("w") * F.col("ce"))) / F.sum(F.when(kept, F.col("w")))).alias("weighted_ce"),
    )
