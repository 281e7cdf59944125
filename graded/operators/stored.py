"""A fitted sweep cell as a stored model, and the scorer's plug-in for it
(M4, F4, X4).

The model is one file in the shared folder, named by the digest of its bytes:
written under a temporary name through Hadoop's file system and renamed when it
is whole, so a reader never sees a part of it and equal models are one file.
Executors fetch it with Spark's own file distribution (any file system that
Spark reads), check its digest, and keep it for the life of the Python worker.
"""

from __future__ import annotations

import hashlib
import io
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graded.operators import bayes as B
from graded.operators.encode import tokens
from graded.sources.versions import Files

MAX_WORDS = 1024  # the model's context


def store(sweep: B.Sweep, cell: int, folder: str, template: str = "") -> str:
    """Write one fitted cell, for prompts of ``template``, into ``folder``;
    returns the file's path. ``BUCKETS`` numbers at most pass the driver."""
    spark = sweep.coefs.sparkSession
    if sweep.cells[cell].bias is None:
        raise ValueError(f"cell {cell} has no model")
    own = F.col(f"w{sweep.cells[cell].column}").alias("w")
    weights = np.zeros(B.BUCKETS, np.int64)
    for row in sweep.coefs.select("bucket", own).where("w != 0").collect():
        weights[row["bucket"]] = row["w"]
    body = io.BytesIO()
    np.save(body, np.append(weights, B.shifts(sweep, {"": template})["", cell]), allow_pickle=False)
    raw = body.getvalue()
    path = f"{folder.rstrip('/')}/{hashlib.sha256(raw).hexdigest()}.npy"
    Files(spark, path).publish(path, raw)  # (a file of that name holds the same bytes)
    return path


def word_buckets(text, max_words: int = MAX_WORDS) -> Column:
    """What the stored model reads of a text (null for a null one): its words,
    and one beyond the context of a longer one, which tells that it is."""
    return F.transform(F.slice(tokens(text), 1, max_words + 1), B.bucket)


@dataclass(frozen=True)
class StoredModel:
    """Plug-in for :func:`graded.operators.scoring.score` over rows with
    ``words`` (:func:`word_buckets`). It fails on a row without a text and on
    one beyond its context; those rows get the fallback and their error."""

    name: str
    max_words: int = MAX_WORDS

    output = T.StructType([T.StructField("answer", T.StringType()), T.StructField("margin", T.LongType())])
    fallback = {"answer": "", "margin": None}

    def cache_key(self) -> str:
        return f"{self.name}-{self.max_words}"

    def load(self) -> Loaded:
        with open(SparkFiles.get(self.name), "rb") as f:
            raw = f.read()
        if hashlib.sha256(raw).hexdigest() != self.name.removesuffix(".npy"):
            raise OSError(f"{self.name} isn't whole")
        numbers = np.load(io.BytesIO(raw), allow_pickle=False)
        return Loaded(numbers[:-1], int(numbers[-1]), self.max_words)


@dataclass(frozen=True)
class Loaded:
    weights: np.ndarray
    shift: int
    max_words: int

    def predict(self, batch: pd.DataFrame) -> pd.DataFrame:
        margins = []
        for words in batch["words"]:
            if words is None:
                raise ValueError("no text")
            if len(words) > self.max_words:
                raise ValueError(f"more than {self.max_words} words")
            margins.append(self.shift + int(self.weights[np.asarray(words, np.int64)].sum()))
        return pd.DataFrame({"answer": [B.spoken_text(m) for m in margins], "margin": margins})

    fallback = StoredModel.fallback


def plug_in(spark: SparkSession, path: str, max_words: int = MAX_WORDS) -> StoredModel:
    """The stored model at ``path``, made known to all executors."""
    spark.sparkContext.addFile(path)
    return StoredModel(path.rsplit("/", 1)[-1], max_words)


def scored(df: DataFrame, model: StoredModel, keep: list[str], text: str = "text") -> DataFrame:
    """F4 with a stored model: ``keep``, answer, margin, error."""
    from graded.operators.scoring import score

    return score(df.withColumn("words", word_buckets(text, model.max_words)).select(*keep, "words"), model, keep)
