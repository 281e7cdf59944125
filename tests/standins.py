"""Model plug-ins for tests of the scorer."""

import hashlib

import pandas as pd
from pyspark.sql import types as T


class StandInGenerator:
    """Causal-LM stand-in: ``full_text = prompt + ' ' + answer`` with the
    answer rule of FIXTURES §3 (the same rule as ``graded.plans.standin``)."""

    output = T.StructType([T.StructField("full_text", T.StringType())])
    fallback = {"full_text": ""}

    def cache_key(self) -> str:
        return "standin-generator"

    def load(self):
        return self

    @staticmethod
    def answer(example_id: int, label: int) -> str:
        h = hashlib.md5(f"ans:{example_id}".encode()).hexdigest()
        h1, h2 = h[0], h[1]
        word = "misschien" if h1 >= "e" else ("ja" if (h1 < "b") == (label == 1) else "nee")
        if h2 < "4":
            return word
        if h2 < "8":
            return word.upper() + "."
        if h2 < "b":
            return "Het antwoord is: " + word
        if h2 < "e":
            return word + ", dit geldt jaarlijks"
        return word + " ."

    def predict(self, batch: pd.DataFrame) -> pd.DataFrame:
        answers = [self.answer(int(i), int(lab)) for i, lab in zip(batch["example_id"], batch["label"])]
        return pd.DataFrame({"full_text": batch["prompt"].str.cat(pd.Series(answers, index=batch.index), sep=" ")})


class FlakyGenerator(StandInGenerator):
    """Stand-in that fails on some rows (md5 of the id starts with ``0``),
    to exercise the per-row error fallback (X4)."""

    def cache_key(self) -> str:
        return "flaky-generator"

    def predict(self, batch: pd.DataFrame) -> pd.DataFrame:
        for i in batch["example_id"]:
            if hashlib.md5(f"err:{int(i)}".encode()).hexdigest()[0] == "0":
                raise RuntimeError(f"generation failed for example {int(i)}")
        return super().predict(batch)
