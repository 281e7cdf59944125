"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text.
A text is cut into windows of ``WINDOW`` words; each window is compressed with
either dictionary, and the difference of the two lengths says which side's
text it shares more with. A text's features are its mean difference and the
shares of windows whose difference reaches each of ``STEPS``; a logistic model
calibrated on labelled rows that trained no dictionary turns them into a score.

What a dictionary is trained on are the character n-grams that tell its class
from the other by the G² statistic of document counts, each at least ``ODDS``
(or ``ORDINARY_ODDS``) times as common there, none inside another; a dictionary of whole random texts
would mostly hold what both classes share. The least G² is one of ``LEAST_G2``,
chosen by the loss on the calibration rows. All windows have the same prefix,
which compresses alike under both dictionaries, so that short windows too are
stored compressed and their lengths compare.

Fitting uses a bounded sample of labelled rows: at most ``SAMPLE`` of each
class, texts of at most ``SAMPLE_CHARS`` characters, in the order of a hash of
the id; half of them train the dictionaries, half calibrate. Scoring covers
every whole text. A score depends on the text alone.

Nulls: a null text counts as empty and scores as one without windows. A null
doc_id is never held out and never labelled. Labels that are null, or that
aren't 0 or 1, aren't used. Repeated rows stay repeated rows. Without labelled
rows of both classes every text gets the share of toxic rows (0.0 if there are
no labels). Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, ship_package, unboxed

SAMPLE = 3000  # labelled rows of each class
SAMPLE_CHARS = 20_000  # longer texts aren't in the sample
GRAMS = (4, 5, 6, 7)  # characters
ODDS = 20  # as common in toxic texts
LEAST_G2 = (14.0, 25.0, 40.0, 60.0, 90.0)
ORDINARY_ODDS = 2  # ordinary text has few n-grams that toxic text lacks
ORDINARY_G2 = 10.8
MOST_GRAMS = 400
WINDOW = 4  # words
STEPS = (1, 3, 4, 5)  # bytes
LEVEL = 3
REJECT = 0.7  # score from which a document is toxic
PREFIX = b"#" * 64
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def windows_of(text: str, size: int = WINDOW) -> list[bytes]:
    words = words_of(text)
    return [(" " + " ".join(words[i : i + size]) + " ").encode() for i in range(0, len(words), size)]


def _gram_counts(texts: list[str]) -> Counter:
    """In how many texts each n-gram of a word (with its edges) occurs."""
    counts: Counter = Counter()
    for text in texts:
        found = set()
        for word in set(words_of(text)):
            edged = f" {word} "
            for n in GRAMS:
                found.update([edged[i : i + n] for i in range(len(edged) - n + 1)])
        counts.update(found)
    return counts


def _told_apart(
    own: Counter, n_own: int, other: Counter, n_other: int, odds: float
) -> list[tuple[float, str]]:
    """N-grams typical of the own class with their G², largest first."""
    grams = [g for g, x in own.items() if x >= 3 and x * (n_other or 1) > odds * n_own * (other[g] + 0.5)]
    if not grams:
        return []
    x = np.array([own[g] for g in grams], dtype=float)
    z = np.array([other[g] for g in grams], dtype=float)
    p = (x + z) / (n_own + n_other)

    def part(k: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            a = np.where(k > 0, k * np.log(k / n / p), 0.0)
            b = np.where(k < n, (n - k) * np.log((1 - k / n) / (1 - p)), 0.0)
        return a + b

    g2 = 2 * (part(x, n_own) + part(z, n_other))
    return sorted(zip(g2.tolist(), grams, strict=True), key=lambda s: (-s[0], -len(s[1]), s[1]))


def _pick(ranked: list[tuple[float, str]], least: float) -> list[str]:
    """The best n-grams, none of which holds another."""
    out: list[str] = []
    for g2, gram in ranked:
        if g2 < least or len(out) == MOST_GRAMS:
            break
        if not any(gram in o or o in gram for o in out):
            out.append(gram)
    return out


def train_dictionary(grams: list[str]) -> bytes:
    """Dictionary content: the most telling n-grams last, where matches are
    cheapest. Never shorter than the format's least length."""
    return "".join(reversed(grams)).encode().rjust(8, b"\0")


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]  # the intercept last
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    constant: float | None = None  # the score of every text, without a fit


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        settings = zstandard.ZstdCompressionParameters.from_level(
            LEVEL,
            write_content_size=False,
            write_checksum=False,
            write_dict_id=False,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            min_match=5,
            window_log=15,
            hash_log=13,
            chain_log=13,
        )

        def lengths(content: bytes):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=settings)
            return zstandard.ZstdCompressor(dict_data=d, compression_params=settings).compress

        self._toxic, self._ordinary = lengths(model.toxic), lengths(model.ordinary)

    def features(self, text: str) -> np.ndarray:
        toxic, ordinary = self._toxic, self._ordinary
        diff = np.array([len(ordinary(w)) - len(toxic(w)) for w in (PREFIX + x for x in windows_of(text))] or [0])
        return np.array([diff.mean(), *[(diff >= s).mean() for s in STEPS], np.log1p(len(diff))])

    def score(self, text: str) -> float:
        m = self.model
        if m.constant is not None:
            return m.constant
        x = (self.features(text) - np.array(m.centre)) / np.array(m.scale)
        z = float(x @ np.array(m.weights[:-1]) + m.weights[-1])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic fit by Newton steps; the intercept last."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (y - p) - penalty @ w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """Fit on texts of either class, in a fixed order."""
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    if len(toxic) < 4 or len(ordinary) < 4:
        share = len(toxic) / max(1, len(toxic) + len(ordinary))
        return Model(b"", b"", (), (), (), constant=share)
    train = toxic[::2], ordinary[::2]
    rows = toxic[1::2] + ordinary[1::2]
    y = np.array([1.0] * len(toxic[1::2]) + [0.0] * len(ordinary[1::2]))
    a, b = _gram_counts(train[0]), _gram_counts(train[1])
    for_toxic = _told_apart(a, len(train[0]), b, len(train[1]), ODDS)
    for_ordinary = _told_apart(b, len(train[1]), a, len(train[0]), ORDINARY_ODDS)
    ordinary_content = train_dictionary(_pick(for_ordinary, ORDINARY_G2))
    best: tuple[float, Model] | None = None
    for least in LEAST_G2:
        blank = Model(train_dictionary(_pick(for_toxic, least)), ordinary_content, (), (), ())
        scorer = Scorer(blank)
        x = np.array([scorer.features(t) for t in rows])
        centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        x = (x - centre) / scale
        # the loss on rows that this half of the rows' fit hasn't seen
        loss = 0.0
        for fold in (0, 1):
            seen = np.arange(len(y)) % 2 == fold
            w = _logistic(x[seen], y[seen])
            z = np.clip(x[~seen] @ w[:-1] + w[-1], -30, 30)
            loss += float(np.sum(np.logaddexp(0, z) - y[~seen] * z))
        w = _logistic(x, y)
        model = Model(blank.toxic, blank.ordinary, tuple(w), tuple(centre), tuple(scale))
        if best is None or loss < best[0]:
            best = (loss, model)
    return best[1]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of the labelled rows that aren't held out."""
    picked = None
    for value in (1, 0):
        some = (
            labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
            .where((F.col("toxic") == value) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
            .distinct()
            .orderBy(F.xxhash64("doc_id"), "doc_id")
            .limit(SAMPLE)
        )
        picked = some if picked is None else picked.unionAll(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(
        F.length("text") <= SAMPLE_CHARS
    )
    # at most twice SAMPLE ids: a proven bound
    rows = (
        texts.join(F.broadcast(picked), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        .limit(2 * SAMPLE)
        .collect()
    )
    both = {r["doc_id"] for r in rows if r["toxic"]} & {r["doc_id"] for r in rows if not r["toxic"]}
    of = lambda v: [r["text"] for r in rows if r["toxic"] == v and r["doc_id"] not in both]
    return fit(of(1), of(0))


def score(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.Series([scorer.score(t or "") for t in texts], dtype="float64")

    return run(text)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    ship_package(docs.sparkSession)
    model = fit_on(docs, labels)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id").cast("long")).alias("held_out"),
        score(F.coalesce(F.col("text"), F.lit("")), model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= REJECT).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The same columns, without the rows that are predicted toxic. A null text
    is scored as an empty one; equal texts go together; an empty table stays
    empty."""
    ship_package(docs.sparkSession)
    model = fit_on(docs, labels)
    rows = boxed(docs, score=score(F.coalesce(F.col("text"), F.lit("")), model))
    return unboxed(rows.where(F.col("score") < REJECT), docs.columns)
