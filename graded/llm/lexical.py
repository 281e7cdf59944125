"""Ranked lexical search by an Aho-Corasick scan of the documents.

There is no index of the documents. The terms of all query items go into one
automaton; its patterns are guarded by a boundary on either side, so a term
matches whole terms only. A scan runs every text through it once and counts
each term's occurrences (tf) directly, along with the text's length in terms;
the automaton's outputs map to the items that hold the term. The counts of a
document are a short row, written once; from them come the number of documents
that hold a term, the totals, and in a second pass the scores. A task keeps
only its ten best documents of each item, and the ten best of all tasks follow
from those in two steps, so no task ever sees all scores of an item.

The automaton is broadcast. Items are dealt into blocks whose terms have
``BLOCK_BYTES`` bytes at most (one item is the least), and each block is a scan
of its own, so what is broadcast doesn't grow with the number of items.

Terms are maximal runs of characters other than ASCII ones that are neither
letter nor digit; only A-Z are lower-cased.

Nulls: a null text has no terms; a null id (of a document, of an item) is an
id of its own, and sorts last among equal scores. Rows of one item id are one
item with the terms of all of them; repeated document rows are documents of
their own. Texts and items without terms, and empty tables, give no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship_package, written

BEST = 10  # documents of an item
BLOCK_BYTES = 8_000_000  # of the terms of a block
CELLS = 4_000_000  # scores at a time: documents x items
PARTS = 64  # parts in which the best of an item are looked for at first

#: Each byte of a text in UTF-8: A-Z in lower case, boundaries as spaces.
NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def automaton(terms: list[bytes]):
    """Outputs the number of the term that ends there. Bytes are taken as
    Latin-1 characters, so one character is one byte."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        made.add_word(f" {term.decode('latin-1')} ", number)
    made.make_automaton()
    return made


def term_counts(made, text: bytes) -> tuple[int, Counter]:
    """Number of terms of the text, and occurrences of each of the automaton's."""
    plain = text.translate(NORMAL)
    guarded = f" {plain.decode('latin-1')} "
    return len(plain.split()), Counter(map(itemgetter(1), made.iter(guarded)))


def scan(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n (terms of the text), terms (numbers), tfs of every document
    that has terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = automaton(terms)
        for batch in batches:
            keep, n, numbers, tfs = [], [], [], []
            for row, text in enumerate(batch.column(1)):
                size, found = term_counts(made, text.as_py() or b"")
                if size:
                    keep.append(row)
                    n.append(size)
                    numbers.append(np.fromiter(found.keys(), np.int32, len(found)))
                    tfs.append(np.fromiter(found.values(), np.int64, len(found)))
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(keep, pa.int64())),
                    pa.array(n, pa.int64()),
                    pa.array(numbers, pa.list_(pa.int32())),
                    pa.array(tfs, pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "terms", "tfs"],
            )

    ship_package(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


class Best:
    """The best documents of each item so far."""

    def __init__(self, items: int, best: int):
        self.items, self.best = items, best
        self.item = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)
        self.doc = np.zeros(0, np.int64)
        self.least = np.ones(items, np.int64)  # score that a newcomer needs

    def add(self, scores: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        """``scores``: documents x items."""
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        item, score = np.append(self.item, item), np.append(self.score, scores[row, item])
        null, doc = np.append(self.null, null[row]), np.append(self.doc, doc[row])
        order = np.lexsort((doc, null, -score, item))
        begin = np.searchsorted(item[order], np.arange(self.items))
        order = order[np.arange(len(order)) - begin[item[order]] < self.best]
        self.item, self.score, self.null, self.doc = item[order], score[order], null[order], doc[order]
        sizes = np.bincount(self.item, minlength=self.items)
        last = np.cumsum(sizes) - 1
        full = sizes == self.best
        self.least[full] = np.maximum(1, self.score[last[full]])


def ranked(counts: DataFrame, weights: np.ndarray, postings: list[list[int]], items: list, n_docs: int, n_terms: int, best: int) -> DataFrame:
    """item_id, doc_id, score: the best documents of each item that each task
    has. ``postings``: numbers of the items that hold a term."""
    sizes = np.array([len(p) for p in postings], np.int64)
    begins = np.cumsum(sizes) - sizes
    flat = np.array([i for p in postings for i in p], np.int64)
    step = max(1, CELLS // max(1, len(items)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Best(len(items), best)
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                rows = batch.num_rows
                m = np.array([10 + 90 * n * n_docs // n_terms for n in batch.column(1).to_pylist()], np.int64)
                lengths = np.asarray(batch.column(2).value_lengths(), np.int64)
                owner = np.repeat(np.arange(rows), lengths)
                term = batch.column(2).flatten().to_numpy()
                tf = batch.column(3).flatten().to_numpy()
                part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
                times = sizes[term]
                ends = np.cumsum(times)
                at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[term] - (ends - times), times)
                # (sums of whole numbers far below 2^53 are exact in doubles)
                cells = np.bincount(
                    np.repeat(owner, times) * len(items) + flat[at],
                    weights=np.repeat(part, times),
                    minlength=rows * len(items),
                )
                ids = batch.column(0)
                null = ids.is_null().to_numpy(zero_copy_only=False)
                held.add(cells.reshape(rows, -1).astype(np.int64), null, ids.fill_null(0).to_numpy())
        yield pa.record_batch(
            [
                pa.array([items[i] for i in held.item], pa.int64()),
                pa.array(held.doc, mask=held.null),
                pa.array(held.score),
            ],
            ["item_id", "doc_id", "score"],
        )

    return counts.select("doc_id", "n", "terms", "tfs").mapInArrow(run, "item_id long, doc_id long, score long")


def blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """``items`` (item_id, terms) with a block number, and how many blocks: so
    many that each has ``BLOCK_BYTES`` bytes of terms or a single item."""
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.length(t) + 2)
    sized = items.select("item_id", "terms", size.alias("size"))
    n = 1
    while True:
        dealt = sized.withColumn("block", F.pmod(F.xxhash64(F.coalesce("item_id", F.lit(-1))), F.lit(n)))
        over = dealt.groupBy("block").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
        most = over.where("n > 1").agg(F.max("s")).first()[0] or 0
        if most <= BLOCK_BYTES:
            return dealt, n
        n *= max(2, math.ceil(most / BLOCK_BYTES))


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms (distinct, as bytes) of every item that has terms."""
    plain = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = F.regexp_extract_all(plain, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    return (
        items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.array_distinct(runs)).alias("term"))
        .groupBy("item_id")
        .agg(F.collect_set(F.col("term").cast("binary")).alias("terms"))
    )


def search(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """The ``best`` highest-scoring documents of each item: item_id, rank (from
    1), doc_id, score; scores of 0 are left out."""
    spark: SparkSession = docs.sparkSession
    dealt, n_blocks = blocks(written(item_terms(items), "lexical-items"))
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in range(n_blocks):
        held = dealt.where(F.col("block") == block).select("item_id", "terms").collect()  # bounded by BLOCK_BYTES
        if held:
            out = out.unionAll(_search_block(docs, held, best))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS))
    few = out.withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))
    )
    return (
        few.where(F.col("rank") <= best)
        .withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
        .where(F.col("rank") <= best)
        .select("item_id", "rank", "doc_id", "score")
    )


def _search_block(docs: DataFrame, held: list, best: int) -> DataFrame:
    items = [row["item_id"] for row in held]
    numbers: dict[bytes, int] = {}
    postings: list[list[int]] = []
    for i, row in enumerate(held):
        for term in sorted(bytes(t) for t in row["terms"]):
            if term not in numbers:
                numbers[term] = len(numbers)
                postings.append([])
            postings[numbers[term]].append(i)
    counts = written(scan(docs, list(numbers)), "lexical-counts")
    totals = counts.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not totals["docs"]:
        return docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    n_docs, n_terms = totals["docs"], totals["terms"]
    weights = np.zeros(len(numbers), np.int64)  # (as many rows as the block has terms)
    for row in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[row["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row["count"] + 1)))
    return ranked(counts, weights, postings, items, n_docs, n_terms, best)
