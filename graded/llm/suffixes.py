"""Repeated passages by sparse suffix arrays.

A text is cut into words at white space. Of every ``SPAN`` consecutive
``GRAM``-word grams the one with the smallest hash is a minimiser; only
suffixes that begin at minimisers are kept, so equal passages keep suffixes at
the same places in them, wherever they stand. A passage of ``PASSAGE`` words
has a minimiser among its first ``SPAN`` words, and at least ``RIGHT`` words
follow from there. A suffix can therefore take part in a repeat only if its
first ``RIGHT`` words are those of another document's kept suffix: a count of
their hashes drops all other suffixes before any text moves.

What is left is dealt by that hash, so that suffixes with the same first
``RIGHT`` words meet in one task, and sorted by its words there: neighbours are
compared. For each number of words ``j`` to the left, suffixes that share
their next ``PASSAGE - j`` words are one run of neighbours; those of a run that
also share the ``j`` words before them are one passage of ``PASSAGE`` words, a
*class*: the documents that have it, the smallest of which names it. A passage
is looked at where its first minimiser lies, so in every document at the same
place in it and once. A match extends to the left and to the right as far as
its passages reach; the intervals of a document and class are joined to spans.

Runs of more than ``EDGE`` rows with the same first words don't take part in the
sort: there the hash of every passage whose first minimiser begins such a run is
made, and classes are found by grouping those hashes, however large the run.
(A passage's first minimiser depends on its words alone, so equal passages go
the same way, and both ways give the same rows.)

Nulls: a null text has no words; a null doc_id counts as an id of its own that
sorts first. Rows that repeat an id and a text are one document. Texts shorter
than a passage, and empty tables, give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_KEY, ship_package, sort_key, written

PASSAGE = 50  # words
SPAN = 32  # grams that a minimiser is taken from
GRAM = 5  # words
LEFT = SPAN - 1
RIGHT = PASSAGE - LEFT
EDGE = 50_000  # rows of a run that is sorted (30 MB); larger ones are counted by hashes
CHUNK = 30_000  # rows compared at a time, and at least one run
BITS = 24  # the bitmap of large runs has 2^BITS bits (2 MB)
MEMORY = 400_000  # remembered words, then the memory starts anew
BATCH = 2_000_000  # characters at a time, and at least one text
PLACES = 20_000  # suffixes cut out at a time (10 MB)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Words:
    """Hashes of the words of texts, in one array for all of them."""

    def __init__(self):
        self._memory: dict[str, int] = {}

    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text number) of each word."""
        split = pc.utf8_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self._memory) > MEMORY:
            self._memory.clear()
        known = self._memory
        found = list(map(known.get, distinct))
        for n, h in enumerate(found):
            if h is None:
                w = distinct[n]
                known[w] = found[n] = xxhash.xxh64_intdigest(w.encode())
        table = np.fromiter(found, dtype=np.uint64, count=len(found))
        at = coded.indices.to_numpy()
        owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
        empty = pc.equal(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
        if empty.any():
            kept = ~empty[at]
            at, owner = at[kept], owner[kept]
        return table[at], owner


def all_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words that :class:`Words` counts, of all texts in one array, and
    where each text's begin (one more entry than texts)."""
    split = pc.utf8_split_whitespace(texts)
    flat, begins = split.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
    kept = pc.not_equal(pc.binary_length(flat), 0)
    upto = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])
    return flat.filter(kept), upto[begins]


def words_of(text: str) -> list[str]:
    """The words of one text."""
    return all_words(pa.array([text], pa.large_string()))[0].to_pylist()


def minimisers(code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, minimiser's word) of every ``SPAN`` grams of one text."""
    n = len(code) - GRAM + 1
    if n < SPAN:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    gram = np.zeros(n, dtype=np.uint64)
    for j in range(GRAM):
        gram = gram * BASE + code[j : j + n]
    gram = _mix(gram)
    # the smallest of 1, 2, 4, ... grams from each on (the first of equal ones)
    low, at, width = gram, np.arange(n), 1
    while width < SPAN:
        step = min(width, SPAN - width)
        less = low[step:] < low[:-step]
        low, at, width = np.where(less, low[step:], low[:-step]), np.where(less, at[step:], at[:-step]), width + step
    first = np.flatnonzero(owner[: len(at)] == owner[SPAN + GRAM - 2 : SPAN + GRAM - 2 + len(at)])
    return first, at[first]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Rows of about ``BATCH`` characters at a time, with their texts (the
    third column; none: empty)."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + BATCH, "right")))
            some = batch.slice(a, b - a)
            yield some, pc.fill_null(some.column(2), "").cast(pa.large_string())
            a = b


def kept_suffixes(code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word indices at which suffixes are kept, and the least and the most words
    to the left of each with which a passage has its first minimiser there.
    (Those lie in a row, and depend on the passage's words alone.)"""
    start, at = minimisers(code, owner)
    begin = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
    last = np.append(begin[1:], len(at)) - 1
    return at[begin], at[begin] - start[last], at[begin] - start[begin]


def prefix_hashes(code: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each index on."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(code * _powers(BASE, len(code)), dtype=np.uint64)])
    return _mix((total[at + size] - total[at]) * _powers(INVERSE, len(code))[at])


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(
        sort_key(F.col("doc_id").cast("long")).alias("key"),
        F.xxhash64("text").alias("tie"),
        F.col("text").cast("string").alias("text"),
    )


def sample(rows: DataFrame) -> DataFrame:
    """key, tie, pos (word), lo, hi (words to the left), and a hash of the first
    ``RIGHT`` words of every kept suffix that has as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for some, texts in _batches(batches):
            code, owner = words.codes(texts)
            at, lo, hi = kept_suffixes(code, owner)
            fits = at + RIGHT <= len(code)
            fits[fits] = owner[at[fits]] == owner[at[fits] + RIGHT - 1]
            at, lo, hi = at[fits], lo[fits], hi[fits]
            begins = np.searchsorted(owner, np.arange(some.num_rows))
            who = pa.array(owner[at])
            yield pa.record_batch(
                [
                    some.column(0).take(who),
                    some.column(1).take(who),
                    pa.array((at - begins[owner[at]]).astype(np.int32)),
                    pa.array(lo.astype(np.int8)),
                    pa.array(hi.astype(np.int8)),
                    pa.array(prefix_hashes(code, at, RIGHT).view(np.int64)),
                ],
                ["key", "tie", "pos", "lo", "hi", "hash"],
            )

    return rows.mapInArrow(run, "key long, tie long, pos int, lo byte, hi byte, hash long")


def _document() -> Column:
    """A hash of a document (key, tie)."""
    return F.xxhash64("key", "tie")


def _bitmap(hashes: DataFrame) -> np.ndarray | None:
    """Bits of the leading ``BITS`` bits of each hash; None without hashes.
    At most 2^BITS / 64 rows are collected, whatever the number of hashes."""
    spot = F.shiftrightunsigned("hash", 64 - BITS)
    cells = (
        hashes.groupBy(F.shiftright(spot, 6).alias("cell"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned(hash, {64 - BITS}) & 63))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(2 ** (BITS - 6), dtype=np.uint64)
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
    return out if cells.num_rows else None


def _set(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash's bit is set."""
    spot = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    return (bitmap[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1) > 0


def passages(rows: DataFrame, bitmap: np.ndarray, docs: np.ndarray) -> DataFrame:
    """key, tie, start (word), hash, one, two (a hash of 128 bits): every passage
    of ``PASSAGE`` words in a document whose bit is in ``docs`` and whose first
    minimiser's ``RIGHT`` words are in ``bitmap``; ``hash`` is theirs. A bit set
    by another hash gives passages that the caller drops by ``hash``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        some_docs = (b.filter(pa.array(_set(docs, b.column(3).to_numpy().view(np.uint64)))) for b in batches)
        for some, texts in _batches(some_docs):
            code, owner = words.codes(texts)
            start, at = minimisers(code, owner)
            fits = start + PASSAGE <= len(code)
            start, at = start[fits], at[fits]
            fits = owner[start] == owner[start + PASSAGE - 1]
            start, at = start[fits], at[fits]
            hashes = prefix_hashes(code, at, RIGHT)
            hot = _set(bitmap, hashes)
            start, hashes = start[hot], hashes[hot].view(np.int64)
            begins = np.searchsorted(owner, np.arange(some.num_rows))
            one = prefix_hashes(code, start, PASSAGE).view(np.int64)
            two = prefix_hashes(_mix(code), start, PASSAGE).view(np.int64)
            for b in np.array_split(np.arange(len(start)), len(start) // 50_000 + 1):
                who = pa.array(owner[start[b]])
                yield pa.record_batch(
                    [
                        some.column(0).take(who),
                        some.column(1).take(who),
                        pa.array((start[b] - begins[owner[start[b]]]).astype(np.int32)),
                        pa.array(hashes[b]),
                        pa.array(one[b]),
                        pa.array(two[b]),
                    ],
                    ["key", "tie", "start", "hash", "one", "two"],
                )

    return rows.select("key", "tie", "text", _document().alias("doc")).mapInArrow(
        run, "key long, tie long, start int, hash long, one long, two long"
    )


FOUND = "key long, tie long, start int, end int, class_key long, class_tie long, class_start int, partner long"


def counted_passages(rows: DataFrame, kept: DataFrame, large: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """``FOUND``: the passages of large runs that two documents or more have.
    ``large``: the hashes of those runs, one for ``EDGE`` rows of ``kept`` at
    most; only texts with such a suffix are looked at."""
    # (written tables: texts are read once, and Spark can split a hot passage's
    # rows in the joins)
    hashes = F.broadcast(large.select("hash"))
    docs = _bitmap(kept.join(hashes, "hash", "left_semi").select(_document().alias("hash")))
    made = written(passages(rows, bitmap, docs).join(hashes, "hash", "left_semi").drop("hash"), "hot-passages")
    doc, place = F.struct("key", "tie"), F.struct("key", "tie", "start")
    groups = written(
        made.groupBy("one", "two")
        .agg(F.min(place).alias("low"), F.min(doc).alias("first"), F.max(doc).alias("last"))
        .where("first != last")
        .select("one", "two", "low"),
        "hot-groups",
    )
    members = made.join(groups, ["one", "two"])
    own = (F.col("key") == F.col("low.key")) & (F.col("tie") == F.col("low.tie"))
    second = written(members.where(~own).groupBy("one", "two").agg(F.min("key").alias("second")), "hot-seconds")
    return members.join(second, ["one", "two"]).select(
        "key",
        "tie",
        "start",
        (F.col("start") + PASSAGE).alias("end"),
        F.col("low.key").alias("class_key"),
        F.col("low.tie").alias("class_tie"),
        F.col("low.start").alias("class_start"),
        F.when(own, F.col("second")).otherwise(F.col("low.key")).alias("partner"),
    )


SUFFIX = "key long, tie long, pos int, lo byte, hi byte, hash long, right string, left string"


def cut_out(rows: DataFrame) -> DataFrame:
    """``rows``: key, tie, text, places (word index, lo, hi, hash). The words right of
    each place, ``PASSAGE`` at most, and those left of it, ``LEFT`` at most,
    nearest first."""

    def joined(words: pa.Array, begin: np.ndarray, count: np.ndarray, step: int) -> pa.Array:
        """``count`` words from each index on, ahead (``step`` 1) or back (-1)."""
        ends = np.cumsum(count)
        at = np.repeat(begin - step * (ends - count), count) + step * np.arange(ends[-1])
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], ends]), words.take(pa.array(at)))
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, texts in _batches(batches):
            words, begins = all_words(texts)
            lists = some.column(3)
            owner = np.repeat(np.arange(some.num_rows), pc.list_value_length(lists).to_numpy())
            pos, lo, hi, hashed = lists.flatten().flatten()
            place = pos.to_numpy()
            order = np.lexsort((place, owner))
            for a in range(0, len(order), PLACES):
                b = order[a : a + PLACES]
                who, at = owner[b], begins[owner[b]] + place[b]
                row, index = pa.array(who), pa.array(b)
                ahead, back = np.minimum(begins[who + 1] - at, PASSAGE), np.minimum(place[b], LEFT)
                yield pa.record_batch(
                    [
                        some.column(0).take(row),
                        some.column(1).take(row),
                        *[c.take(index) for c in (pos, lo, hi, hashed)],
                        joined(words, at, ahead, 1),
                        joined(words, at - 1, back, -1),
                    ],
                    ["key", "tie", "pos", "lo", "hi", "hash", "right", "left"],
                )

    return rows.select("key", "tie", "text", "places").mapInArrow(run, SUFFIX)


def _matrix(texts: pa.Array, width: int, codes: dict[str, int]) -> np.ndarray:
    """Numbers of the first ``width`` words of each text; -1 where it ends."""
    split = pc.split_pattern(texts.cast(pa.large_string()), " ")
    flat = split.flatten().dictionary_encode()
    table = np.array([codes.setdefault(w, len(codes)) if w else -1 for w in flat.dictionary.to_pylist()], dtype=np.int32)
    sizes = pc.list_value_length(split).to_numpy().astype(np.int64)
    out = np.full((len(sizes), width), -1, dtype=np.int32)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = table[flat.indices.to_numpy()]
    return out


def shared_words(right: np.ndarray) -> np.ndarray:
    """Words that each row shares with the row before it."""
    same = (right[1:] == right[:-1]) & (right[1:] >= 0)
    return np.concatenate([[0], np.logical_and.accumulate(same, axis=1).sum(axis=1)])


def compare(
    right: np.ndarray, left: np.ndarray, who: np.ndarray, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray
) -> tuple[np.ndarray, ...]:
    """For sorted suffixes (word numbers to the right, to the left, document
    number in order of documents, first word, least and most words to the left):
    the passages that two documents or more have, each at its first minimiser,
    those of a suffix with the same smallest documents as one. Arrays of
    suffix, words to the left, words to the right, the suffix of the passage's
    first document, and the number of the smallest document beside the own."""
    n = len(who)
    common = shared_words(right)
    lefts = np.zeros(n, dtype=np.uint64)
    whole = np.ones(n, dtype=bool)  # rows that have j words to the left
    lengths = (right >= 0).sum(axis=1)
    hits = []
    for j in range(LEFT + 1):
        if j:
            whole &= left[:, j - 1] >= 0
            lefts = _mix(lefts * BASE + left[:, j - 1].astype(np.uint64) + np.uint64(1))
        run = np.cumsum(common < PASSAGE - j)
        rows = np.flatnonzero(whole & (lengths >= PASSAGE - j) & (lo <= j) & (j <= hi))
        if not len(rows):
            continue
        order = rows[np.lexsort((pos[rows], who[rows], lefts[rows], run[rows]))]
        edge = (np.diff(run[order]) != 0) | (np.diff(lefts[order].view(np.int64)) != 0)
        begin = np.concatenate([[0], np.flatnonzero(edge) + 1])
        group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
        first = order[begin]
        other = who[order] != who[first][group]
        second = np.minimum.reduceat(np.where(other, who[order], n), begin)
        hit = (second < n)[group]
        found, of = order[hit], group[hit]
        partner = np.where(other[hit], who[first][of], second[of])
        if len(found):
            hits.append(np.stack([found, first[of], partner, np.full(len(found), j)]))
    if not hits:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    found, first, partner, j = np.concatenate(hits, axis=1)
    # equal ones but for j are one interval: they lie at the same distance
    order = np.lexsort((j, partner, first, found))
    found, first, partner, j = found[order], first[order], partner[order], j[order]
    new = np.append(True, (np.diff(found) != 0) | (np.diff(first) != 0) | (np.diff(partner) != 0))
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(found)) - 1
    return found[begin], j[last], PASSAGE - j[begin], first[begin], partner[begin]


def _compare_sorted(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Intervals (``FOUND``) of sorted suffixes, about ``chunk`` rows at a time:
    up to the last run that is whole, the rest waits."""
    names = ["key", "tie", "start", "end", "class_key", "class_tie", "class_start", "partner"]
    held: pa.Table | None = None

    def spans(table: pa.Table, right: np.ndarray, codes: dict[str, int]) -> pa.RecordBatch:
        left = _matrix(table["left"].combine_chunks(), LEFT, codes)
        key, tie = table["key"].to_numpy(), table["tie"].to_numpy()
        order = np.lexsort((tie, key))
        changed = (np.diff(key[order]) != 0) | (np.diff(tie[order]) != 0)
        who = np.empty(len(key), dtype=np.int64)
        who[order] = np.concatenate([[0], np.cumsum(changed)])
        of = np.empty(who.max() + 1, dtype=np.int64)
        of[who] = key
        pos = table["pos"].to_numpy()
        hit, back, ahead, first, other = compare(
            right, left, who, pos, table["lo"].to_numpy(), table["hi"].to_numpy()
        )
        return pa.record_batch(
            [
                pa.array(key[hit]),
                pa.array(tie[hit]),
                pa.array((pos[hit] - back).astype(np.int32)),
                pa.array((pos[hit] + ahead).astype(np.int32)),
                pa.array(key[first]),
                pa.array(tie[first]),
                pa.array((pos[first] - back).astype(np.int32)),
                pa.array(of[other]),
            ],
            names,
        )

    def work(table: pa.Table, final: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
        codes: dict[str, int] = {}
        right = _matrix(table["right"].combine_chunks(), PASSAGE, codes)
        cuts = np.flatnonzero(shared_words(right)[1:] < RIGHT) + 1
        end = table.num_rows if final else int(cuts[-1]) if len(cuts) else 0
        return [spans(table.slice(0, end), right[:end], codes)] if end else [], table.slice(end)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None or not held.num_rows else pa.concat_tables([held, table])
        if held.num_rows >= chunk:
            out, held = work(held, False)
            yield from out
    if held is not None and held.num_rows:
        out, _ = work(held, True)
        yield from out


def intervals(docs: DataFrame) -> DataFrame:
    """``FOUND``: every passage of ``PASSAGE`` words that two documents or more
    have, in each of them: first word, end, the smallest of those documents
    (the passage's class) and where the passage stands in it, and the smallest
    other document. Passages of a suffix that agree in these are one interval."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = _documents(docs)
    # (written tables: texts are read once, and Spark can split a hot hash's
    # rows in the join)
    kept = written(sample(rows), "suffix-sample")
    # documents, not rows, are counted: a suffix that repeats in one document
    # alone stays out (the smallest and the largest document differ)
    doc = F.struct("key", "tie")
    repeated = written(
        kept.groupBy("hash")
        .agg(F.min(doc).alias("low"), F.max(doc).alias("high"), F.count("*").alias("n"))
        .where("low != high")
        .select("hash", "n"),
        "suffix-hashes",
    )
    places = (
        kept.join(repeated.where(F.col("n") <= EDGE), "hash", "left_semi")
        .groupBy("key", "tie")
        .agg(F.collect_list(F.struct("pos", "lo", "hi", "hash")).alias("places"))  # a text's own minimisers
    )
    suffixes = cut_out(rows.join(places, ["key", "tie"]).dropDuplicates(["key", "tie"]))
    n, chunk = int(spark.conf.get("spark.sql.shuffle.partitions")), CHUNK
    found = (
        suffixes.repartition(n, "hash")  # no run has more than EDGE rows
        .sortWithinPartitions("right", "left", "key", "tie", "pos")
        .mapInArrow(lambda it: _compare_sorted(it, chunk), FOUND)
    )
    large = repeated.where(F.col("n") > EDGE)
    bitmap = _bitmap(large)
    return found if bitmap is None else found.unionAll(counted_passages(rows, kept, large, bitmap))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words, partner_id, class_id,
    class_start: a row per span of a document whose passages have the same
    class. ``partner_id`` is the smallest other document that has them;
    ``class_id`` the smallest of all that do, the document itself included, and
    ``class_start`` the word of that document at which the span's words stand
    in it. So every document is linked to its classes, none is left out, and
    two documents share a passage just where their spans of one class meet in
    the class's words."""
    found = intervals(docs)
    same = ["key", "tie", "class_key", "class_tie", "partner", "away"]
    per_doc = Window.partitionBy(*same).orderBy("start", "end")
    before = per_doc.rowsBetween(Window.unboundedPreceding, -1)
    upto = per_doc.rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True))
    null = lambda c: F.when(F.col(c) != NULL_KEY, F.col(c))
    return (
        found.withColumn("away", F.col("class_start") - F.col("start"))
        .withColumn("fresh", fresh.cast("int"))
        .withColumn("span", F.sum("fresh").over(upto))
        .groupBy(*same, "span")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .select(
            null("key").alias("doc_id"),
            F.col("start").cast("long").alias("start_word"),
            F.col("end").cast("long").alias("end_word"),
            (F.col("end") - F.col("start")).cast("long").alias("n_words"),
            null("partner").alias("partner_id"),
            null("class_key").alias("class_id"),
            (F.col("start") + F.col("away")).cast("long").alias("class_start"),
        )
    )
