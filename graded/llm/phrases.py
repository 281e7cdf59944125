"""Phrase collocations by vertical partitioning of a truncated suffix tree.

Texts are cut into pieces and words. The tree holds the suffix at every word,
truncated at ``LONGEST`` words or where its piece ends; a node's total is how
often its phrase occurs. It is never held as a whole:

1. *Vertical partitioning.* A first pass counts the prefixes of two words, by
   hash, in 2^``PAIR_BITS`` cells, and those of one word in 2^``WORD_BITS``.
   Cells of pairs are dealt into groups of at most ``BUDGET`` suffixes (the
   memory budget of a subtree). A cell above the budget is split by longer
   prefixes (the hash of the whole truncated suffix). A cell below ``LEAST``
   holds no phrase that is often enough, so its suffixes are left out, and a
   suffix is cut where its next two words lie in such a cell: exact, since a
   phrase isn't more frequent than any part of it. (Cells that several prefixes
   share only keep more than needed.)
2. *Subtrees.* A second pass sends every suffix to its group, equal ones of a
   chunk once with a count, packed into one row per task and group. Words go
   to groups of their own. Each group is sorted on its own, and the leaf totals
   give the totals of all nodes above them.
3. The counts of all groups (parts of them, for split cells) are added up, and
   phrases are scored and ranked from the small table of frequent ones.

What is broadcast is a number per cell, whatever the size of the input.

Nulls: a null text is empty, a null lang is ``und``; doc_id isn't read. Repeated
rows count as often as they stand there. Empty tables give no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import range_count, ship_package, written

LONGEST = 4  # words of a phrase
LEAST = 30  # occurrences of a candidate
COVERED = (80, 100)  # share of its occurrences in a longer phrase that drops one
BEST = 2000  # phrases of a lang
PAIR_BITS = 23
WORD_BITS = 22
PAIRS, CELLS = 1 << PAIR_BITS, (1 << PAIR_BITS) + (1 << WORD_BITS)
BLOCK = 1 << 15  # cells are counted in blocks of as many
BUDGET = 1 << 16  # suffixes of a group
CHUNK = 1 << 22  # bytes of text at a time, and at least one piece
HELD = 1 << 25  # bytes of suffixes that a task packs at a time
WORDS = 400_000  # words counted in a task before the counts are passed on
PARTS = 64  # parts that the counts of a block are summed in at first
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))

#: Bytes in UTF-8: A-Z in lower case, what parts pieces as a line feed, tabs
#: as spaces.
PLAIN = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x0A if 0x0A <= b <= 0x0D or b in b".,;:!?" else 0x20 if b == 0x09 else b
    for b in range(256)
)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Chunk:
    """The words of some texts of one lang, as numbers of distinct words."""

    def __init__(self, lang: str, text: bytes):
        split = pc.split_pattern(pa.array([text.replace(b"\n", b" \n ")], pa.large_binary()), b" ")
        coded = split.flatten().dictionary_encode()
        self.distinct = coded.dictionary
        code = coded.indices.to_numpy()
        kind = self.distinct.type
        empty = pc.index(self.distinct, pa.scalar(b"", kind)).as_py()
        end = pc.index(self.distinct, pa.scalar(b"\n", kind)).as_py()
        word = (code != empty) & (code != end)
        self.lang = lang
        self.words = code[word].astype(np.int64)
        self.piece = np.cumsum(code == end, dtype=np.int32)[word]
        self._hashes = self._hash()

    def _hash(self) -> np.ndarray:
        """A hash of every distinct word and the lang."""
        sizes = np.concatenate([[0], np.cumsum(pc.binary_length(self.distinct).to_numpy(zero_copy_only=False))]).astype(np.int64)
        raw = np.frombuffer(b"".join(self.distinct.to_pylist()), np.uint8).astype(np.uint64) + np.uint64(1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(raw * _powers(BASE, len(raw)), dtype=np.uint64)])
        back = _powers(INVERSE, len(raw) + 1)
        whole = (total[sizes[1:]] - total[sizes[:-1]]) * back[sizes[:-1]]
        return _mix(_mix(whole) + np.uint64(xxhash.xxh64_intdigest(self.lang.encode())))

    def after(self, j: int) -> np.ndarray:
        """Number of the ``j``-th word after each, -1 beyond its piece."""
        out = np.full(len(self.words), -1, np.int64)
        if len(out) > j:
            same = self.piece[j:] == self.piece[:-j]
            out[: len(out) - j][same] = self.words[j:][same]
        return out

    def pair_cells(self, second: np.ndarray) -> np.ndarray:
        """Cell of each word and the one after it; -1 without one."""
        pair = _mix(self._hashes[self.words] * BASE + self._hashes[second])
        return np.where(second >= 0, (pair >> np.uint64(64 - PAIR_BITS)).astype(np.int64), -1)

    def word_cells(self) -> np.ndarray:
        """Cell of each distinct word."""
        return PAIRS + (self._hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)

    def counts(self) -> np.ndarray:
        """How often each distinct word occurs (0: no word)."""
        return np.bincount(self.words, minlength=len(self.distinct))

    def suffixes(self, dealt: Dealt) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(group, suffix, occurrences) of every suffix whose first two words
        are in a cell that has a group."""
        second = self.after(1)
        cell = self.pair_cells(second)
        n = len(self.words)
        open_ = np.append((cell >= 0) & (dealt.base[cell] >= 0), [False] * LONGEST)
        parts = [self.words, second]
        deep = open_[:n]
        for j in range(2, LONGEST):
            deep = deep & open_[j - 1 : n + j - 1]
            parts.append(np.where(deep, self.after(j), -1))
        at = np.flatnonzero(open_[:n])
        # (two numbers of 32 bits in one key)
        keys = [((parts[i][at] + 1) << 32) | (parts[i + 1][at] + 1) for i in range(0, LONGEST, 2)]
        order = np.lexsort(keys[::-1])
        new = np.ones(len(at), bool)
        new[1:] = False
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
        begin = np.flatnonzero(new)
        times = np.diff(np.append(begin, len(at)))
        first = at[order[begin]]
        parts = [p[first] for p in parts]
        mixed = np.zeros(len(first), np.uint64)
        for p in parts:
            mixed = _mix(mixed * BASE + np.where(p >= 0, self._hashes[p], np.uint64(0)))
        words = [self.distinct.take(pa.array(p, mask=p < 0)) for p in parts]
        joined = pc.binary_join_element_wise(*words, pa.scalar(b" ", words[0].type), null_handling="skip")
        return dealt.groups(cell[first], mixed), joined, times


def _segments(text: bytes) -> Iterator[bytes]:
    """A text in segments of about ``CHUNK`` bytes, cut at the ends of pieces."""
    a = 0
    while len(text) - a > CHUNK:
        b = text.find(b"\n", a + CHUNK)
        if b < 0:
            break
        yield text[a:b]
        a = b
    yield text[a:]


def chunks(batch: pa.RecordBatch) -> Iterator[Chunk]:
    """``batch``: lang, text (binary)."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        for part in _segments(text.as_py().translate(PLAIN)):
            held.setdefault(lang, []).append(part)
            size[lang] = size.get(lang, 0) + len(part)
            if size[lang] >= CHUNK:
                yield Chunk(lang, b"\n".join(held.pop(lang)))
                size[lang] = 0
    for lang, parts in held.items():
        yield Chunk(lang, b"\n".join(parts))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text.alias("text"))


# ------------------------------------------------- vertical partitioning


def _packed(counts: np.ndarray) -> bytes:
    """Numbers, compressed byte by byte of them: the high ones are mostly 0."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


PREFIXES = "lang string, n long, block int, part int, cells binary"


def prefixes(rows: DataFrame) -> DataFrame:
    """Parts of sums: words of a lang (lang, n), and the cells of a block
    (block, part, cells)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, int] = {}
        cells = np.zeros(CELLS, np.int32)
        for batch in batches:
            for chunk in chunks(batch):
                words[chunk.lang] = words.get(chunk.lang, 0) + len(chunk.words)
                pair = chunk.pair_cells(chunk.after(1))
                cell, times = np.unique(pair[pair >= 0], return_counts=True)
                cells[cell] += times.astype(np.int32)
                np.add.at(cells, chunk.word_cells(), chunk.counts().astype(np.int32))
        n = len(words)
        yield pa.record_batch(
            [pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
            names,
        )
        blocks = cells.reshape(-1, BLOCK)
        part = int(cells.sum(dtype=np.int64)) % PARTS
        for b in np.flatnonzero(blocks.any(axis=1)):
            yield pa.record_batch(
                [pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([b], pa.int32()), pa.array([part], pa.int32()), pa.array([_packed(blocks[b])])],
                names,
            )

    names = ["lang", "n", "block", "part", "cells"]
    return rows.mapInArrow(run, PREFIXES)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the cells of rows that stand in order of (block, part)."""
    now, total = None, None

    def row() -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([_packed(total)])], ["block", "part", "cells"]
        )

    for batch in batches:
        for block, part, cells in zip(*(c.to_pylist() for c in batch.columns)):
            if now == (block, part):
                total += _unpacked(cells)
                continue
            if now is not None:
                yield row()
            now, total = (block, part), _unpacked(cells).copy()
    if now is not None:
        yield row()


class Dealt:
    """Where prefixes go: the first group of each cell of pairs (-1: none),
    the cells that are split with their numbers of groups, and the cells of
    words that are frequent enough."""

    def __init__(self, least: int, budget: int):
        self.least, self.budget = least, budget
        self.base = np.full(PAIRS, -1, np.int32)
        self.split_cells, self.splits = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.words = np.zeros(CELLS - PAIRS, bool)
        self.n_whole = self.n_pairs = self.n_words = 0

    def deal(self, pairs: np.ndarray, words: np.ndarray) -> Dealt:
        """From the occurrences in every cell."""
        whole = np.flatnonzero((pairs >= self.least) & (pairs <= self.budget))
        self.base[whole] = (np.cumsum(pairs[whole]) - 1) // self.budget  # at most twice the budget
        self.n_whole = int(self.base[whole[-1]]) + 1 if len(whole) else 0
        hot = np.flatnonzero((pairs >= self.least) & (pairs > self.budget))
        self.split_cells, self.splits = hot, -(-pairs[hot] // self.budget)
        ends = self.n_whole + np.cumsum(self.splits)
        self.base[hot] = ends - self.splits
        self.n_pairs = int(ends[-1]) if len(hot) else self.n_whole
        self.words = words >= self.least
        self.n_words = int(-(-words[self.words].sum() // self.budget))
        return self

    def groups(self, cell: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """Group of a suffix in a cell, from a hash of all its words."""
        group = self.base[cell].astype(np.int64)
        if len(self.split_cells):
            at = np.minimum(np.searchsorted(self.split_cells, cell), len(self.splits) - 1)
            split = self.split_cells[at] == cell
            group[split] += (mixed[split] % self.splits[at[split]].astype(np.uint64)).astype(np.int64)
        return group

    def word_groups(self, hashes: np.ndarray) -> np.ndarray:
        return self.n_pairs + (hashes % np.uint64(max(1, self.n_words))).astype(np.int64)

    def whole(self, group: int) -> bool:
        """Whether all suffixes with the prefixes of a group are in it."""
        return group < self.n_whole


def vertical_partitioning(counted: DataFrame, least: int, budget: int) -> Dealt:
    """As many numbers as there are cells, whatever the input, are collected."""
    shape = "block int, part int, cells binary"
    rows = counted.where("block is not null").select("block", "part", "cells")
    for part in ("part", "0"):
        rows = (
            rows.withColumn("part", F.expr(part).cast("int"))
            .repartition("block", "part")
            .sortWithinPartitions("block", "part")
            .mapInArrow(_added, shape)
        )
    cells = np.zeros((CELLS // BLOCK, BLOCK), np.int64)
    for row in rows.toLocalIterator():
        cells[row["block"]] = _unpacked(bytes(row["cells"]))
    cells = cells.ravel()
    return Dealt(least, budget).deal(cells[:PAIRS], cells[PAIRS:])


# ------------------------------------------------------------- subtrees


def packed(suffix: pa.Array, n: np.ndarray) -> bytes:
    """Some suffixes (large_binary) with their occurrences, compressed."""
    offsets = np.frombuffer(suffix.buffers()[1], np.int64, len(suffix) + 1, 8 * suffix.offset)
    data = suffix.buffers()[2]
    raw = data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if data is not None else b""
    sizes = np.diff(offsets).astype("<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(b"".join([len(n).to_bytes(8, "little"), sizes, n.astype("<i8").tobytes(), raw]))


def unpacked(raw: bytes) -> tuple[pa.Array, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    size = int.from_bytes(raw[:8], "little")
    sizes = np.frombuffer(raw, "<u4", size, 8)
    n = np.frombuffer(raw, "<i8", size, 8 + 4 * size)
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    text = pa.LargeStringArray.from_buffers(size, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[8 + 12 * size :]))
    return text, n


def suffixes(rows: DataFrame, dealt: Dealt) -> DataFrame:
    """grp, lang, packed (suffixes of the group, and how often each occurs)."""

    def told(lang: str, held: list) -> Iterator[pa.RecordBatch]:
        group = np.concatenate([h[0] for h in held])
        order = np.argsort(group, kind="stable")
        group, n = group[order], np.concatenate([h[2] for h in held])[order]
        suffix = pa.concat_arrays([h[1] for h in held]).take(pa.array(order))
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else group
        end = np.append(begin[1:], len(group))
        for a in range(0, len(begin), 1000):
            some = list(zip(begin[a : a + 1000], end[a : a + 1000]))
            yield pa.record_batch(
                [
                    pa.array(group[begin[a : a + 1000]]),
                    pa.array([lang] * len(some)),
                    pa.array([packed(suffix.slice(x, y - x), n[x:y]) for x, y in some], pa.binary()),
                ],
                ["grp", "lang", "packed"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        words: dict[str, dict[bytes, int]] = {}
        size: dict[str, int] = {}

        def counted(lang: str) -> Iterator[pa.RecordBatch]:
            found = words.pop(lang)
            names = pa.array(list(found), pa.large_binary())
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in found), np.uint64, len(found))
            yield from told(lang, [(dealt.word_groups(hashes), names, np.fromiter(found.values(), np.int64, len(found)))])

        for batch in batches:
            for chunk in chunks(batch):
                lang = chunk.lang
                n = chunk.counts()
                some = np.flatnonzero((n > 0) & dealt.words[chunk.word_cells() - PAIRS])
                of = words.setdefault(lang, {})
                for word, times in zip(chunk.distinct.take(pa.array(some)).to_pylist(), n[some].tolist()):
                    of[word] = of.get(word, 0) + times
                if len(of) > WORDS:
                    yield from counted(lang)
                found = chunk.suffixes(dealt)
                held.setdefault(lang, []).append(found)
                size[lang] = size.get(lang, 0) + found[1].nbytes
                if sum(size.values()) > HELD:
                    for lang in list(held):
                        yield from told(lang, held.pop(lang))
                    size.clear()
        for lang in list(held):
            yield from told(lang, held.pop(lang))
        for lang in list(words):
            yield from counted(lang)

    return rows.mapInArrow(run, "grp long, lang string, packed binary")


def subtree(suffix: pa.Array, n: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Nodes of the tree of some truncated suffixes (with their occurrences):
    depth, the number of a suffix that has the node's phrase as its prefix,
    and the node's total. A word that stands alone is a tree of its own."""
    split = pc.split_pattern(suffix, " ")
    flat = split.flatten().dictionary_encode().indices.to_numpy()
    sizes = np.asarray(split.value_lengths(), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    word = np.full((len(sizes), LONGEST), -1, np.int64)
    word[owner, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    keys = [((word[:, i] + 1) << 32) | (word[:, i + 1] + 1) for i in range(0, LONGEST, 2)]
    order = np.lexsort(keys[::-1])
    word, n = word[order], n[order]
    fresh = np.zeros(len(n), bool)  # first of the suffixes with an equal prefix
    fresh[:1] = True
    fresh[1:] = word[1:, 0] != word[:-1, 0]
    for depth in range(1, LONGEST + 1):
        if depth > 1:
            fresh[1:] |= word[1:, depth - 1] != word[:-1, depth - 1]
        begin = np.flatnonzero(fresh)
        total = np.add.reduceat(n, begin)
        # (shorter suffixes come first, as a run of their own)
        node = word[begin, depth - 1] >= 0 if depth > 1 else word[begin, 1] < 0
        yield depth, order[begin[node]], total[node]


def phrase_counts(docs: DataFrame, least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(lang, n: words of each lang; lang, phrase, words, f of every phrase of
    1 to ``LONGEST`` words that occurs ``least`` times): written tables."""
    ship_package(docs.sparkSession)
    rows = _rows(docs)
    counted = written(prefixes(rows), "phrase-prefixes")
    n_words = counted.where("lang is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    dealt = vertical_partitioning(counted, least, budget)

    def nodes(key: tuple, table: pa.Table) -> pa.Table:
        whole = key[0].as_py() >= dealt.n_pairs or dealt.whole(key[0].as_py())
        langs, phrases, depths, totals = [], [], [], []
        rows = sorted(zip(table["lang"].to_pylist(), range(table.num_rows)))
        for lang, some in groupby(rows, key=itemgetter(0)):
            parts = [unpacked(table["packed"][i].as_py()) for _, i in some]
            suffix, n = pa.concat_arrays([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            for depth, at, total in subtree(suffix, n):
                if whole or depth == LONGEST:  # else a part of the total
                    at, total = at[total >= least], total[total >= least]
                cut = pc.list_slice(pc.split_pattern(suffix.take(pa.array(at)), " "), 0, depth)
                phrases.append(pc.binary_join(cut, pa.scalar(" ", pa.large_string())).cast(pa.string()))
                langs += [lang] * len(at)
                depths.append(np.full(len(at), depth))
                totals.append(total)
        return pa.table(
            {
                "lang": pa.array(langs, pa.string()),
                "phrase": pa.concat_arrays(phrases),
                "words": pa.array(np.concatenate(depths), pa.int32()),
                "f": pa.array(np.concatenate(totals), pa.int64()),
            }
        )

    found = suffixes(rows, dealt).repartition("grp").groupBy("grp").applyInArrow(nodes, "lang string, phrase string, words int, f long")
    frequent = found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return n_words, written(frequent, "phrase-counts")


def collocations(docs: DataFrame, best: int = BEST, least: int = LEAST) -> DataFrame:
    """The ``best`` phrases of each lang: lang, rank (from 1), phrase, a (its
    occurrences), l, r (those of the parts of its weakest cut), n (words of
    the lang), score (two millionths of the share that a is of l and r)."""
    n_words, frequent = phrase_counts(docs, least)
    parts = frequent.select("lang", F.col("phrase").alias("part"), "f")
    split = frequent.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    joined = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cut = F.col("cut")
    halves = (
        split.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
        .withColumn("side", F.explode(F.array(F.lit("l"), F.lit("r"))))
        .withColumn("part", F.when(F.col("side") == "l", joined(F.lit(1), cut)).otherwise(joined(cut + 1, F.col("words") - cut)))
        .select("lang", "phrase", "a", "cut", "side", "part")
    )
    score = F.expr("cast((cast(2000000 as decimal(38,0)) * a) div (cast(l as decimal(38,0)) + r) as bigint)")
    weakest = (
        halves.join(parts, ["lang", "part"])
        .groupBy("lang", "phrase", "a", "cut")
        .agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("low"))
        .select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    )
    inner = F.transform(
        F.flatten(
            F.transform(
                F.sequence(F.lit(2), F.col("words") - 1),
                lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.struct(i.alias("i"), k.alias("k"))),
            )
        ),
        lambda x: F.array_join(F.slice(F.col("w"), x["i"], x["k"]), " "),
    )
    longer = (
        split.where("words > 2")
        .select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("f"))
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("longer"))
    )
    num, den = COVERED
    big = lambda c, x: F.col(c).cast("decimal(38,0)") * x
    kept = weakest.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (big("longer", den) < big("a", num))
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(range_count(docs.sparkSession)))
    few = kept.withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    )
    few = few.where(F.col("rank") <= best).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    )
    return (
        few.where(F.col("rank") <= best)
        .join(F.broadcast(n_words), "lang")  # a row per lang
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
