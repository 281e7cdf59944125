"""Benchmark decontamination by template canonicalisation.

A text is cut into tokens at white space; a token loses the punctuation around
it and its case. Numbers, names and units become typed placeholders: a name is
a word with one capital at its front that doesn't begin a sentence; a unit is
a listed word right after a number. A window of ``WINDOW`` canonical tokens,
at least ``LITERALS`` of them literal, is a template; equal templates are
found by a hash join. A re-parameterised question keeps its templates.

An item and a document match if at least ``SHARE`` of the item's windows occur
in the document, and the slots are consistent: each value in the item is
replaced by one and the same value in the document. That is so over all matched
windows, or else over those of one occurrence: windows at one distance from
their places in the item are one alignment, and alignments no further apart than
the item is long are one occurrence as far as their values agree.

An item of fewer than ``WINDOW`` tokens is one window of its own length. An item
of fewer than ``LEAST`` tokens, or without a window with enough literals, says
too little for templates: its windows are compared by their values, with signs
and operators, so its copies are found and nothing else. Items of fewer than
``EXACT`` tokens match nothing.

Documents' windows are many and rarely match. They are first tested against a
bitmap of the items' window hashes, of a fixed size whatever the number of
items; what passes is joined, so the bitmap costs no matches.

Nulls: a null text has no tokens; rows with a null item_id or doc_id are kept
apart from each other by their texts. Repeated documents are one. Extra
columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_KEY, boxed, ship_package, sort_key, unboxed, written

WINDOW = 8  # tokens
LITERALS = 4  # of a window that are no placeholders, at least
LEAST = 5  # tokens of a template
EXACT = 3  # tokens of an item
SHARE = 0.5  # of an item's windows
BITS = 24  # the bitmap has 2^BITS bits (2 MB)
MEMORY = 100_000  # remembered tokens, then the memory starts anew
BATCH = 1000  # texts at a time

LITERAL, NUMBER, NAME, UNIT, MEASURE = range(5)
#: Words that are units after a number.
UNITS = frozenset(
    "% percent mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram "
    "kilograms ton tons tonnes oz ounce ounces lb lbs pound pounds ml l liter liters litre litres "
    "gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month "
    "months year years km/h mph m/s c f k degrees degree cent cents dollar dollars euro euros usd "
    "eur gbp hz khz mhz ghz w kw mw kwh j kj v a n pa kpa bar mol bytes kb mb gb tb".split()
)
_EDGES = re.compile(r"^\W+|\W+$")
_NUMBER = re.compile(r"^[-+]?[$€£]?\d+(?:[.,:/]\d+)*$")
_MEASURE = re.compile(r"^[-+]?\d+(?:[.,]\d+)*([^\W\d_]+|%)$")
_SIGN = re.compile(r"[-+$€£]+(?=\d)")
_OPERATOR = re.compile(r"[-+*/=<>^%×÷−]+$")
_END = re.compile(r"[.!?:][\"')\]]*$")


def token_of(raw: str) -> tuple[int, int, int, str, int]:
    """(hash of the literal, kind by itself, flags, value, hash of the value
    with its sign, or of an operator) of a raw token.
    Flags: 1 could be a name, 2 could be a unit, 4 ends a sentence, 8 empty."""
    if raw.isalpha():
        return _word(raw, 0)
    if raw[-1:] in (".", ",") and raw[:-1].isalpha():
        return _word(raw[:-1], 4 if raw[-1] == "." else 0)
    return _any_token(raw)


def _word(bare: str, flags: int) -> tuple[int, int, int, str, int]:
    """A token of letters alone: most are, and it needs no pattern."""
    value = bare.lower()
    if bare[0].isupper() and (len(bare) == 1 or not any(map(str.isupper, bare[1:]))):
        flags |= 1
    if value in UNITS:
        flags |= 2
    code = _short_hash(value)
    return code, LITERAL, flags, value, code


def _any_token(raw: str) -> tuple[int, int, int, str, int]:
    ends = 4 if _END.search(raw) else 0
    bare = _EDGES.sub("", raw)
    if raw == "%":
        bare = raw
    value = bare.lower()
    if not bare:
        return 0, LITERAL, ends | 8, "", _short_hash(raw) if _OPERATOR.match(raw) else 0
    kind, flags = LITERAL, ends
    if _NUMBER.match(bare):
        kind = NUMBER
    elif (m := _MEASURE.match(bare)) and m[1].lower() in UNITS:
        kind = MEASURE
    else:
        if bare[0].isupper() and not any(map(str.isupper, bare[1:])):
            flags |= 1
        if value in UNITS:
            flags |= 2
    sign = _SIGN.search(raw[: raw.index(bare) + 1]) if bare[0].isdigit() else None
    code = _short_hash(value)
    return code, kind, flags, value, _short_hash(sign[0] + value) if sign else code


def _short_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) >> 4


class Canonical:
    """Canonical tokens of texts, in one array for all of them."""

    def __init__(self):
        self._memory: dict[str, tuple[int, int, int, str, int]] = {}

    def tokens(self, texts: list[str]):
        """code (hash of the canonical token), literal, value number, text
        number of each token, the list of values, and for each token the hashes
        of its exact value and of the operators before it."""
        split = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self._memory) > MEMORY:
            self._memory.clear()
        known = self._memory
        for raw in distinct:
            if raw not in known:
                known[raw] = token_of(raw)
        parsed = [known[raw] for raw in distinct]
        at = coded.indices.to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
        table = np.array([(h, k, f, e) for h, k, f, _, e in parsed], dtype=np.int64).reshape(-1, 4)
        flags = table[at, 2]
        kept = np.flatnonzero(flags & 8 == 0)
        # a token begins a sentence if it is the first or follows an end;
        # a token of punctuation alone may be that end
        before_ends = np.concatenate([[True], (flags[:-1] & 4 > 0) | (owner[1:] != owner[:-1])])
        starts = before_ends[kept]
        passed = np.cumsum(np.where(flags & 8 > 0, table[at, 3], 0).view(np.uint64), dtype=np.uint64)[kept]
        between = np.diff(passed, prepend=passed[:1])
        at, owner, flags = at[kept], owner[kept], flags[kept]
        kind = table[at, 1]
        kind[(flags & 1 > 0) & ~starts & (kind == LITERAL)] = NAME
        after_number = np.concatenate([[False], (kind[:-1] == NUMBER) & (owner[1:] == owner[:-1])]) if len(at) else kind > 0
        kind[(flags & 2 > 0) & after_number & (kind == LITERAL)] = UNIT
        code = np.where(kind == LITERAL, table[at, 0], -kind).astype(np.uint64)
        return code, kind, at, owner, [p[3] for p in parsed], table[at, 3].view(np.uint64), between


def window_hashes(code: np.ndarray, kind: np.ndarray, owner: np.ndarray, size: int):
    """(hash, literals, whether it lies in one text) of the window at each
    token but the last ``size - 1``."""
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int8), np.zeros(0, dtype=bool)
    out = np.full(n, np.uint64(size), dtype=np.uint64)
    literals = np.zeros(n, dtype=np.int8)
    for j in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += code[j : j + n]
        out ^= out >> np.uint64(29)
        literals += kind[j : j + n] == LITERAL
    return out, literals, owner[:n] == owner[size - 1 :]


def exact_hashes(value: np.ndarray, between: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the values, and the operators between them, of the windows that
    begin at ``at``."""
    out = np.full(len(at), np.uint64(size + 1000), dtype=np.uint64)
    for j in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += value[at + j]
        if j:
            out += between[at + j] * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def _spot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


WINDOWS = "key long, tie long, hash long, size int, pos int, kinds array<int>, slots array<string>, exact boolean"


def _windows(
    rows: DataFrame, sizes: list[int], whole: bool, bitmap: np.ndarray | None, exact_sizes: frozenset[int] = frozenset()
) -> DataFrame:
    """Templates of each text: their hash, position, and their slots' kinds and
    values. ``whole``: a text of fewer tokens than ``WINDOW`` is one window, and
    a text without templates has exact windows, without slots; else windows of
    all ``sizes`` are made, and exact ones of ``exact_sizes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = Canonical()
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                some = batch.slice(a, BATCH)
                texts = [t or "" for t in some.column(2).to_pylist()]
                code, kind, at, owner, values, value, between = canonical.tokens(texts)
                begins = np.searchsorted(owner, np.arange(len(texts)))
                lengths = np.bincount(owner, minlength=len(texts))
                for size in sizes:
                    hashes, literals, inside = window_hashes(code, kind, owner, size)
                    if whole:
                        fits = (lengths >= size) if size == WINDOW else (lengths == size)
                        inside &= fits[owner[: len(inside)]]
                    found = np.flatnonzero(inside & (literals >= min(LITERALS, size))) if size >= LEAST else np.zeros(0, dtype=np.int64)
                    if whole:
                        templated = np.bincount(owner[found], minlength=len(texts)) > 0
                        few = np.flatnonzero(inside & ~templated[owner[: len(inside)]])
                    elif size in exact_sizes:
                        # what stands before a window can make its first token
                        # a literal or not, so one literal more than in an item
                        few = np.flatnonzero(inside & (literals <= LITERALS))
                    else:
                        few = found[:0]
                    for exact, w, h in (
                        (False, found, hashes[found]),
                        (True, few, exact_hashes(value, between, few, size)),
                    ):
                        if bitmap is not None:
                            spot = _spot(h)
                            passed = (bitmap[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1) > 0
                            w, h = w[passed], h[passed]
                        for c in np.array_split(np.arange(len(w)), max(1, len(w) // 50_000)):
                            if len(c):
                                yield batch_of(some, size, exact, w[c], h[c], kind, at, owner, values, begins)

    def batch_of(some, size, exact, b, hashes, kind, at, owner, values, begins):
        slots = [[(int(kind[i]), values[at[i]]) for i in range(w, w + size) if kind[i] != LITERAL and not exact] for w in b.tolist()]
        return pa.record_batch(
            [
                some.column(0).take(pa.array(owner[b])),
                some.column(1).take(pa.array(owner[b])),
                pa.array(hashes.view(np.int64)),
                pa.array(np.full(len(b), size, dtype=np.int32)),
                pa.array((b - begins[owner[b]]).astype(np.int32)),
                pa.array([[k for k, _ in s] for s in slots], pa.list_(pa.int32())),
                pa.array([[v for _, v in s] for s in slots], pa.list_(pa.string())),
                pa.array(np.full(len(b), exact)),
            ],
            ["key", "tie", "hash", "size", "pos", "kinds", "slots", "exact"],
        )

    return rows.mapInArrow(run, WINDOWS)


def _keyed(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(
        sort_key(F.col(name).cast("long")).alias("key"),
        F.xxhash64("text").alias("tie"),
        F.col("text").cast("string").alias("text"),
    )


def _mapping(slots: list[dict], known: dict) -> dict | None:
    """``known`` and the replacements in ``slots``, or None if they disagree."""
    out = dict(known)
    for s in slots:
        if out.setdefault((s["kind"], s["ours"]), s["theirs"]) != s["theirs"]:
            return None
    return out


def best_occurrence(alignments: list[dict], reach: int) -> tuple[int, int]:
    """(matched windows of the item, first token) of the occurrence with the
    most windows; ``alignments``: offset, windows, first, slots. An alignment
    that disagrees with itself is none."""
    found = {}  # all of them agree, wherever they lie
    for a in alignments:
        found = None if found is None else _mapping(a["slots"], found)
    if found is not None:
        return len({w for a in alignments for w in a["windows"]}), min(a["first"] for a in alignments)
    usable = sorted((a for a in alignments if _mapping(a["slots"], {}) is not None), key=lambda a: a["offset"])
    offsets = [a["offset"] for a in usable]
    best = (0, 0)
    for middle in usable:
        near = usable[bisect_left(offsets, middle["offset"] - reach) : bisect_right(offsets, middle["offset"] + reach)]
        known, windows, first = {}, set(), middle["first"]
        for a in sorted(near, key=lambda a: abs(a["offset"] - middle["offset"])):
            if (more := _mapping(a["slots"], known)) is not None:
                known, first = more, min(first, a["first"])
                windows.update(a["windows"])
        if (len(windows), -first) > (best[0], -best[1]):
            best = len(windows), first
    return best


FOUND = "key long, tie long, item long, item_tie long, n_windows long, n_matched long, first int"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "tie", "item", "item_tie", "n_windows"]
    for batch in batches:
        reach = batch["length"].to_pylist()
        best = [best_occurrence(batch["alignments"][n].as_py(), reach[n]) for n in range(batch.num_rows)]
        more = [pa.array([b[0] for b in best], pa.int64()), pa.array([b[1] for b in best], pa.int32())]
        yield pa.record_batch([*(batch[c] for c in names), *more], [*names, "n_matched", "first"])


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """key, tie (a document), item, item_tie, n_windows, n_matched, share,
    first (token at which the first match begins) of every match."""
    ship_package(docs.sparkSession)
    sizes = list(range(EXACT, WINDOW + 1))
    ours = written(_windows(_keyed(items, "item_id"), sizes, True, None), "templates").dropDuplicates(
        ["key", "tie", "hash", "pos"]
    )
    totals = ours.groupBy(F.col("key").alias("item"), F.col("tie").alias("item_tie")).agg(
        F.countDistinct("pos").alias("n_windows"), F.max(F.col("pos") + F.col("size")).alias("length")
    )
    # at most 2^BITS / 64 rows, whatever the number of items
    spot = F.shiftrightunsigned("hash", 64 - BITS)
    cells = (
        ours.groupBy(F.shiftright(spot, 6).alias("cell"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned(hash, {64 - BITS}) & 63))")).alias("bits"))
        .collect()
    )
    bitmap = np.zeros(2 ** (BITS - 6), dtype=np.uint64)
    for c in cells:
        bitmap[c["cell"]] = np.int64(c["bits"]).view(np.uint64)
    # windows of short items are looked for in documents only if there are any
    kinds = [tuple(r) for r in ours.select("size", "exact").distinct().collect()]
    exact_sizes = frozenset(size for size, exact in kinds if exact)
    theirs = _windows(_keyed(docs, "doc_id"), sorted({size for size, _ in kinds}), False, bitmap, exact_sizes)
    pairs = theirs.join(
        ours.select(
            "hash",
            F.col("key").alias("item"),
            F.col("tie").alias("item_tie"),
            F.col("pos").alias("item_pos"),
            F.col("kinds").alias("item_kinds"),
            F.col("slots").alias("item_slots"),
        ),
        "hash",
    ).where(F.col("kinds") == F.col("item_kinds"))
    slot = F.transform(
        F.arrays_zip("kinds", "item_slots", "slots"),
        lambda x: F.struct(x["kinds"].alias("kind"), x["item_slots"].alias("ours"), x["slots"].alias("theirs")),
    )
    who = ["key", "tie", "item", "item_tie"]
    alignments = pairs.groupBy(*who, (F.col("pos") - F.col("item_pos")).alias("offset")).agg(
        F.collect_set("item_pos").alias("windows"),
        F.min("pos").alias("first"),
        F.array_distinct(F.flatten(F.collect_set(slot))).alias("slots"),
    )
    candidates = (
        alignments.groupBy(*who)
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_set("windows")))).alias("n_any"),
            # as many as places where some of the item is found
            F.collect_list(F.struct("offset", "windows", "first", "slots")).alias("alignments"),
        )
        .join(totals, ["item", "item_tie"])
        .where(F.col("n_any") / F.col("n_windows") >= SHARE)
    )
    return (
        candidates.select(*who, "n_windows", "length", "alignments")
        .mapInArrow(_occurrences, FOUND)
        .withColumn("share", F.col("n_matched") / F.col("n_windows"))
        .where(F.col("share") >= SHARE)
        .select("key", "tie", "item", "item_tie", "n_windows", "n_matched", "share", "first")
    )


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, share, first_token: a row for
    every document and item that match."""
    null = lambda c: F.when(F.col(c) != NULL_KEY, F.col(c))
    return matches(docs, items).select(
        null("key").alias("doc_id"),
        null("item").alias("item_id"),
        F.col("n_windows").cast("long").alias("n_windows"),
        F.col("n_matched").cast("long").alias("n_matched"),
        "share",
        F.col("first").cast("long").alias("first_token"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same columns, without the rows that match a benchmark item. A null
    or empty text matches none; rows that repeat an id and a text go together;
    without documents or items nothing goes."""
    bad = matches(docs, items).select("key", "tie").distinct()
    rows = boxed(docs, key=sort_key(F.col("doc_id").cast("long")), tie=F.xxhash64("text"))
    return unboxed(rows.join(bad, ["key", "tie"], "left_anti"), docs.columns)
