"""Document fingerprints from closed syncmers (DataFrame functions only).

A text is lower-cased and cut into words at white space. A k-mer is ``K``
consecutive words; its inner substrings are the ``K - S + 1`` runs of ``S``
words inside it, ordered by their 64-bit hash. A k-mer is a *closed syncmer*
when its smallest inner substring is its first or its last one. Whether a
k-mer is chosen depends on its own words alone, so an edit changes only the
anchors that overlap it, and the same passage gives the same anchors wherever
it stands. A text without a closed syncmer (all of fewer than ``K`` words, some
of a few more) has its whole word sequence as its only anchor; a text without
words has none.

``anchors`` returns every anchor with its position. A fingerprint is a digest of
them all. Texts are compared by positions: an anchor is common to two texts if it
stands at the same distance behind the same anchor in both (the first anchor of a
text, if it is the first in both), and each is matched once.

Nulls: a null text counts as empty; rows with a null id are kept. Repeated
rows stay repeated rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import key_bounds, range_count, range_of, sort_key

K = 5  # words of a k-mer
S = 2  # words of an inner substring
SPACE = r"[\x09-\x0D\x20]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SPACE), "")


def _anchor_at(inner: Column, i: Column, k: int, s: int) -> Column:
    """Hash of the k-mer at 1-based word ``i``, or null if it is no closed
    syncmer. ``inner`` holds the hashes of all runs of ``s`` words."""
    span = k - s + 1
    parts = [F.element_at(inner, (i + j).cast("int")) for j in range(span)]
    low = F.least(*parts)
    # the inner runs at steps of s, and the last, cover all words of the k-mer
    cover = sorted({*range(0, span, s), span - 1})
    return F.when(
        (parts[0] == low) | (parts[-1] == low), F.xxhash64(*[parts[j] for j in cover])
    )


def anchor_hashes(text: Column, k: int = K, s: int = S) -> Column:
    """Array with one entry per k-mer of the text in order: its hash if it is
    a closed syncmer, else null."""
    words = F.transform(_words(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w))

    def with_words(h: Column) -> Column:
        n = F.size(h)
        runs = F.transform(
            F.sequence(F.lit(1), n - (s - 1)),
            lambda i: F.xxhash64(*[F.element_at(h, (i + j).cast("int")) for j in range(s)]),
        )
        many = _let(
            runs,
            lambda m: F.transform(
                F.sequence(F.lit(1), n - (k - 1)), lambda i: _anchor_at(m, i, k, s)
            ),
        )
        few = F.array(F.xxhash64(h))
        none = F.array().cast("array<bigint>")
        chosen = _let(many, lambda m: F.when(F.exists(m, lambda x: x.isNotNull()), m).otherwise(few))
        return F.when(n >= k, chosen).when(n > 0, few).otherwise(none)

    return _let(words, with_words)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fingerprint(found: Column) -> Column:
    """SHA-256 of all anchors and their places, from :func:`anchor_hashes`; an
    empty string without anchors."""
    listed = F.array_join(F.transform(found, lambda h: F.coalesce(F.hex(h), F.lit(""))), ",")
    return F.when(F.size(found) > 0, F.sha2(listed.cast("binary"), 256)).otherwise("")


def links(found: Column) -> Column:
    """One hash per anchor, of the anchor, the one before it, their distance,
    and how many equal ones the text has before; from :func:`anchor_hashes`."""
    none = F.array().cast("array<bigint>")
    places = F.array_compact(F.transform(found, lambda h, i: F.when(h.isNotNull(), i)))

    def linked(hashes: Column, at: Column) -> Column:
        # (what lies before the first is null, and nulls aren't hashed)
        return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i - 1), F.get(at, i) - F.get(at, i - 1)))

    def numbered(same: Column) -> Column:
        """``same`` is sorted; equal hashes are numbered from 0."""
        n = F.size(same)
        begins = F.filter(
            F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(same, i) != F.get(same, i - 1))
        )
        numbers = _let(
            begins,
            lambda b: F.flatten(
                F.transform(b, lambda x, k: F.sequence(F.lit(0), F.coalesce(F.get(b, k + 1), n) - x - 1))
            ),
        )
        return F.when(n > 0, _let(numbers, lambda m: F.transform(same, lambda h, i: F.xxhash64(h, F.get(m, i))))).otherwise(none)

    return _let(
        _let(F.array_compact(found), lambda hashes: _let(places, lambda at: F.sort_array(linked(hashes, at)))),
        numbered,
    )


def likeness(a: Column, b: Column) -> Column:
    """Share of anchors two texts have in common, 0 to 1 (twice the common ones
    over the sum of both; 1 for two texts without words), from their
    :func:`links`."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))
    )


def anchors(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """One row per closed syncmer of each text: doc_id, pos (0-based word at
    which it starts), anchor (its hash)."""
    return (
        docs.select(F.col("doc_id"), F.posexplode(anchor_hashes(F.col("text"), k, s)))
        .where(F.col("col").isNotNull())
        .select("doc_id", "pos", F.col("col").alias("anchor"))
    )


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Each row with those ``columns`` of the row that follows by ascending
    doc_id (the first row's after the last) in the struct ``next_row``.

    Rows are dealt into ranges of ids, and the rows at the lower end of a
    range also go to the range before it, so one exchange of the texts gives
    every row its successor; no task sees more than its ranges. Rows with the
    same id follow each other by the hash of their text."""
    rows = docs.withColumn("__key", sort_key("doc_id")).withColumn(
        "__tie", F.xxhash64("text")
    )
    bounds = key_bounds(
        docs.select(sort_key("doc_id").alias("__key")), "__key", range_count(docs.sparkSession)
    )
    n = len(bounds)
    at = range_of(F.col("__key"), bounds)
    copies = F.when(
        _is_bound(bounds),
        F.array(
            F.struct(at.alias("range"), F.lit(0).alias("ghost")),
            F.struct(F.pmod(at - 1, F.lit(n)).alias("range"), F.lit(1).alias("ghost")),
        ),
    ).otherwise(F.array(F.struct(at.alias("range"), F.lit(0).alias("ghost"))))
    order = Window.partitionBy("__at.range").orderBy("__at.ghost", "__key", "__tie")
    return (
        rows.withColumn("__at", F.explode(copies))
        .withColumn("next_row", F.lead(F.struct(*columns)).over(order))
        .where(F.col("__at.ghost") == 0)
        .drop("__at", "__key", "__tie")
    )


def _is_bound(bounds: list[int]) -> Column:
    """Whether the key is the lower end of its range."""
    width = 128
    at = range_of(F.col("__key"), bounds, width)
    blocks = F.array(*[F.lit(bounds[i : i + width]) for i in range(0, len(bounds), width)])
    block = F.element_at(blocks, (F.floor(at / width) + 1).cast("int"))
    return F.element_at(block, (at % width + 1).cast("int")) == F.col("__key")


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text, of the text whose last floor(n_chars / 4)
    code points are replaced by the first as many (or all) of the next
    document, and how alike it is to the edited text and to the next one."""
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = (
        with_next(base, ["text"])
        .withColumn("n_chars", n.cast("long"))
        .withColumn(
            "edited",
            F.concat(
                F.substring("text", F.lit(1), n - quarter),
                F.substring(F.col("next_row.text"), F.lit(1), quarter),
            ),
        )
        .select(
            "doc_id",
            "n_chars",
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            anchor_hashes(F.col("text")).alias("own"),
            anchor_hashes(F.col("edited")).alias("edit"),
            anchor_hashes(F.col("next_row.text")).alias("next"),
        )
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            fingerprint(F.col("own")).alias("fingerprint"),
            fingerprint(F.col("edit")).alias("edited_fingerprint"),
            *(links(F.col(c)).alias(c) for c in ("own", "edit", "next")),
        )
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("own"), F.col("edit")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
