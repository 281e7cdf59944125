"""SimHash near-duplicates by vantage-point trees.

Words of the text, with A-Z in lower case, make shingles of three words; a bit
of the 64-bit fingerprint is 1 if it is set in over half the shingles' hashes.
Fingerprints link at ``RADIUS`` or fewer differing bits; the answer is each
document's connected component.

Distinct fingerprints only enter the trees, so a group of copies is one point.
Two trees are made, one over the Hamming distance on each half of the bits
(itself a metric): a pair within 3 bits differs by at most 1 bit in one of its
halves, so each tree is searched with radius 1. At each level a vantage point
and a radius split the points into near and far ones. By the triangle
inequality the ball around a point reaches the other side only if its distance
to the vantage point is next to the radius; such a point is also sent there,
as a query. All others are pruned. The leaves are the shards: in each, the
points it owns are compared, on all 64 bits, with all points it was sent, in
blocks. A leaf returns at most one edge per point (a spanning forest of its
links), never its pairs. A leaf that outgrows ``BIG`` is cut into blocks of
own points against blocks of all points, which are tasks of their own.

The tree's description is a vantage point and a radius per level and half,
taken from a bounded sample; any choice gives the same exact result. The
number of levels follows the number of points.

Nulls: a null text counts as empty (fingerprint 0, linked like any other); a
null doc_id counts as smaller than all others. Repeated rows stay repeated
rows. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NULL_KEY, boxed, ship_package, sort_key, unboxed, written
from .components import components

WORDS = 3  # words of a shingle
SEED = 42
RADIUS = 3  # bits
LEAF = 512  # points a leaf owns, about
BIG = 50_000  # rows of a leaf, or of a block of a large leaf, about
SAMPLE = 4096  # fingerprints that vantage points and radii are taken from
HALVES = (np.uint64(0xFFFFFFFF00000000), np.uint64(0x00000000FFFFFFFF))
NEAR = RADIUS // len(HALVES)  # search radius in a half


def shingle_hashes(text: str, words: int = WORDS) -> list[int]:
    """XXH64 of each shingle, repeats included. Bytes lower-case A-Z only and
    split at exactly the six ASCII white-space characters."""
    found = text.encode().lower().split()
    h = xxhash.xxh64_intdigest
    if len(found) <= words:
        return [h(b" ".join(found), SEED)] if found else []
    joined = b" ".join(found)
    begin = list(accumulate(map(len, found), lambda at, n: at + n + 1, initial=0))
    return [h(joined[a : b - 1], SEED) for a, b in zip(begin, begin[words:])]


def fingerprints_of(texts: list[str], words: int = WORDS) -> np.ndarray:
    """The texts' fingerprints as unsigned 64-bit integers."""
    out = np.zeros(len(texts), dtype=np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for n, text in enumerate(texts):
        hashes = np.array(shingle_hashes(text, words), dtype="<u8")
        ones = np.zeros(64, dtype=np.int64)
        for a in range(0, len(hashes), 65_536):
            bits = np.unpackbits(hashes[a : a + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.uint32)
        out[n] = weights[2 * ones > len(hashes)].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """key (doc_id, null as the smallest), tie (a hash of the text), fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = fingerprints_of([t or "" for t in batch.column(2).to_pylist()], words)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["key", "tie", "fp"]
            )

    ship_package(docs.sparkSession)
    return docs.select(
        sort_key(F.col("doc_id").cast("long")).alias("key"),
        F.xxhash64("text").alias("tie"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(run, "key long, tie long, fp long")


def _tree(points: DataFrame, n: int) -> list[list[tuple[int, int]]]:
    """Per half, (vantage point, radius) of each level. The radius is the
    median distance in a bounded sample of the points."""
    levels = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))
    rows = points.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect() if levels else []
    sample = np.array([r["fp"] for r in rows], dtype=np.int64).view(np.uint64)
    trees = []
    for mask in HALVES:
        tree = []
        for level in range(levels):
            vantage = sample[level % len(sample)]
            far = np.bitwise_count((sample ^ vantage) & mask)
            tree.append((int(vantage), int(np.median(far))))
        trees.append(tree)
    return trees


def _descend(fps: np.ndarray, mask: np.uint64, tree: list[tuple[int, int]]):
    """(index of the point, leaf, whether the leaf owns it) for every leaf
    that a ball around a point reaches."""
    at = np.arange(len(fps))
    leaf = np.zeros(len(fps), dtype=np.int64)
    own = np.ones(len(fps), dtype=bool)
    for vantage, radius in tree:
        far = np.bitwise_count((fps ^ np.uint64(vantage)) & mask).astype(np.int64)[at]
        outside = far > radius
        # the nearest and the farthest distance within the ball
        both = np.where(outside, far - NEAR <= radius, far + NEAR > radius)
        extra = np.flatnonzero(both)
        leaf = np.concatenate([leaf * 2 + outside, leaf[extra] * 2 + ~outside[extra]])
        at = np.concatenate([at, at[extra]])
        own = np.concatenate([own, np.zeros(len(extra), dtype=bool)])
    return at, leaf, own


def _assign(points: DataFrame, trees: list[list[tuple[int, int]]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for n, (mask, tree) in enumerate(zip(HALVES, trees, strict=True)):
                at, leaf, own = _descend(fps, mask, tree)
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(at), n, dtype=np.int32)),
                        pa.array(leaf),
                        pa.array(fps[at].view(np.int64)),
                        pa.array(own),
                    ],
                    ["half", "leaf", "fp", "own"],
                )

    return points.select("fp").mapInArrow(run, "half int, leaf long, fp long, own boolean")


def forest(own: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect, within own and others, all that the links between
    an own and any other point connect; at most one edge per point."""
    nodes = np.unique(np.concatenate([own, others]))
    a, b = np.searchsorted(nodes, own), np.searchsorted(nodes, others)
    parent = np.arange(len(nodes))
    step = max(1, 2**20 // max(1, len(others)))
    for s in range(0, len(own), step):
        close = np.bitwise_count(own[s : s + step, None] ^ others[None, :]) <= RADIUS
        rows, cols = np.nonzero(close)
        more = a[s + rows] != b[cols]
        rows, cols = rows[more], cols[more]
        cuts = np.flatnonzero(np.diff(rows, prepend=-1))
        for c, e in zip(cuts, [*cuts[1:], len(rows)]):
            idx = np.append(b[cols[c:e]], a[s + rows[c]])
            root = parent[idx]
            while True:
                up = parent[root]
                if (up == root).all():
                    break
                root = up
            low = root.min()
            parent[root] = low
            parent[idx] = low
    while True:
        up = parent[parent]
        if (up == parent).all():
            break
        parent = up
    linked = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[linked], nodes[parent[linked]]


def _blocks(assigned: DataFrame) -> DataFrame:
    """Rows with a block and a role (0 other, 1 both, 2 own). All rows of a
    usual leaf make one block; a leaf over ``BIG`` rows is cut into m blocks
    of own points times k blocks of all points, so that each own point meets
    each other point in one block."""
    usual = F.struct(
        F.lit(0).alias("s"), F.lit(0).alias("t"), F.when(F.col("own"), 1).otherwise(0).alias("role")
    )
    sizes = assigned.groupBy("half", "leaf").agg(F.count("*").alias("n"), F.count_if("own").alias("n_own"))
    big = (
        sizes.where(F.col("n") > BIG)
        .withColumn("m", F.ceil(F.col("n_own") / BIG).cast("int"))
        .withColumn("k", F.ceil(F.col("n") / BIG).cast("int"))
        .drop("n", "n_own")
    )
    if big.isEmpty():
        return assigned.withColumn("at", usual).select("half", "leaf", "fp", "at.*")
    spot = F.xxhash64("fp")
    s, t = F.pmod(spot, F.col("m")).cast("int"), F.pmod(F.xxhash64(spot), F.col("k")).cast("int")
    as_other = F.transform(
        F.sequence(F.lit(0), F.col("m") - 1),
        lambda i: F.struct(i.alias("s"), t.alias("t"), F.lit(0).alias("role")),
    )
    as_own = F.transform(
        F.sequence(F.lit(0), F.col("k") - 1),
        lambda j: F.struct(s.alias("s"), j.alias("t"), F.lit(2).alias("role")),
    )
    at = F.when(F.col("m").isNull(), F.array(usual)).otherwise(
        F.when(F.col("own"), F.concat(as_other, as_own)).otherwise(as_other)
    )
    return (
        assigned.join(big, ["half", "leaf"], "left")
        .withColumn("at", F.explode(at))
        .select("half", "leaf", "fp", "at.*")
    )


def links(points: DataFrame, n: int) -> DataFrame:
    """Edges a, b that connect all distinct fingerprints (column fp of
    ``points``, of which there are ``n``) that links connect."""
    assigned = _assign(points, _tree(points, n))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        fps, role = rows["fp"].to_numpy().view(np.uint64), rows["role"].to_numpy()
        a, b = forest(fps[role >= 1], fps[role <= 1])
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return _blocks(assigned).groupBy("half", "leaf", "s", "t").applyInPandas(run, "a long, b long")


def labelled(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """key, tie, fp and root (the fingerprint that stands for the component)
    of every row, and low (the smallest key in the component)."""
    rows = written(fingerprints(docs, words), "simhash")
    points = written(rows.groupBy("fp").agg(F.min("key").alias("low")), "simhash-points")
    roots = components(links(points, points.count()))
    found = points.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "low"
    )
    lows = found.groupBy("root").agg(F.min("low").alias("low"))
    return rows.join(found.drop("low").join(lows, "root"), "fp", "left")


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    null = lambda c: F.when(F.col(c) != NULL_KEY, F.col(c))
    return labelled(docs, words).select(
        null("key").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        null("low").alias("component_id"),
    )


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The same columns, with one row of each component: that with the
    smallest doc_id (a null one is the smallest), of repeated ids that with the
    smallest hash of its text. Rows that repeat both an id and a text are told
    apart by nothing that counts here: one of them stays, with the smallest
    values of the other columns. Null texts are fingerprint zero, like empty
    ones; an empty table stays empty."""
    keep = (
        labelled(docs, words)
        .groupBy("root")
        .agg(F.min(F.struct("key", "tie")).alias("first"))
        .select("first.key", "first.tie")
    )
    rows = boxed(docs, key=sort_key(F.col("doc_id").cast("long")), tie=F.xxhash64("text"))
    kept = rows.join(keep, ["key", "tie"], "left_semi").groupBy("key", "tie")
    ordered = all(_orderable(f.dataType) for f in docs.schema.fields)
    return unboxed(kept.agg((F.min if ordered else F.first)("row").alias("row")), docs.columns)


def _orderable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType))
