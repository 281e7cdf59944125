"""Byte-level BPE encoding and decoding by a segment tree over pair ranks.

A piece starts as its bytes. Leaf ``i`` of a segment tree holds (rank of the
pair that starts at symbol ``i``, ``i``); an inner node holds the smaller of
its two children, so the root yields the lowest-ranked merge, the leftmost of
equals. A merge changes three leaves (the merged pair's, the one it consumes,
the one before it), each a point update along one path to the root. It ends
when the root holds no mergeable pair.

Short pieces run in lockstep: the trees of many pieces of like length are the
rows of one numpy array, and each step applies every row's own root merge.
Long pieces run one at a time.

Nulls: a null text counts as empty and has no ids. Repeated rows stay repeated
rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package
from .pretokens import ChunkEncoder, gather, read_tokenizer, special_ids

NO_PAIR = np.int64(2**62)
LOCKSTEP = 64  # bytes; longer pieces run one at a time
ROWS = 8192  # pieces in one lockstep array


def byte_symbols() -> dict[int, str]:
    """Byte -> the character that stands for it in a byte-level vocabulary:
    printable ones for themselves, the others from U+0100 on, in order."""
    out, extra = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class Merges:
    """Merge ranks of a vocabulary: pair of ids -> (rank, merged id)."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab = model["vocab"]
        symbols = byte_symbols()
        back = {c: b for b, c in symbols.items()}
        self.byte_id = np.array([vocab[symbols[b]] for b in range(256)], dtype=np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.base = np.int64(max(vocab.values()) + 1)
        keys = np.array([vocab[a] * int(self.base) + vocab[b] for a, b in pairs], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order.astype(np.int64)
        self.rank_of = {(int(k) // int(self.base), int(k) % int(self.base)): r for r, k in enumerate(keys)}
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in vocab.items() if all(c in back for c in s)}
        for s, i in special_ids(spec).items():
            self.bytes_of[i] = s.encode()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; a negative one where they don't merge."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], -1)


def encode_one(piece: bytes, merges: Merges) -> list[int]:
    """Ids of one piece of any length."""
    symbols = merges.byte_id[np.frombuffer(piece, dtype=np.uint8)].tolist()
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 1).bit_length()
    rank_of, merged = merges.rank_of, merges.merged
    none = int(NO_PAIR)
    tree = [none] * (2 * size)
    for i in range(n - 1):
        r = rank_of.get((symbols[i], symbols[i + 1]))
        if r is not None:
            tree[size + i] = r * size + i
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            value = a if a < b else b
            if tree[k] == value:
                return
            tree[k] = value
            k >>= 1

    def pair(i: int, j: int) -> int:
        r = rank_of.get((symbols[i], symbols[j])) if j < n else None
        return none if r is None else r * size + i

    while tree[1] != none:
        rank, i = divmod(tree[1], size)
        j = after[i]
        k = after[j]
        symbols[i] = int(merged[rank])
        symbols[j] = -1
        after[i] = k
        if k < n:
            before[k] = i
        put(j, none)
        put(i, pair(i, k))
        p = before[i]
        if p >= 0:
            put(p, pair(p, i))
    return [s for s in symbols if s >= 0]


def encode_rows(pieces: list[bytes], merges: Merges, size: int) -> list[bytes]:
    """Ids of pieces of at most ``size`` bytes (a power of two, 2 or more), in
    lockstep; as bytes of little-endian unsigned 32-bit integers."""
    rows = len(pieces)
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=rows)
    flat = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), dtype=np.uint8)
    symbols = merges.byte_id[flat].reshape(rows, size)
    symbols[np.arange(size) >= lengths[:, None]] = -1
    tree = np.full((rows, 2 * size), NO_PAIR, dtype=np.int64)
    left, right = symbols[:, :-1], symbols[:, 1:]
    rank = np.where((left >= 0) & (right >= 0), merges.ranks(left, right), -1)
    spots = np.arange(size - 1)
    tree[:, size : 2 * size - 1] = np.where(rank >= 0, rank * size + spots, NO_PAIR)
    step = size
    while step > 1:
        half = step // 2
        np.minimum(tree[:, step : 2 * step : 2], tree[:, step + 1 : 2 * step : 2], out=tree[:, half:step])
        step = half
    after = np.tile(np.arange(1, size + 1), (rows, 1))
    before = np.tile(np.arange(-1, size - 1), (rows, 1))

    def pairs(r: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Leaf values of the pairs (i, j) in rows r; j may be past the end."""
        inside = (i >= 0) & (j < lengths[r])
        found = merges.ranks(symbols[r, np.maximum(i, 0)], symbols[r, np.minimum(j, size - 1)])
        return np.where(inside & (found >= 0), found * size + i, NO_PAIR)

    def put(r: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
        k = size + i
        tree[r, k] = value
        k = k >> 1
        while k[0]:  # all leaves have the same depth
            tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])
            k = k >> 1

    live = np.nonzero(tree[:, 1] != NO_PAIR)[0]
    while len(live):
        root = tree[live, 1]
        rank, i = root // size, root % size
        j = after[live, i]
        k = after[live, j]
        symbols[live, i] = merges.merged[rank]
        symbols[live, j] = -1
        after[live, i] = k
        has = k < size
        before[live[has], k[has]] = i[has]
        put(live, j, np.full(len(live), NO_PAIR))
        put(live, i, pairs(live, i, k))
        p = before[live, i]
        has = p >= 0
        if has.any():
            put(live[has], p[has], pairs(live[has], p[has], i[has]))
        live = live[tree[live, 1] != NO_PAIR]
    kept = symbols >= 0
    ids = symbols[kept].astype("<u4").tobytes()
    ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
    return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def encode_pieces(pieces: list[str], merges: Merges) -> list[bytes]:
    """Ids of each piece; pieces of like length share one array."""
    raw = [p.encode() for p in pieces]
    out: list[bytes] = [b""] * len(raw)
    groups: dict[int, list[int]] = {}
    for n, b in enumerate(raw):
        size = max(2, 1 << (len(b) - 1).bit_length()) if b else 0
        groups.setdefault(size, []).append(n)
    for size, members in groups.items():
        if size == 0:
            continue
        if size > LOCKSTEP:
            for n in members:
                out[n] = np.array(encode_one(raw[n], merges), dtype="<u4").tobytes()
            continue
        for a in range(0, len(members), ROWS):
            some = members[a : a + ROWS]
            for n, ids in zip(some, encode_rows([raw[n] for n in some], merges, size), strict=True):
                out[n] = ids
    return out


class Bpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        spec = read_tokenizer(path)
        self.merges = Merges(spec)
        self._chunks = ChunkEncoder(lambda p: encode_pieces(p, self.merges), special_ids(spec))
        top = max(self.merges.bytes_of)
        self._bytes = [self.merges.bytes_of.get(i, b"") for i in range(top + 1)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes of little-endian unsigned 32-bit integers."""
        flat, starts = self._chunks.encode(texts)
        raw = memoryview(flat.tobytes())
        cuts = (4 * starts).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def forget(self) -> None:
        self._chunks.forget()

    def decode_bytes(self, ids: list[bytes]) -> list[bytes]:
        """UTF-8 of each list of ids; bytes that aren't UTF-8 become
        replacement characters."""
        at = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int64)
        flat, ends = gather(self._bytes, at, 1, "u1")
        ends = np.concatenate([[0], ends])
        cuts = ends[np.cumsum([0, *[len(x) // 4 for x in ids]])].tolist()
        raw = flat.tobytes()
        return [_valid(raw[a:b]) for a, b in zip(cuts, cuts[1:])]

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes([ids])[0].decode()


def _valid(raw: bytes) -> bytes:
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()


_LOADED: dict[str, Bpe] = {}  # one per worker and path


def _bpe(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


BATCH = 1000  # texts encoded at a time


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    for a in range(0, batch.num_rows, BATCH):
        some = batch.slice(a, BATCH)
        yield some.column(0), [t or "" for t in some.column(1).to_pylist()]


def encode_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (array of int) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(tokenizer)
        for batch in batches:
            for keys, texts in _runs(batch):
                ids = [np.frombuffer(b, dtype="<u4").astype(np.int32) for b in bpe.encode(texts)]
                yield pa.record_batch([keys, pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
        bpe.forget()

    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_table(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text of every row's ids (null ids: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(tokenizer)
        for batch in batches:
            ids = [np.asarray(x or [], dtype="<u4").tobytes() for x in batch.column(1).to_pylist()]
            texts = [b.decode() for b in bpe.decode_bytes(ids)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    ship_package(encoded.sparkSession)
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids")
    return rows.mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of each text's ids and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(tokenizer)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for keys, texts in _runs(batch):
                ids = bpe.encode(texts)
                yield pa.record_batch(
                    [
                        keys,
                        pa.array([len(b) // 4 for b in ids], pa.int64()),
                        pa.array([sha(b) for b in ids], pa.string()),
                        pa.array([sha(b) for b in bpe.decode_bytes(ids)], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
