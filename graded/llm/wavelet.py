"""Token ids in wavelet-matrix shards.

A shard file holds the ids of a run of documents in ascending doc_id order,
each document ended by an end id. Its ids are stored as one bit-plane per bit
of the largest id, highest bit first; after each plane the ids are dealt
stably into those with a 0 and those with a 1 (a wavelet matrix). A plane is
cut into blocks that are compressed one by one, with the number of ones before
each block, so rank and select read one block per plane: an id by position,
the count of an id in a range and its n-th occurrence all come from the one
compressed file.

File: magic, length of the JSON header, header, then the byte ranges that the
header lists: doc ids, token counts, plane blocks (all zstandard).

Writing: documents are dealt into ranges of ids, sorted, and encoded by range;
a range's file rolls over at ``SHARD_IDS`` ids, between documents. Files get
their final names when whole, and the manifest, a table with one row per file,
is committed after all of them; readers open what the manifest names.

Nulls: a null text counts as empty (the end id alone), a null doc_id sorts
first. Repeated rows stay repeated rows; those with one id follow each other
in the order of their texts' hashes. Extra columns are ignored. An empty table
gives an empty manifest.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_KEY, fresh_path, key_bounds, range_count, range_of, ship_package, sort_key, written
from .bpe import byte_symbols
from .files import get_file, put_file
from .pretokens import KEEP, ChunkEncoder, read_tokenizer, special_ids

MAGIC = b"WVLT0001"
SHARD_IDS = 4_000_000  # a file rolls over between documents once it has as many
BLOCK = 8192  # bytes of a plane in one compressed block
BITS = 8 * BLOCK
PIECES = 800_000  # remembered pieces (160 MB)
JOINED = 256  # pieces in one text for the library


class WaveletMatrix:
    """Bit-planes with rank and select over an array of ids."""

    def __init__(self, n: int, width: int, zeros: list[int], ones: list[np.ndarray], read):
        """``zeros``: zeros per plane; ``ones``: per plane, ones before each
        block; ``read(level, block)``: that block's bytes."""
        self.n, self.width, self.zeros = n, width, zeros
        self._ones, self._read = ones, read
        self._last: dict[int, tuple[int, bytes]] = {}

    def _block(self, level: int, block: int) -> bytes:
        kept = self._last.get(level)
        if kept is None or kept[0] != block:
            self._last[level] = kept = (block, self._read(level, block))
        return kept[1]

    def _bit(self, level: int, i: int) -> int:
        raw = self._block(level, i // BITS)
        return (raw[i % BITS // 8] >> (7 - i % 8)) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block, rest = divmod(i, BITS)
        if rest == 0:
            return int(self._ones[level][block])
        raw = np.frombuffer(self._block(level, block), dtype=np.uint8)
        full, bits = divmod(rest, 8)
        count = int(np.bitwise_count(raw[:full]).sum())
        if bits:
            count += int(raw[full] >> (8 - bits)).bit_count()
        return int(self._ones[level][block]) + count

    def _select(self, level: int, k: int, bit: int) -> int:
        """Position of the k-th (0-based) one or zero of a plane."""
        ones = self._ones[level]
        edges = ones if bit else np.arange(len(ones)) * BITS - ones
        if not bit:  # the last edge counts the bits there are
            edges[-1] = self.n - ones[-1]
        block = int(np.searchsorted(edges, k, side="right")) - 1
        bits = np.unpackbits(np.frombuffer(self._block(level, block), dtype=np.uint8))
        bits = bits[: min(BITS, self.n - block * BITS)]
        return block * BITS + int(np.nonzero(bits == bit)[0][k - int(edges[block])])

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        value = 0
        for level in range(self.width):
            bit = self._bit(level, i)
            ones = self._rank1(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        if value >> self.width:
            return 0, 0
        for level in range(self.width):
            bit = value >> (self.width - 1 - level) & 1
            a, b = self._rank1(level, start), self._rank1(level, end)
            if bit:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id in a range of positions."""
        a, b = self._range(value, start, self.n if end is None else end)
        return b - a

    def occurrence(self, value: int, k: int) -> int:
        """Position of an id's k-th (0-based) occurrence; -1 if it has fewer."""
        a, b = self._range(value, 0, self.n)
        if not 0 <= k < b - a:
            return -1
        i = a + k
        for level in reversed(range(self.width)):
            bit = value >> (self.width - 1 - level) & 1
            i = self._select(level, i - self.zeros[level], 1) if bit else self._select(level, i, 0)
        return i

    def all_ids(self) -> np.ndarray:
        """Every id in order: each plane's deal undone, from the last one up."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        out = np.zeros(self.n, dtype=kind)
        for level in reversed(range(self.width)):
            raw = b"".join(self._read(level, b) for b in range(len(self._ones[level]) - 1))
            ones = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=self.n).view(bool)
            dealt = out
            out = np.empty_like(dealt)
            cut = self.zeros[level]
            out[np.flatnonzero(~ones)] = dealt[:cut]
            out[np.flatnonzero(ones)] = dealt[cut:] | kind(1 << (self.width - 1 - level))
        return out.astype(np.uint32)


def planes(ids: np.ndarray, width: int) -> Iterator[tuple[bytes, int]]:
    """Bytes and number of zeros of each plane, highest bit first."""
    for level in range(width):
        ones = (ids & ids.dtype.type(1 << (width - 1 - level))) != 0
        yield np.packbits(ones).tobytes(), int(len(ids) - np.count_nonzero(ones))
        ids = np.concatenate([np.compress(~ones, ids), np.compress(ones, ids)])


def pack(keys: np.ndarray, counts: np.ndarray, ids: np.ndarray, width: int) -> list[bytes]:
    """A shard file's bytes. ``width``: bits of the largest id there may be."""
    press = zstandard.ZstdCompressor(level=1).compress
    body = [press(keys.astype("<i8").tobytes()), press(counts.astype("<i8").tobytes())]
    sizes = [len(b) for b in body]
    zeros, ones, blocks = [], [], []
    narrow = ids.astype(np.uint16 if width <= 16 else np.uint32)
    for raw, n_zeros in planes(narrow, width):
        zeros.append(n_zeros)
        cuts = [raw[a : a + BLOCK] for a in range(0, len(raw), BLOCK)]
        seen = np.cumsum([0, *[int(np.bitwise_count(np.frombuffer(c, dtype=np.uint8)).sum()) for c in cuts]])
        ones.append(seen.tolist())
        pressed = [press(c) for c in cuts]
        blocks.append([len(c) for c in pressed])
        body.extend(pressed)
    header = json.dumps(
        {"n": len(ids), "docs": len(keys), "width": width, "head": sizes, "zeros": zeros, "ones": ones, "blocks": blocks}
    ).encode()
    return [MAGIC, len(header).to_bytes(8, "little"), header, *body]


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """Doc ids, token counts and the wavelet matrix of a shard file."""
    if raw[:8] != MAGIC:
        raise ValueError("not a wavelet shard")
    size = int.from_bytes(raw[8:16], "little")
    head = json.loads(raw[16 : 16 + size])
    at = 16 + size
    out = zstandard.ZstdDecompressor().decompress
    lists = []
    for n in head["head"]:
        lists.append(np.frombuffer(out(raw[at : at + n]), dtype="<i8"))
        at += n
    begins = []
    for sizes in head["blocks"]:
        ends = at + np.cumsum([0, *sizes])
        begins.append(ends.tolist())
        at = int(ends[-1])
    read = lambda level, b: out(raw[begins[level][b] : begins[level][b + 1]])
    ones = [np.array(x, dtype=np.int64) for x in head["ones"]]
    return lists[0], lists[1], WaveletMatrix(head["n"], head["width"], head["zeros"], ones, read)


class LibraryEncoder:
    """Ids by the tokenizers library, each distinct piece encoded by it.

    Short pieces of a space and other characters go to it many in one text: it
    starts a piece at each of those spaces, and of a piece's ids the first one
    alone begins with a space. So the text's ids are dealt to its pieces."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self.width = max(1, (self._tokenizer.get_vocab_size() - 1).bit_length())
        spec = read_tokenizer(path)
        vocab, space = spec["model"]["vocab"], byte_symbols()[32]
        self._spaced = np.zeros(1 << self.width, dtype=bool)
        self._spaced[[i for s, i in vocab.items() if s.startswith(space)]] = True
        self._chunks = ChunkEncoder(self._pieces, special_ids(spec), PIECES)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        ids = [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), dtype="<u4"), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`_library`, for pieces of a space and other characters."""
        flat, _ = self._library(["".join(pieces[a : a + JOINED]) for a in range(0, len(pieces), JOINED)])
        first = np.flatnonzero(self._spaced[flat])
        if len(first) != len(pieces):  # a vocabulary without a space, or a special token with one
            return self._library(pieces)
        return flat, np.diff(first, append=len(flat))

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        joins = [p[0] == " " and 1 < len(p) <= KEEP and not p[1].isspace() for p in pieces]
        out: list[list[bytes]] = []
        for encode, some in (
            (self._joined, list(compress(pieces, joins))),
            (self._library, [p for p, j in zip(pieces, joins) if not j]),
        ):
            flat, sizes = encode(some)
            raw, ends = flat.tobytes(), (4 * np.cumsum(sizes)).tolist()
            out.append([raw[a:b] for a, b in zip([0, *ends], ends)])
        together, alone = map(iter, out)
        return [next(together if j else alone) for j in joins]

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._chunks.encode(texts)


_LOADED: dict[str, LibraryEncoder] = {}  # one per worker and path
BATCH = 2500  # texts encoded at a time, of however many ranges
END_ID = 0


def _with_ends(flat: np.ndarray, starts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the end id after each text's, and the counts."""
    counts = np.diff(starts) + 1
    return np.insert(flat, starts[1:], end_id).astype(np.uint32), counts


def write_shards(
    docs: DataFrame, tokenizer: str, folder: str, shard_ids: int = SHARD_IDS, end_id: int = END_ID
) -> DataFrame:
    """Write the shard files into ``folder``; returns the committed manifest:
    file, range, part, n_docs, n_ids, base (ids in all files before it)."""
    rows = docs.select(
        sort_key(F.col("doc_id").cast("long")).alias("key"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    spark = docs.sparkSession
    ship_package(spark)
    bounds = key_bounds(rows.select("key"), "key", range_count(spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _LOADED:
            _LOADED[tokenizer] = LibraryEncoder(tokenizer)
        encoder = _LOADED[tokenizer]
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held, now, part = 0, None, 0

        def close() -> pa.RecordBatch:
            nonlocal held, part
            name = f"range-{now:06d}-{part:06d}.wavelet"
            k, c, x = np.concatenate(keys), np.concatenate(counts), np.concatenate(ids)
            put_file(folder, name, pack(k, c, x, encoder.width))
            row = pa.RecordBatch.from_pylist(
                [{"file": name, "range": now, "part": part, "n_docs": len(k), "n_ids": len(x)}],
                schema=pa.schema(
                    [("file", pa.string()), ("range", pa.int32()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]
                ),
            )
            keys.clear(), counts.clear(), ids.clear()
            held, part = 0, part + 1
            return row

        for batch in batches:
            for c in range(0, batch.num_rows, BATCH):
                some = batch.slice(c, BATCH)
                flat, starts = encoder.encode(some.column("text"))
                more, n = _with_ends(flat, starts, end_id)
                key, at = some.column("key").to_numpy(), some.column("range").to_numpy()
                ends = np.cumsum(n)
                # a new range begins where the number changes
                cuts = [0, *(np.nonzero(np.diff(at))[0] + 1).tolist(), len(at)]
                for a, b in zip(cuts, cuts[1:]):
                    if now is not None and at[a] != now:
                        if held:
                            yield close()
                        part = 0
                    now = int(at[a])
                    # roll over between documents
                    done = a
                    while done < b:
                        before = int(ends[done - 1]) if done else 0
                        upto = int(np.searchsorted(ends, before + shard_ids - held)) + 1
                        upto = min(max(upto, done + 1), b)
                        keys.append(key[done:upto])
                        counts.append(n[done:upto])
                        ids.append(more[before : int(ends[upto - 1])])
                        held += int(ends[upto - 1]) - before
                        done = upto
                        if held >= shard_ids:
                            yield close()
        if held:
            yield close()

    manifest = written(
        rows.withColumn("range", range_of(F.col("key"), bounds))
        .withColumn("tie", F.xxhash64("text"))
        .repartition(F.col("range"))
        .sortWithinPartitions("range", "key", "tie")
        .select("range", "key", "text")
        .mapInArrow(run, "file string, range int, part int, n_docs long, n_ids long"),
        "wavelet-manifest",
    )
    # one row per file: few, however long the texts
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts, matrix = unpack(get_file(folder, row["file"]))
                raw = memoryview(matrix.all_ids().astype("<u4").tobytes())
                ends = np.cumsum(counts)
                starts = ends - counts
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch(
                    [
                        pa.array(keys, pa.int64(), mask=keys == NULL_KEY),
                        pa.array(starts + row["base"], pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    ship_package(manifest.sparkSession)
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        manifest.select("file", "base")
        .repartition(n, "file")
        .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def write_and_read(docs: DataFrame, tokenizer: str) -> DataFrame:
    folder = fresh_path(docs.sparkSession, "wavelet")
    return read_shards(write_shards(docs, tokenizer, folder), folder)
