"""Deterministic sharded WARC writer, and its reader.

Records are dealt into ranges of page ids that hold about ``RANGE_BYTES`` of
payload each, sorted by page id, and written one gzip member per record. A
range's file rolls over when its compressed size reaches ``ROLL_BYTES``. The
ranges come from a histogram of the ids alone, headers and record ids are
derived from a record's content, and gzip members carry no time, so the same
pages give the same files however the input was partitioned.

Of records with equal payloads of at least ``least`` bytes, the one with the
largest page id is a response and the others are revisits of it; all smaller
payloads are responses.

A file is written under a temporary name and renamed when whole. The manifest,
a table with a row per file, is committed after all files; the reader opens
what it names, parses the members, and computes every response's digest anew.

Nulls: a null html is an empty payload; a null page id sorts first, counts as
the smallest, and its record has no page id; a null url is left out. Rows that
repeat a page id and a payload share its record type. Extra columns are
ignored. An empty table gives an empty manifest and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_KEY, fresh_path, range_of, ship_package, sort_key, written
from .files import get_file, put_file

RANGE_BYTES = 4_000_000  # payload of a range, about
ROLL_BYTES = 16_000_000  # compressed size from which a file rolls over
MOST_RANGES = 16_384
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
RESPONSE, REVISIT = "response", "revisit"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: each 40 bits of the digest are 8 digits."""
    digest = F.sha1(payload)
    parts = [
        F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)
    ]
    return F.translate(
        F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    )


def payload_ranges(sizes: DataFrame, target: int) -> list[int]:
    """Lower ends of ranges of ``key`` with about ``target`` bytes (column n)
    each, from a histogram by the high bits of the key. Buckets with more than
    the target are divided further, so clustered ids don't share a range. Sums
    don't depend on the order of rows, hence neither do the ranges."""
    known = sizes.where(F.col("key") != NULL_KEY)
    row = known.agg(F.min("key"), F.max("key"), F.sum("n")).first()
    if row[0] is None:
        return [0]
    low, high, total = row
    target = max(target, total // (MOST_RANGES // 2))
    shift = 0
    while (high >> shift) - (low >> shift) >= 1024:
        shift += 1

    def histogram(rows: DataFrame, bits: int) -> dict[int, int]:
        found = rows.groupBy(F.shiftright("key", bits).alias("b")).agg(F.sum("n").alias("n"))
        return {r["b"] << bits: r["n"] for r in found.collect()}

    cells = [(start, shift, n) for start, n in histogram(known, shift).items()]
    while True:
        hot = [c for c in cells if c[2] > target and c[1] > 0]
        if not hot:
            break
        bits = max(c[1] for c in hot)
        some = [c for c in hot if c[1] == bits]
        inside = F.shiftright("key", bits).isin([c[0] >> bits for c in some])
        finer = max(0, bits - 6)
        cells = [c for c in cells if c not in some]
        cells += [(s, finer, n) for s, n in histogram(known.where(inside), finer).items()]
    bounds, held = [], None
    for start, _, n in sorted(cells):
        if held is None or held + n > target:
            bounds.append(start)
            held = 0
        held += n
    return bounds


def _record_id(key: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}:{digest}')}>"


def _clean(value: str) -> str:
    """A header's value holds no line ends."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers)
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(head.encode() + b"\r\n" + block + b"\r\n\r\n") + press.flush()


def record(key: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    http = HTTP.format(len(payload)).encode()
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", RESPONSE if refers_to is None else REVISIT),
        ("WARC-Record-ID", _record_id(key, digest)),
        ("WARC-Date", DATE),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", _clean(url)))
    if key != NULL_KEY:
        headers.append(("WARC-Page-ID", str(key)))
    headers.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    headers.append(("WARC-Payload-Length", str(len(payload))))
    block_digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    headers.append(("WARC-Block-Digest", f"sha1:{block_digest}"))
    if refers_to is not None:
        headers += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", _record_id(refers_to, digest)),
            ("WARC-Refers-To-Page-ID", str(refers_to)),
        ]
    headers += [
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return _member(headers, block)


def _info(name: str) -> bytes:
    block = b"software: graded\r\nformat: WARC File Format 1.1\r\n"
    return _member(
        [
            ("WARC-Type", "warcinfo"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
            ("WARC-Date", DATE),
            ("WARC-Filename", name),
            ("Content-Type", "application/warc-fields"),
            ("Content-Length", str(len(block))),
        ],
        block,
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    least: int = 0,
    range_bytes: int = RANGE_BYTES,
    roll_bytes: int = ROLL_BYTES,
) -> DataFrame:
    """Write the files into ``folder``; returns the committed manifest: file,
    range, part, n_records, n_bytes, sha256."""
    ship_package(pages.sparkSession)
    rows = pages.select(
        sort_key(F.col("page_id").cast("long")).alias("key"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", base32_sha1(F.col("payload")))
    sizes = rows.select("key", F.octet_length("payload").cast("long").alias("n"))
    bounds = payload_ranges(sizes, range_bytes)
    # a written table, so that Spark can split the rows of a hot payload in the
    # join: a side that is an aggregate's own output can't be dealt anew
    shared = written(
        rows.where(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.max("key").alias("response"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "response"),
        "warc-shared",
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, urls, payloads, digests, targets = (batch.column(i) for i in range(5))
            members = [
                record(k.as_py(), u.as_py(), p.as_py(), d.as_py(), t.as_py())
                for k, u, p, d, t in zip(keys, urls, payloads, digests, targets, strict=True)
            ]
            yield pa.record_batch([keys, digests, pa.array(members, pa.binary())], ["key", "digest", "member"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, parts, held, count = None, 0, [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal part, parts, held, count
            name = f"pages-{now:06d}-{part:06d}.warc.gz"
            raw = [_info(name), *parts]
            put_file(folder, name, raw)
            sha = hashlib.sha256()
            for x in raw:
                sha.update(x)
            row = pa.RecordBatch.from_pydict(
                {
                    "file": [name],
                    "range": pa.array([now], pa.int32()),
                    "part": pa.array([part], pa.int32()),
                    "n_records": pa.array([count], pa.int64()),
                    "n_bytes": pa.array([sum(map(len, raw))], pa.int64()),
                    "sha256": [sha.hexdigest()],
                }
            )
            part, parts, held, count = part + 1, [], 0, 0
            return row

        for batch in batches:
            for at, member in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if now is not None and at != now:
                    if parts:
                        yield close()
                    part = 0
                now = at
                raw = member.as_py()
                parts.append(raw)
                held += len(raw)
                count += 1
                if held >= roll_bytes:
                    yield close()
        if parts:
            yield close()

    members = (
        rows.join(shared, "digest", "left")
        .withColumn("refers_to", F.when(F.col("response") != F.col("key"), F.col("response")))
        .select("key", "url", "payload", "digest", "refers_to")
        .mapInArrow(build, "key long, digest string, member binary")
    )
    return written(
        members.withColumn("range", range_of(F.col("key"), bounds))
        .repartition(F.col("range"))
        .sortWithinPartitions("range", "key", "digest", F.xxhash64("member"))
        .select("range", "member")
        .mapInArrow(
            write, "file string, range int, part int, n_records long, n_bytes long, sha256 string"
        ),
        "warc-manifest",
    )


def records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file."""
    view, at = memoryview(raw), 0
    while at < len(view):
        out, d = [], zlib.decompressobj(31)
        while not d.eof:
            if at >= len(view):
                raise ValueError("a record is cut off")
            chunk = view[at : at + 65_536]
            out.append(d.decompress(chunk))
            at += len(chunk) - len(d.unused_data)
        head, _, rest = b"".join(out).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        if len(rest) != size + 4:
            raise ValueError("a record's length differs from its header")
        yield headers, rest[:size]


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Per record, from the files: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url. A response whose payload doesn't match its
    digest, or a file that doesn't match its manifest row, is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = get_file(folder, row["file"])
                if hashlib.sha256(raw).hexdigest() != row["sha256"]:
                    raise ValueError(f"{row['file']} differs from the manifest")
                out = []
                for headers, block in records(raw):
                    kind = headers["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(headers["WARC-Payload-Length"])
                    if kind == RESPONSE:
                        payload = block.partition(b"\r\n\r\n")[2]
                        size = len(payload)
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{headers['WARC-Record-ID']}: wrong payload digest")
                    page, target = headers.get("WARC-Page-ID"), headers.get("WARC-Refers-To-Page-ID")
                    out.append(
                        {
                            "page_id": None if page is None else int(page),
                            "payload_bytes": size,
                            "payload_digest": digest,
                            "record_type": kind,
                            "refers_to": None if target is None else int(target),
                            "url": headers.get("WARC-Target-URI"),
                        }
                    )
                yield pa.RecordBatch.from_pylist(out, schema=FIELDS)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        manifest.select("file", "sha256")
        .repartition(n, "file")
        .mapInArrow(
            run,
            "page_id long, payload_bytes long, payload_digest string, record_type string, "
            "refers_to long, url string",
        )
    )


FIELDS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("url", pa.string()),
    ]
)


def write_and_read(pages: DataFrame, least: int = 0) -> DataFrame:
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, least), folder).drop("url")
