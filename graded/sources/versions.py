"""Results in versioned folders: a new result stands whole before the old one goes.

A result's folder holds a folder per version and a manifest per version, a file
that names it. A version is written first, wholly; then its manifest appears
under its final name by a rename. Readers take the version of the latest
manifest, so a writer that ends midway leaves the result as it was, and readers
never see a part. Of two writers at once, both results stand and the one whose
manifest came last is read. Works on any file system that Spark reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

MANIFEST = "_manifest-"
KEPT = 2  # versions that stay: readers of the last one may still be at work


class Files:
    """Hadoop's file system of a path."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._io = spark._jvm.org.apache.hadoop.io.IOUtils
        self._bytes = spark._jvm.java.io.ByteArrayOutputStream

    def names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def read(self, path: str) -> bytes:
        out = self._bytes()
        self._io.copyBytes(self._fs.open(self._path(path)), out, 4096, True)
        return bytes(out.toByteArray())

    def publish(self, path: str, raw: bytes) -> bool:
        """Write a file that appears whole; False if there is one of that name."""
        final, part = self._path(path), self._path(f"{path}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(part, True)
        try:
            out.write(bytearray(raw))
        finally:
            out.close()
        done = not self._fs.exists(final) and self._fs.rename(part, final)
        self._fs.delete(part, False)
        return done

    def drop(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


def _manifests(files: Files, path: str) -> list[str]:
    return [n for n in files.names(path) if n.startswith(MANIFEST) and not n.endswith(".tmp")]


def write_version(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """``write(folder)`` writes the whole result into a new folder; after that it
    is the current version of ``path``. Returns its folder."""
    path = path.rstrip("/")
    files = Files(spark, path)
    name = f"v-{uuid.uuid4().hex[:12]}"
    write(f"{path}/{name}")
    there = _manifests(files, path)
    number = 1 + (int(there[-1].removeprefix(MANIFEST)) if there else 0)
    while not files.publish(f"{path}/{MANIFEST}{number:010d}", name.encode()):
        number += 1
    for old in _manifests(files, path)[:-KEPT]:
        folder = files.read(f"{path}/{old}").decode()
        files.drop(f"{path}/{old}")
        files.drop(f"{path}/{folder}")
    return f"{path}/{name}"


def current(spark: SparkSession, path: str) -> str:
    """Folder of the current version; ``path`` itself if it isn't versioned."""
    path = path.rstrip("/")
    files = Files(spark, path)
    there = _manifests(files, path)
    return f"{path}/{files.read(f'{path}/{there[-1]}').decode()}" if there else path
