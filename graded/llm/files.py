"""Files in the shared folder, written from tasks under temporary names.

A task writes a file under a name of its own and renames it when it is whole,
so a file with its final name is always complete, and a task that runs again
(or twice at once) replaces a file by one with the same bytes.
"""

from __future__ import annotations

import re
import uuid

import pyarrow.fs as pafs


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and its path there. Hadoop's names of an
    object store (``s3a``, ``s3n``) are the store's own (``s3``)."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", folder))


def put_file(folder: str, name: str, parts: list[bytes]) -> None:
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary, compression=None) as out:
        for part in parts:
            out.write(part)
    fs.move(temporary, f"{path}/{name}")


def get_file(folder: str, name: str) -> bytes:
    fs, path = file_system(folder)
    with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
        return f.read()
