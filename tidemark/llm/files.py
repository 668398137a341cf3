"""Files that tasks write and read themselves, in the folder that all executors share.

A task writes under a name that no other attempt uses and returns a row with that name. The
rows, written as Parquet by Spark, are the manifest: files of lost or repeated attempts are in
no manifest and are never read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that holds ``path``, a plain absolute path or a URI, and the path within it."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path)


def attempt_name(folder: str, suffix: str) -> str:
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


def create(path: str):
    """A new file, written as a stream. Its folder is made if need be."""
    system, inner = filesystem(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inner, compression=None)


def open_random(path: str):
    system, inner = filesystem(path)
    return system.open_input_file(inner)
