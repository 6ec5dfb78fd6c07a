"""Plain binary files in shared storage, written and read by executors.

Paths are URIs; pyarrow's file systems open them, so the same code serves a mounted folder and an
object or HDFS store.  A file is written under a temporary name and moved into place, so that a task that
is retried, or run twice, leaves one whole file.
"""

from __future__ import annotations

import os
import uuid

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, parts) -> int:
    """Write the byte strings ``parts`` one after another; returns the file's length."""
    store, path = filesystem(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    length = 0
    with store.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
            length += len(part)
    store.move(draft, path)
    return length


def open_file(uri: str):
    """A random-access input file with read, read_at, seek and size."""
    store, path = filesystem(uri)
    return store.open_input_file(path)
