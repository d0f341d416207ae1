"""Byte files in the shared folder, written and read by tasks."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyarrow import fs


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs ...) or a plain path."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@contextmanager
def created(folder: str, name: str):
    """A file that appears under its name only when it is complete.

    Each attempt of a task writes under a name of its own, so a repeated or speculative attempt never
    touches what another has written. Yields the stream and the path.
    """
    store, root = _at(folder)
    store.create_dir(root, recursive=True)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(f"{path}.part") as out:
        yield out, f"{folder}/{os.path.basename(path)}"
    store.move(f"{path}.part", path)


def opened(path: str):
    """A readable stream of a file."""
    store, root = _at(path)
    return store.open_input_stream(root, compression=None)


def seekable(path: str):
    """A file for reading at any place."""
    store, root = _at(path)
    return store.open_input_file(root)
