"""Files that executors write to and read from shared storage, by URI.

Writers put an id of their attempt into a file's name and report the name by a committed table, so that a repeated or late task
never touches a file that others know of.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def attempt() -> str:
    return uuid.uuid4().hex[:16]


def make_folder(uri: str) -> None:
    store, path = _at(uri)
    store.create_dir(path, recursive=True)


def write_file(uri: str, data) -> None:
    store, path = _at(uri)
    with store.open_output_stream(path, compression=None) as f:
        f.write(data)


def open_file(uri: str) -> pa.NativeFile:
    """A file to read parts of."""
    store, path = _at(uri)
    return store.open_input_file(path)


def read_file(uri: str) -> bytes:
    with open_file(uri) as f:
        return f.read()
