"""Files that tasks write themselves, for formats Spark has no writer for."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse


def write_file(folder: str, name: str, content: bytes) -> str:
    """``content`` under ``folder``/``name``, whole or not at all.

    A repeated or concurrent attempt of a task writes the same bytes under the same name. Folders are local paths or
    file: URIs of a shared mount, else anything that pyarrow opens (hdfs, s3, gs; s3a is taken as s3).
    """
    parsed = urlparse(folder)
    if parsed.scheme in ("", "file"):
        path = parsed.path if parsed.scheme else folder
        os.makedirs(path, exist_ok=True)
        draft = f"{path}/.{name}.{uuid.uuid4().hex}"
        with open(draft, "wb") as out:
            out.write(content)
        os.replace(draft, f"{path}/{name}")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{name}") as out:
            out.write(content)
    return name


def _opened(folder: str, name: str):
    """Store and path of a file."""
    from pyarrow import fs

    parsed = urlparse(folder)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), f"{parsed.path if parsed.scheme else folder}/{name}"
    store, path = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
    return store, f"{path}/{name}"


def read_file(folder: str, name: str) -> bytes:
    """What :func:`write_file` wrote."""
    store, path = _opened(folder, name)
    with store.open_input_stream(path) as content:
        return content.read()


def delete_file(folder: str, name: str) -> None:
    """Removes a file of :func:`write_file` that no other task reads."""
    store, path = _opened(folder, name)
    store.delete_file(path)
