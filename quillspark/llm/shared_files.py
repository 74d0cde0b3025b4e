"""Files in the shared folder, from driver and executors."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse


def local_path(uri: str) -> str | None:
    """The path of a mounted folder, or None if another store's client is needed."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, data) -> None:
    """Write a whole file; it appears at once or not at all, so a repeated task may write it again."""
    if path := local_path(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    store, path = _store(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)


def mapped(uri: str, dtype, length: int):
    """The file as a read-only numpy array: mapped where the folder is mounted, else from an unlinked local copy."""
    import numpy as np

    if not length:
        return np.empty(0, dtype)
    if path := local_path(uri):
        return np.memmap(path, dtype, "r", shape=(length,))
    store, path = _store(uri)
    with tempfile.TemporaryFile() as copy, store.open_input_stream(path) as f:
        while chunk := f.read(1 << 24):
            copy.write(chunk)
        copy.flush()
        return np.memmap(copy, dtype, "r", shape=(length,))


def size_of(uri: str) -> int:
    if path := local_path(uri):
        return os.path.getsize(path)
    store, path = _store(uri)
    return store.get_file_info(path).size
