"""Byte files in the shared folder, local or in any store that pyarrow knows by its URI."""

from __future__ import annotations

import os
from urllib.parse import urlsplit

import numpy as np


def _local(path: str) -> str | None:
    parts = urlsplit(path)
    return parts.path if parts.scheme in ("", "file") else None


def write_bytes(path: str, chunks) -> None:
    """Writes the chunks; a reader never sees half a local file."""
    local = _local(path)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local + ".tmp", "wb") as out:
            for chunk in chunks:
                out.write(chunk)
        os.replace(local + ".tmp", local)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(inner), recursive=True)
    with store.open_output_stream(inner) as out:
        for chunk in chunks:
            out.write(chunk)


class Remote:
    """The numbers of a file in a store that is no folder; a slice reads its own bytes alone."""

    def __init__(self, path: str, dtype):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        self.file, self.dtype = store.open_input_file(inner), np.dtype(dtype)
        self.size = self.file.size() // self.dtype.itemsize

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> np.ndarray:
        lo, hi, _ = part.indices(self.size)
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at(max(0, hi - lo) * width, lo * width), self.dtype)


def map_array(path: str, dtype) -> np.ndarray | Remote:
    """The file's numbers, to be taken by slices: mapped into memory where it is local, else read by ranges."""
    local = _local(path)
    if local is None:
        return Remote(path, dtype)
    if os.path.getsize(local) == 0:
        return np.empty(0, dtype)
    return np.memmap(local, dtype, "r")
