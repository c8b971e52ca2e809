"""Sorted arrays as files of the shared folder, which workers map into memory."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np


def _local(folder: str) -> str | None:
    u = urlparse(folder)
    return unquote(u.path) if u.scheme in ("", "file") else None


def put(folder: str, name: str, array: np.ndarray) -> None:
    """Writes an array whole or not at all; a task that runs again writes the same."""
    if path := _local(folder):
        os.makedirs(path, exist_ok=True)
        part = f"{path}/.{name}-{uuid.uuid4().hex}"
        array.tofile(part)
        os.replace(part, f"{path}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    with store.open_output_stream(f"{path}/{name}") as f:
        f.write(array.tobytes())


@lru_cache(16_000)
def get(folder: str, name: str, kind: str) -> np.ndarray:
    """An array of the shared folder, mapped into memory; empty if there is none.

    From a remote store a worker maps a copy of its own, whose name is gone as
    soon as it is mapped, so that nothing of it outlives the worker.
    """
    path = _local(folder)
    if path is None:
        from pyarrow import fs

        store, remote = fs.FileSystem.from_uri(folder)
        if store.get_file_info(f"{remote}/{name}").type == fs.FileType.NotFound:
            return np.zeros(0, kind)
        with store.open_input_stream(f"{remote}/{name}") as src, tempfile.TemporaryFile() as out:
            while part := src.read(1 << 24):
                out.write(part)
            out.flush()
            return np.memmap(out, kind, "r") if out.tell() else np.zeros(0, kind)
    if not os.path.exists(f"{path}/{name}") or not os.path.getsize(f"{path}/{name}"):
        return np.zeros(0, kind)
    return np.memmap(f"{path}/{name}", kind, "r")


def put_counts(folder: str, name: str, counts: np.ndarray) -> None:
    """Writes counts in as few bytes each as the largest needs."""
    put(folder, name, counts.astype(np.min_scalar_type(int(counts.max(initial=0)))))


def get_counts(folder: str, name: str, n: int) -> np.ndarray:
    """n counts, of whatever width they were written in."""
    raw = get(folder, name, "u1")
    return raw.view(f"u{len(raw) // n}") if n else raw
