"""Binary files in the shared folder, by any file system that Arrow knows."""

from __future__ import annotations

import numpy as np
from pyarrow import fs as afs


def at(uri: str) -> tuple[afs.FileSystem, str]:
    """File system and path of a URI or of a plain path."""
    if uri.startswith("file:"):
        return afs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return afs.FileSystem.from_uri(uri) if "://" in uri else (afs.LocalFileSystem(), uri)


def create(uri: str, buffer: int = 1 << 20):
    """A new file to write to; its folder is made if need be."""
    system, path = at(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None, buffer_size=buffer)


def put(uri: str, data) -> None:
    with create(uri) as out:
        out.write(data)


def move(uri: str, to: str) -> None:
    """Give a whole file its name. If an earlier attempt of the task has done so, its equal file stays."""
    (system, path), target = at(uri), at(to)[1]
    try:
        system.move(path, target)
    except OSError:
        if system.get_file_info(target).type == afs.FileType.NotFound:
            raise
        system.delete_file(path)


def array(uri: str, dtype: str) -> np.ndarray:
    """A flat file as an array: memory-mapped on a local file system, else read."""
    system, path = at(uri)
    if isinstance(system, afs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if system.get_file_info(path).size else np.zeros(0, dtype)
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)
