"""Files that tasks write to and read from the shared folder, by any scheme pyarrow knows."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def open_new(folder: str, prefix: str) -> tuple[str, object]:
    """A new output stream under a name no other task attempt has: a retried or speculative
    attempt never touches the file of another, and only names that a finished task reports count."""
    uri = f"{folder}/{prefix}-{uuid.uuid4().hex}"
    system, path = locate(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return uri, system.open_output_stream(path, compression=None, buffer_size=1 << 20)


def open_read(uri: str):
    system, path = locate(uri)
    return system.open_input_file(path)
