"""Binary files in any store that pyarrow knows (local, HDFS, S3, GCS)."""

from __future__ import annotations

import io
import posixpath

from pyarrow import fs

READ_AHEAD = 1 << 20


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path in it."""
    if uri.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def create(uri: str):
    store, path = store_of(uri)
    store.create_dir(posixpath.dirname(path), recursive=True)
    return store.open_output_stream(path, compression=None)


def open_file(uri: str):
    store, path = store_of(uri)
    return store.open_input_file(path)


def open_ahead(uri: str, ahead: int = READ_AHEAD) -> io.BufferedReader:
    """A file that is read in order in small parts; the store is asked for ``ahead`` bytes at a time."""
    return io.BufferedReader(open_file(uri), ahead)


def exists(uri: str) -> bool:
    store, path = store_of(uri)
    return store.get_file_info(path).type == fs.FileType.File


def delete(uri: str) -> None:
    """Delete a file or a folder with all that is in it, if it is there."""
    store, path = store_of(uri)
    kind = store.get_file_info(path).type
    if kind == fs.FileType.Directory:
        store.delete_dir(path)
    elif kind == fs.FileType.File:
        store.delete_file(path)


def size_of(uri: str) -> int:
    store, path = store_of(uri)
    info = store.get_file_info(path)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(uri)
    return info.size


def list_files(uri: str, suffix: str) -> list[str]:
    """The file itself, or all files of a folder that end in ``suffix``, sorted."""
    store, path = store_of(uri)
    if store.get_file_info(path).type != fs.FileType.Directory:
        return [uri]
    found = store.get_file_info(fs.FileSelector(path, recursive=True))
    head = uri[: len(uri) - len(path.rstrip("/"))] if uri.rstrip("/").endswith(path.rstrip("/")) else ""
    return sorted(head + f.path for f in found if f.is_file and f.path.endswith(suffix))
