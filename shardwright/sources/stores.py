"""File stores that Python workers open by themselves, without the JVM: local folders and every store of ``pyarrow.fs``.

A path with a scheme names its store (``file:``, ``hdfs:``, ``s3:``, ``gs:``, ...);
one without is local.  For stores that ``pyarrow.fs`` does not know by scheme a
caller names its own opener as ``module:function``; it is called with the path
and returns ``(pyarrow file system, path inside it)``.
"""

from __future__ import annotations

import fnmatch
import importlib
import re
from dataclasses import dataclass

from pyarrow import fs


@dataclass(frozen=True)
class StoredFile:
    path: str  # as the opener takes it
    size: int


def open_store(path: str, opener: str | None = None) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path inside it."""
    if opener:
        module, name = opener.split(":")
        return getattr(importlib.import_module(module), name)(path)
    if re.match(r"file:/", path):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def matching(pattern: str, opener: str | None = None) -> list[StoredFile]:
    """Files that a glob pattern matches, in path order, with their sizes: one listing, no file is opened.

    ``*``, ``?`` and ``[...]`` match within a path component; hidden files match no pattern.
    """
    if not re.search(r"[*?\[]", pattern):
        store, inside = open_store(pattern, opener)
        info = store.get_file_info(inside)
        return [StoredFile(pattern, info.size)] if info.type == fs.FileType.File else []
    parts = pattern.split("/")
    first = next(k for k, p in enumerate(parts) if re.search(r"[*?\[]", p))
    base, wanted = "/".join(parts[:first]) or ("/" if first else "."), parts[first:]
    store, inside = open_store(base, opener)
    listed = store.get_file_info(fs.FileSelector(inside, allow_not_found=True, recursive=len(wanted) > 1))
    found = []
    for info in listed:
        names = info.path[len(inside):].strip("/").split("/") if inside != "." else info.path.removeprefix("./").split("/")
        if info.type == fs.FileType.File and len(names) == len(wanted) and all(
                fnmatch.fnmatchcase(n, w) and not n.startswith(".") for n, w in zip(names, wanted)):
            found.append(StoredFile("/".join([base.rstrip("/"), *names]), info.size))
    return sorted(found, key=lambda f: f.path)


def read_range(path: str, start: int, n_bytes: int, opener: str | None = None) -> bytes:
    """Bytes of a file from ``start`` on, at most ``n_bytes``."""
    store, inside = open_store(path, opener)
    with store.open_input_file(inside) as f:
        return f.read_at(n_bytes, start)
