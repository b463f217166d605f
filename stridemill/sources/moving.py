"""Renaming files inside tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyarrow import fs


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of an unescaped address, and the path within it."""
    scheme, authority, path = re.fullmatch(r"([a-z0-9+.-]+):(?://([^/]*))?(/.*)", uri).groups()
    if scheme == "file":
        return fs.LocalFileSystem(), path
    store, root = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return store, root.rstrip("/") + path


def reachable(uri: str) -> bool:
    """Whether Arrow opens the folder; if here, then in every task with the same installation."""
    try:
        store, path = _opened(uri)
        return store.get_file_info(path).type == fs.FileType.Directory
    except (OSError, ValueError, AttributeError):
        return False


def mover(root: str, archive: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Renames from below ``root`` to the same place below ``archive``, of one file a row.

    ``path`` is the escaped address of a stream's log.  A file that is already there and no
    longer here counts as moved; one that is in neither place, or not below ``root``, does not.
    """
    def present(store: fs.FileSystem, path: str) -> bool:
        return store.get_file_info(path).type == fs.FileType.File

    def move(uri: str) -> bool:
        store, base = _opened(root)
        path = _opened(unquote(uri))[1]
        if not path.startswith(f"{base}/"):
            return False
        there = f"{_opened(archive)[1]}/{path[len(base) + 1:]}"
        if not present(store, path):
            return present(store, there)
        store.create_dir(there.rsplit("/", 1)[0], recursive=True)
        folder, name = path.rsplit("/", 1)
        sums, beside = f"{folder}/.{name}.crc", f"{there.rsplit('/', 1)[0]}/.{name}.crc"
        if present(store, sums):  # Hadoop's checksum of a local file goes along
            store.move(sums, beside)
        store.move(path, there)
        return True

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(moved=[move(uri) for uri in frame["path"]])
    return run
