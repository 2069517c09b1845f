"""Sorted arrays in the shared folder: a bounded number of files, written by parts, memory-mapped by any worker.

The hash space is cut into files, a bounded number however large the corpus is, and each file into parts of
bounded size. One task writes a file, part after part, so it holds one part at a time; parts are in hash
order, so a file is one sorted array and needs no index. A task writes under a name of its own attempt and
renames, so a repeated attempt replaces equal content. A shared file system is mapped in place; another
store's file is copied to the worker's temporary folder first, and the copy is unlinked once mapped. A worker
keeps the maps it used last.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np

# Most files an array is cut into, and most maps a worker keeps.
MOST_FILES, MOST_MAPS = 2048, 8192
_OPEN: OrderedDict[str, np.ndarray] = OrderedDict()


@dataclass(frozen=True)
class Parts:
    """``files`` ranges of the hash, each of ``subs`` parts."""

    files: int
    subs: int

    @property
    def total(self) -> int:
        return self.files * self.subs

    def part_of(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(self.total) >> np.uint64(32)).astype(np.int64)

    def file_of(self, hashes: np.ndarray) -> np.ndarray:
        return self.part_of(hashes) // self.subs

    def files_in(self, sorted_hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(file, from, to) of the files that sorted hashes fall into."""
        yield from runs_of(self.file_of(sorted_hashes))


def parts_for(size: int, part_size: int, least: int = 4) -> Parts:
    wanted = max(least, -(-size // part_size))
    files = min(wanted, MOST_FILES)
    return Parts(files, -(-wanted // files))


def runs_of(ascending: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of each value of an ascending array."""
    if len(ascending):
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(ascending)) + 1, [len(ascending)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield int(ascending[a]), a, b


def _local(uri: str) -> str | None:
    found = urlparse(uri)
    return found.path if found.scheme in ("", "file") else None


@contextmanager
def writing(folder: str, names: list[str]) -> Iterator[list]:
    """Functions that append arrays to the files ``names``, which appear whole or not at all."""
    own = uuid.uuid4().hex
    if _local(folder):
        os.makedirs(_local(folder), exist_ok=True)
        ends = [f"{_local(folder)}/{name}" for name in names]
        open_, move = lambda path: open(path, "wb"), os.replace
    else:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        ends = [f"{base}/{name}" for name in names]
        open_, move = store.open_output_stream, store.move
    outs = [open_(f"{path}.{own}") for path in ends]
    append = lambda out: lambda values: out.write(memoryview(np.ascontiguousarray(values)).cast("B")) if values.size else None
    try:
        yield [append(out) for out in outs]
    finally:
        for out in outs:
            out.close()
    for path in ends:
        move(f"{path}.{own}", path)


def put(folder: str, name: str, values: np.ndarray) -> None:
    with writing(folder, [name]) as (out,):
        out(values)


def fill(folder: str, names: list[str], files: int, made: set[int]) -> None:
    """Empty arrays for the files that no task has made: a bounded number."""
    for f in set(range(files)) - made:
        with writing(folder, [f"{name}-{f}" for name in names]):
            pass


def get(folder: str, name: str, dtype: str) -> np.ndarray:
    """The array, mapped."""
    uri = f"{folder}/{name}"
    if uri in _OPEN:
        _OPEN.move_to_end(uri)
        return _OPEN[uri]
    while len(_OPEN) >= MOST_MAPS:
        _OPEN.popitem(last=False)
    if (path := _local(uri)) is None:
        from pyarrow import fs

        store, far = fs.FileSystem.from_uri(uri)
        handle, path = tempfile.mkstemp()
        with store.open_input_stream(far) as source, os.fdopen(handle, "wb") as out:
            while piece := source.read(1 << 22):
                out.write(piece)
        found = np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype=dtype)
        os.unlink(path)
    else:
        found = np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype=dtype)
    _OPEN[uri] = found
    return found


def find(sorted_hashes: np.ndarray, folder: str, name: str, parts: Parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(file, place, found) of each of the sorted hashes in the sorted array ``name``."""
    file, place, hit = np.zeros(len(sorted_hashes), np.int64), np.zeros(len(sorted_hashes), np.int64), np.zeros(len(sorted_hashes), bool)
    for f, a, b in parts.files_in(sorted_hashes):
        keys = get(folder, f"{name}-{f}", "<u8")
        if len(keys):
            at = np.minimum(np.searchsorted(keys, sorted_hashes[a:b]), len(keys) - 1)
            file[a:b], place[a:b], hit[a:b] = f, at, keys[at] == sorted_hashes[a:b]
    return file, place, hit
