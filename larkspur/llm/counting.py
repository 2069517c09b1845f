"""Counts of 64-bit keys as sorted arrays: packed by tasks for each file, divided into parts and merged in the file's task.

A task sends at most a row per file, whatever the size of the corpus. The task that gathers a file divides
its rows into parts as they come, lets Spark sort them by part (spilling where it must), and merges part
after part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PACKED = "file int, sub int, once binary, more binary, times binary"
# Keys that a task holds before it sends them.
GATHERED = 3_000_000
# Bytes of a batch between Spark and a worker: rows hold up to GATHERED keys, so their number alone bounds nothing.
BATCH_BYTES = 8 << 20


def _rows(found: np.ndarray, counts: np.ndarray, runs: Iterator[tuple[int, int, int]], place: Callable[[int], tuple[int, int]]) -> pd.DataFrame:
    rows = []
    for value, a, b in runs:
        part, times = found[a:b], counts[a:b]
        again = times > 1
        rows.append((*place(value), part[~again].tobytes(), part[again].tobytes(), times[again].astype("<u4").tobytes()))
    return pd.DataFrame(rows, columns=["file", "sub", "once", "more", "times"])


def bounded(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """``pdf`` in pieces of about BATCH_BYTES of its binary columns: what a worker yields goes to Spark as one batch."""
    sizes = sum((pdf[c].str.len() for c in ("once", "more", "times")), pd.Series(0, index=pdf.index)).to_numpy(np.int64)
    place = (np.cumsum(sizes) - sizes) // BATCH_BYTES
    for at in np.unique(place):
        yield pdf[place == at]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each is there; ``keys`` is sorted in place."""
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(first, append=len(keys))


def pack(keys: list[np.ndarray], files_in: Callable[[np.ndarray], Iterator[tuple[int, int, int]]]) -> Iterator[pd.DataFrame]:
    """A row per file that has keys: those seen once, and the others with their counts. ``files_in``: (file, from, to) of
    sorted keys. ``keys`` is emptied."""
    flat = np.concatenate(keys)
    keys.clear()
    found, counts = _counted(flat)
    del flat
    yield from bounded(_rows(found, counts, files_in(found), lambda f: (f, 0)))


def merge(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of packed rows, and their counts. ``rows`` is emptied: a file's rows and their merge need not stand side by side."""
    again = np.concatenate([np.frombuffer(r.more, "<u8") for r in rows])
    times = np.concatenate([np.frombuffer(r.times, "<u4") for r in rows])
    flat = np.concatenate([again, *[np.frombuffer(r.once, "<u8") for r in rows]])
    rows.clear()
    keys, counts = _counted(flat)
    # Each row of a key counted one already.
    np.add.at(counts, np.searchsorted(keys, again), times.astype(np.int64) - 1)
    return keys, counts


def held_rows(rows: Iterator, size: Callable, most: int) -> Iterator[list]:
    """Rows in groups of about ``most`` in size."""
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size(r)
        if total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held


def streamed(batches: Iterator[pd.DataFrame]) -> Iterator:
    return (r for pdf in batches for r in pdf.itertuples(index=False))


def by_file(packed: DataFrame, files: int, subs: int, subs_in: Callable, use: Callable, schema: str) -> DataFrame:
    """``use(file, parts)`` for each file; ``parts`` gives (sub, sorted keys, counts) of all its parts in turn, empty ones too.

    ``use`` yields data frames. ``subs_in(file, keys)``: (sub, from, to) of a file's sorted keys. The session's
    batches are of BATCH_BYTES from here on, which changes no result.
    """
    packed.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def divide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, rows in groupby(streamed(batches), key=lambda r: r.file):
            for some in held_rows(rows, lambda r: (len(r.once) + len(r.more)) // 8, GATHERED):
                keys, counts = merge(some)
                yield from bounded(_rows(keys, counts, subs_in(f, keys), lambda s, f=f: (f, s)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.empty(0, "<u8"), np.empty(0, np.int64)

        def every(rows: Iterator) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            at = 0
            for sub, some in groupby(rows, key=lambda r: r.sub):
                for s in range(at, sub):
                    yield (s, *none)
                yield (sub, *merge(list(some)))
                at = sub + 1
            for s in range(at, subs):
                yield (s, *none)

        for f, rows in groupby(streamed(batches), key=lambda r: r.file):
            parts = every(rows)
            yield from use(f, parts)

    dealt = packed.repartition(files, "file")
    if subs > 1:
        dealt = dealt.sortWithinPartitions("file").mapInPandas(divide, PACKED)
    return dealt.sortWithinPartitions("file", "sub").mapInPandas(run, schema)
